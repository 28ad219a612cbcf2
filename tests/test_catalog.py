"""Every named query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from compare import compare

FOLDER = "/root/testdata/sf0.001"
SLOW = {"grouped_predictions", "latest_predictions", "learned_report",  # covered by test_learning
        "stream_profiles_batches"}  # as stream_lift_state_batches


@pytest.fixture(scope="module")
def con():
    if not Path(FOLDER).exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for path in sorted(Path(FOLDER).glob("*.parquet")):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", [n for n in spark_entry.queries() if n not in SLOW])
def test_query(spark, con, name):
    verdict = compare(spark, con, FOLDER, name)
    assert verdict.startswith(("equal", "rows only")), verdict


def test_entry(spark, con):
    assert spark_entry.entry(spark).count() == 12


def test_names_match():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
