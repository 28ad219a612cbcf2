"""Sliced windows must equal plain windows, whatever the skew."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from setledger.operators.ordering import ranked, with_neighbours


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else f"k{rng.integers(40)}"
        when = None if rng.random() < 0.05 else int(rng.integers(30))  # many ties, some missing
        data.append((key if rng.random() > 0.02 else None, when, i, float(rng.integers(100))))
    return spark.createDataFrame(data, "k string, t int, id int, x double").cache()


def plain(keys):
    return W.partitionBy(*keys).orderBy(F.col("t").asc_nulls_last(), F.col("id").asc_nulls_last())


@pytest.mark.parametrize("bound", [10, 100, 10_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks(skewed, keys, bound):
    got = ranked(skewed, keys, ["t", "id"], "n", bound)
    want = skewed.withColumn("n", F.row_number().over(plain(keys)).cast("bigint"))
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


@pytest.mark.parametrize("bound", [1, 7, 100])
def test_neighbours(skewed, bound):
    def add(df, w):
        frame = w.rowsBetween(-3, -1)
        return (df.withColumn("p1", F.lag("x", 1).over(w)).withColumn("p3", F.lag("x", 3).over(w))
                .withColumn("avg", F.avg("x").over(frame)).withColumn("cnt", F.count("*").over(frame))
                .withColumn("next", F.lead("x", 1).over(w)))
    got = with_neighbours(skewed, ["k"], ["t", "id"], add, before=3, after=1, rows_per_task=bound)
    want = add(skewed, plain(["k"]))
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_slices_smaller_than_the_frame(spark):
    """One row per slice: a row's three predecessors sit in three slices."""
    df = spark.createDataFrame([("a", i, i, float(i)) for i in range(12)], "k string, t int, id int, x double")
    got = with_neighbours(df, ["k"], ["t", "id"], lambda d, w: d.withColumn("p3", F.lag("x", 3).over(w)), before=3,
                          rows_per_task=1)
    assert {r.id: r.p3 for r in got.collect()} == {i: (float(i - 3) if i >= 3 else None) for i in range(12)}


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t int, id int, x double")
    assert ranked(df, ["k"], ["t", "id"], "n").count() == 0
