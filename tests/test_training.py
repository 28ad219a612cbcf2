import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from setledger.operators import evaluation, rules
from setledger.operators.labels import chronological_split, next_weight
from setledger.operators.sessions import coerce_sets, collapse_sessions, valid_sets

DAY = dt.datetime(2024, 1, 1)
SETS = "set_ts timestamp_ntz, exercise string, set_order int, weight double, reps double"


def collapsed(rows, *sets):
    df = rows(SETS, *[(DAY, "Squat", i, float(w), float(r)) for i, (w, r) in enumerate(sets)])
    got = collapse_sessions(valid_sets(df)).collect()
    return [(r.weight, r.sets, r.reps) for r in got]


@pytest.mark.parametrize("sets, expected", [
    ([(100, 5), (100, 5), (110, 4), (110, 3)], [(110.0, 2, 4)]),          # tie: heaviest; 3.5 goes to even
    ([(0, 8), (0, 9)], [(0.0, 2, 8)]),                                    # unloaded, 8.5 goes to even
    ([(50, 9), (60, 5), (50, 10), (50, 2)], [(50.0, 3, 9)]),
    ([(0, 8), (0, 8), (0, 8), (20, 5)], [(20.0, 1, 5)]),                  # any positive weight wins
    ([(-10, 8), (-20, 5)], [(0.0, 2, 6)]),                                # only negative: every set counts
    ([(-10, 8), (0, 5)], [(0.0, 1, 5)]),
    ([(0, 0)], []),                                                       # no load, no repetitions
    ([(33.335, 0)], [(33.34, 1, 0)]),
])
def test_collapse(rows, sets, expected):
    assert collapsed(rows, *sets) == expected


def test_collapse_against_pandas(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"set_ts": [DAY + dt.timedelta(days=int(d)) for d in rng.integers(0, 20, n)],
                        "exercise": rng.choice(["A", "B", "C"], n), "set_order": 1,
                        "weight": rng.choice([0.0, 20.0, 22.5, 25.0], n), "reps": rng.integers(0, 12, n).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("set_ts", F.col("set_ts").cast("timestamp_ntz"))
    got = {(r.logged_at, r.exercise): (r.weight, r.sets, r.reps) for r in collapse_sessions(valid_sets(df)).collect()}
    want = {}
    for (ts, ex), g in pdf[(pdf.weight > 0) | (pdf.reps > 0)].groupby(["set_ts", "exercise"]):
        pos = g[g.weight > 0].weight.value_counts()
        w = max(pos[pos == pos.max()].index) if len(pos) else 0.0
        at = g[g.weight == w]
        want[(ts.to_pydatetime(), ex)] = (w, len(at), int(round(at.reps.median())))
    assert got == want


def test_text_log_is_coerced(rows):
    raw = rows("`Date` string, `Exercise Name` string, `Set Order` string, `Weight` string, `Reps` string",
               ("2024-01-01 10:00:00", " Squat ", "1.9", "5d", "3"), ("01/02/2024", "Squat", "1", "5", "3"),
               ("2024-01-01 10:00:00", None, "1", "5", "3"), ("2024-01-01 10:00:00", "Row", "x", "n", None))
    got = valid_sets(coerce_sets(raw)).collect()
    assert [(r.exercise, r.set_order, r.weight, r.reps) for r in got] == [("Squat", 1, 0.0, 3.0)]


WORKOUT = "exercise string, weight double, date date, logged_at timestamp_ntz, row_id int"


def test_next_weight_orders_by_date_first(rows):
    df = rows(WORKOUT, ("A", 1.0, DAY.date(), DAY + dt.timedelta(days=5), 0),
              ("A", 2.125, DAY.date() + dt.timedelta(days=1), DAY, 1), ("A", 3.0, None, None, 2), (None, 9.0, DAY.date(), DAY, 3))
    got = {r.row_id: r.actual_next_weight for r in next_weight(df).collect()}
    assert got == {0: 2.12, 1: 3.0}


@pytest.mark.parametrize("ratio", [0.0, 0.29, 0.8, 1.0])
@pytest.mark.parametrize("days", [1, 7])
def test_split_sizes_and_order(spark, ratio, days):
    rng = np.random.default_rng(3)
    data = [(DAY + dt.timedelta(days=int(rng.integers(days)), hours=int(rng.integers(3))) if i % 17 else None, i) for i in range(101)]
    df = spark.createDataFrame(data, "logged_at timestamp_ntz, row_id int")
    got = chronological_split(df, ratio, ["logged_at", "row_id"]).collect()
    ordered = sorted(data, key=lambda x: (x[0] is None, x[0] or DAY, x[1]))
    train = {i for _, i in ordered[:int(len(data) * ratio)]}
    assert {r.row_id for r in got if r.dataset == "train"} == train and len(got) == 101


RULE = "exercise string, sets int, reps int, weight double, rpe double, rir double"


@pytest.mark.parametrize("row, increment, predicted, factors", [
    (("Face pull", 3, 5, 50.0, None, 3.0), 3.12, 53.12, ["base increment inferred as 2.5", "rir=3.0", "high reps in reserve", "increment applied=3.12"]),
    (("Chin Up", 3, 5, 20.0, None, None), 2.5, 22.5, ["base increment inferred as 2.5", "missing RPE/RIR, using reps/sets fallback", "standard completed session", "increment applied=2.5"]),
    (("Squat", 3, 5, 224.9, None, 2.0), 5.0, 229.9, ["base increment inferred as 5.0", "rir=2.0", "increment applied=5.0"]),
    (("Squat", 3, 5, 225.0, 9.5, None), 0.0, 225.0, ["base increment inferred as 10.0", "rpe=9.5", "very high effort", "increment applied=0.0"]),
    (("Squat", 3, 5, 225.0, 6.0, 0.0), 0.0, 225.0, ["base increment inferred as 10.0", "rir=0.0", "no reps in reserve", "increment applied=0.0"]),
    (("Bench", 3, 5, 135.0, None, 1.0), 2.5, 137.5, ["base increment inferred as 5.0", "rir=1.0", "one rep in reserve", "increment applied=2.5"]),
    (("Bench", 3, 5, 134.0, 8.5, None), 1.25, 135.25, ["base increment inferred as 2.5", "rpe=8.5", "hard effort", "increment applied=1.25"]),
    (("Bench", 3, 5, 134.0, 7.0, None), 3.12, 137.12, ["base increment inferred as 2.5", "rpe=7.0", "lower effort", "increment applied=3.12"]),
    (("Bench", 3, 5, 134.0, 8.0, 0.5), 2.5, 136.5, ["base increment inferred as 2.5", "rir=0.5", "increment applied=2.5"]),
    (("Curl", 2, 3, 30.0, None, None), 1.25, 31.25, ["base increment inferred as 2.5", "missing RPE/RIR, using reps/sets fallback", "low-rep low-set session", "increment applied=1.25"]),
    (("Curl", 3, 10, 30.0, float("nan"), None), 2.5, 32.5, ["base increment inferred as 2.5", "missing RPE/RIR, using reps/sets fallback", "higher-rep session completed", "increment applied=2.5"]),
    (("Plank", 3, 10, 0.0, 10.0, None), 0.0, 0.0, ["no external load logged", "bodyweight or unloaded movement"]),
])
def test_rule(rows, row, increment, predicted, factors):
    r = rules.predict_by_rule(rows(RULE, row)).first()
    assert (r.recommended_increment, r.predicted_next_weight, r.top_factors) == (increment, predicted, factors)
    assert r.reason and r.model_type == rules.MODEL_TYPE


SCORES = "exercise string, actual_next_weight double, predicted_next_weight double"


def test_metrics(rows):
    scored = evaluation.error_columns(rows(SCORES, ("A", 100.0, 102.5), ("A", 100.0, 95.0), ("B", 50.0, 61.0), (None, 1.0, 1.0)))
    m = evaluation.overall_metrics(scored).first()
    assert (m.rows_evaluated, m.mae, m.mse, m.mean_signed_error) == (4.0, 4.625, 38.062, 2.125)
    assert (m.within_2_5_lb_accuracy, m.within_5_lb_accuracy, m.within_10_lb_accuracy) == (0.5, 0.75, 0.75)
    assert abs(m.mse - m.rmse ** 2) < 0.02
    per = evaluation.per_exercise_metrics(scored).collect()
    assert [(r.exercise, r.samples, r.mae) for r in per] == [("A", 2, 3.75), ("B", 1, 11.0)]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(2)
    errors = rng.normal(size=500)
    df = spark.createDataFrame([("A", 0.0, float(e)) for e in errors], SCORES)
    got = {r.bin: r.n for r in evaluation.error_histogram(evaluation.error_columns(df)).collect()}
    want, _ = np.histogram(errors, bins=30)
    assert got == {i: int(n) for i, n in enumerate(want) if n}


def test_histogram_of_one_value(rows):
    df = rows(SCORES, ("A", 1.0, 3.0), ("A", 1.0, 3.0))
    assert [(r.bin, r.n) for r in evaluation.error_histogram(evaluation.error_columns(df)).collect()] == [(15, 2)]


def test_split_is_found_once(spark):
    """Who reads a part compares rows with a stored one: no day is ranked again."""
    df = spark.createDataFrame([(DAY + dt.timedelta(hours=i), i) for i in range(50)], "logged_at timestamp_ntz, row_id int")
    train = chronological_split(df, 0.8, ["logged_at", "row_id"]).filter("dataset = 'train'")
    assert "row_number" not in train._jdf.queryExecution().optimizedPlan().toString() and train.count() == 40
