import datetime as dt

import pytest

from setledger.operators.activity import daily_quota
from setledger.sources.files import numbered
from setledger.streaming import jobs, quota
from setledger.streaming.state import FoldedState

DAY = dt.datetime(2024, 1, 1)


def feed(spark, folder, schema, batches):
    """Each batch as one file, read one file at a time in order."""
    for i, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(f"{folder}/{i}")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False)
            .option("recursiveFileLookup", True).json(folder))


def test_quota_over_batches_equals_batch(spark, tmp_path):
    data = [(i, i % 3, DAY + dt.timedelta(hours=i)) for i in range(60)]
    stream = feed(spark, str(tmp_path / "in"), "event_id int, user_id int, ts timestamp_ntz", [data[:10], data[10:30], data[30:]])
    jobs.run_available(stream, jobs.quota_sink(str(tmp_path / "out"), 2), str(tmp_path / "cp"))
    whole = daily_quota(spark.createDataFrame(data, "event_id int, user_id int, ts timestamp_ntz"), 2)
    want = {(r.event_id, r.used) for r in whole.filter("allowed").collect()}
    accepted = spark.read.parquet(str(tmp_path / "out/accepted"))
    assert accepted.select("batch_id").distinct().count() == 3
    assert {(r.event_id, r.used) for r in accepted.collect()} == want
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 60 - len(want)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(i, 1, DAY) for i in range(5)], "event_id int, user_id int, ts timestamp_ntz")
    sink = jobs.quota_sink(str(tmp_path / "out"), 3)
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == 3


def test_lift_state_and_predictions(spark, tmp_path):
    schema = ("row_id bigint, user_id bigint, exercise string, sets int, reps int, weight double, date date, rpe double, rir double, logged_at timestamp_ntz")
    def row(i, h):
        return (i, 1, "Squat", 3, 5, 100.0 + i, DAY.date(), None, None, DAY + dt.timedelta(hours=h))
    stream = feed(spark, str(tmp_path / "in"), schema, [[row(0, 5)], [row(1, 3)], [row(2, 5)]])
    jobs.run_available(stream, jobs.lift_state_sink(str(tmp_path / "s")), str(tmp_path / "cp1"))
    assert [r.row_id for r in jobs.lift_state(spark, str(tmp_path / "s")).collect()] == [0]
    jobs.run_available(stream, jobs.prediction_sink(str(tmp_path / "p")), str(tmp_path / "cp2"))
    assert sorted(r.predicted_next_weight for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [105.0, 106.0, 107.0]
    live = jobs.online_predictions(stream)
    assert live.isStreaming and "predicted_next_weight" in live.columns


def test_ingest(spark, tmp_path):
    schema = "row_id int, user_id int, exercise string, sets int, reps int, weight_text string, rpe double, rir double, logged_at timestamp_ntz"
    stream = feed(spark, str(tmp_path / "in"), schema, [[(0, 1, "A", 1, 1, "5", 0.0, 0.0, DAY)], [(1, 1, " ", 1, 1, "5", 0.0, 0.0, DAY)]])
    jobs.run_available(stream, jobs.ingest_sink(str(tmp_path / "o")), str(tmp_path / "cp"))
    assert [r.row_id for r in spark.read.parquet(str(tmp_path / "o/accepted")).collect()] == [0]
    assert [(r.row_id, r.reason) for r in spark.read.parquet(str(tmp_path / "o/rejected")).collect()] == [(1, "exercise is required")]


def test_last_profile_wins(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), "user_id int, goal string, updated_at timestamp_ntz",
                  [[(1, "a", DAY), (1, "b", DAY + dt.timedelta(1))], [(2, "c", DAY), (1, "late", DAY)]])
    jobs.run_available(stream, jobs.profile_sink(str(tmp_path / "o")), str(tmp_path / "cp"))
    assert {(r.user_id, r.goal) for r in jobs.current_profiles(spark, str(tmp_path / "o")).collect()} == {(1, "b"), (2, "c")}


def test_folded_state_reads_no_more_with_every_batch(spark, tmp_path):
    folder, rows, read = str(tmp_path / "s"), [], []
    state = FoldedState(folder, jobs.last_saved, every=4)
    schema = "user_id int, goal string, updated_at timestamp_ntz"
    for batch in range(30):
        new = [(u, f"{batch}", DAY + dt.timedelta(hours=batch if batch % 3 else batch - 5)) for u in (batch % 5, 7)]
        rows += new
        frame = spark.createDataFrame(new, schema).coalesce(1)
        state.sink(frame, batch)
        if batch in (10, 11):  # the same batch again, before and at a fold
            state.sink(frame, batch)
        read.append(len(state.paths(spark)))
    assert max(read[15:]) == max(read[5:15]) <= 1 + 2 * 4
    assert max(len(numbered(spark, f"{folder}/{part}")) for part in ("delta", "snapshot", "versions")) <= 2 * 4
    want = {tuple(r) for r in jobs.last_saved(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r) for r in state.current(spark).collect()} == want


def test_fold_that_broke_off(spark, tmp_path):
    folder, schema = str(tmp_path / "s"), "user_id int, goal string, updated_at timestamp_ntz"
    state = FoldedState(folder, jobs.last_saved, every=3)
    for batch in range(5):
        state.sink(spark.createDataFrame([(batch, "a", DAY)], schema), batch)
    spark.createDataFrame([(99, "half", DAY)], schema).write.parquet(f"{folder}/snapshot/5")  # no marker
    assert state.paths(spark)[0].endswith("/snapshot/2")
    state.sink(spark.createDataFrame([(5, "a", DAY)], schema), 5)
    assert {r.user_id for r in state.current(spark).collect()} == set(range(6))
    with pytest.raises(ValueError):
        FoldedState(str(tmp_path / "none"), jobs.last_saved).current(spark)


def test_quota_state(spark, tmp_path):
    """Repeats get no second place, late prompts count for their own day, and old days leave the state."""
    at = lambda day, hour: DAY + dt.timedelta(days=day, hours=hour)
    batches = [
        [(2, 1, at(0, 2)), (1, 1, at(0, 1)), (3, 1, at(0, 3)), (1, 1, at(0, 1))],  # 1 twice in a batch
        [(1, 1, at(0, 1)), (3, 1, at(0, 3)), (4, 2, at(1, 1))],  # 1 accepted before, 3 turned away before
        [(5, 2, at(0, 5)), (6, 2, at(1, 2)), (7, 2, at(1, 3))],  # 5 is a day late
        [(8, 1, at(9, 0))], [(9, 1, at(9, 1))], [(10, 1, at(9, 2))]]
    stream = feed(spark, str(tmp_path / "in"), "event_id bigint, user_id bigint, ts timestamp_ntz", batches)
    stream_query = quota.start_quota(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 2)
    stream_query.awaitTermination()
    got = {r.event_id: (r.user_id, r.allowed, r.used) for r in quota.read_answers(spark, str(tmp_path / "out")).collect()}
    assert got == {1: (1, True, 1), 2: (1, True, 2), 3: (1, False, 2), 4: (2, True, 1), 5: (2, True, 1), 6: (2, True, 2),
                   7: (2, False, 2), 8: (1, True, 1), 9: (1, True, 2), 10: (1, False, 2)}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in stream_query.recentProgress]
    assert kept[-1] < max(kept)  # only the ninth day is left
    assert spark.conf.get(quota.PROVIDER_KEY, None) != quota.ROCKSDB


def test_quota_state_answers_users_in_blocks(spark, tmp_path):
    """Many users cost no state and no call each; the answers are those of the batch form, a missing user's too."""
    data = [(i, None if i % 50 == 7 else 2**62 + i * 7919 % 1_500, DAY + dt.timedelta(seconds=i)) for i in range(6_000)]
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz"
    stream = feed(spark, str(tmp_path / "in"), schema, [data[:4_000], data[3_900:]])
    stream_query = quota.start_quota(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 3)
    stream_query.awaitTermination()
    # a value, and a timer with its index, for each block
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in stream_query.recentProgress) <= 3 * quota.BLOCKS
    got = {(r.event_id, r.user_id, r.allowed, r.used) for r in quota.read_answers(spark, str(tmp_path / "out")).collect()}
    want, used = set(), {}
    for event, user, _ in data:
        used[user] = used.get(user, 0) + 1
        want.add((event, user, used[user] <= 3, min(used[user], 3)))
    assert got == want
