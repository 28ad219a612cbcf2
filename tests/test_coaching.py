import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from setledger.functions import vocabulary as V
from setledger.functions.text import normalize_text
from setledger.functions.vocabulary import LIFT_ALIASES
from setledger.operators import activity, coaching as C, crawl

DAY = dt.datetime(2024, 1, 1)
LOG = ("row_id bigint, user_id bigint, exercise string, sets int, reps int, weight double, date date, rpe double, rir double, "
       "logged_at timestamp_ntz")


@pytest.fixture
def log(spark):
    def make(*entries):
        data = []
        for i, (user, exercise, hours) in enumerate(entries):
            at = None if hours is None else DAY + dt.timedelta(hours=hours)
            data.append((i, user, exercise, 3, 5, 100.0 + i, (at or DAY).date(), None, None, at))
        return spark.createDataFrame(data, LOG)
    return make


def ask(rows, *questions):
    return rows("question_id bigint, user_id bigint, question string", *[(i, 1, q) for i, q in enumerate(questions)])


def test_target_by_name(rows, log):
    workouts = log((1, "Bench Press (Barbell)", 5), (1, "Bench Press", 1), (1, "Bench Press", 3), (1, "Face pull", 9), (2, "Face pull", 99))
    got = {r.question_id: (r["pass"], r.row_id) for r in C.target_lifts(
        ask(rows, "next weight on bench press?", "next FACE pull", "press day", "barbell bench press"), workouts).collect()}
    # 0: whole name counts 3 more; 2: one shared word each, newest wins
    assert got == {0: (1, 2), 1: (1, 3), 2: (1, 0), 3: (1, 2)}


def test_target_by_lift_then_newest(rows, log):
    workouts = log((1, "Rdl", 1), (1, "Hacksquat machine", 2), (1, "Curl", 8), (1, "Spoto-press", None))
    got = {r.question_id: (r["pass"], r.row_id) for r in C.target_lifts(
        ask(rows, "best deadlift or squat?", "deadlift today", "what now"), workouts).collect()}
    assert got == {0: (2, 1), 1: (2, 0), 2: (3, 2)}


def test_no_log_no_target(rows, log):
    assert C.target_lifts(ask(rows, "squat"), log((2, "Squat", 1))).count() == 0


def test_same_second_goes_to_the_earlier_row(rows, log):
    workouts = log((1, "Squat", 1), (1, "Squat", 1), (1, "!!!", 50))
    assert C.target_lifts(ask(rows, "my squat"), workouts).first().row_id == 0


def brute_target(question, log):
    """The three passes over all names of the user, on (exercise, hour, row_id)."""
    plain = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())
    newest = {}
    for exercise, hour, row in log:
        if exercise not in newest or hour > newest[exercise][0]:
            newest[exercise] = (hour, row)
    asked, best = plain(question), []
    words = set(asked.split())
    for exercise, (hour, row) in newest.items():
        name = plain(exercise)
        score = len(words & set(name.split())) + (3 if name and name in asked else 0)
        if exercise.strip() and (score or not name):
            best.append((1, -score, -hour, row))
        lifts = [i for i, (lift, aliases) in enumerate(LIFT_ALIASES.items())
                 if lift in words and any(a in exercise.lower() for a in aliases)]
        best += [(2, lifts[0], -hour, row)] if lifts else []
        best.append((3, 0, -hour, row))
    return min(best)[0], min(best)[3]


def test_targets_against_all_pairs(spark, rows, log):
    rng = random.Random(6)
    parts = ["row", "press", "bench", "squat", "ab", "x", "T-bar", "(Barbell)", "low", "deadlift", "curl", "tom", "up", "..."]
    made = [(u, " ".join(rng.choices(parts, k=rng.randint(1, 3))), rng.randint(0, 400)) for u in range(4) for _ in range(40)]
    made += [(0, "--", 500), (1, "  ", 501)]
    made = [(u, e, h + k / 1000) for k, (u, e, h) in enumerate(made)]
    workouts = rows(LOG, *[(k, u, e, 3, 5, 100.0, DAY.date(), None, None, DAY + dt.timedelta(hours=int(h), seconds=k))
                           for k, (u, e, h) in enumerate(made)])
    lines = ["".join(rng.choice([" ", "", "-"]) + w for w in rng.choices(parts + ["tomorrow", "workbench", "next", "pressing"], k=rng.randint(0, 5)))
             for _ in range(60)]
    questions = spark.createDataFrame([(k, k % 4, q) for k, q in enumerate(lines)], "question_id int, user_id int, question string")
    got = {r.question_id: (r["pass"], r.row_id) for r in C.target_lifts(questions, workouts).collect()}
    want = {k: brute_target(q, [(e, int(h) * 3600 + n, n) for n, (u, e, h) in enumerate(made) if u == k % 4]) for k, q in enumerate(lines)}
    assert got == want


def test_names_that_share_nothing_make_no_rows(spark, rows):
    """A user with 10,000 names: a question meets those it shares a word or its place with."""
    workouts = spark.range(10_000).selectExpr(
        "id as row_id", "1 as user_id", "concat('zz', id, ' lift', id % 100) as exercise", "3 as sets", "5 as reps", "100.0D as weight",
        "date'2024-01-01' as date", "cast(null as double) as rpe", "cast(null as double) as rir",
        "timestamp_ntz'2024-01-01 00:00:00' as logged_at")
    names = C.newest_per_exercise(workouts).withColumn("_name", normalize_text(F.col("exercise")))
    asked = rows("question_id int, user_id int, _q string", (1, 1, "next weight for lift7 and zz4207"), (2, 1, "nothing of it"))
    keys = C.question_keys(asked, 3, 13)
    met = keys.join(C.name_keys(names), ["user_id", "kind", "key"]).filter("kind = 'word' or startswith(after, _name)")
    pairs = {(r.question_id, r.exercise) for r in met.collect()}
    assert len(pairs) == 100 and {q for q, _ in pairs} == {1}
    got = C.target_lifts(asked.withColumnRenamed("_q", "question"), workouts).collect()
    assert {r.question_id: (r["pass"], r.exercise) for r in got} == {1: (1, "zz4207 lift7"), 2: (3, "zz0 lift0")}


def test_history_block(rows, log):
    workouts = log((1, "Bench Press", 1), (1, "bench  press!", 4), (1, "Squat", 2), (3, "Curl", 1), (3, "Curl", 2), (3, "Row", 3), (3, "Row", None))
    users = rows("user_id bigint", (1,), (2,), (3,))
    got = {r.user_id: r.history.split("\n") for r in C.history_blocks(users, workouts).collect()}
    assert got[1] == ["User workout context:", "- Most recent bench  press!: 101 lb x 5 reps on 2024-01-01",
                      "- Most recent Squat: 102 lb x 5 reps on 2024-01-01"]
    assert got[2] == ["User workout context:", "- No logged workout history found."]
    assert [x.split(":")[0] for x in got[3][1:]] == ["- Recent Row", "- Recent Curl", "- Recent Curl"]


def test_one_exercise_for_two_lifts_is_reported_once(rows, log):
    workouts = log((1, "Bench shoulder press", 1))
    assert C.latest_per_lift(workouts).count() == 2
    assert [r.lift for r in C.dedupe_lifts(C.latest_per_lift(workouts)).collect()] == [0]


def test_profile_block(rows):
    profiles = rows("user_id bigint, goal string, experience_level string, equipment_access array<string>, training_frequency int",
                    (1, "Strength", "", ["Barbell", "Bands"], 3), (2, "", None, [], None))
    users = rows("user_id bigint", (1,), (2,), (3,))
    got = {r.user_id: r.profile.split("\n")[1:] for r in C.profile_blocks(users, profiles).collect()}
    assert got == {1: ["- Goal: Strength", "- Equipment access: Barbell, Bands", "- Training frequency: 3 days per week"],
                   2: ["- No usable user profile fields found."], 3: ["- No user profile found."]}


def test_prediction_block(rows, log):
    workouts = log((1, "Squat", 1))
    got = {r.question_id: r.prediction.split("\n", 1)[1] for r in C.prediction_blocks(
        ask(rows, "next weight squat", "hello"), workouts).collect()}
    assert got == {0: "- Baseline predicts next Squat: 105.0 lb\n- Reason: Completed the session, so apply a standard progressive overload increase.",
                   1: V.NOT_ASKED}
    nobody = rows("question_id bigint, user_id bigint, question string", (0, 9, "next weight"))
    assert C.prediction_blocks(nobody, workouts).first().prediction.endswith(V.NO_TARGET)


def test_excerpt_fallbacks(rows):
    results = rows("query_id int, rank int, title string, source_name string, website string, source_file string, url string, text string",
                   (1, 2, "", "n.txt", None, "f/n.txt", "", " a \n b "), (1, 1, "T", "n", "w", "f", "u", "x" * 400))
    blocks = C.excerpt_blocks(results).first().excerpts.split("\n\n")
    assert blocks[1] == "[1] Title: T\nSource: w\nURL: u\nExcerpt: " + "x" * 350
    assert blocks[2] == "[2] Title: n.txt\nSource: f/n.txt\nURL: unknown\nExcerpt: a b"


def test_context_joins_all_sections(rows, log):
    empty = rows("query_id bigint, rank int, title string, website string, url string, text string")
    profiles = rows("user_id bigint, goal string, experience_level string, equipment_access array<string>, training_frequency int")
    text = C.context_blocks(ask(rows, "why"), empty, log((1, "Squat", 1)), profiles).first().context
    assert [p.split("\n")[0] for p in text.split("\n\n")] == ["Relevant training context:", "User workout context:", "User profile context:", "Prediction context:"]


def test_chat_cut_comes_before_the_role_filter(rows):
    turns = rows("conv_id int, turn int, role string, text string", *[
        (1, i, "system" if i == 9 else "user", None if i == 8 else V.INTERNAL_ERROR_MARKERS[0] + "!" if i == 7 else f"t{i}") for i in range(12)])
    assert [r.turn for r in C.chat_window(turns).orderBy("turn").collect()] == [4, 5, 6, 10, 11]


def test_messages(rows):
    turns = rows("conv_id int, turn int, role string, text string", (1, 1, "assistant", "b"), (1, 0, "user", "a"))
    prompts = rows("conv_id int, prompt string", (1, "p"), (2, "q"))
    contexts = rows("conv_id int, context string", (1, "c"), (2, ""))
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in C.build_messages(prompts, turns, contexts, 8, "S", "C:").collect()}
    assert got == {1: [("system", "S"), ("system", "C:c"), ("user", "a"), ("assistant", "b"), ("user", "p")],
                   2: [("system", "S"), ("user", "q")]}


@pytest.mark.parametrize("bound", [10, 2_000_000])
def test_quota(spark, monkeypatch, bound):
    from setledger.operators import ordering
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", bound)
    data = [(i, 1, DAY + dt.timedelta(minutes=i)) for i in range(32)] + [(99, 1, DAY + dt.timedelta(days=1))]
    got = activity.daily_quota(spark.createDataFrame(data, "event_id int, user_id int, ts timestamp_ntz")).collect()
    allowed = [r.event_id for r in got if r.allowed]
    assert sorted(allowed) == [*range(30), 99]
    by_id = {r.event_id: (r.used, r.remaining) for r in got}
    assert by_id[0] == (1, 29) and by_id[29] == (30, 0) and by_id[31] == (30, 0) and by_id[99] == (1, 29)


def test_entry_checks(rows):
    df = rows("row_id int, exercise string, sets int, reps int, weight_text string, rpe double, rir double, logged_at timestamp_ntz",
              (0, " Squat ", 1, 1, "0", 0.0, 0.0, DAY), (1, " ", 1, 1, "1", 0.0, 0.0, DAY), (2, "A", 0, 1, "1", 0.0, 0.0, DAY),
              (3, "A", 1, None, "1", 0.0, 0.0, DAY), (4, "A", 1, 1, "-1", 0.0, 0.0, DAY), (5, "A", 1, 1, "x", 0.0, 0.0, DAY),
              (6, "A", 1, 1, "1", 10.5, 0.0, DAY), (7, "A", 1, 1, "1", 9.0, 11.0, DAY), (8, "A", 1, 1, "1", None, 2.0, DAY))
    good = {r.row_id: (r.exercise, r.rpe, r.rir) for r in activity.accepted_entries(df).collect()}
    assert good == {0: ("Squat", None, None), 8: ("A", None, 2.0)}
    assert {r.row_id: r.reason.split()[0] for r in activity.rejected_entries(df).collect()} == {
        1: "exercise", 2: "sets", 3: "reps", 4: "weight", 5: "weight", 6: "rpe", 7: "rir"}


@pytest.mark.parametrize("bound", [4, 2_000_000])
def test_stop_after_blocks(spark, monkeypatch, bound):
    from setledger.operators import ordering
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", bound)
    outcomes = ["403", None, "blocked", "timed out", "429", None, "captcha", "x", "Forbidden", "x", "403", "403"]
    log = spark.createDataFrame([(i, 1, m) for i, m in enumerate(outcomes)] + [(0, 2, "403")], "seq int, site int, message string")
    for limit, stop in ((1, 0), (2, 4), (3, 10), (4, 11)):
        assert {r.site: r.stop_at for r in crawl.first_stop(log, limit).collect()}.get(1) == stop
    assert crawl.first_stop(log, 5).count() == 0


def test_month_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, DAY.date()), (2, dt.date(2024, 2, 1))], "id int, date date").write.parquet(str(tmp_path / "l"))
    got = activity.in_month(spark.read.parquet(str(tmp_path / "l")), 2024, 1)
    assert [r.id for r in got.collect()] == [1]
    assert "GreaterThanOrEqual(date,2024-01-01)" in got._jdf.queryExecution().executedPlan().toString()
