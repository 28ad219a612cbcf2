import datetime as dt

import pytest
from pyspark.sql import functions as F

from setledger.operators.documents import chunk_numbers, parse_header
from setledger.plans.indexing import answer_contexts, build_index, chunk_corpus, update_index
from setledger.sources import corpus, index, log, tables

RAW = """Date,Exercise Name,Set Order,Weight,Reps,Notes
2024-01-01 10:00:00,Squat,1,100,5,"a, b"
2024-01-01 10:00:00,Squat,2,100,4,
2024-01-03 10:00:00, Squat ,1,105,5,
bad,Squat,1,105,5,
"""


@pytest.fixture
def raw(tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(RAW)
    return str(path)


def test_missing_columns_are_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("exercise,sets\nA,1\n")
    path = str(tmp_path / "x.csv")
    for read in (tables.read_raw_sets, tables.read_workouts, tables.read_supervised, tables.read_for_rule_model, tables.read_predictions):
        with pytest.raises(ValueError, match="lacks columns"):
            read(spark, path)


def test_user_table_is_rebuilt_once(spark, tmp_path, raw):
    user = str(tmp_path / "user.csv")
    built = tables.rebuild_if_missing(spark, user, raw)
    assert [(r.exercise, r.sets, r.reps, r.weight, r.rpe) for r in built.orderBy("logged_at").collect()] == [
        ("Squat", 2, 4, 100.0, None), ("Squat", 1, 5, 105.0, None)]
    (tmp_path / "empty.csv").write_text("Date,Exercise Name,Set Order,Weight,Reps\n")
    assert tables.rebuild_if_missing(spark, user, str(tmp_path / "empty.csv")).count() == 2
    with pytest.raises(ValueError, match="no usable rows"):
        tables.rebuild_if_missing(spark, str(tmp_path / "other.csv"), str(tmp_path / "empty.csv"))


def test_strict_read_drops_labels(spark, tmp_path):
    (tmp_path / "w.csv").write_text("exercise,sets,reps,weight,date,rpe,rir,logged_at,actual_next_weight\nA,1,2,3.5,2024-01-01,,2,2024-01-01T10:00:00,9\n")
    r = tables.read_workouts(spark, str(tmp_path / "w.csv"))
    assert "actual_next_weight" not in r.columns
    assert tuple(r.first()) == ("A", 1, 2, 3.5, dt.date(2024, 1, 1), None, 2.0, dt.datetime(2024, 1, 1, 10))
    s = tables.read_supervised(spark, str(tmp_path / "w.csv"), grouped=True).first()
    assert (s.actual_next_weight, s.model_group) == (9.0, "global")


def test_lenient_read(spark, tmp_path):
    assert tables.read_workouts_lenient(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert tables.read_workouts_lenient(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "part.csv").write_text("exercise,weight\nA,5\n")
    r = tables.read_workouts_lenient(spark, str(tmp_path / "part.csv")).first()
    assert (r.exercise, r.weight, r.sets, r.date) == ("A", 5.0, None, None)


def test_corpus(spark, tmp_path):
    for name, data in {"v/b.txt": b"TITLE: x\n", "v/a.txt": b" caf\xc3\xa9 \xff!\nline two ", "v/c.md": b"no", "w/e.txt": b"[ERROR] x", "w/f.txt": b"  ", "w/a.txt": b"z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = corpus.read_text_corpus(spark, [str(tmp_path / "v"), str(tmp_path / "w")], str(tmp_path)).orderBy("folder", "source_name").collect()
    assert [(r.source_file, r.raw_text) for r in got] == [("v/a.txt", "café !\nline two"), ("v/b.txt", "TITLE: x"), ("w/a.txt", "z")]


def test_links(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\n\n  http://a \nhttp://b\n")
    path = str(tmp_path / "l.txt")
    assert [r.url for r in corpus.read_links(spark, path).collect()] == ["http://a", "http://b"]
    assert corpus.read_links(spark, path, comments=None).count() == 3


def test_index_is_checked(spark, rows, tmp_path):
    chunks = rows("doc_id int, chunk_key bigint, text string", (1, 0, "a"), (1, 1, "b"))
    vectors = rows("chunk_key bigint, embedding array<float>", (0, [1.0]), (1, [1.0]))
    index.write_index(chunks, vectors, str(tmp_path / "ok"))
    c, v, name = index.read_index(spark, str(tmp_path / "ok"))
    assert index.joined_index(c, v).count() == 2 and name == index.DEFAULT_ENCODER
    index.write_index(chunks, vectors.filter("chunk_key = 0"), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="without"):
        index.read_index(spark, str(tmp_path / "bad"))


def test_corpus_to_context(spark, rows, tmp_path):
    for name, text in {"squat": "squat depth and knees", "bench": "bench press arch and grip"}.items():
        (tmp_path / f"{name}.txt").write_text(f"TITLE: {name}\nAUTHOR: A\nWEBSITE: w.org\nURL: u\nTYPE: Article\n\n{text}")
    docs = corpus.read_text_corpus(spark, [str(tmp_path)], str(tmp_path))
    order = ["folder", "source_name"]
    assert chunk_corpus(docs, order).select("chunk_key").distinct().count() == 2
    numbers = chunk_numbers(parse_header(docs), order)
    assert [(r.source_name, r.chunk_id) for r in numbers.orderBy("chunk_id").collect()] == [("bench.txt", 0), ("squat.txt", 1)]
    model = build_index(docs, order, str(tmp_path / "index"), dim=128)
    chunks, vectors, _ = index.read_index(spark, str(tmp_path / "index"))
    questions = rows("question_id bigint, user_id bigint, question string", (1, 1, "how deep should I squat"))
    workouts = rows("row_id bigint, user_id bigint, exercise string, sets int, reps int, weight double, date date, rpe double, rir double, logged_at timestamp_ntz")
    profiles = rows("user_id bigint, goal string, experience_level string, equipment_access array<string>, training_frequency int")
    text = answer_contexts(questions, model, vectors, chunks, workouts, profiles).first().context
    assert "[1] Title: squat\nSource: w.org\nURL: u\nExcerpt: squat depth" in text and "No logged workout history" in text


def test_reports_and_predictions_are_stored(spark, rows, tmp_path):
    from setledger.operators import evaluation as E
    from setledger.operators.rules import predict_by_rule
    df = rows("exercise string, sets int, reps int, weight double, rpe double, rir double, actual_next_weight double",
              ("Squat", 3, 5, 100.0, None, None, 110.0), ("Row", 3, 5, 50.0, None, 1.0, 50.0))
    predictions = predict_by_rule(df)
    tables.write_predictions(predictions, str(tmp_path / "deep/p.csv"))
    back = tables.read_predictions(spark, str(tmp_path / "deep/p.csv"))
    assert sorted(r.predicted_next_weight for r in back.collect()) == [51.25, 105.0]
    scored = E.error_columns(back)
    tables.write_report(E.overall_metrics(scored), E.per_exercise_metrics(scored), E.model_report({"rule": back}), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/model_report.parquet")).first().model == "rule"
    assert spark.read.parquet(str(tmp_path / "r/per_exercise_metrics.parquet")).count() == 2
    rule = tables.read_for_rule_model(spark, str(tmp_path / "deep/p.csv"))
    assert predict_by_rule(rule.select(*df.columns)).count() == 2


def test_index_grows_by_changes(spark, rows, tmp_path):
    folder, seen = str(tmp_path / "index"), []

    def vectorize(chunks):
        seen.append(sorted(r.doc_id for r in chunks.select("doc_id").distinct().collect()))
        return chunks.select("chunk_key", F.array(F.length("text").cast("double")).alias("embedding"))

    def docs(*entries):
        return rows("doc_id int, raw_text string", *entries)

    def update(frame, **more):
        return update_index(frame, ["doc_id"], folder, vectorize, size=3, overlap=1, **more)

    def held():
        chunks, vectors, _ = index.read_index(spark, folder)
        return sorted((r.doc_id, r.chunk_index, r.text, r.embedding[0]) for r in index.joined_index(chunks, vectors.drop("part")).collect())

    def want(*entries):
        out = []
        for key, text in entries:
            words = text.split()
            starts = range(0, max(1, len(words) - 1), 2) if words and not text.startswith("[ERROR]") else []
            out += [(key, n, " ".join(words[at:at + 3]), float(len(" ".join(words[at:at + 3])))) for n, at in enumerate(starts)]
        return sorted(out)

    first = [(k, f"a{k} b c d e") for k in range(20)] + [(50, "[ERROR] none"), (51, "  ")]
    assert update(docs(*first)) == 0 and held() == want(*first) and index.read_manifest(spark, folder)["num_files"] == 20
    assert update(docs(*first)) == 0 and len(seen) == 1  # nothing to do
    second = [(0, "new text here"), *first[2:], (60, "one")]  # 0 changed, 1 gone, 60 new
    assert update(docs(*second)) == 1 and seen[-1] == [0, 60] and held() == want(*second)
    spark.createDataFrame([(1, "junk")], "chunk_key bigint, text string").write.parquet(f"{folder}/parts/chunks/2")  # broke off
    assert held() == want(*second)
    third = [first[0], *second[1:]]  # 0 as it was at first
    assert update(docs(*third)) == 2 and seen[-1] == [0] and held() == want(*third)
    assert index.read_manifest(spark, folder)["parts"] == [0, 1, 2]
    fourth = third[:8]
    assert update(docs(*fourth)) == 3 and seen[-1] == [] and held() == want(*fourth)
    assert index.read_manifest(spark, folder)["parts"] == [3] and index.read_manifest(spark, folder)["num_dead"] == 0  # written anew
    stamped = docs(*fourth).withColumn("modified", F.lit(7))
    assert update(stamped, stamp="modified") == 4 and update(stamped.withColumn("raw_text", F.lit("x")), stamp="modified") == 4
    assert held() == want(*fourth) and len(list((tmp_path / "index" / "commits").glob("[0-9]*"))) == 2
    with pytest.raises(ValueError, match="same key"):
        update(docs((1, "a"), (1, "a")))
    assert held() == want(*fourth)


def test_log_by_month(spark, rows, tmp_path):
    folder = str(tmp_path / "log")
    days = [dt.date(2023 + k % 2, 1 + k % 12, 1 + k % 28) for k in range(120)] + [None] * 3
    made = [(k, day, float(k)) for k, day in enumerate(days)]
    for start in range(0, len(made), 41):
        log.append_log(rows("row_id int, date date, weight double", *made[start:start + 41]), folder)

    def month(year, number=None):
        return sorted(r.row_id for r in log.read_period(spark, folder, year, number).collect())

    want = sorted(k for k, day, _ in made if day and (day.year, day.month) == (2024, 4))
    assert month(2024, 4) == want and month(2023) == sorted(k for k, day, _ in made if day and day.year == 2023)
    plan = log.read_period(spark, folder, 2024, 4)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(year" in scan and "month" in scan.split("PartitionFilters")[1].split("]")[0]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "log/year=2023").rglob("part*")}
    many = rows("row_id int, date date, weight double", *[(1_000 + k, dt.date(2024, 4, 2), 1.0) for k in range(4)])
    for k in range(4):
        log.append_log(many.filter(f"row_id = {1_000 + k}"), folder)
    assert log.compact_log(spark, folder, files=4) == 1 and log.compact_log(spark, folder, files=4) == 0
    assert len(list((tmp_path / "log/year=2024/month=4").glob("part*"))) == 1
    assert month(2024, 4) == want + [1_000, 1_001, 1_002, 1_003]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "log/year=2023").rglob("part*")}
    assert log.read_log(spark, folder).count() == len(made) + 4 and log.read_log(spark, folder).filter("date is null").count() == 3
