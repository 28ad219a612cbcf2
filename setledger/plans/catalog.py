"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from setledger import schemas as S
from setledger.functions import markers as M, numbers as N, text as X, times as D, urls as U, vectors as L
from setledger.functions import vocabulary as V
from setledger.operators import (activity, coaching, crawl, documents, evaluation, features, labels, learning,
                                 retrieval, rules, scoring, sessions, vectorize)
from setledger.plans import indexing, training
from setledger.session import pin, scratch_path
from setledger.sources import corpus, files, fixtures as A, index, log, tables
from setledger.streaming import jobs, quota

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The given tables are small per key; these parameters make the limits take effect on them.
CHAT_TURNS = 4
QUOTA = 3
ROUTER_ROWS = 60
STREAK = 2
SLICES = 50


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def show(df: DataFrame) -> DataFrame:
    """Values in the form both engines print alike: times as ISO text, doubles at 6 places,
    lists as one text."""
    def plain(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = D.iso_seconds(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.bround(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        return c.alias(f.name)
    return df.select(*[plain(f) for f in df.schema.fields])


# ---- training log: sets, sessions, labels, split


@query
def clean_sets(spark, sf):
    return show(sessions.valid_sets(sessions.coerce_sets(A.text_sets(spark, sf))))


def _sessions(spark, sf):
    return sessions.collapse_sessions(sessions.valid_sets(A.raw_sets(spark, sf)))


@query
def collapse_sessions(spark, sf):
    return show(_sessions(spark, sf))


@query
def collapse_user_sessions(spark, sf):
    return show(sessions.collapse_sessions(sessions.valid_sets(A.user_sets(spark, sf)),
                                           ["user_id", *sessions.SESSION]))


@query
def working_weight(spark, sf):
    return show(_sessions(spark, sf).select("logged_at", "exercise", "weight"))


@query
def set_count(spark, sf):
    return show(_sessions(spark, sf).select("logged_at", "exercise", "sets"))


@query
def typical_reps(spark, sf):
    return show(_sessions(spark, sf).select("logged_at", "exercise", "reps"))


@query
def next_weight_labels(spark, sf):
    rows = training.supervised_rows(A.user_sets(spark, sf), ["user_id"])
    return show(rows.select("user_id", "exercise", "logged_at", "weight", S.TARGET))


def _split(spark, sf):
    return training.split_rows(A.raw_sets(spark, sf))


@query
def chronological_split(spark, sf):
    return show(_split(spark, sf).select("exercise", "logged_at", "weight", S.TARGET, "dataset"))


@query
def chronological_split_users(spark, sf):
    rows = training.split_rows(A.user_sets(spark, sf), users=["user_id"])
    return show(rows.select("user_id", "exercise", "logged_at", "dataset"))


@query
def sorted_sessions(spark, sf):
    return show(sessions.sort_sessions(_sessions(spark, sf)).select("date", "exercise", "weight"))


@query
def supervised_round_trip(spark, sf):
    """Write the split's tables, read the training part back as a grouped supervised table."""
    folder = scratch_path(spark, "training")
    tables.write_training_tables(_split(spark, sf), folder, ".csv")
    train = tables.read_supervised(spark, f"{folder}/train_workouts.csv", grouped=True)
    return show(train.select("exercise", "sets", "reps", "weight", "date", "logged_at", S.TARGET, "model_group"))


@query
def training_tables(spark, sf):
    """The three tables of a split as they are stored: all rows, the earlier and the later ones."""
    folder = scratch_path(spark, "training")
    tables.write_training_tables(_split(spark, sf), folder)
    parts = [tables.read_supervised(spark, f"{folder}/{name}.parquet").select(F.lit(name).alias("part"), "exercise", "weight", "logged_at", S.TARGET)
             for name in ("workouts", "train_workouts", "test_workouts")]
    return show(parts[0].union(parts[1]).union(parts[2]))


@query
def raw_set_scan(spark, sf):
    """The text log through a CSV file: scan, parse, validate, collapse."""
    path = scratch_path(spark, "sets") + ".csv"
    tables.write_table(A.text_sets(spark, sf), path)
    sets = sessions.valid_sets(sessions.coerce_sets(tables.read_raw_sets(spark, path)))
    return show(sessions.collapse_sessions(sets))


# ---- rule model and evaluation


@query
def exercise_class(spark, sf):
    rows = A.table(spark, sf, "part").select("p_partkey", A.exercise_name(F.col("p_partkey")).alias("exercise"))
    return rows.select("*", M.exercise_class(F.col("exercise")).alias("increment_class"),
                       M.model_group(F.col("exercise")).alias("model_group"))


@query
def base_increment(spark, sf):
    rows = A.workouts(spark, sf)
    return show(rows.select("row_id", "exercise", "weight",
                            rules.base_increment(F.col("exercise"), F.col("weight")).alias("base_increment")))


@query
def rule_predictions(spark, sf):
    rows = rules.predict_by_rule(A.workouts(spark, sf))
    return show(rows.select("row_id", "exercise", "weight", *rules.EXPORT_COLUMNS))


@query
def zero_effort_predictions(spark, sf):
    """Effort as text, blank where missing, before the rule."""
    rows = A.workouts(spark, sf).withColumns({c: N.optional_effort(F.coalesce(F.col(c).cast("string"), F.lit("")))
                                              for c in ("rpe", "rir")})
    return show(rules.predict_by_rule(rows).select("row_id", "predicted_next_weight"))


def _scored(spark, sf, part="test"):
    return training.scored_rule_predictions(_split(spark, sf), part)


@query
def error_columns(spark, sf):
    return show(_scored(spark, sf).select("exercise", "logged_at", "error", "absolute_error", "squared_error",
                                          *evaluation.THRESHOLDS))


@query
def overall_metrics(spark, sf):
    return show(evaluation.overall_metrics(_scored(spark, sf)))


@query
def per_exercise_metrics(spark, sf):
    return show(evaluation.per_exercise_metrics(_scored(spark, sf)))


@query
def top_exercises(spark, sf):
    return show(evaluation.top_exercises(_scored(spark, sf), 10))


@query
def model_report(spark, sf):
    """The rule on the later rows, on the earlier rows, and no change at all."""
    split = _split(spark, sf)
    ruled = rules.predict_by_rule(split)
    still = split.filter(F.col("dataset") == "test").withColumn("predicted_next_weight", F.col("weight"))
    return show(evaluation.model_report({
        "rule": ruled.filter(F.col("dataset") == "test"),
        "rule on training rows": ruled.filter(F.col("dataset") == "train"),
        "no change": still}))


@query
def error_histogram(spark, sf):
    return show(evaluation.error_histogram(_scored(spark, sf), 30))


@query
def prediction_range(spark, sf):
    return show(evaluation.prediction_range(_scored(spark, sf)))


@query
def train_rows_per_group(spark, sf):
    train = _split(spark, sf).filter(F.col("dataset") == "train")
    return evaluation.train_rows_per_group(learning.with_model_group(train))


@query
def prediction_table_round_trip(spark, sf):
    """Predictions through a CSV file, then the metrics of what was read."""
    path = scratch_path(spark, "predictions") + ".csv"
    split = _split(spark, sf)
    tables.write_predictions(rules.predict_by_rule(split.filter(F.col("dataset") == "test")), path)
    return show(evaluation.overall_metrics(evaluation.error_columns(tables.read_predictions(spark, path))))


@query
def rebuilt_user_table(spark, sf):
    """No stored user table: it is derived from the raw sets, stored, and read strictly."""
    raw = scratch_path(spark, "sets") + ".csv"
    tables.write_table(A.text_sets(spark, sf), raw)
    return show(tables.rebuild_if_missing(spark, scratch_path(spark, "user") + ".csv", raw))


@query
def lenient_log_read(spark, sf):
    """A stored log without effort columns: they come back as missing."""
    path = scratch_path(spark, "log") + ".csv"
    tables.write_table(A.workouts(spark, sf).select("row_id", "exercise", "sets", "weight", "date"), path)
    return show(tables.read_workouts_lenient(spark, path, keep=["row_id"]))


# ---- history features


FEATURES = ["row_id", "user_id", "exercise", *features.NUMERIC_FEATURES]


@query
def history_features(spark, sf):
    return show(features.history_features(A.workouts(spark, sf)).select(FEATURES))


@query
def filled_features(spark, sf):
    """Earlier and later rows stacked with a marker, features together, gaps as zero."""
    rows = A.workouts(spark, sf)
    cut = F.lit("2024-01-20").cast("date")
    both = features.combined_features(rows.filter(F.col("date") < cut), rows.filter(F.col("date") >= cut))
    return show(both.select(*FEATURES, "_dataset").withColumnRenamed("_dataset", "dataset"))


@query
def strict_past_features(spark, sf):
    return show(features.strict_past_features(A.workouts_tied(spark, sf)).select(FEATURES))


# ---- learned models


def _labelled_workouts(spark, sf):
    from setledger.operators.labels import chronological_split, next_weight

    rows = pin(next_weight(A.workouts(spark, sf), ["user_id", "exercise"], ["row_id"]))
    return chronological_split(rows, order=["logged_at", "date", "exercise", "row_id"])


def _train_test(spark, sf):
    split = _labelled_workouts(spark, sf)
    return [split.filter(F.col("dataset") == part).drop("dataset") for part in ("train", "test")]


@query
def boosted_predictions(spark, sf):
    train, test = _train_test(spark, sf)
    return show(learning.boosted_predictions(train, test))


@query
def grouped_predictions(spark, sf):
    train, test = _train_test(spark, sf)
    models = learning.train_per_group(train, test)
    history = train.unionByName(test)
    return show(learning.predict_per_group(models, history, test))


@query
def latest_predictions(spark, sf):
    """Models stored and loaded again, then the newest row of every user and exercise of the whole log."""
    train, _ = _train_test(spark, sf)
    whole = A.workouts(spark, sf)
    feats = pin(features.fill_features(features.history_features(train)))
    model = learning.train_boosted(feats)
    folder = scratch_path(spark, "models")
    learning.save_models(spark, {"global": model}, folder)
    loaded = learning.load_models(spark, folder)["global"]
    learned = learning.predict_latest(loaded, whole)
    ruled = rules.predict_by_rule(whole)
    return show(learning.prefer_learned(learned, ruled).select(
        "row_id", "exercise", "weight", "predicted_next_weight", "model_name"))


@query
def restored_groups(spark, sf):
    """Models per group, stored, one of them damaged, loaded again; later rows, some with a name no model has seen: the
    group that scores each of them, what goes with the prediction, and the vector of the stored global model."""
    train, test = _train_test(spark, sf)
    models = learning.train_per_group(train, test, learning.BoostSettings(trees=3))
    folder = scratch_path(spark, "forests")
    scoring.save_forests(spark, {g: scoring.forest_of(spark, m) for g, m in models.items()}, folder)
    files.remove(spark, f"{folder}/0/isolation/nodes")
    loaded = scoring.load_forests(spark, folder)
    test = test.withColumn("exercise", F.when(F.col("row_id") % 9 == 0, "Sled Push").otherwise(F.col("exercise")))
    history = pin(train.unionByName(test))
    scored = learning.predict_per_group(loaded, history, test)
    rows = learning.with_model_group(features.fill_features(features.strict_past_features(history)))
    inputs = F.array(*scoring.input_columns(loaded["global"], rows))
    n = len(features.NUMERIC_FEATURES)
    def total(part):
        return F.bround(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), 3)
    vectors = rows.select("row_id", inputs.alias("v")).select(
        "row_id", F.size("v").alias("width"), total(F.slice("v", 1, n)).alias("numbers"), total(F.slice("v", n + 1, F.size("v") - n)).alias("names"))
    gain = F.bround(F.col("predicted_next_weight") - F.col("current_weight"), 2)
    return show(scored.join(vectors, "row_id").select(
        "row_id", "exercise", "model_group", "current_weight", "top_factors", "reason", "model_type",
        (F.col("recommended_increment") == gain).alias("gain_fits"), "width", "numbers", "names"))


@query
def learned_report(spark, sf):
    """The error of the rule, of one model for all rows, and of a model per group, on the later rows."""
    train, test = _train_test(spark, sf)
    fast = learning.BoostSettings(trees=20)
    grouped = learning.predict_per_group(learning.train_per_group(train, test, fast), train.unionByName(test), test)
    return show(evaluation.model_report({
        "rule": rules.predict_by_rule(test),
        "boosted": learning.boosted_predictions(train, test, settings=fast),
        "grouped": grouped.join(test.select("row_id", S.TARGET), "row_id")}))


@query
def latest_features(spark, sf):
    """What a model is given for the newest row of every user and exercise."""
    return show(learning.latest_features(A.workouts_tied(spark, sf)).select(FEATURES))


@query
def assembled_vectors(spark, sf):
    """The assembled vector: its width, the sum of its numbers, and the column that its name has."""
    rows = pin(features.fill_features(features.history_features(A.workouts(spark, sf))))
    vectors = Pipeline(stages=learning.encoder_stages(["exercise"])).fit(rows).transform(rows)
    n = len(features.NUMERIC_FEATURES)
    values = vectors.select("row_id", "exercise", vector_to_array("features").alias("v"))
    return values.select(
        "row_id", "exercise", F.size("v").alias("width"),
        F.bround(F.aggregate(F.slice("v", 1, n), F.lit(0.0), lambda s, x: s + x), 3).alias("total"),
        (F.array_position(F.slice("v", n + 1, F.size("v") - n), 1.0) - 1).alias("name_column"))


@query
def routed_groups(spark, sf):
    """Each row's model group when only three groups have a model."""
    manifest = spark.createDataFrame([("global",), ("upper_compound",), ("bodyweight",)], "model_group string")
    return learning.resolve_group(A.workouts(spark, sf).select("row_id", "exercise"), manifest)


# ---- stored tables and their order


def _placed(df):
    """``place``: each row's position in a sorted table, from 0."""
    spread = pin(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return spread.join(before, "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


@query
def sorted_sets(spark, sf):
    rows = _placed(sessions.sort_sets(sessions.valid_sets(A.raw_sets(spark, sf))))
    return show(rows.select("place", "set_ts", "exercise", "set_order"))


@query
def sorted_supervised(spark, sf):
    rows = _placed(labels.sort_supervised(training.supervised_rows(A.user_sets(spark, sf), ["user_id"])))
    return show(rows.select("place", "logged_at", "exercise"))


@query
def restored_order(spark, sf):
    """History and the rows to predict, stacked, back in the order of their rows."""
    rows = A.workouts(spark, sf)
    current = rows.filter(F.col("row_id") % 8 == 0).select("row_id", "user_id", "exercise", "weight", "logged_at")
    both = features.append_current(rows.filter(F.col("row_id") % 8 != 0), current)
    return show(_placed(features.restore_order(both)).select("place", "row_id", "exercise", "sets", "weight", "rpe"))


@query
def rule_model_table(spark, sf):
    """A stored table without effort columns, read for the rule model."""
    path = scratch_path(spark, "log") + ".csv"
    tables.write_table(A.workouts(spark, sf).drop("rpe", "rir"), path)
    return show(rules.predict_by_rule(tables.read_for_rule_model(spark, path)).select("row_id", "predicted_next_weight", "reason"))


@query
def stored_report(spark, sf):
    """Metrics, metrics per exercise and model report, written and read back."""
    folder, scored = scratch_path(spark, "report"), pin(_scored(spark, sf))
    tables.write_report(evaluation.overall_metrics(scored), evaluation.per_exercise_metrics(scored),
                        evaluation.model_report({"rule": scored}), folder)
    def part(name, label):
        return spark.read.parquet(f"{folder}/{name}.parquet").select(F.lit(name).alias("part"), label.alias("name"), "mae")
    return show(part("metrics", F.lit("")).union(part("per_exercise_metrics", F.col("exercise"))).union(part("model_report", F.col("model"))))


@query
def text_corpus(spark, sf):
    """Benchmark texts as files, one folder each; a folder that is not there is left out."""
    folder = scratch_path(spark, "corpus")
    rows = A.table(spark, sf, "benchmark").withColumn("text", F.when(F.col("item_id") % 10 == 0, "[ERROR] 404").otherwise(F.col("text")))
    rows.select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(folder)
    found = corpus.read_text_corpus(spark, [f"{folder}-absent", folder], folder)
    return found.select("folder", F.regexp_extract("source_file", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "raw_text")


def _stored_sessions(spark, sf):
    """Sessions of all users as a log by year and month, in two appends, compacted."""
    folder = scratch_path(spark, "log")
    rows = sessions.collapse_sessions(sessions.valid_sets(A.user_sets(spark, sf)), ["user_id", *sessions.SESSION])
    for part in range(2):
        log.append_log(rows.filter(F.col("user_id") % 2 == part), folder)
    log.compact_log(spark, folder, files=1)
    return folder


@query
def stored_month(spark, sf):
    return show(log.read_period(spark, _stored_sessions(spark, sf), 1995, 3).select("user_id", "exercise", "date", "weight"))


@query
def stored_year(spark, sf):
    return show(log.read_period(spark, _stored_sessions(spark, sf), 1995).select("user_id", "exercise", "date", "weight"))


@query
def year_log(spark, sf):
    """Every second row moved to the year before; one year of the log."""
    moved = A.workouts(spark, sf).withColumn("date", F.when(F.col("row_id") % 2 == 0, F.add_months("date", -12)).otherwise(F.col("date")))
    return show(activity.in_month(moved, 2023).select("row_id", "exercise", "date"))


# ---- documents and chunks


@query
def header_parse(spark, sf):
    return documents.parse_header(A.raw_docs(spark, sf)).select("doc_id", *S.DOCUMENT_FIELDS, "text")


@query
def document_records(spark, sf):
    docs = A.doc_meta(spark, sf)
    record = documents.document_record(F.col("text"), title=F.col("title"), author=F.lit(None).cast("string"),
                                       website=F.col("website"), url=F.lit("https://example.org/"), type=F.col("type"))
    return docs.select("doc_id", record.alias("record"))


@query
def header_round_trip(spark, sf):
    """Stored record, parsed again."""
    stored = document_records(spark, sf).withColumnRenamed("record", "raw_text")
    return documents.parse_header(stored).select("doc_id", *S.DOCUMENT_FIELDS, X.strip(F.col("text")).alias("text"))


@query
def chunk_words(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    return documents.chunk_words(docs)


@query
def small_chunks(spark, sf):
    """Short chunks with an overlap as large as the chunk: steps of one word would not end, so
    steps are at least one."""
    docs = A.table(spark, sf, "pages").select("page_id", F.col("url").alias("text"))
    return documents.chunk_words(docs.withColumn("text", F.regexp_replace("text", "[/:.]+", " ")), 3, 3)


@query
def chunk_ids(spark, sf):
    docs = A.table(spark, sf, "documents").select("source", "doc_id", "text")
    return documents.chunk_numbers(docs, ["source", "doc_id"]).select("doc_id", "chunk_index", "chunk_id", "n_words")


@query
def chunk_index_stats(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    return documents.index_stats(documents.chunk_words(docs))


@query
def index_round_trip(spark, sf):
    """Store whole documents with their vectors, read the index, report unmatched keys."""
    chunks, vectors = A.indexed_docs(spark, sf), A.vectors(spark, sf)
    folder = scratch_path(spark, "index")
    index.write_index(chunks, vectors, folder)
    chunks, vectors, _ = index.read_index(spark, folder, check=False)
    return index.index_orphans(chunks, vectors).select("chunk_key", "side")


def _letter_vectors(chunks):
    """Counts of a few letters and of words: vectors that both engines can make."""
    counts = [F.length("text") - F.length(F.replace("text", F.lit(c), F.lit(""))) for c in "aeinst"]
    return chunks.select("chunk_key", F.array(*counts, F.col("n_words")).cast("array<double>").alias("embedding"))


@query
def index_built(spark, sf):
    """An index of most documents, some with an older text and some that are gone later, brought up to the whole
    table: every chunk with its vector, the part that holds it, and the manifest's counts."""
    folder, key = scratch_path(spark, "index"), F.col("doc_id")
    docs = A.table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw_text"))
    old = docs.filter(key % 10 != 0).withColumn("raw_text", F.when(key % 10 == 1, F.concat(F.lit("older "), "raw_text")).otherwise(F.col("raw_text")))
    gone = docs.filter(key % 20 == 2).withColumn("doc_id", key + 10_000_000)
    indexing.update_index(old.unionByName(gone), ["doc_id"], folder, _letter_vectors)
    indexing.update_index(docs, ["doc_id"], folder, _letter_vectors)
    chunks, vectors, _ = index.read_index(spark, folder)
    manifest = index.read_manifest(spark, folder)
    rows = index.joined_index(chunks, vectors.drop("part"))
    return show(rows.select("doc_id", "chunk_index", "n_words", "part", F.md5("text").alias("digest"), "embedding",
                            F.lit(manifest["num_files"]).alias("num_files"), F.lit(manifest["num_chunks"]).alias("num_chunks")))


@query
def joined_index(spark, sf):
    rows = index.joined_index(A.indexed_docs(spark, sf), A.vectors(spark, sf))
    return show(rows.select("chunk_key", "title", F.size("embedding").alias("dim")))


# ---- retrieval


@query
def dot_products(spark, sf):
    rows = A.table(spark, sf, "embeddings")
    unit = L.l2_normalize(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3.0))
    return show(rows.select("vec_id", L.dot(F.col("embedding"), unit).alias("self_score")))


@query
def retrieve_topk(spark, sf):
    return show(retrieval.candidates(A.query_set(spark, sf), A.vectors(spark, sf), 4))


@query
def retrieve_topk_blocks(spark, sf):
    """The same answer in passes of four queries, as for a query set too large to send around at once."""
    return show(retrieval.candidates(A.query_set(spark, sf), A.vectors(spark, sf), 4,
                                     broadcast_queries=0, block_rows=4))


@query
def rerank_topk(spark, sf):
    found = retrieval.retrieve(A.query_set(spark, sf), A.vectors(spark, sf), A.indexed_docs(spark, sf), 3)
    return show(found.select("query_id", "rank", "score", "embedding_score", "chunk_key", "title", "website", "type"))


@query
def title_overlap(spark, sf):
    """Each query against the title of the document with its number."""
    queries = A.query_set(spark, sf).select("query_id", "query_text")
    docs = A.doc_meta(spark, sf).select("doc_id", "title")
    rows = queries.join(docs, F.col("query_id") == F.col("doc_id"))
    return show(rows.select("query_id", retrieval.title_overlap(F.col("query_text"), F.col("title")).alias("overlap")))


@query
def low_value_chunks(spark, sf):
    return A.doc_meta(spark, sf).select(
        "doc_id", M.has_low_value_text(F.col("text"), V.LOW_VALUE_WINDOW).alias("low_value"),
        M.has_low_value_text(F.col("text")).alias("low_value_anywhere"), M.trusted_site(F.col("website")).alias("trusted"))


@query
def explanatory_queries(spark, sf):
    return A.query_set(spark, sf).select("query_id", M.prefers_explanatory(F.col("query_text")).alias("explanatory"))


@query
def token_sets(spark, sf):
    rows = A.table(spark, sf, "benchmark")
    return show(rows.select("item_id", F.sort_array(X.token_set(F.col("text"))).alias("tokens"),
                            X.normalize_text(F.col("text")).alias("normalized")))


@query
def excerpts(spark, sf):
    rows = A.table(spark, sf, "documents")
    return rows.select("doc_id", X.excerpt(F.col("text"), V.EXCERPT_CHARS).alias("excerpt"))


@query
def label_vectors(spark, sf):
    """Masked mean of the vectors of each label, one row per label and dimension."""
    pooled = vectorize.mean_pool(A.masked_vectors(spark, sf), "label")
    return show(pooled.select("label", F.posexplode("embedding").alias("dim", "value")))


@query
def hashed_vectors(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    rows = vectorize.hashed_vectors(docs, vectorize.fit_hashed_vectorizer(docs))
    return show(rows.select("doc_id", F.size("embedding").alias("dim"), L.l2_norm(F.col("embedding")).alias("length")))


# ---- chats, quota, log entries, dashboards


@query
def chat_window(spark, sf):
    return coaching.chat_window(A.table(spark, sf, "conversations"), CHAT_TURNS).select("conv_id", "turn", "role", "text")


@query
def internal_errors(spark, sf):
    rows = A.table(spark, sf, "conversations")
    said = F.when(F.col("turn") % 3 == 1, F.concat(F.lit(V.INTERNAL_ERROR_MARKERS[2]), F.lit(". "), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", M.is_internal_error(said).alias("internal_error"))


@query
def chat_messages(spark, sf):
    """Message lists as text: role and content of each, in order."""
    turns = A.table(spark, sf, "conversations")
    prompts = turns.groupBy("conv_id").agg(F.count("*").cast("string").alias("n")).select(
        "conv_id", F.concat(F.lit("what should I do after "), "n", F.lit(" turns?")).alias("prompt"))
    contexts = turns.filter(F.col("turn") == 0).select("conv_id", X.squeeze(F.col("text")).alias("context"))
    built = coaching.build_messages(prompts, turns, contexts, CHAT_TURNS, "Coach.", "Context: ")
    lines = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return built.select("conv_id", F.size("messages").alias("n"), F.array_join(lines, "\n").alias("messages"))


@query
def daily_quota(spark, sf):
    rows = activity.daily_quota(A.table(spark, sf, "events").select("event_id", "user_id", "ts"), QUOTA)
    return show(rows.select("event_id", "user_id", "day", "allowed", "used", "remaining", "resets_at"))


@query
def quota_rejections(spark, sf):
    return show(activity.quota_rejections(A.table(spark, sf, "events"), QUOTA))


@query
def ingest_valid(spark, sf):
    rows = activity.accepted_entries(A.log_entries(spark, sf))
    return show(rows.select("row_id", "user_id", "exercise", "sets", "reps", "weight", "date", "rpe", "rir", "logged_at"))


@query
def ingest_rejects(spark, sf):
    return activity.rejected_entries(A.log_entries(spark, sf)).select("row_id", "user_id", "reason")


@query
def appended_logs(spark, sf):
    """Accepted form entries appended to the existing rows, in the fixed column order."""
    logs = A.workouts(spark, sf)
    new = activity.accepted_entries(A.log_entries(spark, sf)).withColumn("row_id", F.col("row_id") + 10_000_000)
    return show(activity.append_entries(logs, new, ["row_id", *S.BASE_COLUMNS]))


@query
def dashboard_counts(spark, sf):
    chats = A.table(spark, sf, "conversations").select((F.col("conv_id") % 160).alias("user_id"))
    return activity.dashboard_counts(A.workouts(spark, sf), chats, A.profiles(spark, sf))


@query
def dashboard_latest(spark, sf):
    rows = activity.latest_logs(A.workouts(spark, sf), 5)
    return show(rows.select("user_id", "place", "row_id", "exercise", "date"))


@query
def logs_by_day(spark, sf):
    return show(activity.logs_by_day(A.workouts(spark, sf)))


@query
def available_periods(spark, sf):
    return activity.available_periods(A.workouts(spark, sf))


@query
def month_log(spark, sf):
    return show(activity.in_month(A.workouts(spark, sf), 2024, 1).select("row_id", "exercise", "date"))


@query
def log_listing(spark, sf):
    return show(activity.list_logs(A.workouts(spark, sf)).select("row_id", "date", "logged_at"))


@query
def date_texts(spark, sf):
    rows = A.workouts(spark, sf)
    return rows.select("row_id", D.pretty_date(F.col("date")).alias("pretty"), D.iso_seconds(F.col("logged_at")).alias("iso"),
                       D.format_date(F.col("date")).alias("day"), D.epoch_seconds(F.col("logged_at")).alias("epoch"),
                       D.month_name(F.col("date")).alias("month"),
                       D.iso_seconds(D.next_midnight(F.col("logged_at"))).alias("resets_at"),
                       N.format_number(F.col("weight")).alias("weight_text"), N.format_number(F.col("rpe")).alias("rpe_text"))


# ---- coaching context


@query
def latest_per_lift(spark, sf):
    return show(coaching.latest_per_lift(A.workouts(spark, sf)).select("user_id", "lift", "row_id", "exercise", "weight"))


@query
def deduped_lifts(spark, sf):
    rows = coaching.dedupe_lifts(coaching.latest_per_lift(A.workouts(spark, sf)))
    return rows.select("user_id", "lift", "row_id")


@query
def recent_k(spark, sf):
    return coaching.recent_rows(A.workouts(spark, sf), 3).select("user_id", "place", "row_id")


@query
def prediction_questions(spark, sf):
    return A.questions(spark, sf).select("question_id", M.is_prediction_question(F.col("question")).alias("asks"))


@query
def target_lift(spark, sf):
    rows = coaching.target_lifts(A.questions(spark, sf), A.workouts(spark, sf))
    return rows.select("question_id", "pass", "row_id", "exercise")


@query
def model_router(spark, sf):
    return coaching.model_router(A.workouts(spark, sf), ROUTER_ROWS)


@query
def history_block(spark, sf):
    return coaching.history_blocks(A.questions(spark, sf), A.workouts(spark, sf))


@query
def profile_block(spark, sf):
    return coaching.profile_blocks(A.questions(spark, sf), A.profiles(spark, sf))


@query
def prediction_block(spark, sf):
    return coaching.prediction_blocks(A.questions(spark, sf), A.workouts(spark, sf))


@query
def routed_prediction_block(spark, sf):
    """Busy users get the stored learned prediction, or the rule with a note where it is missing."""
    rows = A.workouts(spark, sf)
    learned = rows.filter(F.col("sets") > 2).select(
        "row_id", F.bround(F.col("weight") * 1.5, 2).alias("predicted_next_weight"), F.lit("Learned.").alias("reason"))
    return coaching.prediction_blocks(A.questions(spark, sf), rows, learned, ROUTER_ROWS)


@query
def excerpt_block(spark, sf):
    found = retrieval.retrieve(A.query_set(spark, sf), A.vectors(spark, sf), A.indexed_docs(spark, sf), 3)
    return coaching.excerpt_blocks(found)


@query
def context_blocks(spark, sf):
    found = retrieval.retrieve(A.question_vectors(spark, sf), A.vectors(spark, sf), A.indexed_docs(spark, sf), 3)
    return coaching.context_blocks(A.questions(spark, sf), found, A.workouts(spark, sf), A.profiles(spark, sf))


@query
def learned_contexts(spark, sf):
    """Contexts in which busy users get a fitted model's prediction after their newest row; its weight is masked."""
    train, _ = _train_test(spark, sf)
    whole = A.workouts(spark, sf)
    model = learning.train_boosted(pin(features.fill_features(features.history_features(train))))
    learned = pin(learning.predict_latest(model, whole).select("row_id", "predicted_next_weight", "reason"))
    found = retrieval.retrieve(A.question_vectors(spark, sf), A.vectors(spark, sf), A.indexed_docs(spark, sf), 3)
    rows = coaching.context_blocks(A.questions(spark, sf), found, whole, A.profiles(spark, sf), learned, ROUTER_ROWS)
    masked = F.regexp_replace("context", r"(XGBoost predicts next [^\n]*?: )[-0-9.]+ lb", "$1N lb")
    return rows.select("question_id", "user_id", masked.alias("context"))


# ---- links, pages, crawl logs


@query
def url_stems(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", U.file_stem(F.col("url")).alias("stem"))


@query
def site_names(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", U.site_name(F.col("url")).alias("site"))


@query
def video_ids(spark, sf):
    """Watch links, short links and others made of the page links."""
    kind = F.col("page_id") % 3
    link = (F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v=a%2Bb"), "page_id"))
            .when(kind == 1, F.concat(F.lit(" https://youtu.be/x"), "page_id", F.lit(" "))).otherwise(F.col("url")))
    return A.table(spark, sf, "pages").select("page_id", U.video_id(link).alias("video_id"))


@query
def html_titles(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", U.html_title(F.col("html")).alias("title"))


@query
def owner_names(spark, sf):
    page = F.concat("html", F.lit('<script>{"ownerChannelName":"Lift &amp; '), "page_id", F.lit('","x":1}</script>'))
    return A.table(spark, sf, "pages").select("page_id", U.owner_name(page).alias("owner"))


@query
def oembed_fields(spark, sf):
    payload = F.to_json(F.struct(F.regexp_extract("url", "//([a-z]+)", 1).alias("title"),
                                 F.when(F.col("page_id") % 4 == 0, "  ").otherwise(F.col("url")).alias("author_name")))
    return A.table(spark, sf, "pages").select("page_id", U.oembed_title(payload).alias("title"),
                                              U.oembed_author(payload).alias("author"))


@query
def video_fields(spark, sf):
    """The oEmbed answer first, the page second."""
    key = F.col("page_id")
    payload = F.when(key % 3 == 0, F.to_json(F.struct(F.concat(F.lit("Video "), key).alias("title"), F.lit(" ").alias("author_name")))).when(
        key % 3 == 1, '{"title": "  ", "author_name": ""}')
    page = F.when(key % 5 == 0, F.lit('"ownerChannelName":"Nobody"')).otherwise(
        F.concat(F.lit("<title>Page "), key, F.lit(' &amp; more - YouTube</title>{"ownerChannelName":"Lift '), key, F.lit('","x":1}')))
    return A.table(spark, sf, "pages").select("page_id", U.video_fields(payload, page).alias("f")).select("page_id", "f.*")


@query
def transcript_blocks(spark, sf):
    """Where transcript fetching stops: its blocks are worded in their own way, others do not count."""
    key = F.col("seq")
    said = F.when(F.col("message").isNotNull(), F.when(key % 3 == 0, "YouTube is blocking requests from your IP").when(
        key % 3 == 1, "RequestBlocked: try later").otherwise("403 Client Error: Forbidden"))
    return crawl.first_stop(A.crawl_log(spark, sf).withColumn("message", said), STREAK, transcripts=True)


@query
def author_lists(spark, sf):
    names = F.array(F.concat(F.lit(" "), "source"), F.lit("  "), F.col("lang"))
    return A.table(spark, sf, "documents").select("doc_id", X.join_authors(names).alias("authors"))


@query
def unprocessed_pages(spark, sf):
    rows = crawl.skip_existing(A.table(spark, sf, "pages").select("page_id", "url"), A.seen_pages(spark, sf), "page_id")
    return rows.select("page_id", "url")


@query
def link_scan(spark, sf):
    """Links as a text file with comments and blank lines, read as a link list."""
    path = scratch_path(spark, "links")
    rows = A.table(spark, sf, "pages")
    text = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), "url")).when(
        F.col("page_id") % 5 == 1, "   ").otherwise(F.concat(F.lit("  "), "url"))
    rows.select(text.alias("value")).write.text(path)
    return corpus.read_links(spark, path)


@query
def block_errors(spark, sf):
    return crawl.crawl_outcomes(A.crawl_log(spark, sf)).select("seq", "site", "blocked", "success")


@query
def block_streaks(spark, sf):
    return crawl.first_stop(A.crawl_log(spark, sf), STREAK)


@query
def transcripts(spark, sf):
    return crawl.join_transcript(A.table(spark, sf, "conversations"), "conv_id")


# ---- streams


def _event_stream(spark, sf):
    """The event table as a stream of files."""
    schema = A.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drain(stream, sink, name):
    jobs.run_available(stream, sink, scratch_path(stream.sparkSession, f"{name}-checkpoint"))


def _workout_stream(spark, sf):
    return A.as_workouts(_event_stream(spark, sf))


@query
def stream_ingest(spark, sf):
    folder = scratch_path(spark, "ingest")
    _drain(A.as_log_entries(_workout_stream(spark, sf)), jobs.ingest_sink(folder), "ingest")
    accepted = spark.read.parquet(f"{folder}/accepted")
    return show(accepted.select("row_id", "user_id", "exercise", "sets", "reps", "weight", "rpe", "rir", "logged_at"))


@query
def stream_rejects(spark, sf):
    folder = scratch_path(spark, "ingest")
    _drain(A.as_log_entries(_workout_stream(spark, sf)), jobs.ingest_sink(folder), "ingest")
    return spark.read.parquet(f"{folder}/rejected").select("row_id", "user_id", "reason")


@query
def stream_quota(spark, sf):
    folder = scratch_path(spark, "quota")
    _drain(_event_stream(spark, sf).select("event_id", "user_id", "ts"), jobs.quota_sink(folder, QUOTA), "quota")
    return show(spark.read.parquet(f"{folder}/accepted").select("event_id", "user_id", "day", "used"))


@query
def stream_lift_state(spark, sf):
    folder = scratch_path(spark, "lifts")
    _drain(_workout_stream(spark, sf), jobs.lift_state_sink(folder), "lifts")
    return show(jobs.lift_state(spark, folder).select("user_id", "exercise", "row_id", "weight", "logged_at"))


@query
def stream_predictions(spark, sf):
    folder = scratch_path(spark, "predictions")
    _drain(_workout_stream(spark, sf), jobs.prediction_sink(folder), "predictions")
    return show(spark.read.parquet(folder).select("row_id", "predicted_next_weight", "recommended_increment"))


@query
def stream_profiles(spark, sf):
    """Every event saves a profile; the last save of each user stays."""
    folder = scratch_path(spark, "profiles")
    saves = _event_stream(spark, sf).select("user_id", F.col("event_type").alias("goal"), F.col("ts").alias("updated_at"))
    _drain(saves, jobs.profile_sink(folder), "profiles")
    return jobs.current_profiles(spark, folder).select("user_id", "goal")


def _arrival_stream(spark, sf):
    """The events in many files, one per batch, with late and repeated ones."""
    folder = scratch_path(spark, "arrivals")
    rows = A.arrivals(spark, sf, SLICES)
    rows.repartition(SLICES, "slice").write.partitionBy("slice").parquet(folder)
    present = [r["slice"] for r in rows.select("slice").distinct().orderBy("slice").collect()]
    files.set_age_order(spark, [f"{folder}/slice={number}" for number in present])
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def stream_quota_state(spark, sf):
    """The quota as keyed state over many batches; prompts are answered in order of arrival."""
    folder, checkpoint = scratch_path(spark, "answers"), scratch_path(spark, "answers-checkpoint")
    prompts = _arrival_stream(spark, sf).select("event_id", "user_id", "ts")
    quota.start_quota(prompts, folder, checkpoint, QUOTA).awaitTermination()
    return show(quota.read_answers(spark, folder))


@query
def stream_lift_state_batches(spark, sf):
    """The folded lift state after many batches."""
    folder = scratch_path(spark, "lifts")
    _drain(A.as_workouts(_arrival_stream(spark, sf)), jobs.lift_state_sink(folder), "lifts")
    return show(jobs.lift_state(spark, folder).select("user_id", "exercise", "row_id", "weight", "logged_at"))


@query
def stream_profiles_batches(spark, sf):
    """The folded profiles after many batches."""
    folder = scratch_path(spark, "profiles")
    saves = _arrival_stream(spark, sf).select("user_id", F.col("event_type").alias("goal"), F.col("ts").alias("updated_at"))
    _drain(saves, jobs.profile_sink(folder), "profiles")
    return jobs.current_profiles(spark, folder).select("user_id", "goal")
