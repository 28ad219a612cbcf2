"""Training-log views over the given star-schema tables.

Each view reads only the columns it needs, so pruning reaches the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from setledger.functions.times import start_of_day, start_of_week, truncate_seconds

# Exercise names by number.
EXERCISES = ["Squat (Barbell)", "Chin Up", "Lateral Raise (Dumbbells)", "Bench Press (Barbell)",
             "Leg press (hinge )", "Weighted dips", "Face pull", "Neutral Chin", "T-bar Row",
             "Romanian Deadlift (Barbell)", "Tricep pushdown", "Seated Shoulder  Press (Barbell)"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exercise_name(number: Column) -> Column:
    names = F.array(*[F.lit(x) for x in EXERCISES])
    return F.element_at(names, (number % len(EXERCISES) + 1).cast("int"))


def raw_sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        start_of_week(F.col("l_shipdate")).alias("set_ts"),
        exercise_name(F.col("l_partkey")).alias("exercise"),
        F.col("l_linenumber").alias("set_order"),
        (F.rint(F.col("l_discount") * 100) * 5).alias("weight"),
        (F.col("l_quantity").cast("int") % 13).alias("reps"))


def user_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Raw sets with a user: the part's supplier."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("user_id"),
        start_of_week(F.col("l_shipdate")).alias("set_ts"),
        exercise_name(F.col("l_partkey")).alias("exercise"),
        (F.rint(F.col("l_discount") * 100) * 5).alias("weight"),
        (F.col("l_quantity").cast("int") % 13).alias("reps"))


def workouts(spark: SparkSession, folder: str) -> DataFrame:
    return as_workouts(table(spark, folder, "events"))


def as_workouts(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    digits = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select(
        key.alias("row_id"), "user_id", exercise_name(key).alias("exercise"),
        (key % 5 + 1).cast("int").alias("sets"), (digits % 15 + 1).cast("int").alias("reps"),
        (F.floor(F.col("value") / 2.5) * 2.5).cast("double").alias("weight"),
        F.to_date("ts").alias("date"),
        F.when(key % 3 == 0, (6 + (key % 9) * 0.5).cast("double")).alias("rpe"),
        F.when(key % 4 == 1, (key % 5).cast("double")).alias("rir"),
        truncate_seconds(F.col("ts")).alias("logged_at"))


def workouts_tied(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows with times cut to the day, so that times tie."""
    return workouts(spark, folder).withColumn("logged_at", start_of_day(F.col("logged_at")))


def log_entries(spark: SparkSession, folder: str) -> DataFrame:
    return as_log_entries(workouts(spark, folder))


def as_log_entries(logs: DataFrame) -> DataFrame:
    """Form-like text input with bad numbers, blanks and zeros."""
    key = F.col("row_id")
    return logs.select(
        "row_id", "user_id", F.when(key % 19 == 0, "  ").otherwise(F.col("exercise")).alias("exercise"),
        F.when(key % 23 == 0, 0).otherwise(F.col("sets")).alias("sets"), "reps",
        F.when(key % 17 == 0, "abc").when(key % 17 == 1, "").otherwise(F.col("weight").cast("string")).alias("weight_text"),
        F.coalesce("rpe", F.lit(0.0)).alias("rpe"), F.coalesce("rir", F.lit(0.0)).alias("rir"), "logged_at")


def doc_meta(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, folder, "documents").select(
        key, F.when(key % 6 == 0, F.concat(F.lit("In this video "), "text")).otherwise(F.col("text")).alias("text"),
        F.substring("text", 1, 60).alias("title"),
        F.when(key % 3 == 0, "Video").otherwise("Article").alias("type"),
        F.when(key % 5 == 0, "strongerbyscience.com").when(key % 5 == 1, "barbellmedicine.com")
        .otherwise("example.org").alias("website"))


def raw_docs(spark: SparkSession, folder: str) -> DataFrame:
    key, n = F.col("doc_id"), F.col("doc_id").cast("string")
    third = F.when(key % 7 == 0, "SITE: ").otherwise("WEBSITE: ")
    record = F.concat(F.lit("TITLE: Document "), n, F.lit("\nAUTHOR: "), "source", F.lit("\n"), third,
                      F.lit("example.org\nURL: https://example.org/"), n, F.lit("\nTYPE: Article\n\n"), "text")
    return table(spark, folder, "documents").select(
        key, F.when(key % 11 == 0, "[ERROR] 403 Client Error\nURL: x").when(key % 13 == 0, "   ")
        .otherwise(record).alias("raw_text"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")


def indexed_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as chunks, keyed like their vectors."""
    return doc_meta(spark, folder).withColumn("chunk_key", F.col("doc_id"))


def query_set(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as queries, with the vector of the same number."""
    items = table(spark, folder, "benchmark")
    stored = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    text = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("what is "), "text")).otherwise(F.col("text"))
    return items.join(stored, F.col("item_id") == F.col("vec_id")).select(
        F.col("vec_id").alias("query_id"), "query_vec", text.alias("query_text"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of the chats as questions of logged users; some ask for a next weight, by
    exercise name, by lift, or by neither, and some users have no log."""
    key = F.col("conv_id") * 100 + F.col("turn")
    kind = key % 7
    name = exercise_name(F.col("conv_id"))
    lead = (F.when(kind == 0, F.concat(F.lit("What weight should I use for "), name, F.lit(" next session? ")))
            .when(kind == 1, "what should I squat ").when(kind == 2, "How to fix my deadlift lockout ")
            .when(kind == 3, "next workout ideas ").when(kind == 4, F.concat(F.lit("Next weight on "), F.lower(name), F.lit("? ")))
            .when(kind == 5, "zzz next weight ").otherwise(""))
    return (table(spark, folder, "conversations").filter(F.col("role") == "user")
            .select(key.alias("question_id"), (F.col("conv_id") % 160).alias("user_id"),
                    F.concat(lead, "text").alias("question")))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    equipment = F.when(key % 3 == 0, F.array(F.lit("Barbell"), F.lit("Bands"))).when(
        key % 3 == 1, F.array(F.lit("Dumbbells"))).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "customer").select(
        key.alias("user_id"), F.when(key % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("goal"),
        F.when(key % 3 == 0, "Beginner").when(key % 3 == 1, "Intermediate").otherwise("Advanced").alias("experience_level"),
        equipment.alias("equipment_access"), (key % 7 + 1).cast("int").alias("training_frequency"))


def crawl_log(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    failed = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        key.alias("seq"), (F.col("user_id") % 10).alias("site"),
        F.when(failed & (key % 3 < 2), "403 Client Error: Forbidden").when(failed, "timed out").alias("message"))


def seen_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages fetched without encryption count as processed already."""
    return table(spark, folder, "pages").filter(F.col("url").startswith("http://")).select("page_id")


def text_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The set log as text, as a CSV file would give it, with unreadable and blank values."""
    name = exercise_name(F.col("l_partkey"))
    nameless = (F.col("l_tax") == 0) & (F.col("l_linenumber") == 7)
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_quantity") == 50, "soon").otherwise(
            F.date_format(start_of_week(F.col("l_shipdate")), "yyyy-MM-dd HH:mm:ss")).alias("Date"),
        F.when(nameless, "   ").otherwise(F.concat(F.lit(" "), name, F.lit(" "))).alias("Exercise Name"),
        F.col("l_linenumber").cast("string").alias("Set Order"),
        F.when(F.col("l_returnflag") == "R", "5d").otherwise(
            (F.rint(F.col("l_discount") * 100) * 5).cast("string")).alias("Weight"),
        (F.col("l_quantity").cast("int") % 13).cast("string").alias("Reps"))


def question_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Questions as retrieval queries, with the vector of the conversation's number."""
    stored = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    asked = questions(spark, folder).withColumn("conv_id", F.floor(F.col("question_id") / 100))
    return asked.join(stored, F.col("conv_id") == F.col("vec_id")).select(
        F.col("question_id").alias("query_id"), "query_vec", F.col("question").alias("query_text"))


def masked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a 0/1 mask: documents labelled as poor do not count."""
    scored = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    return table(spark, folder, "embeddings").join(scored, "vec_id", "left").select(
        "vec_id", "label", "embedding", F.coalesce("quality", F.lit(1)).alias("mask"))


def arrivals(spark: SparkSession, folder: str, slices: int) -> DataFrame:
    """Events in the order in which they might arrive: ``slice`` follows the event ids, some events come one slice
    late, and some are delivered again three slices later."""
    key = F.col("event_id")
    events = table(spark, folder, "events")
    total = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    placed = events.withColumn("_due", F.floor(key * slices / total))
    late = F.when(key % 7 == 3, 1).otherwise(0)
    first = placed.withColumn("slice", F.least(F.col("_due") + late, F.lit(slices - 1)))
    again = placed.filter(key % 10 == 0).withColumn("slice", F.least(F.col("_due") + 3, F.lit(slices - 1)))
    return first.union(again).select(*events.columns, F.col("slice").cast("int"))
