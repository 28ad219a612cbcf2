"""Log entry checks, daily quota and dashboard reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from setledger.functions.numbers import parse_number, positive_or_missing
from setledger.functions.text import strip
from setledger.functions.times import month_name, next_midnight, pretty_date
from setledger.functions.vocabulary import DAILY_PROMPTS
from setledger.operators.ordering import ranked


def reject_reason() -> Column:
    """First failed check of a form entry, null when it is fine."""
    checks = [
        ("exercise is required", F.coalesce(strip(F.col("exercise")), F.lit("")) != ""),
        ("sets must be at least 1", F.col("sets") >= 1),
        ("reps must be at least 1", F.col("reps") >= 1),
        ("weight must be a number from 0", F.col("weight") >= 0),
        ("rpe must be 0 to 10", F.col("rpe").isNull() | F.col("rpe").between(0, 10)),
        ("rir must be 0 to 10", F.col("rir").isNull() | F.col("rir").between(0, 10)),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), reason) for reason, ok in checks])


def check_entries(entries: DataFrame) -> DataFrame:
    """Entries with a parsed weight and a ``reason`` that is null for acceptable ones."""
    weight = parse_number(F.col("weight_text"))
    return entries.withColumn("weight", weight).withColumn("reason", reject_reason())


def accepted_entries(entries: DataFrame) -> DataFrame:
    """Clean rows: trimmed name, zero effort as missing, whole-second times are the caller's."""
    good = check_entries(entries).filter(F.col("reason").isNull())
    return good.withColumns({
        "exercise": strip(F.col("exercise")),
        "rpe": positive_or_missing(F.col("rpe")),
        "rir": positive_or_missing(F.col("rir")),
        "date": F.to_date("logged_at"),
    }).drop("reason", "weight_text")


def rejected_entries(entries: DataFrame) -> DataFrame:
    return check_entries(entries).filter(F.col("reason").isNotNull()).drop("weight")


def append_entries(logs: DataFrame, entries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Existing rows and new rows in one fixed column order."""
    return logs.unionByName(entries, allowMissingColumns=True).select(*columns)


def daily_quota(prompts: DataFrame, limit: int = DAILY_PROMPTS, user: str = "user_id", at: str = "ts",
                order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Number each user's prompts of a day; the first ``limit`` are allowed.

    A rejected prompt does not count, so ``used`` stops at the limit and ``remaining`` at zero.
    """
    keyed = prompts.withColumn("day", F.to_date(at))
    numbered = ranked(keyed, [user, "day"], list(order), "_n")
    return (numbered.withColumn("allowed", F.col("_n") <= limit)
            .withColumn("used", F.least("_n", F.lit(limit).cast("bigint")))
            .withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0).cast("bigint")))
            .withColumn("resets_at", next_midnight(F.col(at)))
            .drop("_n"))


def quota_rejections(prompts: DataFrame, limit: int = DAILY_PROMPTS, user: str = "user_id",
                     at: str = "ts") -> DataFrame:
    """Prompts turned away per user and day; counting alone answers this."""
    return (prompts.groupBy(user, F.to_date(at).alias("day")).agg(F.count("*").alias("asked"))
            .filter(F.col("asked") > limit)
            .withColumn("rejected", F.col("asked") - limit))


def dashboard_counts(workouts: DataFrame, messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per user: logged rows, chat messages, whether a profile is saved."""
    logs = workouts.groupBy("user_id").agg(F.count("*").alias("workout_logs"))
    chats = messages.groupBy("user_id").agg(F.count("*").alias("chat_messages"))
    saved = profiles.select("user_id").distinct().withColumn("_saved", F.lit(True))
    joined = logs.join(chats, "user_id", "full_outer").join(saved, "user_id", "full_outer")
    zero = F.lit(0).cast("bigint")
    return joined.select("user_id", F.coalesce("workout_logs", zero).alias("workout_logs"),
                         F.coalesce("chat_messages", zero).alias("chat_messages"),
                         F.coalesce("_saved", F.lit(False)).alias("profile_saved"))


def latest_logs(workouts: DataFrame, n: int = 5) -> DataFrame:
    """The report of each user's ``n`` newest rows, undated rows last."""
    newest = W.partitionBy("user_id").orderBy(F.col("date").desc_nulls_last(), F.col("row_id"))
    return (workouts.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n))


def drop_undated(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("date").isNotNull())


def list_logs(logs: DataFrame) -> DataFrame:
    return drop_undated(logs).orderBy(F.desc("date"), F.desc("logged_at"))


def in_month(logs: DataFrame, year: int, month: int | None = None) -> DataFrame:
    """Rows of a year or of one month, as a date range that reaches the scan."""
    first = F.make_date(F.lit(year), F.lit(month or 1), F.lit(1))
    after = F.add_months(first, 12 if month is None else 1)
    return logs.filter((F.col("date") >= first) & (F.col("date") < after))


def logs_by_day(logs: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Rows per day with a readable label; newest day first is ``orderBy(desc('date'))``."""
    counted = drop_undated(logs).groupBy(*keys, "date").agg(F.count("*").alias("entries"))
    return counted.withColumn("label", F.concat(pretty_date(F.col("date")), F.lit(" ("),
                                                F.col("entries").cast("string"), F.lit(" exercise(s))")))


def available_periods(logs: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    dated = drop_undated(logs)
    return dated.select(*keys, F.year("date").alias("year"), F.month("date").alias("month"),
                        month_name(F.col("date")).alias("month_name")).distinct()
