"""Next-weight predictor by rule: one projection, no user function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from setledger.functions.markers import exercise_class
from setledger.functions.numbers import known

MODEL_TYPE = "baseline_progressive_overload"
EXPORT_COLUMNS = ["predicted_next_weight", "recommended_increment", "top_factors", "reason", "model_type"]

# Weight steps in pounds by class, below and from the given weight on.
STEPS = {"lower_compound": (225.0, 5.0, 10.0), "upper_compound": (135.0, 2.5, 5.0)}
PLAIN_STEP = 2.5

# Per situation the multiplier, the factor label and the explanation.
STANDARD = (1.0, None, "Completed the session, so apply a standard progressive overload increase.")
RIR_NONE = (0.0, "no reps in reserve", "No reps left in reserve, so hold the weight steady next session.")
RIR_ONE = (0.5, "one rep in reserve", "Only one rep in reserve, so use a smaller increase next session.")
RIR_MANY = (1.25, "high reps in reserve", "Plenty of reps in reserve, so take a slightly larger increase.")
RPE_MAX = (0.0, "very high effort", "Very high effort set, so hold the weight steady next session.")
RPE_HARD = (0.5, "hard effort", "Hard effort set, so use a smaller increase next session.")
RPE_EASY = (1.25, "lower effort", "Lower effort set, so take a slightly larger increase.")
LOW_REP = (0.5, "low-rep low-set session",
           "Low-rep work usually progresses more conservatively, so use a smaller increase.")
HIGH_REP = (1.0, "higher-rep session completed",
            "Higher-rep work completed successfully, so apply a standard increase.")
NO_EFFORT = (1.0, "standard completed session", STANDARD[2])
UNLOADED_FACTORS = ["no external load logged", "bodyweight or unloaded movement"]
UNLOADED_REASON = "No external load logged, so the baseline keeps weight unchanged."


def class_step(kind: Column, weight: Column) -> Column:
    step = F.when(kind == "bodyweight", F.when(weight > 0, PLAIN_STEP).otherwise(0.0))
    for name, (threshold, light, heavy) in STEPS.items():
        step = step.when(kind == name, F.when(weight >= threshold, heavy).otherwise(light))
    return step.otherwise(PLAIN_STEP)


def base_increment(exercise: Column, weight: Column) -> Column:
    return class_step(exercise_class(exercise), weight)


OUTCOMES = [RIR_NONE, RIR_ONE, RIR_MANY, STANDARD, RPE_MAX, RPE_HARD, RPE_EASY, STANDARD, LOW_REP, HIGH_REP,
            NO_EFFORT]


def situation(sets: Column, reps: Column, rpe: Column, rir: Column) -> Column:
    """Position (from 1) in ``OUTCOMES``; reserve outranks perceived effort."""
    questions = [rir <= 0, rir == 1, rir >= 3, rir.isNotNull(), rpe >= 9.5, rpe >= 8.5, rpe <= 7, rpe.isNotNull(),
                 (reps <= 3) & (sets <= 2), reps >= 10]
    position = F.when(questions[0], 1)
    for i, question in enumerate(questions[1:], start=2):
        position = position.when(question, i)
    return position.otherwise(len(OUTCOMES))


def _of_case(part: int) -> Column:
    return F.element_at(F.array(*[F.lit(o[part]) for o in OUTCOMES]), F.col("_case"))


def predict_by_rule(df: DataFrame) -> DataFrame:
    """Add the prediction columns next to the input row (exercise, sets, reps, weight, rpe, rir).

    Class, situation and step are columns of their own, so each is computed once per row and the
    generated code stays small.
    """
    weight = F.col("weight")
    efforts = {c: known(F.col(c).cast("double")) for c in ("rpe", "rir")}
    staged = (df.withColumns({f"_{c}": e for c, e in efforts.items()})
              .withColumns({"_class": exercise_class(F.col("exercise")),
                            "_case": situation(F.col("sets"), F.col("reps"), F.col("_rpe"), F.col("_rir"))})
              .withColumn("_base", class_step(F.col("_class"), weight))
              .withColumn("_unloaded", weight <= 0)
              .withColumn("recommended_increment",
                          F.when(F.col("_unloaded"), 0.0).otherwise(F.bround(F.col("_base") * _of_case(0), 2))))
    effort = F.coalesce(F.concat(F.lit("rir="), F.col("_rir").cast("string")),
                        F.concat(F.lit("rpe="), F.col("_rpe").cast("string")),
                        F.lit("missing RPE/RIR, using reps/sets fallback"))
    factors = F.array_compact(F.array(
        F.concat(F.lit("base increment inferred as "), F.col("_base").cast("string")), effort, _of_case(1),
        F.concat(F.lit("increment applied="), F.col("recommended_increment").cast("string"))))
    unloaded = F.col("_unloaded")
    return staged.withColumns({
        "predicted_next_weight": F.when(unloaded, weight).otherwise(
            F.bround(weight + F.col("recommended_increment"), 2)),
        "top_factors": F.when(unloaded, F.array(*[F.lit(x) for x in UNLOADED_FACTORS])).otherwise(factors),
        "reason": F.when(unloaded, UNLOADED_REASON).otherwise(_of_case(2)),
        "model_type": F.lit(MODEL_TYPE),
    }).drop("_rpe", "_rir", "_class", "_case", "_base", "_unloaded")


def export_columns(predictions: DataFrame, key: str | None = None) -> DataFrame:
    return predictions.select(*([key] if key else []), *EXPORT_COLUMNS)
