"""The catalog's queries as SQL over the same tables, for checking results with another engine."""

from __future__ import annotations

from setledger.functions import vocabulary as V
from setledger.operators import rules
from setledger.plans.catalog import CHAT_TURNS, QUOTA, ROUTER_ROWS, STREAK
from setledger.schemas import DOCUMENT_FIELDS
from setledger.sources.fixtures import EXERCISES

VIEWS: dict[str, str] = {}
SQL: dict[str, str] = {}

_ISO = "'%Y-%m-%dT%H:%M:%S'"
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAKS = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def iso(c: str) -> str:
    return f"strftime({c}, {_ISO})"


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def r6(c: str) -> str:
    return f"round_even(CAST({c} AS DOUBLE), 6)"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


def normalized(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def excerpt(chars: int) -> str:
    return f"substring(trim(regexp_replace(text, '{_SPACES}+', ' ', 'g')), 1, {chars})"


def number_text(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
            f"ELSE regexp_replace(CAST(round_even({c}, 1) AS VARCHAR), '\\.0$', '') END")


def add(name: str, body: str) -> None:
    """A query; every view it names, directly or through another view, is put in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for view in VIEWS:
            if view not in needed and any(f"{lead}{view}{tail}" in text for lead in (" ", "(") for tail in (" ", "\n", ")", ",")):
                need(" " + VIEWS[view] + " ")
                if view not in needed:
                    needed.append(view)

    need(" " + body + " ")
    # views appear in definition order, which is dependency order
    heads = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed]
    recursive = "WITH " if heads else ""
    SQL[name] = recursive + ",\n".join(heads) + "\n" + body


# ---- views

VIEWS["v_exercise"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(n)})" for i, n in enumerate(EXERCISES)) + ") AS t(ex_id, exercise)"
VIEWS["v_raw_sets"] = """
SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS set_ts, exercise, l_linenumber AS set_order, l_suppkey AS user_id,
       round(l_discount * 100) * 5 AS weight, CAST(l_quantity AS INT) % 13 AS reps
FROM lineitem JOIN v_exercise ON ex_id = l_partkey % 12 """
VIEWS["v_text_sets"] = """
SELECT CASE WHEN l_quantity = 50 THEN NULL ELSE date_trunc('week', l_shipdate)::TIMESTAMP END AS set_ts,
       CASE WHEN l_tax = 0 AND l_linenumber = 7 THEN '' ELSE exercise END AS exercise, l_linenumber AS set_order,
       CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE round(l_discount * 100) * 5 END AS weight,
       CAST(CAST(l_quantity AS INT) % 13 AS DOUBLE) AS reps
FROM lineitem JOIN v_exercise ON ex_id = l_partkey % 12 """


def session_views(prefix: str, source: str, keys: str) -> None:
    VIEWS[f"{prefix}_valid"] = f"SELECT * FROM {source} WHERE set_ts IS NOT NULL AND exercise <> '' AND (weight > 0 OR reps > 0) "
    VIEWS[f"{prefix}_votes"] = f"SELECT {keys}, weight AS w, count(*) AS votes FROM {prefix}_valid GROUP BY {keys}, weight "
    VIEWS[f"{prefix}_work"] = (f"SELECT {keys}, coalesce(arg_max(w, row(votes, w)) FILTER (WHERE w > 0), 0.0) AS ww "
                               f"FROM {prefix}_votes GROUP BY {keys} ")
    VIEWS[f"{prefix}_sessions"] = f"""
SELECT {keys}, greatest(1, count(*)) AS sets,
       greatest(0, CAST(round_even(median(CAST(reps AS DOUBLE)), 0) AS INT)) AS reps,
       round_even(any_value(ww), 2) AS weight, CAST(set_ts AS DATE) AS date, set_ts AS logged_at
FROM {prefix}_valid JOIN {prefix}_work USING ({keys}) WHERE weight = ww GROUP BY {keys} """


session_views("v_one", "v_raw_sets", "set_ts, exercise")
session_views("v_user", "v_raw_sets", "user_id, set_ts, exercise")
session_views("v_text", "v_text_sets", "set_ts, exercise")

VIEWS["v_one_labelled"] = """
SELECT * FROM (SELECT exercise, sets, reps, weight, date, CAST(NULL AS DOUBLE) AS rpe, CAST(NULL AS DOUBLE) AS rir, logged_at,
  round_even(lead(weight) OVER (PARTITION BY exercise ORDER BY date, logged_at), 2) AS actual_next_weight
  FROM v_one_sessions ) WHERE actual_next_weight IS NOT NULL """
VIEWS["v_user_labelled"] = """
SELECT * FROM (SELECT user_id, exercise, sets, reps, weight, date, logged_at,
  round_even(lead(weight) OVER (PARTITION BY user_id, exercise ORDER BY date, logged_at), 2) AS actual_next_weight
  FROM v_user_sessions ) WHERE actual_next_weight IS NOT NULL """


def split_of(source: str, order: str) -> str:
    return f"""
SELECT *, CASE WHEN row_number() OVER (ORDER BY {order}) <= CAST(floor(count(*) OVER () * CAST({V.TRAIN_RATIO} AS DOUBLE)) AS BIGINT)
          THEN 'train' ELSE 'test' END AS dataset FROM {source} """


VIEWS["v_one_split"] = split_of("v_one_labelled", "logged_at, date, exercise")
VIEWS["v_user_split"] = split_of("v_user_labelled", "logged_at, date, exercise, user_id")

VIEWS["v_workouts"] = """
SELECT event_id AS row_id, user_id, exercise, CAST(event_id % 5 + 1 AS INT) AS sets,
       CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 15 + 1 AS INT) AS reps,
       CAST(floor(value / CAST(2.5 AS DOUBLE)) * CAST(2.5 AS DOUBLE) AS DOUBLE) AS weight, CAST(ts AS DATE) AS date,
       CASE WHEN event_id % 3 = 0 THEN CAST(6 + (event_id % 9) * 0.5 AS DOUBLE) END AS rpe,
       CASE WHEN event_id % 4 = 1 THEN CAST(event_id % 5 AS DOUBLE) END AS rir,
       date_trunc('second', ts) AS logged_at
FROM events JOIN v_exercise ON ex_id = event_id % 12 """
VIEWS["v_tied"] = """
SELECT row_id, user_id, exercise, sets, reps, weight, date, rpe, rir, CAST(date_trunc('day', logged_at) AS TIMESTAMP) AS logged_at
FROM v_workouts """
VIEWS["v_entries"] = """
SELECT row_id, user_id, CASE WHEN row_id % 19 = 0 THEN '' ELSE exercise END AS exercise,
       CASE WHEN row_id % 23 = 0 THEN 0 ELSE sets END AS sets, reps,
       CASE WHEN row_id % 17 IN (0, 1) THEN NULL ELSE weight END AS weight,
       coalesce(rpe, 0.0) AS rpe, coalesce(rir, 0.0) AS rir, logged_at FROM v_workouts """
VIEWS["v_checked"] = """
SELECT *, CASE WHEN exercise = '' THEN 'exercise is required' WHEN sets < 1 THEN 'sets must be at least 1'
   WHEN reps < 1 THEN 'reps must be at least 1' WHEN weight IS NULL OR weight < 0 THEN 'weight must be a number from 0'
   WHEN rpe NOT BETWEEN 0 AND 10 THEN 'rpe must be 0 to 10' WHEN rir NOT BETWEEN 0 AND 10 THEN 'rir must be 0 to 10' END AS reason
FROM v_entries """


# ---- rule model

def classes(c: str, order: list[tuple[str, list[str]]], other: str) -> str:
    cases = " ".join(f"WHEN {any_of(f'lower(trim({c}))', words)} THEN '{name}'" for name, words in order)
    return f"CASE {cases} ELSE '{other}' END"


INCREMENT_CLASS = classes("exercise", [("lower_compound", V.LOWER_COMPOUND), ("upper_compound", V.UPPER_COMPOUND),
                                       ("isolation", V.ISOLATION), ("bodyweight", V.BODYWEIGHT)], "other")
MODEL_GROUP = classes("exercise", [("bodyweight", V.BODYWEIGHT), ("lower_compound", V.LOWER_COMPOUND),
                                   ("upper_compound", V.UPPER_COMPOUND), ("isolation", V.ISOLATION)], "global")
BASE_STEP = f"""CAST(CASE {INCREMENT_CLASS} WHEN 'lower_compound' THEN CASE WHEN weight >= 225 THEN 10 ELSE 5 END
  WHEN 'upper_compound' THEN CASE WHEN weight >= 135 THEN 5 ELSE 2.5 END
  WHEN 'bodyweight' THEN CASE WHEN weight > 0 THEN 2.5 ELSE 0 END ELSE 2.5 END AS DOUBLE)"""


def rule_of(source: str) -> str:
    """Rule predictions next to the columns of ``source``."""
    def outcome(o: tuple) -> str:
        label = q(o[1]) if o[1] else "NULL"
        return f"{{'m': CAST({o[0]} AS DOUBLE), 'label': {label}, 'why': {q(o[2])}}}"
    return f"""
SELECT * EXCLUDE (b, o), CASE WHEN weight <= 0 THEN 0.0 ELSE round_even(b * o.m, 2) END AS recommended_increment,
  CASE WHEN weight <= 0 THEN weight ELSE round_even(weight + round_even(b * o.m, 2), 2) END AS predicted_next_weight,
  CASE WHEN weight <= 0 THEN {q('|'.join(rules.UNLOADED_FACTORS))} ELSE
    concat_ws('|', 'base increment inferred as ' || CAST(b AS VARCHAR),
      CASE WHEN rir IS NOT NULL THEN 'rir=' || CAST(rir AS VARCHAR) WHEN rpe IS NOT NULL THEN 'rpe=' || CAST(rpe AS VARCHAR)
           ELSE 'missing RPE/RIR, using reps/sets fallback' END,
      o.label, 'increment applied=' || CAST(round_even(b * o.m, 2) AS VARCHAR)) END AS top_factors,
  CASE WHEN weight <= 0 THEN {q(rules.UNLOADED_REASON)} ELSE o.why END AS reason, {q(rules.MODEL_TYPE)} AS model_type
FROM (SELECT *, {BASE_STEP} AS b,
  CASE WHEN rir <= 0 THEN {outcome(rules.RIR_NONE)} WHEN rir = 1 THEN {outcome(rules.RIR_ONE)}
       WHEN rir >= 3 THEN {outcome(rules.RIR_MANY)} WHEN rir IS NOT NULL THEN {outcome(rules.STANDARD)}
       WHEN rpe >= 9.5 THEN {outcome(rules.RPE_MAX)} WHEN rpe >= 8.5 THEN {outcome(rules.RPE_HARD)}
       WHEN rpe <= 7 THEN {outcome(rules.RPE_EASY)} WHEN rpe IS NOT NULL THEN {outcome(rules.STANDARD)}
       WHEN reps <= 3 AND sets <= 2 THEN {outcome(rules.LOW_REP)} WHEN reps >= 10 THEN {outcome(rules.HIGH_REP)}
       ELSE {outcome(rules.NO_EFFORT)} END AS o FROM {source} ) """


VIEWS["v_ruled"] = rule_of("v_workouts")
VIEWS["v_one_ruled"] = rule_of("v_one_split")


def errors_of(source: str, extra: str = "") -> str:
    return f"""SELECT *, abs(error) AS absolute_error, error * error AS squared_error, abs(error) <= 2.5 AS within_2_5_lb,
  abs(error) <= 5 AS within_5_lb, abs(error) <= 10 AS within_10_lb
FROM (SELECT *, predicted_next_weight - actual_next_weight AS error FROM {source} {extra}) """


VIEWS["v_scored"] = errors_of("v_one_ruled", "WHERE dataset = 'test'")
METRICS = """CAST(count(*) AS DOUBLE) AS rows_evaluated, round_even(avg(absolute_error), 3) AS mae,
  round_even(sqrt(avg(squared_error)), 3) AS rmse, round_even(avg(squared_error), 3) AS mse,
  round_even(avg(error), 3) AS mean_signed_error, round_even(avg(CAST(within_2_5_lb AS DOUBLE)), 4) AS within_2_5_lb_accuracy,
  round_even(avg(CAST(within_5_lb AS DOUBLE)), 4) AS within_5_lb_accuracy,
  round_even(avg(CAST(within_10_lb AS DOUBLE)), 4) AS within_10_lb_accuracy"""
PER_EXERCISE = """SELECT exercise, count(*) AS samples, round_even(avg(absolute_error), 3) AS mae,
  round_even(sqrt(avg(squared_error)), 3) AS rmse, round_even(avg(error), 3) AS mean_signed_error,
  round_even(avg(CAST(within_5_lb AS DOUBLE)), 3) AS within_5_lb_accuracy
FROM v_scored GROUP BY exercise"""

add("clean_sets", f"SELECT {iso('set_ts')} AS set_ts, exercise, set_order, {r6('weight')} AS weight, {r6('reps')} AS reps FROM v_text_valid ")


def session_columns(source: str, extra: str = "") -> str:
    return (f"SELECT {extra}exercise, sets, reps, weight, {day('date')} AS date, CAST(NULL AS DOUBLE) AS rpe, "
            f"CAST(NULL AS DOUBLE) AS rir, {iso('logged_at')} AS logged_at FROM {source} ")


add("collapse_sessions", session_columns("v_one_sessions"))
add("collapse_user_sessions", session_columns("v_user_sessions", "user_id, "))
add("raw_set_scan", session_columns("v_text_sessions"))
for name, column in (("working_weight", "weight"), ("set_count", "sets"), ("typical_reps", "reps")):
    add(name, f"SELECT {iso('logged_at')} AS logged_at, exercise, {column} FROM v_one_sessions ")
add("sorted_sessions", f"SELECT {day('date')} AS date, exercise, weight FROM v_one_sessions ORDER BY date, exercise")
add("next_weight_labels", f"SELECT user_id, exercise, {iso('logged_at')} AS logged_at, weight, actual_next_weight FROM v_user_labelled ")
add("chronological_split", f"SELECT exercise, {iso('logged_at')} AS logged_at, weight, actual_next_weight, dataset FROM v_one_split ")
add("chronological_split_users", f"SELECT user_id, exercise, {iso('logged_at')} AS logged_at, dataset FROM v_user_split ")
add("supervised_round_trip", f"""SELECT exercise, sets, reps, weight, {day('date')} AS date, {iso('logged_at')} AS logged_at,
  actual_next_weight, {MODEL_GROUP} AS model_group FROM v_one_split WHERE dataset = 'train'""")
add("training_tables", f"""SELECT part, exercise, weight, {iso('logged_at')} AS logged_at, actual_next_weight
FROM v_one_split JOIN (VALUES ('workouts', 'train'), ('workouts', 'test'), ('train_workouts', 'train'), ('test_workouts', 'test')) AS p(part, held)
  ON held = dataset""")
add("exercise_class", f"""SELECT p_partkey, exercise, {INCREMENT_CLASS} AS increment_class, {MODEL_GROUP} AS model_group
FROM part JOIN v_exercise ON ex_id = p_partkey % 12""")
add("base_increment", f"SELECT row_id, exercise, weight, {BASE_STEP} AS base_increment FROM v_workouts ")
add("rule_predictions", f"SELECT row_id, exercise, weight, {', '.join(rules.EXPORT_COLUMNS)} FROM v_ruled ")
add("zero_effort_predictions", "SELECT row_id, predicted_next_weight FROM v_ruled ")
add("error_columns", f"""SELECT exercise, {iso('logged_at')} AS logged_at, {r6('error')} AS error, {r6('absolute_error')} AS absolute_error,
  {r6('squared_error')} AS squared_error, within_2_5_lb, within_5_lb, within_10_lb FROM v_scored """)
add("overall_metrics", f"SELECT {METRICS} FROM v_scored ")
add("per_exercise_metrics", PER_EXERCISE)
add("top_exercises", PER_EXERCISE + " ORDER BY samples DESC, avg(absolute_error), exercise LIMIT 10")
VIEWS["v_models"] = errors_of("""(
  SELECT 'rule' AS model, actual_next_weight, predicted_next_weight FROM v_one_ruled WHERE dataset = 'test'
  UNION ALL SELECT 'rule on training rows', actual_next_weight, predicted_next_weight FROM v_one_ruled WHERE dataset = 'train'
  UNION ALL SELECT 'no change', actual_next_weight, weight FROM v_one_ruled WHERE dataset = 'test')""")
add("model_report", f"SELECT model, {METRICS} FROM v_models GROUP BY model")
add("error_histogram", f"""SELECT bin, round_even(min(lo + bin * (hi - lo) / 30), 6) AS bin_start, count(*) AS n FROM (
  SELECT lo, hi, CAST(least(floor((error - lo) / (hi - lo) * 30), 29) AS INT) AS bin
  FROM v_scored CROSS JOIN (SELECT min(error) AS lo, max(error) AS hi FROM v_scored )) GROUP BY bin""")
add("prediction_range", """SELECT least(min(actual_next_weight), min(predicted_next_weight)) AS min_weight,
  greatest(max(actual_next_weight), max(predicted_next_weight)) AS max_weight FROM v_scored """)
add("prediction_table_round_trip", f"SELECT {METRICS} FROM v_scored ")
add("rebuilt_user_table", session_columns("v_text_sessions"))
add("lenient_log_read", f"""SELECT row_id, exercise, sets, CAST(NULL AS INT) AS reps, weight, {day('date')} AS date, CAST(NULL AS DOUBLE) AS rpe,
  CAST(NULL AS DOUBLE) AS rir, CAST(NULL AS VARCHAR) AS logged_at FROM v_workouts """)
add("log_listing", f"SELECT row_id, {day('date')} AS date, {iso('logged_at')} AS logged_at FROM v_workouts ")
add("train_rows_per_group", f"""SELECT 'global' AS model_group, count(*) AS train_rows FROM v_one_split WHERE dataset = 'train'
UNION ALL SELECT g, count(*) FROM (SELECT {MODEL_GROUP} AS g FROM v_one_split WHERE dataset = 'train') WHERE g <> 'global' GROUP BY g""")
add("routed_groups", f"""SELECT row_id, exercise, CASE WHEN g IN ('upper_compound', 'bodyweight') THEN g ELSE 'global' END AS model_group
FROM (SELECT row_id, exercise, {MODEL_GROUP} AS g FROM v_workouts )""")

# ---- features

_EFFORT = ["sets", "reps", "weight", "rpe", "rir"]


def feature_columns(fill: bool) -> str:
    def shown(expr: str, name: str) -> str:
        value = f"coalesce({expr}, 0)" if fill else expr
        return f"{r6(value)} AS {name}"
    cols = [shown(c, c) for c in _EFFORT]
    cols += [shown(f"previous_{k}_{c}", f"previous_{k}_{c}") for k in (1, 2, 3) for c in _EFFORT]
    cols += [shown("previous_3_weight_avg", "previous_3_weight_avg"), shown("previous_3_reps_avg", "previous_3_reps_avg"),
             shown("previous_1_weight - previous_2_weight", "previous_weight_change")]
    cols.append(r6("history_count") + " AS history_count" if fill else "history_count")
    return ", ".join(cols)


_LAGS = ", ".join(f"lag({c}, {k}) OVER w AS previous_{k}_{c}" for k in (1, 2, 3) for c in _EFFORT)
VIEWS["v_lagged"] = f"""
SELECT *, {_LAGS}, avg(weight) OVER r AS previous_3_weight_avg, avg(reps) OVER r AS previous_3_reps_avg,
  least(row_number() OVER w - 1, 3) AS history_count FROM v_workouts
WINDOW w AS (PARTITION BY user_id, exercise ORDER BY logged_at, date, row_id),
       r AS (PARTITION BY user_id, exercise ORDER BY logged_at, date, row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) """
add("history_features", f"SELECT row_id, user_id, exercise, {feature_columns(False)} FROM v_lagged ")
add("filled_features", f"""SELECT row_id, user_id, exercise, {feature_columns(True)},
  CASE WHEN date < DATE '2024-01-20' THEN 'train' ELSE 'test' END AS dataset FROM v_lagged """)
_PAST = ", ".join(f"max(CASE WHEN n = {k} THEN p_{c} END) AS previous_{k}_{c}" for k in (1, 2, 3) for c in _EFFORT)
VIEWS["v_past"] = f"""
SELECT row_id, {_PAST}, avg(p_weight) AS previous_3_weight_avg, avg(p_reps) AS previous_3_reps_avg, count(*) AS history_count
FROM (SELECT w.row_id, {', '.join(f'p.{c} AS p_{c}' for c in _EFFORT)},
        row_number() OVER (PARTITION BY w.row_id ORDER BY p.logged_at DESC, p.date DESC, p.row_id DESC) AS n
      FROM v_tied w JOIN v_tied p ON p.user_id = w.user_id AND p.exercise = w.exercise AND p.logged_at < w.logged_at)
WHERE n <= 3 GROUP BY row_id """
add("strict_past_features", f"""SELECT row_id, user_id, exercise, {feature_columns(False)} FROM (
  SELECT v_tied.*, v_past.* EXCLUDE (row_id, history_count), coalesce(history_count, 0) AS history_count
  FROM v_tied LEFT JOIN v_past ON v_past.row_id = v_tied.row_id)""")

add("latest_features", f"""SELECT row_id, user_id, exercise, {feature_columns(True)} FROM (
  SELECT v_tied.*, v_past.* EXCLUDE (row_id, history_count), coalesce(history_count, 0) AS history_count
  FROM v_tied LEFT JOIN v_past ON v_past.row_id = v_tied.row_id
  QUALIFY row_number() OVER (PARTITION BY v_tied.user_id, v_tied.exercise ORDER BY logged_at DESC, date DESC, v_tied.row_id) = 1)""")
_NUMBERS = [*_EFFORT, *[f"previous_{k}_{c}" for k in (1, 2, 3) for c in _EFFORT], "previous_3_weight_avg", "previous_3_reps_avg",
            "previous_1_weight - previous_2_weight", "history_count"]
add("assembled_vectors", f"""SELECT row_id, exercise, CAST({len(_NUMBERS)} + (SELECT count(DISTINCT exercise) FROM v_workouts ) AS INT) AS width,
  round_even(CAST({' + '.join(f'coalesce({c}, 0)' for c in _NUMBERS)} AS DOUBLE), 3) AS total,
  dense_rank() OVER (ORDER BY exercise) - 1 AS name_column FROM v_lagged """)

# ---- stored models, tables and their order

VIEWS["v_log_labelled"] = """
SELECT * FROM (SELECT *, round_even(lead(weight) OVER (PARTITION BY user_id, exercise ORDER BY date, logged_at, row_id), 2) AS actual_next_weight
  FROM v_workouts ) WHERE actual_next_weight IS NOT NULL """
VIEWS["v_log_split"] = split_of("v_log_labelled", "logged_at, date, exercise, row_id")
VIEWS["v_log_renamed"] = """
SELECT * REPLACE (CASE WHEN dataset = 'test' AND row_id % 9 = 0 THEN 'Sled Push' ELSE exercise END AS exercise) FROM v_log_split """
VIEWS["v_log_past"] = f"""
SELECT row_id, {_PAST}, avg(p_weight) AS previous_3_weight_avg, avg(p_reps) AS previous_3_reps_avg, count(*) AS history_count
FROM (SELECT w.row_id, {', '.join(f'p.{c} AS p_{c}' for c in _EFFORT)},
        row_number() OVER (PARTITION BY w.row_id ORDER BY p.logged_at DESC, p.date DESC, p.row_id DESC) AS n
      FROM v_log_renamed w JOIN v_log_renamed p ON p.user_id = w.user_id AND p.exercise = w.exercise AND p.logged_at < w.logged_at)
WHERE n <= 3 GROUP BY row_id """
VIEWS["v_log_routed"] = f"""SELECT *, {MODEL_GROUP} AS own, CASE WHEN {MODEL_GROUP} = 'isolation' THEN 'global' ELSE {MODEL_GROUP} END AS used
FROM v_log_renamed """
add("restored_groups", f"""SELECT w.row_id, exercise, used AS model_group, {r6('weight')} AS current_weight,
  'current workout row|previous 3 same-exercise performances|' || used || ' XGBoost plus regressor' AS top_factors,
  'Predicted from the category-specific XGBoost plus model using current row features and available same-exercise history.' AS reason,
  'xgboost_plus_regressor' AS model_type, true AS gain_fits,
  CAST({len(_NUMBERS)} + (SELECT count(DISTINCT exercise) + count(DISTINCT {MODEL_GROUP}) FROM v_log_split ) AS INT) AS width,
  round_even(CAST({' + '.join(f'coalesce({c}, 0)' for c in _NUMBERS)} AS DOUBLE), 3) AS numbers,
  CAST(exercise IN (SELECT exercise FROM v_log_split ) AS INT)
  + CAST(own IN (SELECT {MODEL_GROUP} FROM v_log_split ) AS INT)::DOUBLE AS names
FROM v_log_routed w LEFT JOIN v_log_past ON v_log_past.row_id = w.row_id WHERE dataset = 'test'""")

VIEWS["v_no_effort"] = "SELECT * REPLACE (CAST(NULL AS DOUBLE) AS rpe, CAST(NULL AS DOUBLE) AS rir) FROM v_workouts "
VIEWS["v_no_effort_ruled"] = rule_of("v_no_effort")
add("rule_model_table", "SELECT row_id, predicted_next_weight, reason FROM v_no_effort_ruled ")
add("sorted_sets", f"""SELECT row_number() OVER (ORDER BY set_ts, exercise, set_order) - 1 AS place, {iso('set_ts')} AS set_ts, exercise, set_order
FROM v_one_valid """)
add("sorted_supervised", f"""SELECT row_number() OVER (ORDER BY logged_at, exercise) - 1 AS place, {iso('logged_at')} AS logged_at, exercise
FROM v_user_labelled """)
add("restored_order", f"""SELECT row_number() OVER (ORDER BY row_id) - 1 AS place, row_id, exercise, CASE WHEN row_id % 8 <> 0 THEN sets END AS sets, weight,
  CASE WHEN row_id % 8 <> 0 THEN rpe END AS rpe FROM v_workouts """)
add("stored_report", """SELECT 'metrics' AS part, '' AS name, round_even(avg(absolute_error), 3) AS mae FROM v_scored
UNION ALL SELECT 'per_exercise_metrics', exercise, round_even(avg(absolute_error), 3) FROM v_scored GROUP BY exercise
UNION ALL SELECT 'model_report', 'rule', round_even(avg(absolute_error), 3) FROM v_scored """)
add("text_corpus", f"""SELECT 1 AS folder, item_id, {strip('text')} AS raw_text FROM benchmark WHERE item_id % 10 <> 0""")
add("video_fields", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Video ' || page_id WHEN page_id % 5 <> 0 THEN 'Page ' || page_id || ' & more' END AS title,
  CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 'Lift ' || page_id END AS author FROM pages""")
VIEWS["v_transcripts"] = """
SELECT event_id AS seq, user_id % 10 AS site, event_type = 'error' AND event_id % 3 < 2 AS blocked, event_type <> 'error' AS success FROM events """

add("stored_month", f"""SELECT user_id, exercise, {day('date')} AS date, weight FROM v_user_sessions WHERE year(date) = 1995 AND month(date) = 3""")
add("stored_year", f"SELECT user_id, exercise, {day('date')} AS date, weight FROM v_user_sessions WHERE year(date) = 1995")
add("year_log", "SELECT row_id, exercise, strftime(date - INTERVAL 12 MONTH, '%Y-%m-%d') AS date FROM v_workouts WHERE row_id % 2 = 0")

# ---- documents

VIEWS["v_meta"] = """
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN concat('In this video ', text) ELSE text END AS text, substring(text, 1, 60) AS title,
       CASE WHEN doc_id % 3 = 0 THEN 'Video' ELSE 'Article' END AS type,
       CASE doc_id % 5 WHEN 0 THEN 'strongerbyscience.com' WHEN 1 THEN 'barbellmedicine.com' ELSE 'example.org' END AS website
FROM documents """
VIEWS["v_raw_docs"] = """
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN concat('[ERROR] 403 Client Error', chr(10), 'URL: x')
                    WHEN doc_id % 13 = 0 THEN '   '
                    ELSE concat('TITLE: Document ', CAST(doc_id AS VARCHAR), chr(10), 'AUTHOR: ', source, chr(10),
                                CASE WHEN doc_id % 7 = 0 THEN 'SITE: ' ELSE 'WEBSITE: ' END, 'example.org', chr(10),
                                'URL: https://example.org/', CAST(doc_id AS VARCHAR), chr(10),
                                'TYPE: Article', chr(10), chr(10), text) END AS raw_text
FROM documents """
VIEWS["v_records"] = """
SELECT doc_id, concat('TITLE: ', title, chr(10), 'AUTHOR: ', chr(10), 'WEBSITE: ', website, chr(10),
  'URL: https://example.org/', chr(10), 'TYPE: ', type, chr(10), chr(10), text) AS raw_text
FROM v_meta WHERE text <> '' AND NOT starts_with(text, '[ERROR]') """


def parsed_of(source: str) -> str:
    flags, good = [], "len(ls) >= 6"
    for i, name in enumerate(DOCUMENT_FIELDS):
        label = f"{name.upper()}:"
        good = f"{good} AND starts_with(ls[{i + 1}], '{label}')"
        flags.append(f"CASE WHEN {good} THEN {strip(f'substring(ls[{i + 1}], {len(label) + 1})')} ELSE '' END AS {name}")
    return f"""
SELECT * FROM (SELECT doc_id, {', '.join(flags)},
  CASE WHEN {good} THEN {strip("array_to_string(ls[7:], chr(10))")} ELSE t END AS text
FROM (SELECT doc_id, t, regexp_split_to_array(t, '{_BREAKS}') AS ls FROM (
  SELECT doc_id, {strip('raw_text')} AS t FROM {source} ) WHERE t <> '' AND NOT starts_with(t, '[ERROR]'))) WHERE text <> '' """


VIEWS["v_parsed"] = parsed_of("v_raw_docs")
VIEWS["v_parsed_records"] = parsed_of("v_records")
add("header_parse", f"SELECT doc_id, {', '.join(DOCUMENT_FIELDS)}, text FROM v_parsed ")
add("document_records", "SELECT doc_id, raw_text AS record FROM v_meta LEFT JOIN v_records USING (doc_id)")
add("header_round_trip", f"SELECT doc_id, {', '.join(DOCUMENT_FIELDS)}, text FROM v_parsed_records ")


def chunks_of(source: str, key: str, size: int, step: int) -> str:
    return f"""
SELECT {key}, CAST(i AS INT) AS chunk_index, CAST(len(part) AS INT) AS n_words, array_to_string(part, ' ') AS text
FROM (SELECT {key}, i, ws[i * {step} + 1 : i * {step} + {size}] AS part FROM (
  SELECT {key}, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= {size} THEN 1
     ELSE CAST(ceil((len(ws) - {size}) / CAST({step} AS DOUBLE)) AS BIGINT) + 1 END)) AS i
  FROM (SELECT {key}, list_filter(regexp_split_to_array(text, '{_SPACES}+'), lambda x: x <> '') AS ws FROM {source} ))) """


VIEWS["v_chunks"] = chunks_of("documents", "doc_id", V.CHUNK_WORDS, V.CHUNK_WORDS - V.CHUNK_OVERLAP)
VIEWS["v_link_words"] = "SELECT page_id, regexp_replace(url, '[/:.]+', ' ', 'g') AS text FROM pages "
VIEWS["v_small_chunks"] = chunks_of("v_link_words", "page_id", 3, 1)
add("chunk_words", "SELECT * FROM v_chunks ")
add("small_chunks", "SELECT * FROM v_small_chunks ")
add("chunk_ids", """SELECT doc_id, chunk_index, row_number() OVER (ORDER BY source, doc_id, chunk_index) - 1 AS chunk_id, n_words
FROM v_chunks JOIN documents USING (doc_id)""")
add("chunk_index_stats", "SELECT count(DISTINCT doc_id) AS num_files, count(*) AS num_chunks FROM v_chunks ")
add("index_round_trip", """SELECT doc_id AS chunk_key, 'chunk' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'vector' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
_LETTERS = " || '|' || ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE" for c in "aeinst")
add("index_built", f"""SELECT doc_id, chunk_index, n_words, CASE WHEN doc_id % 10 < 2 THEN 1 ELSE 0 END AS part, md5(text) AS digest,
  {_LETTERS} || '|' || n_words::DOUBLE AS embedding, (SELECT count(DISTINCT doc_id) FROM v_chunks ) AS num_files,
  (SELECT count(*) FROM v_chunks ) AS num_chunks FROM v_chunks """)
add("joined_index", "SELECT doc_id AS chunk_key, title, len(embedding) AS dim FROM v_meta JOIN embeddings ON vec_id = doc_id")

# ---- retrieval

VIEWS["v_queries"] = """
SELECT vec_id AS query_id, embedding AS query_vec, CASE WHEN vec_id % 2 = 0 THEN concat('what is ', text) ELSE text END AS query_text
FROM embeddings JOIN benchmark ON item_id = vec_id """
VIEWS["v_questions"] = """
SELECT conv_id * 100 + turn AS question_id, conv_id % 160 AS user_id, conv_id, concat(CASE (conv_id * 100 + turn) % 7
   WHEN 0 THEN concat('What weight should I use for ', exercise, ' next session? ') WHEN 1 THEN 'what should I squat '
   WHEN 2 THEN 'How to fix my deadlift lockout ' WHEN 3 THEN 'next workout ideas '
   WHEN 4 THEN concat('Next weight on ', lower(exercise), '? ') WHEN 5 THEN 'zzz next weight ' ELSE '' END, text) AS question
FROM conversations JOIN v_exercise ON ex_id = conv_id % 12 WHERE role = 'user' """
VIEWS["v_question_queries"] = """
SELECT question_id AS query_id, embedding AS query_vec, question AS query_text FROM v_questions JOIN embeddings ON vec_id = conv_id """


def found_of(queries: str, top_k: int) -> str:
    k = max(V.OVERFETCH * top_k, V.MIN_CANDIDATES)
    return f"""
SELECT * FROM (SELECT query_id, query_text, vec_id AS chunk_key, s AS embedding_score,
   row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS candidate_rank
 FROM (SELECT query_id, query_text, vec_id, round_even(list_dot_product(CAST(query_vec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS s
       FROM {queries} CROSS JOIN embeddings)) WHERE candidate_rank <= {k} """


def overlap(query: str, title: str) -> str:
    return (f"(CASE WHEN len({tokens(query)}) > 0 AND len({tokens(title)}) > 0 THEN "
            f"len(list_intersect({tokens(query)}, {tokens(title)})) / CAST(greatest(1, len({tokens(query)})) AS DOUBLE) ELSE 0.0 END)")


def ranked_of(found: str, top_k: int) -> str:
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_rank) AS rank FROM (
 SELECT {found}.*, title, website, type, text, embedding_score + {V.TITLE_WEIGHT} * {overlap('query_text', 'title')}
  + CASE WHEN {any_of('lower(query_text)', V.EXPLANATORY_PHRASES)} AND lower(type) = 'article' THEN {V.EXPLANATORY_BONUS} ELSE 0 END
  + CASE WHEN {any_of('lower(website)', V.TRUSTED_SITES)} THEN {V.TRUSTED_BONUS} ELSE 0 END
  - CASE WHEN {any_of(f'substring(lower(text), 1, {V.LOW_VALUE_WINDOW})', V.LOW_VALUE_MARKERS)} THEN {V.LOW_VALUE_PENALTY} ELSE 0 END AS score
 FROM {found} JOIN v_meta ON doc_id = chunk_key)) WHERE rank <= {top_k} """


VIEWS["v_found"] = found_of("v_queries", 3)
VIEWS["v_ranked"] = ranked_of("v_found", 3)
VIEWS["v_question_found"] = found_of("v_question_queries", 3)
VIEWS["v_question_ranked"] = ranked_of("v_question_found", 3)
_TOPK = f"SELECT query_id, chunk_key, {r6('embedding_score')} AS embedding_score, candidate_rank FROM v_found4 "
VIEWS["v_found4"] = found_of("v_queries", 4)
add("retrieve_topk", _TOPK)
add("retrieve_topk_blocks", _TOPK)
add("rerank_topk", f"""SELECT query_id, rank, {r6('score')} AS score, {r6('embedding_score')} AS embedding_score, chunk_key, title, website, type
FROM v_ranked """)
add("dot_products", f"""SELECT vec_id, {r6('list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / n))')} AS self_score
FROM (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""")
add("title_overlap", f"SELECT query_id, {r6(overlap('query_text', 'title'))} AS overlap FROM v_queries JOIN v_meta ON doc_id = query_id")
add("low_value_chunks", f"""SELECT doc_id, {any_of(f'substring(lower(text), 1, {V.LOW_VALUE_WINDOW})', V.LOW_VALUE_MARKERS)} AS low_value,
  {any_of('lower(text)', V.LOW_VALUE_MARKERS)} AS low_value_anywhere, {any_of('lower(website)', V.TRUSTED_SITES)} AS trusted FROM v_meta """)
add("explanatory_queries", f"SELECT query_id, {any_of('lower(query_text)', V.EXPLANATORY_PHRASES)} AS explanatory FROM v_queries ")
add("token_sets", f"SELECT item_id, array_to_string(list_sort({tokens('text')}), '|') AS tokens, {normalized('text')} AS normalized FROM benchmark")
add("excerpts", f"SELECT doc_id, {excerpt(V.EXCERPT_CHARS)} AS excerpt FROM documents")
add("label_vectors", f"""SELECT label, CAST(dim AS INT) AS dim, {r6('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY label)), 1e-12)')} AS value FROM (
  SELECT label, dim, sum(x * mask) / greatest(sum(mask), 1e-9) AS v FROM (
    SELECT label, coalesce(quality, 1) AS mask, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim
    FROM embeddings LEFT JOIN labels ON doc_id = vec_id) GROUP BY label, dim)""")

add("hashed_vectors", f"SELECT doc_id, 512 AS dim, CASE WHEN len({tokens('text')}) > 0 THEN 1.0 ELSE 0.0 END AS length FROM documents")

# ---- chats, quota, entries, dashboards

VIEWS["v_last_turns"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
WHERE n <= {CHAT_TURNS} AND role IN ('user', 'assistant') AND text IS NOT NULL AND NOT {any_of('text', V.INTERNAL_ERROR_MARKERS)} """
add("chat_window", "SELECT conv_id, turn, role, text FROM v_last_turns ")
add("internal_errors", f"""SELECT conv_id, turn, {any_of('said', V.INTERNAL_ERROR_MARKERS)} AS internal_error FROM (SELECT conv_id, turn,
  CASE WHEN turn % 3 = 1 THEN concat({q(V.INTERNAL_ERROR_MARKERS[2])}, '. ', text) ELSE text END AS said FROM conversations)""")
add("chat_messages", f"""SELECT conv_id, CAST(2 + (CASE WHEN coalesce(context, '') <> '' THEN 1 ELSE 0 END) + coalesce(k, 0) AS INT) AS n,
  concat_ws(chr(10), 'system: Coach.', CASE WHEN coalesce(context, '') <> '' THEN concat('system: Context: ', context) END,
    recent, concat('user: what should I do after ', turns, ' turns?')) AS messages
FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)
LEFT JOIN (SELECT conv_id, trim(regexp_replace(text, '{_SPACES}+', ' ', 'g')) AS context FROM conversations WHERE turn = 0) USING (conv_id)
LEFT JOIN (SELECT conv_id, count(*) AS k, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS recent
           FROM v_last_turns GROUP BY conv_id) USING (conv_id)""")
add("daily_quota", f"""SELECT event_id, user_id, {day('ts')} AS day, n <= {QUOTA} AS allowed, least(n, {QUOTA}) AS used,
  greatest({QUOTA} - n, 0) AS remaining, {iso("CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP)")} AS resets_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)""")
add("quota_rejections", f"""SELECT user_id, {day('d')} AS day, asked, asked - {QUOTA} AS rejected FROM (
  SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS asked FROM events GROUP BY 1, 2) WHERE asked > {QUOTA}""")
VIEWS["v_accepted"] = f"""
SELECT row_id, user_id, exercise, sets, reps, weight, CASE WHEN rpe > 0 THEN rpe END AS rpe,
  CASE WHEN rir > 0 THEN rir END AS rir, logged_at FROM v_checked WHERE reason IS NULL """
_ACCEPTED = f"""SELECT row_id, user_id, exercise, sets, reps, weight, {{date}}rpe, rir, {iso('logged_at')} AS logged_at FROM v_accepted """
add("ingest_valid", _ACCEPTED.format(date=f"{day('logged_at')} AS date, "))
add("stream_ingest", _ACCEPTED.format(date=""))
add("ingest_rejects", "SELECT row_id, user_id, reason FROM v_checked WHERE reason IS NOT NULL")
SQL["stream_rejects"] = SQL["ingest_rejects"]
add("appended_logs", f"""SELECT row_id, exercise, sets, reps, weight, {day('date')} AS date, rpe, rir, {iso('logged_at')} AS logged_at FROM v_workouts
UNION ALL SELECT row_id + 10000000, exercise, sets, reps, weight, {day('logged_at')}, rpe, rir, {iso('logged_at')} FROM v_accepted """)
add("stream_quota", f"""SELECT event_id, user_id, {day('ts')} AS day, n AS used
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n <= {QUOTA}""")
add("dashboard_counts", """SELECT user_id, coalesce(workout_logs, 0) AS workout_logs, coalesce(chat_messages, 0) AS chat_messages,
  coalesce(saved, false) AS profile_saved
FROM (SELECT user_id, count(*) AS workout_logs FROM events GROUP BY user_id)
FULL JOIN (SELECT conv_id % 160 AS user_id, count(*) AS chat_messages FROM conversations GROUP BY 1) USING (user_id)
FULL JOIN (SELECT c_custkey AS user_id, true AS saved FROM customer) USING (user_id)""")
add("dashboard_latest", f"""SELECT user_id, place, row_id, exercise, {day('date')} AS date FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC NULLS LAST, row_id) AS place FROM v_workouts ) WHERE place <= 5""")
PRETTY = ("strftime(date, '%B ') || day(date) || CASE WHEN day(date) BETWEEN 11 AND 13 THEN 'th' WHEN day(date) % 10 = 1 THEN 'st' "
          "WHEN day(date) % 10 = 2 THEN 'nd' WHEN day(date) % 10 = 3 THEN 'rd' ELSE 'th' END || ', ' || year(date)")
add("logs_by_day", f"""SELECT user_id, {day('date')} AS date, entries, {PRETTY} || ' (' || entries || ' exercise(s))' AS label
FROM (SELECT user_id, date, count(*) AS entries FROM v_workouts GROUP BY user_id, date)""")
add("available_periods", """SELECT DISTINCT user_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  strftime(date, '%B') AS month_name FROM v_workouts """)
add("month_log", f"""SELECT row_id, exercise, {day('date')} AS date FROM v_workouts WHERE year(date) = 2024 AND month(date) = 1""")
add("date_texts", f"""SELECT row_id, {PRETTY} AS pretty, {iso('logged_at')} AS iso, {day('date')} AS day,
  CAST(floor(epoch(logged_at)) AS BIGINT) AS epoch, strftime(date, '%B') AS month, {iso('CAST(date + 1 AS TIMESTAMP)')} AS resets_at,
  {number_text('weight')} AS weight_text, {number_text('rpe')} AS rpe_text FROM v_workouts """)

# ---- coaching

VIEWS["v_lifts"] = "\nUNION ALL\n".join(
    f"SELECT *, {i} AS lift FROM v_workouts WHERE {any_of('lower(exercise)', aliases)} "
    for i, aliases in enumerate(V.LIFT_ALIASES.values()))
_NEWEST = "logged_at DESC NULLS LAST, date DESC NULLS LAST, row_id"
VIEWS["v_latest_lift"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lift ORDER BY {_NEWEST}) AS n FROM v_lifts ) WHERE n = 1 """
VIEWS["v_lift_once"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, {normalized('exercise')} ORDER BY lift) AS once FROM v_latest_lift ) WHERE once = 1 """
VIEWS["v_recent"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_NEWEST}) AS place FROM v_workouts ) WHERE place <= 3 """
add("latest_per_lift", "SELECT user_id, lift, row_id, exercise, weight FROM v_latest_lift ")
add("deduped_lifts", "SELECT user_id, lift, row_id FROM v_lift_once ")
add("recent_k", "SELECT user_id, place, row_id FROM v_recent ")
ASKS = any_of("lower(question)", V.PREDICTION_MARKERS)
add("prediction_questions", f"SELECT question_id, {ASKS} AS asks FROM v_questions ")

_TOK = "list_filter(list_distinct(string_split({}, ' ')), lambda x: x <> '')"
_OVERLAP = f"len(list_intersect({_TOK.format('nx')}, {_TOK.format('nq')}))"
VIEWS["v_asked_rows"] = f"""
SELECT q.question_id, w.*, {normalized('question')} AS nq, {normalized('w.exercise')} AS nx
FROM v_questions q JOIN v_workouts w ON w.user_id = q.user_id """
VIEWS["v_choices"] = f"""
SELECT question_id, row_id, exercise, 1 AS pass, -CASE WHEN contains(nq, nx) THEN {_OVERLAP} + 3 ELSE {_OVERLAP} END AS preference,
       logged_at, date FROM v_asked_rows WHERE contains(nq, nx) OR {_OVERLAP} > 0
UNION ALL """ + "\nUNION ALL ".join(
    f"SELECT question_id, row_id, exercise, 2, {i}, logged_at, date FROM v_asked_rows WHERE list_contains({_TOK.format('nq')}, '{n}') "
    f"AND {any_of('lower(exercise)', aliases)}" for i, (n, aliases) in enumerate(V.LIFT_ALIASES.items())) + """
UNION ALL SELECT question_id, row_id, exercise, 3, 0, logged_at, date FROM v_asked_rows """
VIEWS["v_target"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pass, preference, {_NEWEST}) AS n FROM v_choices ) WHERE n = 1 """
add("target_lift", "SELECT question_id, pass, row_id, exercise FROM v_target ")
add("model_router", f"""SELECT user_id, count(*) AS logged_rows, CASE WHEN count(*) > {ROUTER_ROWS} THEN 'learned' ELSE 'rule' END AS model
FROM events GROUP BY user_id""")


def line(prefix: str) -> str:
    return (f"concat('- {prefix} ', trim(exercise), ': ', {number_text('weight')}, ' lb x ', reps, ' reps on ', {day('date')})")


VIEWS["v_asking"] = "SELECT DISTINCT user_id FROM v_questions "
VIEWS["v_history"] = f"""
SELECT user_id, concat('User workout context:', chr(10), coalesce(a, b, '- No logged workout history found.')) AS history FROM v_asking
LEFT JOIN (SELECT user_id, string_agg({line('Most recent')}, chr(10) ORDER BY lift) AS a FROM v_lift_once GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, string_agg({line('Recent')}, chr(10) ORDER BY place) AS b FROM v_recent GROUP BY user_id) USING (user_id) """
add("history_block", "SELECT user_id, history FROM v_history ")
VIEWS["v_profile"] = f"""
SELECT user_id, CASE WHEN c_custkey IS NULL THEN concat({q(V.PROFILE_HEADING)}, chr(10), {q(V.NO_PROFILE)}) ELSE concat_ws(chr(10), 'User profile context:',
  CASE WHEN c_custkey % 4 <> 0 THEN concat('- Goal: ', c_mktsegment) END,
  concat('- Experience level: ', CASE c_custkey % 3 WHEN 0 THEN 'Beginner' WHEN 1 THEN 'Intermediate' ELSE 'Advanced' END),
  CASE c_custkey % 3 WHEN 0 THEN '- Equipment access: Barbell, Bands' WHEN 1 THEN '- Equipment access: Dumbbells' END,
  concat('- Training frequency: ', c_custkey % 7 + 1, ' days per week')) END AS profile
FROM v_asking LEFT JOIN customer ON c_custkey = user_id """
add("profile_block", "SELECT user_id, profile FROM v_profile ")
_RULE_TEXT = "concat('- Baseline predicts next ', exercise, ': ', CAST(predicted_next_weight AS VARCHAR), ' lb', chr(10), '- Reason: ', reason)"


def prediction_of(text: str, joins: str = "") -> str:
    return f"""
SELECT question_id, concat('Prediction context:', chr(10), CASE WHEN NOT {ASKS} THEN {q(V.NOT_ASKED)}
   WHEN exercise IS NULL THEN {q(V.NO_TARGET)} ELSE {text} END) AS prediction
FROM v_questions LEFT JOIN (SELECT question_id, v_ruled.* EXCLUDE (user_id) FROM v_target JOIN v_ruled USING (row_id)) USING (question_id) {joins} """


VIEWS["v_prediction"] = prediction_of(_RULE_TEXT)
add("prediction_block", "SELECT question_id, prediction FROM v_prediction ")
_NOTE = "chr(10) || '- XGBoost prediction unavailable: no learned prediction for this row'"
VIEWS["v_routed"] = prediction_of(
    f"""CASE WHEN coalesce(busy, 0) <= {ROUTER_ROWS} THEN {_RULE_TEXT} WHEN sets > 2 THEN
   concat('- XGBoost predicts next ', exercise, ': ', CAST(round_even(weight * 1.5, 2) AS VARCHAR), ' lb', chr(10), '- Reason: Learned.')
   ELSE {_RULE_TEXT} || {_NOTE} END""",
    "LEFT JOIN (SELECT user_id, count(*) AS busy FROM events GROUP BY user_id) USING (user_id)")
add("routed_prediction_block", "SELECT question_id, prediction FROM v_routed ")


def excerpt_of(ranked: str) -> str:
    return f"""
SELECT query_id, concat('Relevant training context:', chr(10), chr(10), string_agg(concat('[', rank, '] Title: ', CASE WHEN title = '' THEN 'Untitled' ELSE title END, chr(10),
  'Source: ', website, chr(10), 'URL: unknown', chr(10), 'Excerpt: ', {excerpt(V.EXCERPT_CHARS)}), chr(10) || chr(10) ORDER BY rank)) AS excerpts
FROM {ranked} GROUP BY query_id """


VIEWS["v_excerpts"] = excerpt_of("v_ranked")
VIEWS["v_question_excerpts"] = excerpt_of("v_question_ranked")
add("excerpt_block", "SELECT query_id, excerpts FROM v_excerpts ")
add("context_blocks", f"""SELECT question_id, user_id, concat_ws(chr(10) || chr(10), coalesce(excerpts, concat({q(V.EXCERPTS_HEADING)}, chr(10), {q(V.NO_EXCERPTS)})), history, profile, prediction) AS context
FROM v_questions LEFT JOIN v_question_excerpts ON query_id = question_id LEFT JOIN v_prediction USING (question_id)
LEFT JOIN v_history USING (user_id) LEFT JOIN v_profile USING (user_id)""")

VIEWS["v_learned"] = prediction_of(
    f"""CASE WHEN coalesce(busy, 0) <= {ROUTER_ROWS} THEN {_RULE_TEXT} ELSE concat('- XGBoost predicts next ', exercise, ': N lb', chr(10),
   '- Reason: Predicted from the trained XGBoost model using current row features and available exercise history.') END""",
    "LEFT JOIN (SELECT user_id, count(*) AS busy FROM events GROUP BY user_id) USING (user_id)")
add("learned_contexts", f"""SELECT question_id, user_id, concat_ws(chr(10) || chr(10), coalesce(excerpts, concat({q(V.EXCERPTS_HEADING)}, chr(10), {q(V.NO_EXCERPTS)})), history, profile, prediction) AS context
FROM v_questions LEFT JOIN v_question_excerpts ON query_id = question_id LEFT JOIN v_learned USING (question_id)
LEFT JOIN v_history USING (user_id) LEFT JOIN v_profile USING (user_id)""")

# ---- links, pages, crawl logs

_PATH = "regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
_SLUG = f"trim(regexp_replace(regexp_extract(trim({_PATH}, '/'), '([^/]*)$', 1), '[^a-zA-Z0-9_-]+', '-', 'g'), '-')"
add("url_stems", f"SELECT page_id, concat(CASE WHEN {_SLUG} = '' THEN 'article' ELSE {_SLUG} END, '_', substring(sha1(url), 1, 8)) AS stem FROM pages")
add("site_names", "SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', ''), '') AS site FROM pages")
add("video_ids", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('a+b', page_id) WHEN 1 THEN concat('x', page_id) END AS video_id FROM pages")
_UNESCAPED = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"),
                       ("&nbsp;", "\xa0"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, {q(_entity)}, {q(_char)})"
add("html_titles", f"SELECT page_id, nullif({strip(_UNESCAPED)}, '') AS title FROM pages")
add("owner_names", "SELECT page_id, concat('Lift & ', page_id) AS owner FROM pages")
add("oembed_fields", """SELECT page_id, nullif(regexp_extract(url, '//([a-z]+)', 1), '') AS title,
  CASE WHEN page_id % 4 <> 0 THEN url END AS author FROM pages""")
add("author_lists", "SELECT doc_id, concat_ws(', ', nullif(trim(source), ''), nullif(trim(lang), '')) AS authors FROM documents")
add("unprocessed_pages", "SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'http://')")
add("link_scan", "SELECT url FROM pages WHERE page_id % 5 NOT IN (0, 1)")
VIEWS["v_crawl"] = f"""
SELECT event_id AS seq, user_id % 10 AS site, event_type = 'error' AND event_id % 3 < 2 AS blocked, event_type <> 'error' AS success FROM events """
add("block_errors", "SELECT seq, site, blocked, success FROM v_crawl ")
add("block_streaks", f"""SELECT site, min(seq) AS stop_at FROM (SELECT *, sum(CAST(blocked AS INT)) OVER (PARTITION BY site, island ORDER BY seq) AS run
  FROM (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY site ORDER BY seq) AS island FROM v_crawl ))
WHERE blocked AND run >= {STREAK} GROUP BY site""")
add("transcript_blocks", """SELECT site, min(seq) AS stop_at FROM (SELECT *, sum(CAST(blocked AS INT)) OVER (PARTITION BY site, island ORDER BY seq) AS run
  FROM (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY site ORDER BY seq) AS island FROM v_transcripts ))
WHERE blocked AND run >= 2 GROUP BY site""")
add("transcripts", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")

# ---- streams

add("stream_lift_state", f"""SELECT user_id, exercise, row_id, weight, {iso('logged_at')} AS logged_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, exercise ORDER BY {_NEWEST}) AS n FROM v_workouts ) WHERE n = 1""")
add("stream_predictions", "SELECT row_id, predicted_next_weight, recommended_increment FROM v_ruled ")
add("stream_profiles", "SELECT user_id, arg_max(event_type, ts) AS goal FROM events GROUP BY user_id")

# 50 slices; three prompts a day; in order of arrival, then of time
add("stream_quota_state", f"""SELECT event_id, user_id, {day('ts')} AS day, n <= 3 AS allowed, least(n, 3) AS used FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY slice, ts, event_id) AS n FROM (
    SELECT *, least(event_id * 50 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END, 49) AS slice
    FROM events))""")
SQL["stream_lift_state_batches"] = SQL["stream_lift_state"]
SQL["stream_profiles_batches"] = SQL["stream_profiles"]
