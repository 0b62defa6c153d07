"""Form strings of users' event histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import form_momentum
from ..functions.form import flatten_stats, with_form_stats
from ..functions.text import discipline_code
from ..operators.grouping import Grouping, row_number_within
from .registry import query
from .roles import rounded, table

RUNS_PER_FORM = 50  # a user's history is cut into form strings of this many runs
LETTERS = {"click": "a", "view": "m", "purchase": "p", "signup": "h"}
NAMES = ("Attelé", "monté", "PLAT", "H")


def forms(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, part, form, typec): tokens in time order, 50 per form string."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    by_user = Grouping.measure(events, "user_id")
    rows = row_number_within(events, by_user, [F.col("ts").asc(), F.col("event_id").asc()], "no")
    letter = F.create_map(*[F.lit(v) for pair in LETTERS.items() for v in pair])[F.col("event_type")]
    token = F.when(F.col("event_type") == "error", "Da").otherwise(
        F.concat((1 + F.floor("value") % 9).cast("string"), letter)
    )
    part = F.floor((F.col("no") - 1) / RUNS_PER_FORM).cast("long")
    typec = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("user_id") % 4).cast("int"))
    tokens = F.array_sort(F.collect_list(F.struct("no", token.alias("token"))))
    return (
        rows.groupBy("user_id", part.alias("part"))
        .agg(F.array_join(F.transform(tokens, lambda t: t["token"]), " ").alias("form"))
        .withColumn("discipline", discipline_code(typec))
    )


_NUMBERED = """
WITH n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events),
t AS (
  SELECT user_id, (no - 1) // 50 AS part, no, event_type = 'error' AS lost, 1 + CAST(floor(value) AS BIGINT) % 9 AS place,
    CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'M' WHEN 'purchase' THEN 'P' WHEN 'signup' THEN 'H' END AS letter,
    CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'P' ELSE 'H' END AS discipline
  FROM n),
l AS (
  SELECT user_id, part, discipline, count(*) AS total, count(*) FILTER (WHERE lost) AS lost,
    count(*) FILTER (WHERE lost AND discipline IN ('D', 'A')) AS lost_same,
    coalesce(list(place ORDER BY no DESC) FILTER (WHERE NOT lost), []) AS g,
    coalesce(list(place ORDER BY no DESC) FILTER (WHERE NOT lost AND letter = discipline), []) AS s
  FROM t GROUP BY user_id, part, discipline)"""


def _stats_sql(a: str, total: str, lost: str, prefix: str) -> str:
    n = f"len({a})"
    return f"""
  CASE WHEN {n} > 0 THEN list_avg({a}) ELSE 0 END AS {prefix}_avg_pos,
  CASE WHEN {n} > 0 THEN list_avg({a}[1:3]) ELSE 0 END AS {prefix}_recent_perf,
  CASE WHEN {n} > 1 THEN list_stddev_pop({a}) ELSE 0 END AS {prefix}_consistency,
  CASE WHEN {n} > 1 THEN {a}[1] - list_avg({a}[2:]) ELSE 0 END AS {prefix}_trend,
  CASE WHEN {n} > 0 THEN len(list_filter({a}, lambda x : x <= 3)) / {n} ELSE 0 END AS {prefix}_pct_top3,
  {n} AS {prefix}_nb_courses, {total} AS {prefix}_total_races,
  CASE WHEN {total} > 0 THEN CASE WHEN {n} > 0 THEN {lost} / {total} ELSE 1 END ELSE 0 END AS {prefix}_dnf_rate"""


_SAME_LOST = "(CASE WHEN len(s) > 0 THEN lost_same ELSE 0 END)"
_STATS = _NUMBERED + ",\nstats AS (SELECT user_id, part," + _stats_sql("g", "total", "lost", "che_global") + "," + _stats_sql(
    "s", f"(len(s) + {_SAME_LOST})", _SAME_LOST, "che_bytype"
) + " FROM l)"
_FIELDS = ("avg_pos", "recent_perf", "consistency", "trend", "pct_top3", "nb_courses", "total_races", "dnf_rate")
_WHOLE = ("nb_courses", "total_races")


def _list(prefix: str) -> str:
    return ", ".join(
        f"CAST({prefix}_{f} AS BIGINT) AS {prefix}_{f}" if f in _WHOLE else f"round({prefix}_{f}, 6)::DOUBLE AS {prefix}_{f}"
        for f in _FIELDS
    )


@query(_STATS + f"\nSELECT user_id, part, {_list('che_global')}, {_list('che_bytype')} FROM stats")
def form_string_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = with_form_stats(forms(spark, sf), "form", "discipline", "che").drop("che_weighted")
    return rounded(flatten_stats(stats, "che").drop("form", "discipline"))


@query(
    _STATS
    + """
SELECT user_id, part,
  round(che_bytype_avg_pos * 0.7 + che_global_avg_pos * 0.3, 6)::DOUBLE AS che_weighted_avg_pos,
  round(che_bytype_recent_perf * 0.7 + che_global_recent_perf * 0.3, 6)::DOUBLE AS che_weighted_recent_perf,
  round(che_bytype_consistency * 0.7 + che_global_consistency * 0.3, 6)::DOUBLE AS che_weighted_consistency,
  round(che_bytype_pct_top3 * 0.7 + che_global_pct_top3 * 0.3, 6)::DOUBLE AS che_weighted_pct_top3,
  CAST(che_bytype_nb_courses AS BIGINT) AS che_weighted_nb_courses,
  CAST(che_global_total_races AS BIGINT) AS che_weighted_total_races,
  round(che_global_dnf_rate, 6)::DOUBLE AS che_weighted_dnf_rate, round(che_bytype_trend, 6)::DOUBLE AS che_weighted_trend
FROM stats"""
)
def form_weighted(spark: SparkSession, sf: str) -> DataFrame:
    stats = with_form_stats(forms(spark, sf), "form", "discipline", "che").drop("che_global", "che_bytype")
    return rounded(flatten_stats(stats, "che").drop("form", "discipline"))


_B = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(
    _STATS
    + f""",
m AS (
  SELECT h.user_id, h.part, h.che_global_nb_courses AS hn, h.che_global_recent_perf AS hr, h.che_global_consistency AS hc,
    h.che_global_pct_top3 AS ht, j.che_global_consistency AS jc, j.che_global_pct_top3 AS jt,
    CASE WHEN h.che_global_nb_courses >= 3 THEN h.che_global_avg_pos - h.che_global_recent_perf ELSE 0 END AS hm,
    CASE WHEN j.che_global_nb_courses >= 3 THEN j.che_global_avg_pos - j.che_global_recent_perf ELSE 0 END AS jm
  FROM stats h JOIN stats j ON j.user_id = h.user_id AND j.part = 0),
q AS (
  SELECT *, CASE WHEN hc < 2 THEN 1.0 WHEN hc < 3 THEN 0.5 ELSE 0.0 END AS h_steady,
    CASE WHEN jc < 2 THEN 1.0 WHEN jc < 3 THEN 0.5 ELSE 0.0 END AS j_steady,
    CASE WHEN hn < 3 THEN 0.0 WHEN hr <= 3 THEN 1.0 WHEN hr <= 5 THEN 0.7 WHEN hr <= 8 THEN 0.4 ELSE 0.1 END AS quality FROM m),
p AS (
  SELECT *, {_B('hm > 0')} + {_B('jm > 0')} + {_B('h_steady >= 0.5')} + {_B('quality >= 0.7')}
    + {_B('ht >= 0.33 AND jt >= 0.25')} AS points FROM q)
SELECT user_id, part, round(hm, 6)::DOUBLE AS che_form_momentum, {_B('hm > 0')} AS che_improving_form,
  {_B('hm < -1')} AS che_declining_form, h_steady::DOUBLE AS che_high_consistency, quality::DOUBLE AS che_recent_quality,
  {_B('ht >= 0.33')} AS che_elite_performer, {_B('ht >= 0.2')} AS che_regular_placer,
  round(jm, 6)::DOUBLE AS joc_form_momentum, {_B('jm > 0')} AS joc_improving_form, j_steady::DOUBLE AS joc_high_consistency,
  {_B('jt >= 0.25')} AS joc_elite_performer, {_B('hm > 0 AND jm > 0')} AS synergy_both_improving,
  {_B('h_steady >= 0.5 AND j_steady >= 0.5')} AS synergy_both_consistent,
  {_B('ht >= 0.33 AND jt >= 0.25')} AS synergy_both_elite, points AS overall_momentum_score, {_B('points >= 3')} AS high_momentum
FROM p"""
)
def form_momentum_scores(spark: SparkSession, sf: str) -> DataFrame:
    stats = with_form_stats(forms(spark, sf), "form", "discipline", "che").select("user_id", "part", "che_global")
    first = stats.where(F.col("part") == 0).select("user_id", F.col("che_global").alias("joc_global"))
    both = stats.join(first, "user_id")
    return rounded(both.select("user_id", "part", *[c.alias(n) for n, c in form_momentum().items()]))


@query(
    _NUMBERED
    + """
SELECT user_id, part, no, CASE WHEN NOT lost THEN CAST(place AS INTEGER) END AS place,
  CASE WHEN NOT lost THEN letter END AS discipline, CAST(lost AS INTEGER) AS unfinished FROM t"""
)
def form_tokens(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.form import form_runs

    runs = forms(spark, sf).select("user_id", "part", F.posexplode(form_runs(F.col("form"), newest_first=False)))
    return runs.select(
        "user_id",
        "part",
        (F.col("part") * RUNS_PER_FORM + F.col("pos") + 1).alias("no"),
        "col.place",
        "col.discipline",
        F.col("col.unfinished").cast("int").alias("unfinished"),
    )
