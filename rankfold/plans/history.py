"""Leak-free history of horses, jockeys and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..operators.grouping import Grouping, first_per_key
from .registry import query
from .roles import WITH_FIELD, WITH_RUNNERS, field, r6, rounded, runners

ASOF = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
# Day number as the ordering value, so that rows of one day do not see one another.
BY_HORSE = f"(PARTITION BY horse_id ORDER BY datediff('day', DATE '1970-01-01', jour) {ASOF})"


def horse_field(spark: SparkSession, sf: str) -> tuple[DataFrame, Grouping]:
    rows, _ = field(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("horse_id"))
    return rows, Grouping.measure(lines, "horse_id")


@query(
    WITH_FIELD + f""",
totals AS (
  SELECT race_id, numero, horse_id, jour,
    coalesce(count(*) OVER {BY_HORSE}, 0) AS coursescheval,
    coalesce(count(CASE WHEN position = 1 THEN 1 END) OVER {BY_HORSE}, 0) AS victoirescheval,
    coalesce(count(CASE WHEN position <= 3 THEN 1 END) OVER {BY_HORSE}, 0) AS placescheval,
    coalesce(sum(price) OVER {BY_HORSE}, 0.0) AS gains
  FROM field)
SELECT race_id, numero, horse_id, coursescheval, victoirescheval, placescheval,
  round(gains, 2) AS gains_carriere,
  round(CASE WHEN coursescheval > 0 THEN victoirescheval / coursescheval ELSE 0 END, 6) AS ratio_victoires,
  round(CASE WHEN coursescheval > 0 THEN placescheval / coursescheval ELSE 0 END, 6) AS ratio_places
FROM totals"""
)
def asof_career_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_horse = horse_field(spark, sf)
    out = history.career_totals(rows, by_horse, "jour", "position", "price")
    return out.select(
        "race_id",
        "numero",
        "horse_id",
        "coursescheval",
        "victoirescheval",
        "placescheval",
        F.round("gainsCarriere", 2).alias("gains_carriere"),
        r6("ratio_victoires").alias("ratio_victoires"),
        r6("ratio_places").alias("ratio_places"),
    )


@query(
    WITH_FIELD + f""",
h AS (
  SELECT race_id, numero, horse_id, jour, natpis,
    count(*) OVER w AS starts,
    count(CASE WHEN position = 1 THEN 1 END) OVER w AS wins,
    count(CASE WHEN position <= 5 THEN 1 END) OVER w AS top5,
    avg(position) OVER w AS mean_pos, max(jour) OVER w AS last_day,
    avg(CASE WHEN typec IN ('1-URGENT', '2-HIGH') THEN position END) OVER w AS hcap,
    avg(CASE WHEN typec NOT IN ('1-URGENT', '2-HIGH') THEN position END) OVER w AS cond,
    avg(CASE WHEN partant >= 6 THEN position END) OVER w AS large,
    avg(position) OVER (PARTITION BY horse_id, natpis ORDER BY datediff('day', DATE '1970-01-01', jour) {ASOF}) AS same
  FROM field
  WINDOW w AS {BY_HORSE})
SELECT race_id, numero, horse_id, CAST(starts AS DOUBLE) AS quinte_career_starts,
  round(CASE WHEN starts > 0 THEN wins / starts ELSE 0 END, 6) AS quinte_win_rate,
  round(CASE WHEN starts > 0 THEN top5 / starts ELSE 0 END, 6) AS quinte_top5_rate,
  round(coalesce(mean_pos, 10.0), 6) AS avg_quinte_position,
  CAST(least(coalesce(datediff('day', last_day, jour), 999), 999) AS DOUBLE) AS days_since_last_quinte,
  CASE WHEN coalesce(hcap, 10.0) < coalesce(cond, 10.0) - 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quinte_handicap_specialist,
  CASE WHEN coalesce(cond, 10.0) < coalesce(hcap, 10.0) - 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quinte_conditions_specialist,
  round(CASE WHEN large IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - (large - 1) / 15)) END, 6) AS quinte_large_field_ability,
  round(CASE WHEN same IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - (same - 1) / 15)) END, 6) AS quinte_track_condition_fit
FROM h"""
)
def asof_hit_rates_and_recency(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_horse = horse_field(spark, sf)
    rows = rows.withColumn("is_handicap", F.col("typec").isin("1-URGENT", "2-HIGH"))
    out = history.event_career(
        rows, by_horse, "jour", "position", "is_handicap", "partant", "natpis", large_field=6
    )
    kept = [c for c in out.columns if c.endswith("quinte") or "quinte_" in c]
    return rounded(out.select("race_id", "numero", "horse_id", *kept))


def newest_first():
    return [F.col("jour").desc(), F.col("race_id").desc(), F.col("numero").asc()]


@query(
    WITH_FIELD + """
SELECT horse_id, run_no, race_id, numero, position FROM (
  SELECT *, row_number() OVER (PARTITION BY horse_id ORDER BY jour DESC, race_id DESC, numero) AS run_no FROM field)
WHERE run_no <= 20"""
)
def recent_k_history(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = field(spark, sf)
    latest = history.recent_runs(rows, ["horse_id"], newest_first(), 20)
    return latest.select("horse_id", "run_no", "race_id", "numero", "position")


@query(
    WITH_FIELD + """,
today AS (SELECT horse_id, max(jour) AS today FROM field GROUP BY horse_id)
SELECT horse_id, run_no, race_id, numero, position FROM (
  SELECT f.*, row_number() OVER (PARTITION BY f.horse_id ORDER BY jour DESC, race_id DESC, numero) AS run_no
  FROM field f JOIN today t ON f.horse_id = t.horse_id
  WHERE f.jour < t.today AND f.jour >= t.today - 365)
WHERE run_no <= 20"""
)
def recent_year_history(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = field(spark, sf)
    today = rows.groupBy("horse_id").agg(F.max("jour").alias("today"))
    rows = rows.join(today, "horse_id")
    latest = history.recent_runs_within(rows, ["horse_id"], "jour", newest_first(), F.col("today"))
    return latest.select("horse_id", "run_no", "race_id", "numero", "position")


@query(
    WITH_FIELD + """,
seq AS (
  SELECT race_id, numero, horse_id, position,
    list(position) OVER (PARTITION BY horse_id ORDER BY jour, race_id, numero ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p,
    list(CAST(odds AS BIGINT)) OVER (PARTITION BY horse_id ORDER BY jour, race_id, numero ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS o
  FROM field)
SELECT race_id, numero, horse_id, position AS target, array_to_string(p, ',') AS positions, array_to_string(o, ',') AS odds
FROM seq WHERE len(p) = 5"""
)
def previous_five_sequence(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_horse = horse_field(spark, sf)
    order = [F.col("jour").asc(), F.col("race_id").asc(), F.col("numero").asc()]
    out = history.previous_sequence(rows, by_horse, order, ["position", "odds"], 5)
    step = lambda i: F.array_join(F.transform("sequence", lambda s: F.get(s, i).cast("long").cast("string")), ",")
    return out.select(
        "race_id", "numero", "horse_id", F.col("position").alias("target"), step(0).alias("positions"), step(1).alias("odds")
    )


@query(
    WITH_RUNNERS + """,
g AS (SELECT numero, count(*) AS starts, count(*) FILTER (WHERE position = 1) AS wins,
             count(*) FILTER (WHERE position <= 5) AS top5 FROM runners WHERE numero BETWEEN 1 AND 20 GROUP BY numero)
SELECT numero, starts, wins, top5, round((wins / starts / 0.0625 + top5 / starts / 0.3125) / 2, 6) AS post_position_bias
FROM g"""
)
def gate_bias(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    return rounded(history.gate_bias(rows, "numero", "position"))


@query(
    WITH_FIELD + f""",
g AS (
  SELECT race_id, numero, count(*) OVER w AS starts, count(CASE WHEN position = 1 THEN 1 END) OVER w AS wins,
    count(CASE WHEN position <= 5 THEN 1 END) OVER w AS top5
  FROM field WINDOW w AS (PARTITION BY numero ORDER BY datediff('day', DATE '1970-01-01', jour) {ASOF}))
SELECT race_id, numero, starts,
  round(CASE WHEN starts > 0 THEN (wins / starts / 0.0625 + top5 / starts / 0.3125) / 2 ELSE 1 END, 6) AS post_position_bias
FROM g"""
)
def gate_bias_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Gate bias from earlier days only. A gate spans the whole table, so days are summed first."""
    rows, _ = field(spark, sf)
    daily = rows.groupBy("numero", "jour").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("position") == 1, 1)).alias("w"),
        F.count(F.when(F.col("position") <= 5, 1)).alias("t"),
    )
    before = history.asof_totals(
        daily, Grouping(("numero",)), "jour", starts=F.col("n"), wins=F.col("w"), top5=F.col("t")
    ).na.fill(0)
    bias = (F.col("wins") / F.col("starts") / 0.0625 + F.col("top5") / F.col("starts") / 0.3125) / 2
    before = before.select(
        "numero", "jour", "starts", r6(F.when(F.col("starts") > 0, bias).otherwise(1.0)).alias("post_position_bias")
    )
    return rows.join(before, ["numero", "jour"]).select("race_id", "numero", "starts", "post_position_bias")


@query(
    WITH_FIELD + """,
a AS (SELECT race_id, numero, horse_id, jour, CASE WHEN discount >= 0.04 THEN discount * 100 END AS age FROM field),
f AS (
  SELECT *, last_value(age IGNORE NULLS) OVER (PARTITION BY horse_id ORDER BY jour, race_id, numero
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
            first_value(age IGNORE NULLS) OVER (PARTITION BY horse_id ORDER BY jour, race_id, numero
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
  FROM a)
SELECT race_id, numero, horse_id, round(coalesce(back, ahead, 5.0), 6) AS age FROM f"""
)
def fill_age_by_horse(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_horse = horse_field(spark, sf)
    rows = rows.select(
        "race_id", "numero", "horse_id", "jour", F.when(F.col("discount") >= 0.04, F.col("discount") * 100).alias("age")
    )
    order = [F.col("jour").asc(), F.col("race_id").asc(), F.col("numero").asc()]
    return rounded(history.fill_age(rows, by_horse, order).drop("jour"))


@query(
    WITH_FIELD + """
SELECT horse_id, race_id, numero FROM (
  SELECT *, row_number() OVER (PARTITION BY horse_id ORDER BY jour, race_id, numero) AS n FROM field) WHERE n = 1"""
)
def first_row_per_horse(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = field(spark, sf)
    order = [F.col("jour").asc(), F.col("race_id").asc(), F.col("numero").asc()]
    return first_per_key(rows, ["horse_id"], order).select("horse_id", "race_id", "numero")
