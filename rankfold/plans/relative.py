"""Relative scores and competitive adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import performance, relative
from ..operators.blending import blend
from .registry import query
from .roles import WITH_FIELD, field, rounded

_INPUT = (
    WITH_FIELD
    + """,
inp AS (
  SELECT race_id, numero, partant, cheque, dist, pred_a, pred_b, CASE WHEN discount > 0.01 THEN price END AS gains, odds AS starts,
    sqrt(price) / 10 AS win_pct, line_no AS runs, sqrt(odds) / 7 AS dropped, pred_b / 20 AS purse_ratio,
    sqrt(odds) - 4 AS trend, pred_b / 5 AS recent, sqrt(price) / 100 - 1.5 AS joc_trend,
    CAST(odds AS BIGINT) % 3 AS jwins, horse_id % 2 AS twins, horse_id % 7 AS rides,
    CASE WHEN flag <> 'N' THEN dist + (line_no - 4) * 60 END AS last_dist
  FROM field),
s1 AS (SELECT *, CASE WHEN gains > 0 AND starts > 0 THEN gains / starts ELSE 0 END AS epr,
    CASE WHEN runs >= 3 THEN win_pct END AS wp FROM inp),
s2 AS (
  SELECT *, avg(nullif(epr, 0)) OVER r AS em, stddev_pop(nullif(epr, 0)) OVER r AS es, count(*) OVER r AS n,
    count(*) OVER (PARTITION BY race_id ORDER BY epr DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e_at_least,
    coalesce(avg(wp) OVER r, 0) AS wm, stddev_pop(wp) OVER r AS ws, avg(dropped) OVER r AS dm, stddev_samp(dropped) OVER r AS ds,
    avg(purse_ratio) OVER r AS pm, avg(trend) OVER r AS tm, stddev_samp(trend) OVER r AS ts, avg(recent) OVER r AS rm,
    stddev_samp(recent) OVER r AS rs, avg(joc_trend) OVER r AS jm, stddev_samp(joc_trend) OVER r AS js,
    CASE WHEN coalesce(last_dist, 0) > 0 THEN abs(dist - last_dist) ELSE 1000 END AS move
  FROM s1 WINDOW r AS (PARTITION BY race_id)),
s3 AS (
  SELECT *, coalesce(em, 0) AS field_avg_earnings,
    CASE WHEN epr = 0 OR em IS NULL THEN 0 ELSE CASE WHEN es > 0 THEN greatest(-2, least(2, (epr - em) / es)) / 2 ELSE 0 END END AS earnings_score,
    CASE WHEN epr = 0 OR em IS NULL THEN CAST(floor(n / 2) AS BIGINT) ELSE e_at_least END AS earnings_rank,
    epr > 0 AND cheque > 0 AND epr > cheque / n * 2 AS earnings_advantage,
    CASE WHEN runs >= 3 AND wm <> 0 AND ws > 0 THEN greatest(-2, least(2, (win_pct - wm) / ws)) / 2 ELSE 0 END AS track_score,
    runs >= 5 AND wm <> 0 AND win_pct > wm * 1.5 AND win_pct > 10 AS track_specialist,
    CASE WHEN ds > 0 THEN greatest(-2, least(2, (dropped - dm) / ds)) / 2 ELSE 0 END AS class_score,
    (dropped - dm) * 0.7 + (pm - purse_ratio) / greatest(pm, 0.01) * 0.3 AS class_relief_score,
    greatest(-2, least(2, CASE WHEN rs > 0 THEN (recent - rm) / rs ELSE 0 END * 0.4 + CASE WHEN ts > 0 THEN (trend - tm) / ts ELSE 0 END * 0.35
      + CASE WHEN js > 0 THEN (joc_trend - jm) / js ELSE 0 END * 0.25)) / 2 AS form_score,
    trend > 0.01 AND recent > rm AS positive_momentum, (jwins - 0.1 * greatest(greatest(rides, 1) - 4, 0)) * 0.6 + twins * 0.4 AS connection_score,
    jwins > 0 AND greatest(rides, 1) <= 4 AND twins > 0 AS hot_connection, move <= 200 AS distance_comfort,
    CASE WHEN move <= 50 THEN 1.0 WHEN move <= 200 THEN 0.5 WHEN move / dist < 0.2 THEN 0.0 ELSE -0.5 END::DOUBLE AS comfort_score
  FROM s2),
s4 AS (
  SELECT *, earnings_score * 0.25 + track_score * 0.25 + form_score * 0.25 + connection_score * 0.15 + comfort_score * 0.10 AS composite_score,
    CAST(earnings_advantage AS INTEGER) + CAST(track_specialist AS INTEGER) + CAST(positive_momentum AS INTEGER) + CAST(hot_connection AS INTEGER)
      + CAST(distance_comfort AS INTEGER) AS total_advantages,
    greatest(-0.5, least(0.5, - CASE WHEN earnings_advantage THEN 0.25 ELSE 0 END - CASE WHEN track_specialist THEN 0.20 ELSE 0 END
      - CASE WHEN positive_momentum THEN 0.15 ELSE 0 END - CASE WHEN hot_connection THEN 0.10 ELSE 0 END - CASE WHEN distance_comfort THEN 0.05 ELSE 0 END)) AS adj
  FROM s3),
s5 AS (
  SELECT *, round(greatest(earnings_score, track_score, form_score, connection_score, comfort_score), 9) AS top_score,
    CASE WHEN total_advantages >= 3 AND composite_score > 0.3 THEN 'dominant' WHEN total_advantages >= 2 AND composite_score > 0.15 THEN 'strong'
      WHEN total_advantages >= 1 OR composite_score > 0.05 THEN 'moderate' WHEN composite_score > -0.1 THEN 'neutral' ELSE 'weak' END AS strength
  FROM s4),
s AS (
  SELECT *, CASE WHEN total_advantages > 1 THEN 'multiple' WHEN total_advantages = 1 THEN CASE top_score WHEN round(earnings_score, 9) THEN 'earnings' WHEN round(track_score, 9) THEN 'track'
      WHEN round(form_score, 9) THEN 'form' WHEN round(connection_score, 9) THEN 'connection' ELSE 'distance' END ELSE 'none' END AS primary_advantage_type,
    CASE WHEN total_advantages > 1 THEN composite_score WHEN total_advantages = 1 THEN top_score ELSE 0 END AS advantage_strength,
    0.6 * pred_a + 0.4 * pred_b AS ensemble
  FROM s5)"""
)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = field(spark, sf)
    odds, price = F.col("odds"), F.col("price")
    rows = rows.select(
        "race_id", "numero", "partant", "cheque", "dist", "pred_a", "pred_b",
        F.when(F.col("discount") > 0.01, price).alias("gains"),
        odds.alias("starts"),
        (F.sqrt(price) / 10).alias("win_pct"),
        F.col("line_no").alias("runs"),
        (F.sqrt(odds) / 7).alias("dropped"),
        (F.col("pred_b") / 20).alias("purse_ratio"),
        (F.sqrt(odds) - 4).alias("trend"),
        (F.col("pred_b") / 5).alias("recent"),
        (F.sqrt(price) / 100 - 1.5).alias("joc_trend"),
        (odds.cast("long") % 3).alias("jwins"),
        (F.col("horse_id") % 2).alias("twins"),
        (F.col("horse_id") % 7).alias("rides"),
        F.when(F.col("flag") != "N", F.col("dist") + (F.col("line_no") - 4) * 60).alias("last_dist"),
    )
    rows = relative.earnings_scores(rows, by_race, "gains", "starts", "cheque")
    rows = relative.track_scores(rows, by_race, "win_pct", "runs")
    rows = relative.class_scores(rows, by_race, "dropped", "purse_ratio")
    rows = relative.form_scores(rows, by_race, "trend", "recent", "joc_trend")
    rows = relative.connection_scores(rows, "jwins", "twins", "rides")
    return relative.distance_scores(rows, "dist", "last_dist")


def adjusted(spark: SparkSession, sf: str) -> DataFrame:
    rows = relative.composite(scored(spark, sf))
    return relative.adjust(rows.withColumn("ensemble", blend({"pred_a": 0.6, "pred_b": 0.4})), "ensemble")


@query(
    _INPUT
    + """
SELECT race_id, numero, round(epr, 9) AS earnings_per_race, round(field_avg_earnings, 9) AS field_avg_earnings, round(earnings_score, 6)::DOUBLE AS earnings_score,
  earnings_rank, CAST(earnings_advantage AS INTEGER) AS earnings_advantage, round(track_score, 6)::DOUBLE AS track_score, CAST(track_specialist AS INTEGER) AS track_specialist,
  round(class_score, 6)::DOUBLE AS class_score, round(class_relief_score, 6) AS class_relief_score, round(form_score, 6)::DOUBLE AS form_score,
  CAST(positive_momentum AS INTEGER) AS positive_momentum, round(connection_score, 6)::DOUBLE AS connection_score, CAST(hot_connection AS INTEGER) AS hot_connection,
  comfort_score, CAST(distance_comfort AS INTEGER) AS distance_comfort FROM s3"""
)
def relative_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    flags = ("earnings_advantage", "track_specialist", "positive_momentum", "hot_connection", "distance_comfort")
    out = rows.select(
        "race_id", "numero", F.round("earnings_per_race", 9).alias("earnings_per_race"),
        F.round("field_avg_earnings", 9).alias("field_avg_earnings"), "earnings_rank", *[F.col(f).cast("int").alias(f) for f in flags],
        *[F.round(c, 6).alias(c) for c in (
            "earnings_score", "track_score", "class_score", "class_relief_score", "form_score", "connection_score", "comfort_score")],
    )
    return out


@query(
    _INPUT
    + """
SELECT race_id, numero, round(composite_score, 6)::DOUBLE AS composite_score, total_advantages, primary_advantage_type, round(advantage_strength, 6)::DOUBLE AS advantage_strength,
  strength AS competitive_strength, round(adj, 6)::DOUBLE AS total_adjustment, round(ensemble * (1 + adj), 6) AS final_prediction FROM s"""
)
def composite_adjustment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        adjusted(spark, sf).select(
            "race_id", "numero", "composite_score", "total_advantages", "primary_advantage_type", "advantage_strength",
            "competitive_strength", "total_adjustment", "final_prediction",
        )
    )


@query(
    _INPUT
    + """,
o AS (
  SELECT race_id, numero, track_score * 0.25 + class_score * 0.25 + form_score * 0.20 + earnings_score * 0.30 AS composite_score,
    CAST(earnings_score > 0.05 AS INTEGER) + CAST(track_score > 0.15 AS INTEGER) + CAST(class_score > 0.20 AS INTEGER) + CAST(form_score > 0.10 AS INTEGER) AS total_advantages,
    earnings_score * 0.15 + track_score * 0.12 + class_score * 0.10 + form_score * 0.08 AS total_adjustment FROM s3)
SELECT race_id, numero, round(composite_score, 6)::DOUBLE AS composite_score, total_advantages, round(total_adjustment, 6)::DOUBLE AS total_adjustment,
  CASE WHEN total_advantages >= 3 AND composite_score > 0.3 THEN 'dominant' WHEN total_advantages >= 2 AND composite_score > 0.15 THEN 'strong'
      WHEN total_advantages >= 1 OR composite_score > 0.05 THEN 'moderate' WHEN composite_score > -0.1 THEN 'neutral' ELSE 'weak' END AS competitive_strength
FROM o"""
)
def older_composite(spark: SparkSession, sf: str) -> DataFrame:
    names = {"speed": "earnings_score", "track": "track_score", "class": "class_score", "form": "form_score"}
    rows = relative.composite(scored(spark, sf), relative.OLDER, names)
    return rounded(
        rows.select("race_id", "numero", "composite_score", "total_advantages", "total_adjustment", "competitive_strength")
    )


@query(
    _INPUT
    + """,
k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(composite_score, 9) DESC, numero) AS contender FROM s)
SELECT race_id, numero, contender, round(composite_score, 6)::DOUBLE AS composite_score, strength AS competitive_strength, total_advantages, primary_advantage_type,
  array_to_string(list_filter([CASE WHEN earnings_advantage THEN 'earnings' END, CASE WHEN track_specialist THEN 'track' END, CASE WHEN positive_momentum THEN 'form' END,
    CASE WHEN hot_connection THEN 'connection' END, CASE WHEN distance_comfort THEN 'distance' END], lambda x : x IS NOT NULL), ',') AS key_advantages
FROM k WHERE contender <= 3"""
)
def top_contenders(spark: SparkSession, sf: str) -> DataFrame:
    rows = relative.composite(scored(spark, sf))
    out = relative.top_contenders(rows, ["race_id"], "numero")
    return rounded(out.withColumn("key_advantages", F.array_join("key_advantages", ",")))


@query(
    _INPUT
    + """
SELECT race_id, count(*) AS total_horses, round(avg(composite_score), 6)::DOUBLE AS average_competitive_score, round(stddev_pop(composite_score), 6)::DOUBLE AS std_competitive_score,
  round(max(composite_score), 6)::DOUBLE AS max_competitive_score, round(min(composite_score), 6)::DOUBLE AS min_competitive_score, round(avg(total_advantages), 6) AS average_advantages,
  count(*) FILTER (WHERE total_advantages > 0) AS horses_with_advantages, count(*) FILTER (WHERE total_advantages > 1) AS horses_with_multiple_advantages,
  count(*) FILTER (WHERE earnings_advantage) AS earnings_advantage_count, count(*) FILTER (WHERE track_specialist) AS track_specialist_count,
  count(*) FILTER (WHERE positive_momentum) AS positive_momentum_count, count(*) FILTER (WHERE hot_connection) AS hot_connection_count,
  count(*) FILTER (WHERE distance_comfort) AS distance_comfort_count,
  CASE WHEN stddev_pop(composite_score) > 0.15 THEN 'high' WHEN stddev_pop(composite_score) > 0.08 THEN 'moderate' ELSE 'low' END AS field_competitiveness
FROM s GROUP BY race_id"""
)
def field_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relative.field_statistics(relative.composite(scored(spark, sf)), ["race_id"]))


@query(
    _INPUT
    + """,
f AS (SELECT race_id, CASE WHEN stddev_pop(composite_score) > 0.15 THEN 'high' WHEN stddev_pop(composite_score) > 0.08 THEN 'moderate' ELSE 'low' END AS level FROM s GROUP BY race_id),
c AS (SELECT s.race_id, level, avg(abs(ensemble * adj)) AS m, max(abs(ensemble * adj)) AS x FROM s JOIN f ON s.race_id = f.race_id GROUP BY s.race_id, level)
SELECT race_id, level AS field_competitiveness, round(m, 6) AS average_prediction_change, round(x, 6) AS max_prediction_change,
  CASE WHEN level = 'high' AND m > 0.05 THEN 0.015 WHEN level = 'moderate' AND m > 0.03 THEN 0.010 ELSE 0.005 END::DOUBLE AS estimated_r2_improvement,
  CASE WHEN level = 'high' THEN 'high' ELSE 'moderate' END AS confidence_level FROM c"""
)
def adjustment_impact(spark: SparkSession, sf: str) -> DataFrame:
    rows = adjusted(spark, sf)
    level = relative.field_statistics(rows, ["race_id"]).select("race_id", "field_competitiveness")
    out = performance.impact_estimate(rows.join(level, "race_id"), ["race_id"], "ensemble", "final_prediction", "field_competitiveness")
    return rounded(out)


@query(
    _INPUT
    + """
SELECT race_id, count(*) AS runners, round(max(composite_score), 6)::DOUBLE AS best_score, least(3, count(*)) AS contenders FROM s GROUP BY race_id"""
)
def analysis_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested analysis per race, read back from the nested columns."""
    rows = relative.composite(scored(spark, sf))
    documents = relative.analysis_document(rows, "race_id", "numero", ["composite_score", *relative.SCORES.values()])
    out = documents.groupBy("race_id").agg(
        F.sum(F.size("competitive_scores")).alias("runners"),
        F.max("field_statistics.max_competitive_score").alias("best_score"),
        F.max(F.size("top_contenders")).cast("long").alias("contenders"),
    )
    return rounded(out)
