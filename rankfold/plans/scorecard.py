"""Order strings, bets and the race scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.orders import explode_order
from ..operators import evaluation
from ..operators.blending import blend
from ..operators.grouping import row_number_within
from ..operators.nesting import CHUNK, nest, order_strings, unnest
from .registry import query
from .roles import WITH_RUNNERS, rounded, runners

BLEND = {"pred_a": 0.6, "pred_b": 0.4}

RANKED = """,
ranked AS (
  SELECT *, 0.6 * pred_a + 0.4 * pred_b AS score,
         row_number() OVER (PARTITION BY race_id ORDER BY 0.6 * pred_a + 0.4 * pred_b, numero) AS rank
  FROM runners)"""


def ranked_runners(spark: SparkSession, sf: str):
    rows, by_race = runners(spark, sf)
    rows = rows.withColumn("score", blend(BLEND))
    return row_number_within(rows, by_race, [F.col("score").asc(), F.col("numero").asc()], "rank"), by_race


CARD_SQL = """,
joined AS (SELECT race_id, numero, score, rank, position FROM ranked),
card AS (
  SELECT race_id, count(*) AS horses, avg(abs(score - position)) AS mae,
         max(CASE WHEN rank = 1 AND position = 1 THEN 1 ELSE 0 END) AS winner_correct,
         count(*) FILTER (WHERE rank = position AND rank <= 5) AS same_place,
         count(*) FILTER (WHERE rank <= 5 AND position <= 5) AS in5,
         count(*) FILTER (WHERE rank <= 5 AND position <= 4) AS in4,
         count(*) FILTER (WHERE rank <= 5 AND position <= 3) AS in3,
         count(*) FILTER (WHERE rank <= 6 AND position <= 5) AS s5,
         count(*) FILTER (WHERE rank <= 6 AND position <= 4) AS s4,
         count(*) FILTER (WHERE rank <= 6 AND position <= 3) AS s3
  FROM joined GROUP BY race_id)"""


def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Nested races -> runners -> blend -> rank -> joined results -> per-race card."""
    rows, by_race = runners(spark, sf)
    nested = nest(rows, ["race_id"], "numero", ["horse_id", "pred_a", "pred_b"], "participants")
    field = unnest(nested, "participants").drop("part").withColumn("score", blend(BLEND))
    field = row_number_within(field, by_race, [F.col("score").asc(), F.col("numero").asc()], "rank")
    arrivals = order_strings(rows, ["race_id"], "position", "numero", "ordre")
    results = explode_order(arrivals, "ordre", "race_id", "part").select(
        "race_id", "numero", (F.col("part") * CHUNK + F.col("position")).alias("actual_position")
    )
    joined = field.join(results, ["race_id", "numero"], "left")
    return evaluation.per_race(joined, by_race, score="score", rank="rank")


@query(
    WITH_RUNNERS + RANKED + CARD_SQL + """
SELECT count(*) AS total_races, CAST(sum(horses) AS BIGINT) AS total_horses,
       CAST(sum(winner_correct) AS BIGINT) AS winners,
       round(avg(winner_correct), 6) AS winner_rate, round(avg(mae), 6) AS mean_race_mae,
       CAST(sum(in5) AS BIGINT) AS horses_in_quinte,
       count(*) FILTER (WHERE in3 = 3) AS top5_bonus3, count(*) FILTER (WHERE in4 = 4) AS top5_bonus4,
       count(*) FILTER (WHERE in5 = 5) AS top5_quinte, count(*) FILTER (WHERE s3 = 3) AS top6_bonus3,
       count(*) FILTER (WHERE s4 = 4) AS top6_bonus4, count(*) FILTER (WHERE s5 = 5) AS top6_quinte
FROM card"""
)
def flagship_event_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    card = scorecard(spark, sf)
    out = card.agg(
        F.count(F.lit(1)).alias("total_races"),
        F.sum("horses").alias("total_horses"),
        F.sum("winner_correct").alias("winners"),
        F.avg("winner_correct").alias("winner_rate"),
        F.avg("mae").alias("mean_race_mae"),
        F.sum("horses_in_quinte").alias("horses_in_quinte"),
        F.sum("top5_bonus3").alias("top5_bonus3"),
        F.sum("top5_bonus4").alias("top5_bonus4"),
        F.sum("top5_quinte_desordre").alias("top5_quinte"),
        F.sum("top6_bonus3").alias("top6_bonus3"),
        F.sum("top6_bonus4").alias("top6_bonus4"),
        F.sum("top6_quinte_desordre").alias("top6_quinte"),
    )
    return rounded(out)


@query(
    WITH_RUNNERS + RANKED + """
, lists AS (
  SELECT race_id, count(*) AS horses, round(avg(abs(score - position)), 6) AS mae,
    list(numero ORDER BY rank) FILTER (WHERE rank <= 5) AS p5, list(numero ORDER BY rank) FILTER (WHERE rank <= 6) AS p6,
    list(numero ORDER BY position) FILTER (WHERE position <= 5) AS a5,
    count(*) FILTER (WHERE rank = position AND rank <= 5) AS same_place,
    count(*) FILTER (WHERE rank <= 5 AND position <= 5) AS in5,
    count(*) FILTER (WHERE rank <= 5 AND position <= 4) AS in4,
    count(*) FILTER (WHERE rank <= 5 AND position <= 3) AS in3,
    count(*) FILTER (WHERE rank <= 6 AND position <= 5) AS s5,
    count(*) FILTER (WHERE rank <= 6 AND position <= 4) AS s4,
    count(*) FILTER (WHERE rank <= 6 AND position <= 3) AS s3,
    max(CASE WHEN rank = 1 AND position = 1 THEN 1 ELSE 0 END) AS winner_correct
  FROM ranked GROUP BY race_id)
SELECT race_id, horses, mae, array_to_string(p5, ',') AS predicted_top5, array_to_string(p6, ',') AS predicted_top6,
  array_to_string(a5, ',') AS actual_arrive,
  CASE WHEN len(a5) >= 5 THEN same_place * 20.0::DOUBLE ELSE 0.0::DOUBLE END AS pct_exact_order,
  CASE WHEN len(p5) >= 5 THEN in5 * 20.0::DOUBLE ELSE 0.0::DOUBLE END AS pct_in_quinte,
  CAST(in5 AS INTEGER) AS horses_in_quinte, winner_correct,
  CAST(in3 AS INTEGER) AS top5_bonus3_count, CAST(in3 = 3 AS INTEGER) AS top5_bonus3,
  CAST(in4 AS INTEGER) AS top5_bonus4_count, CAST(in4 = 4 AS INTEGER) AS top5_bonus4,
  CAST(in5 AS INTEGER) AS top5_quinte_count, CAST(in5 = 5 AS INTEGER) AS top5_quinte_desordre,
  CAST(s3 AS INTEGER) AS top6_bonus3_count, CAST(s3 = 3 AS INTEGER) AS top6_bonus3,
  CAST(s4 AS INTEGER) AS top6_bonus4_count, CAST(s4 = 4 AS INTEGER) AS top6_bonus4,
  CAST(s5 AS INTEGER) AS top6_quinte_count, CAST(s5 = 5 AS INTEGER) AS top6_quinte_desordre
FROM lists"""
)
def race_scorecards(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = ranked_runners(spark, sf)
    return rounded(evaluation.per_race(rows, by_race, score="score", rank="rank", actual="position"))


@query(
    WITH_RUNNERS + """
SELECT race_id, numero, horse_id, round(pred_b, 6) AS pred_b FROM runners"""
)
def nested_explode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    nested = nest(rows, ["race_id"], "numero", ["horse_id", "pred_b"], "participants")
    return rounded(unnest(nested, "participants").drop("part"))


@query(WITH_RUNNERS + """ SELECT race_id, position, numero FROM runners""")
def order_string_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    texts = order_strings(rows, ["race_id"], "position", "numero", "ordre")
    found = explode_order(texts, "ordre", "race_id", "part")
    return found.select("race_id", (F.col("part") * CHUNK + F.col("position")).alias("position"), "numero")


@query(
    WITH_RUNNERS + RANKED + """
SELECT race_id, array_to_string(list(numero ORDER BY rank), '-') AS predicted,
       array_to_string(list(numero ORDER BY position), '-') AS actual
FROM ranked GROUP BY race_id"""
)
def full_order_strings(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = ranked_runners(spark, sf)
    predicted = order_strings(rows, ["race_id"], "rank", "numero", "predicted")
    actual = order_strings(rows, ["race_id"], "position", "numero", "actual")
    return predicted.join(actual, ["race_id", "part"]).drop("part")
