"""Blends, weight rules and weight search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import bucket
from ..operators import blending
from ..operators.grouping import row_number_within, top_k
from .registry import query
from .roles import RACES, WITH_FIELD, WITH_RUNNERS, field, rounded, runners, table

GRID = blending.weight_steps(0.1)
_GRID_SQL = "[" + ",".join(str(w) for w in GRID) + "]"

# Rules in the shape of a weight configuration; the first match wins.
RULES = (
    {"condition": {"typec": "1-URGENT"}, "weights": {"rf": 0.9, "tabnet": 0.1}, "accuracy": 47.8},
    {"condition": {"dist_min": 1500, "dist_max": 2000}, "weights": {"rf": 0.9, "tabnet": 0.1}, "accuracy": 27.6},
    {"condition": {"partant_max": 3}, "weights": {"rf": 1.0, "tabnet": 0.0}, "accuracy": 25.2},
    {"condition": {"typec": "2-HIGH"}, "weights": {"rf": 0.7, "tabnet": 0.3}, "accuracy": 22.4},
    {"condition": {"cheque_min": 300000}, "weights": {"rf": 0.5, "tabnet": 0.5}},
)
DEFAULT = {"rf": 0.9, "tabnet": 0.1}


@query(
    WITH_RUNNERS
    + """,
s AS (SELECT race_id, numero, CASE WHEN flag <> 'A' THEN pred_a END AS a, CASE WHEN status = 'O' THEN pred_b END AS b, odds AS c FROM runners),
w AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 0.5 END AS wa, CASE WHEN b IS NULL THEN 0 ELSE 0.3 END AS wb, 0.2 AS wc FROM s)
SELECT race_id, numero, round((coalesce(a, 0) * wa + coalesce(b, 0) * wb + c * wc) / (wa + wb + wc), 6) AS blended,
  round(coalesce(a * 0.6 + b * 0.4, a, b), 6) AS fixed_blend
FROM w"""
)
def blend_two_models(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    rows = rows.select(
        "race_id",
        "numero",
        F.when(F.col("flag") != "A", F.col("pred_a")).alias("a"),
        F.when(F.col("status") == "O", F.col("pred_b")).alias("b"),
        F.col("odds").alias("c"),
    )
    out = rows.select(
        "race_id",
        "numero",
        blending.blend({"a": 0.5, "b": 0.3, "c": 0.2}).alias("blended"),
        blending.blend_fixed("a", "b").alias("fixed_blend"),
    )
    return rounded(out)


def rule_races(spark: SparkSession, sf: str) -> DataFrame:
    """Races with their field size; one row per race before the join."""
    lines = table(spark, sf, "lineitem")
    sizes = lines.groupBy(F.col("l_orderkey").alias("race_id")).agg(F.count(F.lit(1)).alias("partant"))
    from .roles import races

    return races(spark, sf).join(sizes, "race_id").select("race_id", "typec", "dist", "cheque", "partant")


_RULE_RACES = (
    "WITH"
    + RACES
    + """,
r AS (SELECT a.race_id, a.typec, a.dist, a.cheque, s.partant FROM races a
      JOIN (SELECT l_orderkey AS race_id, count(*) AS partant FROM lineitem GROUP BY l_orderkey) s ON a.race_id = s.race_id)"""
)


@query(
    _RULE_RACES
    + """,
n AS (SELECT *, CASE WHEN typec = '1-URGENT' THEN 1 WHEN dist BETWEEN 1500 AND 2000 THEN 2 WHEN partant <= 3 THEN 3
      WHEN typec = '2-HIGH' THEN 4 WHEN cheque >= 300000 THEN 5 ELSE 0 END AS rule_no FROM r)
SELECT race_id, rule_no, CASE rule_no WHEN 3 THEN 1.0 WHEN 4 THEN 0.7 WHEN 5 THEN 0.5 ELSE 0.9 END::DOUBLE AS rf,
  CASE rule_no WHEN 3 THEN 0.0 WHEN 4 THEN 0.3 WHEN 5 THEN 0.5 ELSE 0.1 END::DOUBLE AS tabnet
FROM n"""
)
def rule_weights_first_match(spark: SparkSession, sf: str) -> DataFrame:
    out = blending.first_rule(rule_races(spark, sf), RULES, DEFAULT)
    return out.select("race_id", "rule_no", "rf", "tabnet")


@query(
    _RULE_RACES
    + """,
k AS (SELECT * FROM (VALUES (1, 0.9, 0.1, 47.8), (2, 0.9, 0.1, 27.6), (3, 1.0, 0.0, 25.2), (4, 0.7, 0.3, 22.4), (5, 0.5, 0.5, NULL))
      t(rule_no, rf, tabnet, accuracy))
SELECT race_id, rule_no, rf::DOUBLE AS rf, tabnet::DOUBLE AS tabnet, accuracy::DOUBLE AS accuracy FROM r JOIN k ON
  (rule_no = 1 AND typec = '1-URGENT') OR (rule_no = 2 AND dist BETWEEN 1500 AND 2000) OR (rule_no = 3 AND partant <= 3)
  OR (rule_no = 4 AND typec = '2-HIGH') OR (rule_no = 5 AND cheque >= 300000)"""
)
def rule_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    out = blending.all_rules(rule_races(spark, sf), RULES)
    return out.select("race_id", "rule_no", "rf", "tabnet", "accuracy").orderBy(F.desc_nulls_last("accuracy"))


@query(
    WITH_FIELD
    + """,
w AS (
  SELECT race_id, numero, pred_a, pred_b, odds,
    0.4 * CASE WHEN dist < 1200 THEN 1.2 ELSE 1 END * 1.1 AS w_rf,
    0.3 * CASE WHEN dist > 2000 THEN 1.2 ELSE 1 END * 1.3 AS w_lstm,
    0.3 * CASE WHEN partant > 16 THEN 1.3 ELSE 1 END * 0.7 AS w_ens
  FROM field)
SELECT race_id, numero, round((pred_a * w_rf + pred_b * w_lstm + odds * w_ens) / (w_rf + w_lstm + w_ens), 6) AS blended FROM w"""
)
def adaptive_blend(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = field(spark, sf)
    weights = blending.adaptive_weights({"rf": 0.4, "lstm": 0.3, "ensemble": 0.3}, "dist", "typec", "partant")
    recent = {"rf": 5.5, "lstm": 4.0, "ensemble": 9.0}
    weights = {m: w * blending.performance_factor(F.lit(recent[m])) for m, w in weights.items()}
    rows = rows.select("*", F.col("pred_a").alias("rf"), F.col("pred_b").alias("lstm"), F.col("odds").alias("ensemble"))
    return rounded(rows.select("race_id", "numero", blending.blend(weights).alias("blended")))


@query(
    WITH_FIELD
    + f""",
n AS (SELECT race_id, numero, pred_a, pred_b, CASE WHEN typec = '1-URGENT' THEN 0.9 WHEN dist BETWEEN 1500 AND 2000 THEN 0.9
      WHEN partant <= 3 THEN 1.0 WHEN typec = '2-HIGH' THEN 0.7 WHEN cheque >= 300000 THEN 0.5 ELSE 0.9 END::DOUBLE AS rf FROM field)
SELECT race_id, numero, round(pred_a * rf + pred_b * (1 - rf), 6) AS final_prediction,
  row_number() OVER (PARTITION BY race_id ORDER BY round(pred_a * rf + pred_b * (1 - rf), 9), numero) AS predicted_rank
FROM n"""
)
def reblend_with_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Stored scores under the current rules, ranked again."""
    rows, by_race = field(spark, sf)
    rows = blending.first_rule(rows, RULES, DEFAULT)
    score = blending.blend({"pred_a": F.col("rf"), "pred_b": F.col("tabnet")})
    rows = rows.withColumns({"final_prediction": score, "key": F.round(score, 9)})
    rows = row_number_within(rows, by_race, [F.col("key").asc(), F.col("numero").asc()], "predicted_rank")
    return rounded(rows.select("race_id", "numero", "final_prediction", "predicted_rank"))


def _grid_sql(keys: str = "", extra: str = "", source: str = "runners", podium: str = "podium >= 3 AND placed >= 3") -> str:
    by = f", {keys}" if keys else ""
    return f""",
g AS (SELECT r.*{extra}, w.weight, row_number() OVER (PARTITION BY race_id, w.weight
        ORDER BY pred_a * w.weight + pred_b * (1 - w.weight), numero) AS rank
      FROM {source} r, (SELECT unnest({_GRID_SQL}::DOUBLE[]) AS weight) w),
p AS (SELECT race_id, weight{by}, max(CASE WHEN rank = 1 AND position = 1 THEN 1 ELSE 0 END) AS win,
        count(*) FILTER (WHERE rank <= 3 AND position <= 3) AS podium, count(*) FILTER (WHERE position <= 3) AS placed,
        count(*) FILTER (WHERE rank <= 5 AND position <= 5) AS in5, count(*) FILTER (WHERE rank <= 5 AND position <= 4) AS in4,
        count(*) FILTER (WHERE rank <= 5 AND position <= 3) AS in3, sum(abs(rank - position)) AS err,
        sum((rank - position) * (rank - position)) AS err2, count(*) AS n
      FROM g GROUP BY race_id, weight{by}),
results AS (
  SELECT weight{by}, avg(win) AS winner_accuracy, avg(CASE WHEN {podium} THEN 1 ELSE 0 END) AS podium_accuracy,
    sum(err) / sum(n) AS mae, sqrt(sum(err2) / sum(n)) AS rmse, count(*) FILTER (WHERE in5 = 5) AS quinte_desordre,
    count(*) FILTER (WHERE in4 = 4) AS bonus4, count(*) FILTER (WHERE in3 = 3) AS bonus3, count(*) AS total_races
  FROM p GROUP BY weight{by})"""


_RESULT = """round(winner_accuracy, 6) AS winner_accuracy, round(podium_accuracy, 6) AS podium_accuracy, round(mae, 6) AS mae,
  round(rmse, 6) AS rmse, quinte_desordre, bonus4, bonus3, total_races"""
_TYPE = ", (SELECT o_orderpriority FROM orders WHERE o_orderkey = r.race_id) AS typec"


def graded(spark: SparkSession, sf: str, keep=()):
    rows, by_race = runners(spark, sf)
    rows = rows.select("race_id", "numero", "position", "pred_a", "pred_b")
    if keep:
        races = rule_races(spark, sf).withColumn("dist_range", _dist_range(F.col("dist")))
        rows = rows.join(races.select("race_id", *keep), "race_id")
    ranked, _ = blending.over_weights(rows, by_race, "pred_a", "pred_b", GRID, ["numero"])
    return ranked


def _dist_range(dist):
    return bucket(
        dist, [0, 1500, 2000, 2500, 3000, float("inf")],
        ["<1500m", "1500-2000m", "2000-2500m", "2500-3000m", ">3000m"], right_closed=False,
    )


@query(WITH_RUNNERS + _grid_sql() + f"\nSELECT weight, {_RESULT} FROM results")
def weight_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(blending.weight_results(graded(spark, sf), ["race_id"], "numero", "position"))


_WITH_TYPES = (
    WITH_FIELD
    + """,
typed AS (SELECT race_id, numero, position, pred_a, pred_b, typec, CASE WHEN dist < 1500 THEN '<1500m' WHEN dist < 2000 THEN '1500-2000m'
    WHEN dist < 2500 THEN '2000-2500m' WHEN dist < 3000 THEN '2500-3000m' ELSE '>3000m' END AS dist_range FROM field)"""
)


@query(
    _WITH_TYPES
    + _grid_sql("typec, dist_range", source="typed")
    + f"\nSELECT weight, typec, dist_range, {_RESULT} FROM results"
)
def weight_grid_by_group(spark: SparkSession, sf: str) -> DataFrame:
    ranked = graded(spark, sf, ["typec", "dist_range"])
    return rounded(blending.weight_results(ranked, ["race_id"], "numero", "position", ["typec", "dist_range"]))


@query(
    _WITH_TYPES
    + _grid_sql("dist_range", source="typed", podium="podium >= 2")
    + """,
ball AS (SELECT weight, avg(win) AS acc, count(*) AS n FROM p GROUP BY weight),
ov AS (SELECT weight AS ow, acc AS oa FROM ball ORDER BY round(acc, 9) DESC, weight LIMIT 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dist_range ORDER BY round(winner_accuracy, 9) DESC, weight) AS k FROM results) WHERE k = 1)
SELECT dist_range, weight AS optimal_weight, round(winner_accuracy, 6) AS winner_accuracy,
  round(winner_accuracy - oa, 6) AS improvement_vs_overall, total_races,
  CASE WHEN round(abs(weight - ow), 9) >= 0.2 THEN 'own_weight' ELSE 'overall_weight' END AS recommendation
FROM b, ov WHERE total_races >= 10 AND (round(abs(weight - ow), 9) >= 0.2 OR winner_accuracy - oa > 0.05)"""
)
def best_weight_patterns(spark: SparkSession, sf: str) -> DataFrame:
    ranked = graded(spark, sf, ["dist_range"])
    per = blending.weight_results(ranked, ["race_id"], "numero", "position", ["dist_range"], min_podium=2)
    overall = per.groupBy("weight").agg(
        (F.sum(F.col("winner_accuracy") * F.col("total_races")) / F.sum("total_races")).alias("winner_accuracy"),
        F.sum("total_races").alias("total_races"),
    )
    return rounded(blending.weight_patterns(per, overall, ["dist_range"]))


@query(
    WITH_RUNNERS
    + _grid_sql()
    + """
SELECT weight, quinte_desordre, bonus4, bonus3, round(winner_accuracy, 6) AS winner_accuracy
FROM results ORDER BY quinte_desordre DESC, bonus4 DESC, bonus3 DESC, weight LIMIT 1"""
)
def best_weight_by_wins(spark: SparkSession, sf: str) -> DataFrame:
    results = blending.weight_results(graded(spark, sf), ["race_id"], "numero", "position")
    best = results.orderBy(F.desc("quinte_desordre"), F.desc("bonus4"), F.desc("bonus3"), "weight").limit(1)
    return rounded(best.select("weight", "quinte_desordre", "bonus4", "bonus3", "winner_accuracy"))


_CHAR_SQL = (
    WITH_FIELD
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY pred_a * 0.8 + pred_b * 0.2, numero) AS rank FROM field),
c AS (SELECT race_id, typec, dist, partant, cheque, (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = cust_id) AS hippo,
    max(CASE WHEN rank = 1 AND position = 1 THEN 1 ELSE 0 END) AS win, count(*) FILTER (WHERE rank <= 3 AND position <= 3) AS podium,
    sum(abs(rank - position)) AS err, count(*) AS n FROM r GROUP BY race_id, typec, dist, partant, cheque, cust_id),
top AS (SELECT hippo FROM c GROUP BY hippo ORDER BY count(*) DESC, hippo LIMIT 5),
long AS (
  SELECT 'typec' AS characteristic, typec AS value, * FROM c
  UNION ALL SELECT 'dist', CASE WHEN dist <= 1500 THEN '<1500m' WHEN dist <= 2000 THEN '1500-2000m' WHEN dist <= 2500 THEN '2000-2500m'
    WHEN dist <= 3000 THEN '2500-3000m' ELSE '>3000m' END, * FROM c
  UNION ALL SELECT 'partant', CASE WHEN partant <= 8 THEN 'Small' WHEN partant <= 12 THEN 'Medium' WHEN partant <= 16 THEN 'Large' ELSE 'Very Large' END, * FROM c
  UNION ALL SELECT 'cheque', CASE WHEN cheque <= 20000 THEN 'Low' WHEN cheque <= 50000 THEN 'Medium' WHEN cheque <= 100000 THEN 'High' ELSE 'Premium' END, * FROM c
  UNION ALL SELECT 'hippo', hippo, * FROM c WHERE hippo IN (SELECT hippo FROM top))
SELECT characteristic, value, round(avg(win), 6) AS winner_accuracy,
  round(avg(CASE WHEN podium = 3 THEN 1 ELSE 0 END), 6) AS podium_accuracy, round(sum(err) / sum(n), 6) AS mae, count(*) AS total_races
FROM long GROUP BY characteristic, value"""
)


@query(_CHAR_SQL)
def results_by_characteristic(spark: SparkSession, sf: str) -> DataFrame:
    """Race results once per race, then unpivoted over five characteristics."""
    from .roles import races, venues

    rows, by_race = runners(spark, sf)
    rows = rows.withColumn("score", F.col("pred_a") * 0.8 + F.col("pred_b") * 0.2)
    rows = row_number_within(rows, by_race, [F.col("score").asc(), F.col("numero").asc()], "rank")
    rank, pos = F.col("rank"), F.col("position")
    per_race = rows.groupBy("race_id").agg(
        F.max(F.when((rank == 1) & (pos == 1), 1).otherwise(0)).alias("win"),
        F.count(F.when((rank <= 3) & (pos <= 3), 1)).alias("podium"),
        F.sum(F.abs(rank - pos)).alias("err"),
        F.count(F.lit(1)).alias("n"),
    )
    per_race = per_race.join(races(spark, sf), "race_id").join(venues(spark, sf), "cust_id")
    dist = bucket(F.col("dist"), [0, 1500, 2000, 2500, 3000, 1e12], ["<1500m", "1500-2000m", "2000-2500m", "2500-3000m", ">3000m"])
    size = bucket(F.col("n"), [0, 8, 12, 16, 1e12], ["Small", "Medium", "Large", "Very Large"])
    purse = bucket(F.col("cheque"), [0, 20_000, 50_000, 100_000, 1e12], ["Low", "Medium", "High", "Premium"])
    values = {"typec": F.col("typec"), "dist": dist, "partant": size, "cheque": purse, "hippo": F.col("hippo")}
    pairs = F.array(*[F.struct(F.lit(k).alias("characteristic"), v.alias("value")) for k, v in values.items()])
    long = per_race.select("win", "podium", "err", "n", F.inline(pairs)).where(F.col("value").isNotNull())
    out = long.groupBy("characteristic", "value").agg(
        F.avg("win").alias("winner_accuracy"),
        F.avg((F.col("podium") == 3).cast("int")).alias("podium_accuracy"),
        (F.sum("err") / F.sum("n")).alias("mae"),
        F.count(F.lit(1)).alias("total_races"),
    )
    # The five most frequent venues are found on the aggregated rows.
    keep = top_k(
        out.where(F.col("characteristic") == "hippo"), ["characteristic"], [F.desc("total_races"), F.asc("value")], 5
    )
    return rounded(out.where(F.col("characteristic") != "hippo").unionByName(keep))


@query(
    WITH_RUNNERS
    + """,
a AS (SELECT *, pred_a + (discount - 0.05) * 100 * w.weight AS score, w.weight FROM runners, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS weight) w),
r AS (SELECT *, row_number() OVER (PARTITION BY race_id, weight ORDER BY round(score, 6), numero) AS rank FROM a),
p AS (SELECT race_id, weight, count(*) FILTER (WHERE rank <= 5 AND position <= 5) AS in5, count(*) FILTER (WHERE rank <= 5 AND position <= 4) AS in4,
    count(*) FILTER (WHERE rank <= 5 AND position <= 3) AS in3, count(*) AS n FROM r GROUP BY race_id, weight)
SELECT weight, count(*) FILTER (WHERE in5 = 5) AS quinte_desordre, count(*) FILTER (WHERE in4 = 4) AS bonus4,
  count(*) FILTER (WHERE in3 = 3) AS bonus3, count(*) AS races FROM p WHERE n >= 5 GROUP BY weight"""
)
def competitive_weight_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Wins per strength of an adjustment, on races with a complete top five."""
    rows, by_race = runners(spark, sf)
    rows = rows.withColumn("adjusted", F.col("pred_a") + (F.col("discount") - 0.05) * 100)
    rows = rows.select("race_id", "numero", "position", "pred_a", "adjusted")
    score = F.round(F.col("pred_a") + (F.col("adjusted") - F.col("pred_a")) * F.col("weight"), 6)
    ranked, _ = blending.under_weights(rows, by_race, (0.0, 0.25, 0.5, 0.75, 1.0), score, [F.col("score").asc(), F.col("numero").asc()])
    rank, pos = F.col("predicted_rank"), F.col("position")
    per = ranked.groupBy("race_id", "weight").agg(
        *[F.count(F.when((rank <= 5) & (pos <= k), 1)).alias(f"in{k}") for k in (3, 4, 5)], F.count(F.lit(1)).alias("n")
    )
    return per.where(F.col("n") >= 5).groupBy("weight").agg(
        F.count(F.when(F.col("in5") == 5, 1)).alias("quinte_desordre"),
        F.count(F.when(F.col("in4") == 4, 1)).alias("bonus4"),
        F.count(F.when(F.col("in3") == 3, 1)).alias("bonus3"),
        F.count(F.lit(1)).alias("races"),
    )
