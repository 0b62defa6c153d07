"""Error metrics, bets, and statistics of stored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.orders import any_order, bet_columns, order_scores
from ..operators import evaluation, performance
from ..operators.grouping import row_number_within
from .registry import query
from .roles import WITH_FIELD, WITH_RUNNERS, rounded, runners
from .scorecard import RANKED, ranked_runners

BETS = (
    "tierce_exact", "tierce_desordre", "quarte_exact", "quarte_desordre", "quinte_exact", "quinte_desordre",
    "bonus4", "bonus3", "deuxsur4", "multi4",
)
EXTRA_BETS = ("quinte_6horses", "bonus4_6horses", "quinte_7horses", "bonus4_7horses", "bonus3_7horses")

# Leading seven of both orders as lists, and the bets settled on them.
ORDERS_SQL = (
    WITH_RUNNERS
    + RANKED
    + """,
o AS (SELECT race_id, list(numero ORDER BY rank) FILTER (WHERE rank <= 7) AS p,
        list(numero ORDER BY position) FILTER (WHERE position <= 7) AS a, avg(abs(rank - position)) AS mre
      FROM ranked GROUP BY race_id)"""
)
_SET = lambda n: f"list_sort(p[1:{n}]) = list_sort(a[1:{n}])"
_WIN = "p[1] = a[1]"
_HIT = lambda lo, hi, lo2, hi2: f"len(list_intersect(p[{lo}:{hi}], a[{lo2}:{hi2}]))"
_BET_SQL = {
    "tierce_exact": "len(p) >= 3 AND p[1:3] = a[1:3]",
    "tierce_desordre": f"len(p) >= 3 AND {_SET(3)}",
    "quarte_exact": "len(p) >= 4 AND p[1:4] = a[1:4]",
    "quarte_desordre": f"len(p) >= 4 AND {_SET(4)}",
    "quinte_exact": "len(p) >= 5 AND p[1:5] = a[1:5]",
    "quinte_desordre": f"len(p) >= 5 AND {_SET(5)}",
    "bonus4": f"len(p) >= 4 AND {_WIN} AND {_HIT(2, 4, 2, 4)} >= 3",
    "bonus3": f"len(p) >= 5 AND {_WIN} AND {_HIT(2, 3, 2, 3)} >= 2",
    "deuxsur4": f"len(p) >= 5 AND {_HIT(1, 4, 1, 4)} >= 2",
    "multi4": f"len(p) >= 5 AND {_SET(4)}",
    "quinte_6horses": f"len(p) >= 6 AND {_HIT(1, 6, 1, 5)} = 5",
    "bonus4_6horses": f"len(p) >= 6 AND {_WIN} AND {_HIT(2, 6, 2, 4)} >= 3",
    "quinte_7horses": f"len(p) >= 7 AND {_HIT(1, 7, 1, 5)} = 5",
    "bonus4_7horses": f"len(p) >= 7 AND {_WIN} AND {_HIT(2, 7, 2, 4)} >= 3",
    "bonus3_7horses": f"len(p) >= 7 AND {_WIN} AND {_HIT(2, 7, 2, 3)} >= 2",
}
_OVERLAP_SQL = {
    **{b: _BET_SQL[b] for b in BETS},
    "bonus4": f"len(p) >= 5 AND {_HIT(1, 5, 1, 5)} >= 4",
    "bonus3": f"len(p) >= 5 AND {_HIT(1, 5, 1, 5)} >= 3",
    "multi4": f"len(p) >= 5 AND {_HIT(1, 4, 1, 5)} = 4",
}
_FLAGS = lambda bets: ", ".join(f"CAST({sql} AS INTEGER) AS {name}" for name, sql in bets.items())
_FLAGGED = ORDERS_SQL + f",\nb AS (SELECT race_id, {_FLAGS({k: _BET_SQL[k] for k in BETS})} FROM o)"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Leading seven of the predicted and the actual order, as arrays."""
    rows, _ = ranked_runners(spark, sf)
    return leading_orders(rows)


def leading_orders(rows: DataFrame) -> DataFrame:
    # One grouping for both orders: conditional collections of at most seven.
    text = lambda rank: F.transform(
        F.array_sort(F.collect_list(F.when(F.col(rank) <= 7, F.struct(F.col(rank), F.col("numero"))))),
        lambda e: e["numero"].cast("string"),
    )
    return rows.groupBy("race_id").agg(
        text("rank").alias("p"),
        text("position").alias("a"),
        F.avg(F.abs(F.col("rank") - F.col("position"))).alias("mean_rank_error"),
    )


def bets(spark: SparkSession, sf: str, definition: str = "first_correct", names=BETS) -> DataFrame:
    won = bet_columns(F.col("p"), F.col("a"), definition)
    return orders(spark, sf).select("race_id", *[won[n].cast("int").alias(n) for n in names])


@query(
    ORDERS_SQL
    + f"""
SELECT race_id, CAST(p[1] = a[1] AS INTEGER) AS winner_correct,
  round(len(list_intersect(p[1:3], a[1:3])) / least(3, len(p)), 6) AS podium_accuracy,
  CAST(len(p) >= 2 AND p[1:2] = a[1:2] AS INTEGER) AS exacta_correct,
  CAST(len(p) >= 3 AND p[1:3] = a[1:3] AS INTEGER) AS trifecta_correct, round(mre, 6) AS mean_rank_error, {_FLAGS(_BET_SQL)}
FROM o"""
)
def bet_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    scores = order_scores(F.col("p"), F.col("a"))
    flags = {**{k: scores[k] for k in ("winner_correct", "exacta_correct", "trifecta_correct")}}
    flags.update(bet_columns(F.col("p"), F.col("a")))
    out = orders(spark, sf).select(
        "race_id", "mean_rank_error", scores["podium_accuracy"].alias("podium_accuracy"),
        *[c.cast("int").alias(n) for n, c in flags.items()],
    )
    return rounded(out)


@query(ORDERS_SQL + f" SELECT race_id, {_FLAGS(_OVERLAP_SQL)} FROM o")
def bet_outcomes_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return bets(spark, sf, "overlap")


@query(
    _FLAGGED
    + """
SELECT bet, CAST(sum(won) AS BIGINT) AS wins, count(*) AS races, round(avg(won), 6) AS rate
FROM (UNPIVOT b ON COLUMNS(* EXCLUDE race_id) INTO NAME bet VALUE won) GROUP BY bet"""
)
def bet_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.bet_totals(bets(spark, sf), BETS))


@query(
    _FLAGGED
    + f"""
SELECT CAST({' + '.join(BETS)} AS INTEGER) AS bets_won, count(*) AS races FROM b GROUP BY 1"""
)
def wins_histogram(spark: SparkSession, sf: str) -> DataFrame:
    count = sum((F.col(b) for b in BETS[1:]), F.col(BETS[0]))
    return bets(spark, sf).groupBy(count.cast("int").alias("bets_won")).agg(F.count(F.lit(1)).alias("races"))


@query(
    _FLAGGED
    + """
SELECT bet, race_id FROM (UNPIVOT b ON COLUMNS(* EXCLUDE race_id) INTO NAME bet VALUE won) WHERE won = 1"""
)
def races_won_by_bet(spark: SparkSession, sf: str) -> DataFrame:
    won = bets(spark, sf)
    flags = won.select("race_id", *[(F.col(b) == 1).alias(b) for b in BETS])
    return evaluation.won_races(flags, BETS, "race_id")


@query(
    ORDERS_SQL
    + """
SELECT count(*) AS races, round(avg(CASE WHEN len(a) >= 5 AND len(list_intersect(p[1:5], a[1:5])) = 5 THEN 1 ELSE 0 END), 6) AS pick5_rate,
  round(avg(CASE WHEN len(p) >= 6 AND len(list_intersect(p[1:6], a[1:5])) = 5 THEN 1 ELSE 0 END), 6) AS pick6_rate,
  round(avg(CASE WHEN len(p) >= 7 AND len(list_intersect(p[1:7], a[1:5])) = 5 THEN 1 ELSE 0 END), 6) AS pick7_rate
FROM o"""
)
def k_pick_strategies(spark: SparkSession, sf: str) -> DataFrame:
    wins = evaluation.strategy_columns(F.col("p"), F.col("a"))
    rates = {f"pick{k}_rate": F.avg(wins[f"pick{k}_win"].cast("int")) for k in (5, 6, 7)}
    return rounded(orders(spark, sf).agg(F.count(F.lit(1)).alias("races"), *[c.alias(n) for n, c in rates.items()]))


@query(
    _FLAGGED
    + f""",
q AS (SELECT b.*, p[1] = a[1] AS winner FROM b JOIN o ON b.race_id = o.race_id JOIN orders ON o_orderkey = b.race_id WHERE o_totalprice > 50000)
SELECT count(*) AS quinte_races, round(avg(CAST(winner AS INTEGER)), 6) AS winner_accuracy,
  round(avg(CASE WHEN quinte_exact + quinte_desordre + bonus4 + bonus3 > 0 THEN 1 ELSE 0 END), 6) AS quinte_bet_win_rate,
  round(avg(CASE WHEN {' + '.join(BETS)} > 0 THEN 1 ELSE 0 END), 6) AS any_bet_win_rate FROM q"""
)
def quinte_race_analysis(spark: SparkSession, sf: str) -> DataFrame:
    won = bet_columns(F.col("p"), F.col("a"))
    some = lambda names: F.avg(F.greatest(*[won[n].cast("int") for n in names]))
    major = spark.read.parquet(f"{sf}/orders.parquet").where(F.col("o_totalprice") > 50_000)
    chosen = orders(spark, sf).join(major.select(F.col("o_orderkey").alias("race_id")), "race_id", "left_semi")
    out = chosen.agg(
        F.count(F.lit(1)).alias("quinte_races"),
        F.avg((F.get("p", 0) == F.get("a", 0)).cast("int")).alias("winner_accuracy"),
        some(["quinte_exact", "quinte_desordre", "bonus4", "bonus3"]).alias("quinte_bet_win_rate"),
        some(BETS).alias("any_bet_win_rate"),
    )
    return rounded(out)


@query(
    WITH_RUNNERS
    + RANKED
    + """
SELECT round(avg(abs(score / 5 - position)), 6) AS mae, round(sqrt(avg(pow(score / 5 - position, 2))), 6) AS rmse,
  count(*) FILTER (WHERE round_even(score / 5, 0) = position) AS exact_correct,
  round(count(*) FILTER (WHERE round_even(score / 5, 0) = position) / count(*), 6) AS exact_accuracy,
  count(*) FILTER (WHERE position <= 5 AND round_even(score / 5, 0) <= 5) AS top5_correct,
  count(*) FILTER (WHERE position <= 5) AS total_top5,
  round(count(*) FILTER (WHERE position <= 5 AND round_even(score / 5, 0) <= 5) / count(*) FILTER (WHERE position <= 5), 6) AS top5_accuracy,
  count(*) AS total_horses FROM ranked"""
)
def error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = ranked_runners(spark, sf)
    rows = rows.select("position", (F.col("score") / 5).alias("predicted"))
    return rounded(rows.agg(*[c.alias(n) for n, c in evaluation.error_metrics("predicted", "position").items()]))


@query(
    WITH_RUNNERS
    + RANKED
    + """,
r AS (SELECT race_id, count(*) AS n, sum(abs(rank - position)) AS err, sum(pow(rank - position, 2)) AS err2,
    count(*) FILTER (WHERE rank <= 1 AND position <= 1) AS h1, count(*) FILTER (WHERE rank <= 3 AND position <= 3) AS h3,
    count(*) FILTER (WHERE rank <= 5 AND position <= 5) AS h5 FROM ranked GROUP BY race_id)
SELECT count(*) AS n_races, CAST(sum(n) AS BIGINT) AS n_predictions, round(sum(err) / sum(n), 6) AS mae,
  round(sqrt(sum(err2) / sum(n)), 6) AS rmse, round(avg(h1), 6) AS winner_accuracy,
  round(avg(CASE WHEN h3 = least(3, n) THEN 1 ELSE 0 END), 6) AS top3_exact,
  round(avg(CASE WHEN h5 = least(5, n) THEN 1 ELSE 0 END), 6) AS top5_exact,
  round(avg(h3), 6) AS avg_top3_overlap, round(avg(h5), 6) AS avg_top5_overlap,
  (SELECT quantile_cont(abs(rank - position)::DOUBLE, 0.5) FROM ranked) AS median_error FROM r"""
)
def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = ranked_runners(spark, sf)
    return rounded(evaluation.rank_metrics(rows, ["race_id"], "rank", "position"))


@query(
    WITH_RUNNERS
    + RANKED
    + """,
v AS (SELECT race_id % 5 = 0 AS test, position::DOUBLE AS y, score / 5 AS p FROM ranked)
SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS split, round(avg(pow(y - p, 2)), 6) AS mse,
  round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) AS r2, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance,
  round(avg(CASE WHEN (y = 1) = (round_even(p, 0) = 1) THEN 1 ELSE 0 END), 6) AS top1_accuracy,
  round(avg(CASE WHEN (y <= 3) = (round_even(p, 0) <= 3) THEN 1 ELSE 0 END), 6) AS top3_accuracy,
  round(avg(CASE WHEN round_even(p, 0) = y THEN 1 ELSE 0 END), 6) AS exact_match,
  round(avg(CASE WHEN abs(round_even(p, 0) - y) <= 1 THEN 1 ELSE 0 END), 6) AS within_one, count(*) AS n,
  round(count(*) FILTER (WHERE y <= 3 AND p <= 3) / count(*) FILTER (WHERE y <= 3 OR p <= 3), 6) AS top3_iou
FROM v GROUP BY test"""
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = ranked_runners(spark, sf)
    rows = rows.select(
        F.when(F.col("race_id") % 5 == 0, "test").otherwise("train").alias("split"),
        F.col("position").cast("double").alias("y"),
        (F.col("score") / 5).alias("p"),
    )
    metrics = {**evaluation.regression_metrics("p", "y"), "top3_iou": evaluation.top3_iou("p", "y")}
    return rounded(rows.groupBy("split").agg(*[c.alias(n) for n, c in metrics.items()]))


@query(
    WITH_RUNNERS
    + RANKED
    + """
SELECT race_id, round(avg(pow(score - position, 2)), 6) AS mse, round(avg(abs(score - position)), 6) AS mae,
  max(CASE WHEN rank = 1 AND position = 1 THEN 1 ELSE 0 END) AS winner_correct,
  count(*) FILTER (WHERE rank <= 3 AND position <= 3) AS podium_overlap, count(*) AS runners FROM ranked GROUP BY race_id"""
)
def race_error_table(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = ranked_runners(spark, sf)
    return rounded(evaluation.race_errors(rows, by_race, "score", "rank", "position"))


@query(
    WITH_RUNNERS
    + """,
k AS (SELECT race_id, rank() OVER (PARTITION BY race_id ORDER BY pred_a) + (count(*) OVER (PARTITION BY race_id, pred_a) - 1) / 2 AS rp, position AS ra FROM runners)
SELECT race_id, count(*) AS n, round(CASE WHEN stddev_pop(rp) > 0 AND stddev_pop(ra) > 0 THEN corr(rp, ra) END, 6) AS spearman FROM k GROUP BY race_id"""
)
def spearman_by_event(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = runners(spark, sf)
    return rounded(evaluation.spearman(rows, by_race, "pred_a", "position"))


@query(
    WITH_FIELD
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY 0.6 * pred_a + 0.4 * pred_b, numero) AS rank FROM field),
c AS (SELECT race_id, jour, max(CASE WHEN rank = 1 AND position = 1 THEN 1 ELSE 0 END) AS win,
    count(*) FILTER (WHERE rank <= 3 AND position <= 3) AS podium FROM r GROUP BY race_id, jour)
SELECT jour, count(*) AS races, CAST(sum(win) AS BIGINT) AS winners, round(avg(win), 6) AS winner_accuracy, round(avg(podium) / 3, 6) AS podium_accuracy
FROM c GROUP BY jour"""
)
def accuracy_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Winner and podium accuracy per day: races first, then days."""
    from .roles import races

    rows, by_race = ranked_runners(spark, sf)
    per_race = evaluation.race_errors(rows, by_race, "score", "rank", "position")
    per_race = per_race.join(races(spark, sf).select("race_id", "jour"), "race_id")
    out = per_race.groupBy("jour").agg(
        F.count(F.lit(1)).alias("races"),
        F.sum("winner_correct").cast("long").alias("winners"),
        F.avg("winner_correct").alias("winner_accuracy"),
        (F.avg("podium_overlap") / 3).alias("podium_accuracy"),
    )
    return rounded(out)


@query(
    WITH_RUNNERS
    + """,
x AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY pred_a, numero) AS ka, row_number() OVER (PARTITION BY race_id ORDER BY pred_b, numero) AS kb FROM runners),
c AS (SELECT race_id, count(*) FILTER (WHERE ka <= 5 AND position <= 5) AS hits_a, count(*) FILTER (WHERE kb <= 5 AND position <= 5) AS hits_b,
    count(*) FILTER (WHERE ka <= 5 AND kb <= 5) AS shared, count(*) FILTER (WHERE ka <= 5 AND ka = position) AS exact_a,
    count(*) FILTER (WHERE kb <= 5 AND kb = position) AS exact_b, count(*) AS n FROM x GROUP BY race_id)
SELECT race_id, hits_a, hits_b, shared, exact_a, exact_b,
  CASE WHEN hits_a > hits_b THEN 'first' WHEN hits_b > hits_a THEN 'second' ELSE 'tie' END AS better_model FROM c WHERE n >= 5"""
)
def two_model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = runners(spark, sf)
    for score, name in (("pred_a", "ka"), ("pred_b", "kb")):
        rows = row_number_within(rows, by_race, [F.col(score).asc(), F.col("numero").asc()], name)
    a, b, pos = F.col("ka"), F.col("kb"), F.col("position")
    count = lambda condition: F.count(F.when(condition, 1))
    per = rows.groupBy("race_id").agg(
        count((a <= 5) & (pos <= 5)).alias("hits_a"),
        count((b <= 5) & (pos <= 5)).alias("hits_b"),
        count((a <= 5) & (b <= 5)).alias("shared"),
        count((a <= 5) & (a == pos)).alias("exact_a"),
        count((b <= 5) & (b == pos)).alias("exact_b"),
        F.count(F.lit(1)).alias("n"),
    )
    return evaluation.two_model_comparison(per.where(F.col("n") >= 5).drop("n"), "hits_a", "hits_b")


@query(
    WITH_RUNNERS + """
SELECT round(corr(pred_a, pred_b), 6) AS correlation, round(avg(abs(pred_a - pred_b)), 6) AS mean_abs_difference, count(*) AS n FROM runners"""
)
def model_agreement(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_quantity").alias("a"), (F.sqrt("l_extendedprice") / 6).alias("b")
    )
    return rounded(performance.agreement(lines, "a", "b"))


@query(
    WITH_RUNNERS + """
SELECT race_id, count(*) AS field_size, round(max(pred_b) - min(pred_b), 6) AS span,
  round(CASE WHEN count(*) > 1 THEN (1 - (max(pred_b) - min(pred_b)) / (count(*) - 1)) * 100 END, 6) AS compression_pct
FROM runners GROUP BY race_id"""
)
def spread_compression(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = runners(spark, sf)
    return rounded(performance.spread_compression(rows, by_race, "pred_b"))


@query(
    WITH_RUNNERS + """
SELECT race_id, round(max(pred_b) - min(pred_b), 6) AS span FROM runners GROUP BY race_id HAVING count(*) > 1 ORDER BY span, race_id LIMIT 5"""
)
def most_compressed_races(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = runners(spark, sf)
    spans = performance.spread_compression(rows, by_race, "pred_b").where(F.col("field_size") > 1)
    return rounded(spans.orderBy("span", "race_id").limit(5).select("race_id", "span"))


@query(
    WITH_RUNNERS + """
SELECT position, count(*) AS n, round(avg(pred_b - position), 6) AS mean_error, round(avg(abs(pred_b - position)), 6) AS mae,
  round(sqrt(avg(pow(pred_b - position, 2))), 6) AS rmse FROM runners GROUP BY position"""
)
def error_by_position(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    return rounded(performance.error_by_position(rows, "pred_b", "position"))


@query(
    WITH_RUNNERS
    + """
SELECT horse_id, jockey_id, count(*) AS races_total, count(*) FILTER (WHERE position = 1) AS wins,
  count(*) FILTER (WHERE position <= 3) AS places, round(avg(position), 6) AS avg_position,
  round(count(*) FILTER (WHERE position = 1) / count(*), 6) AS win_rate, round(count(*) FILTER (WHERE position <= 3) / count(*), 6) AS place_rate
FROM runners GROUP BY horse_id, jockey_id"""
)
def pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    return rounded(performance.pair_stats(rows, "horse_id", "jockey_id", "position"))


@query(
    WITH_RUNNERS
    + """
SELECT jockey_id, round(avg(pred_b), 6) AS pred_b, round(avg(CASE WHEN position = 1 THEN 1.0 ELSE 0.0 END), 6) AS won,
  round(avg(CASE WHEN position <= 3 THEN 1.0 ELSE 0.0 END), 6) AS placed, round(avg(CASE WHEN flag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS lost,
  max(odds) AS races, round(ln(max(odds) + 1), 6) AS experience_factor, round(1 - avg(CASE WHEN flag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS reliability,
  round((avg(CASE WHEN position = 1 THEN 1.0 ELSE 0.0 END) * 3 + avg(CASE WHEN position <= 3 THEN 1.0 ELSE 0.0 END) * 1.5) / 4.5, 6) AS performance_index
FROM runners GROUP BY jockey_id"""
)
def jockey_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    one = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    rows = rows.select(
        "jockey_id", "pred_b", one(F.col("position") == 1).alias("won"), one(F.col("position") <= 3).alias("placed"),
        one(F.col("flag") == "A").alias("lost"), F.col("odds").alias("races"),
    )
    return rounded(
        performance.jockey_profile(rows, "jockey_id", ["pred_b", "won", "placed", "lost"], "races", "lost", "won", "placed")
    )


# Stored predictions: an advantage type, its strength and an adjustment per runner.
STORED = (
    WITH_RUNNERS
    + RANKED
    + """,
stored AS (
  SELECT race_id, numero, horse_id, rank, ship_day, CASE flag WHEN 'R' THEN 'earnings' WHEN 'A' THEN 'track' ELSE 'none' END AS kind,
    (discount - 0.05) * 12 AS strength, (tax - 0.04) * sqrt(odds) AS adjustment, pred_a, pred_b, score AS ensemble,
    score * (1 + (tax - 0.04)) AS final, CASE WHEN status = 'F' OR discount > 0.02 THEN position END AS actual
  FROM ranked)"""
)


def stored(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = ranked_runners(spark, sf)
    shift = F.col("tax") - 0.04
    return rows.select(
        "race_id", "numero", "horse_id", "rank", "ship_day",
        F.when(F.col("flag") == "R", "earnings").when(F.col("flag") == "A", "track").otherwise("none").alias("kind"),
        ((F.col("discount") - 0.05) * 12).alias("strength"),
        (shift * F.sqrt("odds")).alias("adjustment"),
        "pred_a", "pred_b", F.col("score").alias("ensemble"),
        (F.col("score") * (1 + shift)).alias("final"),
        F.when((F.col("status") == "F") | (F.col("discount") > 0.02), F.col("position")).alias("actual"),
    )


@query(
    STORED
    + """
SELECT count(*) AS total_predictions, count(actual) AS validated_predictions, round(count(actual) / count(*), 6) AS validation_rate,
  round(avg(abs(pred_a - actual)), 6) AS pred_a_mae, round(avg(abs(pred_b - actual)), 6) AS pred_b_mae,
  round(avg(abs(ensemble - actual)), 6) AS ensemble_mae, round(avg(abs(final - actual)), 6) AS final_mae,
  round(avg(CASE WHEN actual IS NOT NULL THEN adjustment END), 6) AS avg_adjustment
FROM stored WHERE ship_day > (SELECT max(ship_day) FROM stored) - 365"""
)
def model_performance_summary(spark: SparkSession, sf: str) -> DataFrame:
    recent = performance.since_last(stored(spark, sf), "ship_day", 365)
    return rounded(performance.model_summary(recent, ["pred_a", "pred_b", "ensemble", "final"], "actual", "adjustment"))


@query(
    STORED
    + """
SELECT kind, count(*) AS predictions, count(actual) AS validated, round(avg(adjustment), 6) AS avg_adjustment,
  round(avg(strength), 6) AS avg_advantage_strength, round(avg(abs(ensemble - actual)), 6) AS ensemble_mae,
  round(avg(abs(final - actual)), 6) AS final_mae, round(avg(abs(final - actual) - abs(ensemble - actual)), 6) AS mae_improvement,
  count(*) FILTER (WHERE actual <= 3) AS top3_actual, count(*) FILTER (WHERE actual IS NOT NULL AND final <= 3) AS top3_predicted,
  round(count(actual) / count(*), 6) AS validation_rate, round(count(*) FILTER (WHERE actual <= 3) / greatest(count(actual), 1), 6) AS top3_accuracy,
  round(count(*) FILTER (WHERE actual <= 3) / greatest(count(*) FILTER (WHERE actual IS NOT NULL AND final <= 3), 1), 6) AS top3_precision
FROM stored GROUP BY kind"""
)
def adjustment_by_advantage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(performance.by_advantage(stored(spark, sf), "kind", "ensemble", "final", "actual", "adjustment", "strength"))


@query(
    STORED
    + """
SELECT race_id, numero, ship_day, round(final, 6) AS final, actual, round(abs(final - actual), 6) AS prediction_error
FROM stored ORDER BY ship_day DESC, race_id, numero LIMIT 100"""
)
def recent_predictions(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("ship_day"), F.asc("race_id"), F.asc("numero")]
    rows = performance.recent_predictions(stored(spark, sf), order, "final", "actual")
    return rounded(rows.select("race_id", "numero", "ship_day", "final", "actual", "prediction_error"))


@query(
    STORED
    + """,
k AS (SELECT race_id, array_to_string(list(kind || ':' || n ORDER BY kind), ',') AS advantage_types FROM
      (SELECT race_id, kind, count(*) AS n FROM stored GROUP BY race_id, kind) GROUP BY race_id)
SELECT s.race_id, count(*) AS total_horses, count(actual) AS horses_with_results, round(avg(abs(actual - final)), 6) AS avg_final_mae,
  round(avg(abs(actual - ensemble)), 6) AS avg_ensemble_mae, round(avg(adjustment), 6) AS avg_competitive_adjustment,
  count(*) FILTER (WHERE final <= 3 AND actual <= 3) AS top3_predicted_correct, count(*) FILTER (WHERE actual <= 3) AS top3_actual, advantage_types
FROM stored s JOIN k ON s.race_id = k.race_id GROUP BY s.race_id, advantage_types"""
)
def race_prediction_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = performance.race_summary(stored(spark, sf), ["race_id"], "kind", "ensemble", "final", "actual", "adjustment")
    pairs = F.transform(F.map_entries("advantage_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return rounded(out.withColumn("advantage_types", F.array_join(pairs, ",")))


@query(
    STORED
    + """
SELECT count(*) AS total_predictions, count(actual) AS validated_predictions, count(DISTINCT race_id) AS total_races,
  min(ship_day) AS earliest, max(ship_day) AS latest FROM stored"""
)
def prediction_table_stats(spark: SparkSession, sf: str) -> DataFrame:
    return performance.table_stats(stored(spark, sf), "race_id", "ship_day", "actual")


@query(
    STORED
    + """
SELECT kind, count(strength) AS n, round(avg(strength), 6) AS mean, round(stddev_samp(strength), 6) AS std,
  round(min(strength), 6) AS min, round(max(strength), 6) AS max, round(count(strength) / (SELECT count(strength) FROM stored), 6) AS share
FROM stored GROUP BY kind"""
)
def advantage_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(performance.advantage_distribution(stored(spark, sf), "kind", "strength"))


@query(
    STORED
    + """
SELECT round(avg(adjustment), 6) AS mean, round(stddev_samp(adjustment), 6) AS std, round(min(adjustment), 6) AS min, round(max(adjustment), 6) AS max,
  count(*) FILTER (WHERE adjustment > 0.5) AS strong_positive, count(*) FILTER (WHERE adjustment > 0 AND adjustment <= 0.5) AS moderate_positive,
  count(*) FILTER (WHERE adjustment = 0) AS neutral, count(*) FILTER (WHERE adjustment < 0 AND adjustment >= -0.5) AS moderate_negative,
  count(*) FILTER (WHERE adjustment < -0.5) AS strong_negative, round(quantile_cont(adjustment, 0.25), 6) AS q25,
  round(quantile_cont(adjustment, 0.5), 6) AS median, round(quantile_cont(adjustment, 0.75), 6) AS q75 FROM stored"""
)
def strength_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(performance.strength_distribution(stored(spark, sf), "adjustment"))


@query(
    STORED
    + """
SELECT round(avg(adjustment), 6) AS mean_adjustment, round(stddev_samp(adjustment), 6) AS std_adjustment, round(min(adjustment), 6) AS min_adjustment,
  round(max(adjustment), 6) AS max_adjustment, round(corr(strength, adjustment), 6) AS strength_correlation,
  count(*) FILTER (WHERE adjustment > 1) AS large_positive, count(*) FILTER (WHERE adjustment > 0 AND adjustment <= 1) AS moderate_positive,
  count(*) FILTER (WHERE adjustment = 0) AS neutral, count(*) FILTER (WHERE adjustment < 0 AND adjustment >= -1) AS moderate_negative,
  count(*) FILTER (WHERE adjustment < -1) AS large_negative FROM stored"""
)
def adjustment_effect(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(performance.adjustment_effect(stored(spark, sf), "strength", "adjustment"))


@query(
    STORED
    + """,
r AS (SELECT race_id, count(adjustment) AS n, avg(adjustment) AS m, stddev_samp(adjustment) AS s FROM stored GROUP BY race_id)
SELECT count(*) AS races_analyzed, round(avg(n), 6) AS avg_horses_per_race, round(avg(m), 6) AS avg_field_strength,
  (SELECT race_id FROM r WHERE s IS NOT NULL ORDER BY round(s, 9) DESC, race_id LIMIT 1) AS most_competitive_race, round(max(s), 6) AS most_competitive_std,
  (SELECT race_id FROM r WHERE s IS NOT NULL ORDER BY round(s, 9), race_id LIMIT 1) AS least_competitive_race, round(min(s), 6) AS least_competitive_std
FROM r"""
)
def field_competitiveness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(performance.field_competitiveness(stored(spark, sf), "race_id", "adjustment"))


@query(
    STORED
    + """,
k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY adjustment DESC, numero) AS top,
    row_number() OVER (PARTITION BY race_id ORDER BY adjustment, numero DESC) AS bottom FROM stored)
SELECT race_id, count(*) AS total_horses, count(*) FILTER (WHERE kind <> 'none') AS competitive_horses,
  round(max(adjustment) - min(adjustment), 6) AS strength_range, round(var_samp(adjustment), 6) AS strength_variance,
  round(coalesce(stddev_samp(adjustment), 0), 6) AS competitiveness_score,
  array_to_string(list(numero ORDER BY top) FILTER (WHERE top <= 3), ',') AS top_contenders,
  array_to_string(list(numero ORDER BY bottom) FILTER (WHERE bottom <= 2), ',') AS bottom_contenders
FROM k GROUP BY race_id"""
)
def race_insights(spark: SparkSession, sf: str) -> DataFrame:
    out = performance.race_insights(stored(spark, sf), ["race_id"], "kind", "adjustment", "adjustment", "numero")
    text = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
    return rounded(
        out.withColumns({c: text(c) for c in ("top_contenders", "bottom_contenders")})
    )


@query(
    STORED
    + """
SELECT kind, count(*) FILTER (WHERE abs(adjustment) > 0.001) AS total_horses_adjusted, count(*) FILTER (WHERE adjustment > 0) AS horses_boosted,
  count(*) FILTER (WHERE adjustment < 0) AS horses_penalized, round(avg(adjustment), 6) AS average_adjustment,
  round(coalesce(max(adjustment) FILTER (WHERE adjustment > 0), 0), 6) AS max_boost, round(coalesce(min(adjustment) FILTER (WHERE adjustment < 0), 0), 6) AS max_penalty,
  round(stddev_pop(adjustment), 6) AS adjustment_spread, count(*) FILTER (WHERE abs(adjustment) > 0.05) AS significant_adjustments
FROM stored GROUP BY kind"""
)
def adjustment_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(performance.adjustment_summary(stored(spark, sf), "adjustment", ["kind"]))


@query(
    WITH_RUNNERS
    + """,
e AS (SELECT race_id, numero, abs(pred_b - position) AS error FROM runners)
SELECT race_id, numero, round(error, 6) AS error, 'best' AS side FROM (SELECT * FROM e ORDER BY error, race_id, numero LIMIT 5)
UNION ALL SELECT race_id, numero, round(error, 6), 'worst' FROM (SELECT * FROM e ORDER BY error DESC, race_id, numero LIMIT 5)"""
)
def best_and_worst_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    out = performance.best_and_worst(rows, "pred_b", "position", ["race_id", "numero"])
    return rounded(out.select("race_id", "numero", "error", "side"))


@query(
    WITH_RUNNERS
    + """
SELECT race_id, array_to_string(list(numero ORDER BY position) FILTER (WHERE position <= 7), '-') AS arrival FROM runners GROUP BY race_id"""
)
def result_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Results stored as an order string, a JSON list or a JSON document, read as one order."""
    rows, _ = ranked_runners(spark, sf)
    order = leading_orders(rows).select("race_id", "a")
    listed = F.to_json("a")
    document = F.to_json(
        F.transform("a", lambda n, i: F.struct((i + 1).cast("string").alias("narrivee"), n.alias("cheval")))
    )
    kind = F.col("race_id") % 3
    stored = F.when(kind == 0, F.array_join("a", "-")).when(kind == 1, listed).otherwise(document)
    texts = order.select("race_id", stored.alias("text"))
    return texts.select("race_id", F.array_join(any_order(F.col("text")), "-").alias("arrival"))
