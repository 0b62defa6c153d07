"""Predictions against the real order: errors, hit rates and bets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import correlation
from ..functions.orders import overlap
from .grouping import as_grouping, quantiles_within, rank_within, row_number_within


def error_metrics(predicted: str, actual: str) -> dict[str, Column]:
    """Aggregates over rows with a known finish."""
    p, a = F.col(predicted), F.col(actual)
    error = F.when(a.isNotNull() & p.isNotNull(), p - a)
    known = error.isNotNull()
    exact = F.count(F.when(known & (F.rint(p) == a), 1))
    top5 = F.count(F.when(known & (a <= 5), 1))
    top5_hit = F.count(F.when(known & (a <= 5) & (F.rint(p) <= 5), 1))
    return {
        "mae": F.coalesce(F.avg(F.abs(error)), F.lit(0.0)),
        "rmse": F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)),
        "exact_correct": exact,
        "exact_accuracy": F.coalesce(F.try_divide(exact, F.count(error)), F.lit(0.0)),
        "top5_correct": top5_hit,
        "total_top5": top5,
        "top5_accuracy": F.coalesce(F.try_divide(top5_hit, top5), F.lit(0.0)),
        "total_horses": F.count(F.lit(1)),
    }


def regression_metrics(predicted: str, actual: str) -> dict[str, Column]:
    """Errors, R², explained variance and agreement rates."""
    p, a = F.col(predicted), F.col(actual)
    error = a - p
    spread = F.var_pop(a)
    share = lambda condition: F.avg(condition.cast("int"))
    return {
        "mse": F.avg(error * error),
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": 1 - F.try_divide(F.avg(error * error), spread),
        "explained_variance": 1 - F.try_divide(F.var_pop(error), spread),
        "top1_accuracy": share((F.rint(p) == 1) == (a == 1)),
        "top3_accuracy": share((F.rint(p) <= 3) == (a <= 3)),
        "exact_match": share(F.rint(p) == a),
        "within_one": share(F.abs(F.rint(p) - a) <= 1),
        "n": F.count(error),
    }


def top3_iou(predicted: str, actual: str) -> Column:
    """Intersection over union of predicted and actual first-three rows."""
    p, a = F.col(predicted) <= 3, F.col(actual) <= 3
    return F.try_divide(F.count(F.when(p & a, 1)), F.count(F.when(p | a, 1)))


def per_race(
    df: DataFrame,
    group,
    numero: str = "numero",
    score: str = "predicted_position",
    rank: str = "predicted_rank",
    actual: str = "actual_position",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Race scorecard: errors, top-5 and top-6 picks, bonus hits, winner.

    Only the leading five or six entries of a race are collected.
    """
    g = as_grouping(df, group)
    rows = row_number_within(
        df, g, [F.col(actual).asc_nulls_last(), F.col(numero).asc()], "__arrival"
    )
    r, a, n = F.col(rank), F.col(actual), F.col(numero)
    picks = F.array_sort(F.collect_list(F.when(r <= 6, F.struct(r.alias("k"), n.alias("n")))))
    finish = F.array_sort(
        F.collect_list(F.when((F.col("__arrival") <= 5) & a.isNotNull(), F.struct(a.alias("k"), n.alias("n"))))
    )
    card = rows.groupBy(*g.keys).agg(
        *[F.first(k).alias(k) for k in keep],
        F.count(F.lit(1)).alias("horses"),
        F.avg(F.abs(F.col(score) - a)).alias("mae"),
        picks.alias("__picks"),
        finish.alias("__finish"),
    )
    numbers = lambda c, limit: F.transform(F.filter(F.col(c), lambda e: e["k"] <= limit), lambda e: e["n"])
    listed = lambda c: F.transform(F.col(c), lambda e: e["n"])
    text = lambda array: F.array_join(F.transform(array, lambda v: v.cast("string")), ",")
    pred5, pred6 = numbers("__picks", 5), numbers("__picks", 6)
    real = {k: numbers("__finish", k) for k in (3, 4, 5)}
    same_place = F.aggregate(
        F.sequence(F.lit(1), F.lit(5)),
        F.lit(0),
        lambda acc, k: acc
        + F.size(
            F.array_intersect(
                F.filter(F.col("__picks"), lambda e: e["k"] == k).cast("array<struct<k:bigint,n:bigint>>"),
                F.filter(F.col("__finish"), lambda e: e["k"] == k).cast("array<struct<k:bigint,n:bigint>>"),
            )
        ),
    )
    in5 = overlap(pred5, real[5])
    columns = {
        "predicted_top5": text(pred5),
        "predicted_top6": text(pred6),
        "actual_arrive": text(listed("__finish")),
        "pct_exact_order": F.when(F.size(real[5]) >= 5, same_place * 20.0).otherwise(0.0),
        "pct_in_quinte": F.when(F.size(pred5) >= 5, in5 * 20.0).otherwise(0.0),
        "horses_in_quinte": in5,
        "winner_correct": F.coalesce((F.get(numbers("__picks", 1), 0) == F.get(numbers("__finish", 1), 0)).cast("int"), F.lit(0)),
    }
    for label, chosen in (("top5", pred5), ("top6", pred6)):
        for bet, size in (("bonus3", 3), ("bonus4", 4), ("quinte", 5)):
            count = overlap(real[size], chosen)
            columns[f"{label}_{bet}_count"] = count
            columns[f"{label}_{'quinte_desordre' if bet == 'quinte' else bet}"] = (count == size).cast("int")
    return card.select(*g.keys, *keep, "horses", "mae", *[c.alias(name) for name, c in columns.items()])


def rates(df: DataFrame, wins: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wins and rates of 0/1 columns over races."""
    aggregates = [F.count(F.lit(1)).alias("total_races")]
    for w in wins:
        value = F.col(w).cast("int")
        aggregates += [F.sum(value).alias(f"{w}_wins"), F.avg(value).alias(f"{w}_rate")]
    return df.groupBy(*by).agg(*aggregates)


def rank_metrics(df: DataFrame, race: Sequence[str], rank: str, actual: str) -> DataFrame:
    """One row: rank errors with their median, winner, top-3 and top-5 hits and mean overlaps."""
    r, a = F.col(rank), F.col(actual)
    error = F.abs(r - a)
    per_race = df.groupBy(*race).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when((r <= k) & (a <= k), 1)).alias(f"hit{k}") for k in (1, 3, 5)],
        F.sum(error).alias("err"),
        F.sum(error * error).alias("err2"),
    )
    full = lambda k: F.avg((F.col(f"hit{k}") == F.least(F.lit(k), F.col("n"))).cast("int"))
    totals = per_race.agg(
        F.count(F.lit(1)).alias("n_races"),
        F.sum("n").alias("n_predictions"),
        (F.sum("err") / F.sum("n")).alias("mae"),
        F.sqrt(F.sum("err2") / F.sum("n")).alias("rmse"),
        F.avg((F.col("hit1") > 0).cast("int")).alias("winner_accuracy"),
        full(3).alias("top3_exact"),
        full(5).alias("top5_exact"),
        F.avg("hit3").alias("avg_top3_overlap"),
        F.avg("hit5").alias("avg_top5_overlap"),
    )
    errors = df.select(F.lit(0).alias("__all"), error.cast("double").alias("__e"))
    median = quantiles_within(errors, "__all", "__e", [0.5], "m").select(F.get("m", 0)).scalar()
    return totals.withColumn("median_error", median)


def spearman(df: DataFrame, group, score: str, actual: str) -> DataFrame:
    """Rank correlation per race with average ranks for ties; null for a constant side."""
    g = as_grouping(df, group)
    known = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull())
    ranked = rank_within(known, g, score, "__rp", "average")
    ranked = rank_within(ranked, g, actual, "__ra", "average")
    return ranked.groupBy(*g.keys).agg(
        F.count(F.lit(1)).alias("n"),
        correlation("__rp", "__ra").alias("spearman"),
    )


def race_errors(df: DataFrame, group, score: str, rank: str, actual: str) -> DataFrame:
    """MSE, MAE, winner and podium overlap per race."""
    g = as_grouping(df, group)
    error = F.col(score) - F.col(actual)
    return df.groupBy(*g.keys).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.max(F.when((F.col(rank) == 1) & (F.col(actual) == 1), 1).otherwise(0)).alias("winner_correct"),
        F.count(F.when((F.col(rank) <= 3) & (F.col(actual) <= 3), 1)).alias("podium_overlap"),
        F.count(F.lit(1)).alias("runners"),
    )


def bet_totals(bets: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(bet, wins, races, rate) rows from one 0/1 column per bet."""
    pairs = F.array(*[F.struct(F.lit(n).alias("bet"), F.col(n).cast("int").alias("won")) for n in names])
    long = bets.select(*by, F.explode(pairs).alias("__b")).select(*by, "__b.*")
    return long.groupBy(*by, "bet").agg(
        F.sum("won").alias("wins"), F.count(F.lit(1)).alias("races"), F.avg("won").alias("rate")
    )


def won_races(bets: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """(bet, race…) rows of won bets; a long list stays rows instead of one array."""
    pairs = F.array(*[F.when(F.col(n), F.lit(n)) for n in names])
    return bets.select(*keep, F.explode(F.array_compact(pairs)).alias("bet"))


def strategy_columns(pred: Column, actual: Column, picks: Sequence[int] = (5, 6, 7)) -> dict[str, Column]:
    """True where k picks contain the whole actual top five."""
    target = F.slice(actual, 1, 5)
    return {
        f"pick{k}_win": (F.size(target) >= 5)
        & (F.size(pred) >= k)
        & (F.size(F.array_intersect(F.slice(pred, 1, k), target)) == 5)
        for k in picks
    }


def two_model_comparison(df: DataFrame, first: str, second: str) -> DataFrame:
    """Better model per race from two hit counts, and totals."""
    a, b = F.col(first), F.col(second)
    better = F.when(a > b, "first").when(b > a, "second").when(a.isNull() | b.isNull(), "unknown").otherwise("tie")
    return df.withColumn("better_model", better)
