"""Failure mining: why predicted top fives missed, and what to change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.orders import overlap
from .grouping import Grouping, join_on, row_number_within

# Failure weights, odds limits and thresholds of the advice.
FAILURE_WEIGHTS = {"quinte_desordre_miss": 10.0, "bonus_4_miss": 5.0, "bonus_3_miss": 3.0, "high_mae": 2.0, "success": 1.0}
HIGH_MAE = 3.0
FAVORITE_ODDS, LONGSHOT_ODDS = 5.0, 20.0
SMALL_FIELD, MEDIUM_FIELD = 14, 16
COMPETITIVE_WEIGHT, WEIGHT_RANGE, MAX_WEIGHT_STEP = 0.3, (0.0, 0.6), 0.15
MISSED_LIMIT, OVERWEIGHTED_LIMIT, ADVICE_MAE, MAJORITY = 30, 40, 3.5, 0.5
SEVERITY_NO_OVERLAP, SEVERITY_HIGH_MAE, HARD_FACTOR = 2.0, 1.5, 2.0


def field_class(size: Column) -> Column:
    return F.when(size < SMALL_FIELD, "small").when(size <= MEDIUM_FIELD, "medium").otherwise("large")


def analyze(
    df: DataFrame,
    race: Sequence[str],
    numero: str,
    score: str,
    rank: str,
    actual: str,
    odds: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per race: failure type and weight, missed runners, false positives, favourite flags.

    A bonus hit keeps the label ``bonus_4_miss``: it names the failure to reach more.
    """
    r, a, n, o = F.col(rank), F.col(actual), F.col(numero), F.col(odds)
    picked, placed = r <= 5, F.coalesce(a <= 5, F.lit(False))
    numbers = lambda condition: F.sort_array(F.collect_list(F.when(condition, n)))
    some = lambda condition: F.coalesce(F.max(F.when(condition, True)), F.lit(False))
    missed, wrong = placed & ~picked, picked & ~placed
    hits = lambda k: F.count(F.when(picked & (a <= k), 1))
    card = df.groupBy(*race).agg(
        *[F.first(k).alias(k) for k in keep],
        F.count(F.lit(1)).alias("field_size"),
        hits(5).alias("overlap"),
        (hits(5) == 5).alias("quinte_desordre"),
        (hits(4) == 4).alias("bonus_4"),
        (hits(3) == 3).alias("bonus_3"),
        numbers(missed).alias("missed_horses"),
        numbers(wrong).alias("false_positives"),
        # Digits beyond the ninth depend on the order of a sum; thresholds must not.
        F.round(F.coalesce(F.avg(F.abs(F.col(score) - a)), F.lit(0.0)), 9).alias("mae"),
        some(missed & (o < FAVORITE_ODDS)).alias("missed_favorite"),
        some(missed & (o > LONGSHOT_ODDS)).alias("missed_longshot"),
        some(wrong & (o < FAVORITE_ODDS)).alias("over_weighted_favorite"),
    )
    kind = (
        F.when(F.col("quinte_desordre"), "success")
        .when(F.col("bonus_4"), "bonus_4_miss")
        .when(F.col("bonus_3"), "bonus_3_miss")
        .otherwise("quinte_desordre_miss")
    )
    weights = F.create_map(*[F.lit(v) for pair in FAILURE_WEIGHTS.items() for v in pair])
    card = card.withColumn("failure_type", kind)
    weight = weights[F.col("failure_type")]
    weight = F.when(F.col("mae") > HIGH_MAE, F.greatest(weight, F.lit(FAILURE_WEIGHTS["high_mae"]))).otherwise(weight)
    return card.withColumns({"failure_weight": weight, "field_size_category": field_class(F.col("field_size"))})


def from_orders(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Failure type from two order arrays; the bonus sets follow the finishing order."""
    p, a = F.slice(predicted, 1, 5), F.slice(actual, 1, 5)
    hit = lambda k: overlap(p, F.slice(a, 1, k)) == k
    kind = F.when(hit(5), "success").when(hit(4), "bonus_4_miss").when(hit(3), "bonus_3_miss").otherwise("quinte_desordre_miss")
    return df.withColumns(
        {"failure_type": kind, "missed_horses": F.array_except(a, p), "false_positives": F.array_except(p, a)}
    )


def patterns(races: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and percentages of failure patterns, per group."""
    kind = F.col("failure_type")
    count = lambda condition: F.count(F.when(condition, 1))
    out = races.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_failures"),
        count(kind == "quinte_desordre_miss").alias("quinte_desordre_misses"),
        count(kind == "bonus_4_miss").alias("bonus_4_misses"),
        count(kind == "bonus_3_miss").alias("bonus_3_misses"),
        count(F.col("missed_favorite")).alias("missed_favorites_count"),
        count(F.col("missed_longshot")).alias("missed_longshots_count"),
        count(F.col("over_weighted_favorite")).alias("over_weighted_favorites_count"),
        count(F.col("mae") > HIGH_MAE).alias("high_mae_count"),
        count(F.col("mae") > ADVICE_MAE).alias("very_high_mae_count"),
        F.avg("mae").alias("avg_mae"),
        *[count(F.col("field_size_category") == c).alias(f"{c}_fields") for c in ("small", "medium", "large")],
        *[
            count((F.col("field_size_category") == c) & (kind != "success")).alias(f"{c}_field_failures")
            for c in ("small", "medium", "large")
        ],
    )
    share = lambda c: F.col(c) / F.col("total_failures") * 100
    return out.withColumns(
        {
            "missed_favorites_pct": share("missed_favorites_count"),
            "missed_longshots_pct": share("missed_longshots_count"),
            "over_weighted_favorites_pct": share("over_weighted_favorites_count"),
        }
    )


def distribution(races: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Races per value of a column, with the share of its group."""
    counts = races.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    totals = races.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    if by:
        joined = join_on(counts, totals, list(by))
        return joined.withColumn("share", F.col("n") / F.col("total")).drop("total")
    return counts.withColumn("share", F.col("n") / totals.scalar())


def weight_change(summary: DataFrame) -> DataFrame:
    """Suggested weight of the competitive adjustment from the pattern percentages."""
    step = F.lit(MAX_WEIGHT_STEP)
    favorites, longshots, over = (F.col(f"{c}_pct") for c in ("missed_favorites", "missed_longshots", "over_weighted_favorites"))
    down = F.when(favorites > MISSED_LIMIT, F.least(step, favorites / 200)).otherwise(0.0)
    up = F.when(longshots > MISSED_LIMIT, F.least(step, longshots / 200)).otherwise(0.0)
    less = F.when(over > OVERWEIGHTED_LIMIT, F.least(step * 0.5, over / 400)).otherwise(0.0)
    change = up - down - less
    wanted = F.lit(COMPETITIVE_WEIGHT) + change
    return summary.withColumns(
        {
            "adjustment": change,
            "suggested_weight": F.greatest(F.lit(WEIGHT_RANGE[0]), F.least(F.lit(WEIGHT_RANGE[1]), wanted)),
        }
    )


def feature_factors(summary: DataFrame) -> DataFrame:
    """Multipliers of feature groups where failures concentrate."""
    total = F.col("total_failures")
    crowded = F.greatest(*[F.col(f"{c}_field_failures") / total for c in ("small", "medium", "large")])
    return summary.withColumns(
        {
            "field_size_features": F.when(crowded > MAJORITY, 1.25).otherwise(1.0),
            "quinte_career_features": F.when(F.col("very_high_mae_count") / total > 0.4, 1.2).otherwise(1.0),
        }
    )


def advice(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """(group…, issue, value) rows for every limit a group exceeds, or 'none'."""
    total = F.col("total_failures")
    rules = {
        "missed_favorites": (F.col("missed_favorites_pct"), F.col("missed_favorites_pct") > MISSED_LIMIT),
        "missed_longshots": (F.col("missed_longshots_pct"), F.col("missed_longshots_pct") > MISSED_LIMIT),
        "over_weighted_favorites": (
            F.col("over_weighted_favorites_pct"), F.col("over_weighted_favorites_pct") > OVERWEIGHTED_LIMIT
        ),
        "high_mae": (F.col("avg_mae"), F.col("avg_mae") > ADVICE_MAE),
        **{
            f"{c}_fields": (F.col(f"{c}_fields") / total * 100, F.col(f"{c}_fields") / total > MAJORITY)
            for c in ("small", "medium", "large")
        },
    }
    found = F.array_compact(
        F.array(*[
            F.when(test, F.struct(F.lit(issue).alias("issue"), value.alias("value"))) for issue, (value, test) in rules.items()
        ])
    )
    nothing = F.array(F.struct(F.lit("none").alias("issue"), F.lit(0.0).alias("value")))
    found = F.when(F.size(found) > 0, found).otherwise(nothing)
    return summary.select(*by, F.explode(found).alias("a")).select(*by, "a.issue", "a.value")


def baseline_rates(races: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("int"))
    return races.groupBy(*by).agg(
        F.count(F.lit(1)).alias("races"),
        share("quinte_desordre").alias("quinte_desordre_rate"),
        share("bonus_4").alias("bonus_4_rate"),
        share("bonus_3").alias("bonus_3_rate"),
        F.avg("mae").alias("avg_mae"),
    )


def weighted_rows(df: DataFrame, races: DataFrame, race: Sequence[str]) -> DataFrame:
    """Runner rows carrying the failure weight of their race."""
    return join_on(df, races.select(*race, "failure_weight", "failure_type"), list(race))


def hard_examples(df: DataFrame, races: DataFrame, race: str, share: float = 0.2) -> DataFrame:
    """Runner rows of the most severe races, with their weight doubled."""
    severity = (
        F.col("failure_weight")
        * F.when(F.col("overlap") == 0, SEVERITY_NO_OVERLAP).otherwise(1.0)
        * F.when(F.col("mae") > ADVICE_MAE, SEVERITY_HIGH_MAE).otherwise(1.0)
    )
    scored = races.select(race, "failure_weight", severity.alias("severity_score"), F.lit(0).alias("__all"))
    wanted = races.select(F.floor(F.count(F.lit(1)) * share)).scalar()
    # One group over all races: measured, so that a large table is range-sliced.
    group = Grouping.measure(scored, "__all")
    order = [F.desc("severity_score"), F.asc(race)]
    worst = row_number_within(scored, group, order, "__no").where(F.col("__no") <= wanted)
    chosen = worst.select(race, (F.col("failure_weight") * HARD_FACTOR).alias("failure_weight"), "severity_score")
    return df.join(chosen, race)
