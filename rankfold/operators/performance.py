"""Statistics of stored predictions and of competitive adjustments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import correlation
from .grouping import as_grouping, join_on, quantiles_within, top_k


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def since_last(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days of the table."""
    last = df.select(F.max(day)).scalar()
    return df.where(F.col(day) > F.date_sub(last, days))


def model_summary(df: DataFrame, models: Sequence[str], actual: str, adjustment: str) -> DataFrame:
    """Counts and the MAE of each model on validated rows."""
    a = F.col(actual)
    return df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count(a).alias("validated_predictions"),
        F.try_divide(F.count(a), F.count(F.lit(1))).alias("validation_rate"),
        *[F.avg(F.abs(F.col(m) - a)).alias(f"{m}_mae") for m in models],
        F.avg(F.when(a.isNotNull(), F.col(adjustment))).alias("avg_adjustment"),
    )


def by_advantage(
    df: DataFrame, kind: str, ensemble: str, final: str, actual: str, adjustment: str, strength: str
) -> DataFrame:
    """Effect of the adjustment per advantage type."""
    a = F.col(actual)
    before, after = F.abs(F.col(ensemble) - a), F.abs(F.col(final) - a)
    known = a.isNotNull()
    out = df.groupBy(kind).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count(a).alias("validated"),
        F.avg(adjustment).alias("avg_adjustment"),
        F.avg(strength).alias("avg_advantage_strength"),
        F.avg(before).alias("ensemble_mae"),
        F.avg(after).alias("final_mae"),
        F.avg(after - before).alias("mae_improvement"),
        _count(known & (a <= 3)).alias("top3_actual"),
        _count(known & (F.col(final) <= 3)).alias("top3_predicted"),
    )
    at_least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    return out.withColumns(
        {
            "validation_rate": F.col("validated") / F.col("predictions"),
            "top3_accuracy": F.col("top3_actual") / at_least_one("validated"),
            "top3_precision": F.col("top3_actual") / at_least_one("top3_predicted"),
        }
    )


def recent_predictions(df: DataFrame, order: Sequence[Column], final: str, actual: str, limit: int = 100) -> DataFrame:
    """Newest rows with their error."""
    return df.withColumn("prediction_error", F.abs(F.col(final) - F.col(actual))).orderBy(*order).limit(limit)


def race_summary(df: DataFrame, race: Sequence[str], kind: str, ensemble: str, final: str, actual: str, adjustment: str) -> DataFrame:
    """Per race: errors of both stages, top-3 hits and counts per advantage type."""
    a = F.col(actual)
    stats = df.groupBy(*race).agg(
        F.count(F.lit(1)).alias("total_horses"),
        F.count(a).alias("horses_with_results"),
        F.avg(F.abs(a - F.col(final))).alias("avg_final_mae"),
        F.avg(F.abs(a - F.col(ensemble))).alias("avg_ensemble_mae"),
        F.avg(adjustment).alias("avg_competitive_adjustment"),
        _count((F.col(final) <= 3) & (a <= 3)).alias("top3_predicted_correct"),
        _count(a <= 3).alias("top3_actual"),
    )
    kinds = df.groupBy(*race, kind).count().groupBy(*race).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "count")))).alias("advantage_types")
    )
    return join_on(stats, kinds, list(race), "left")


def table_stats(df: DataFrame, race: str, day: str, actual: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count(actual).alias("validated_predictions"),
        F.count_distinct(race).alias("total_races"),
        F.min(day).alias("earliest"),
        F.max(day).alias("latest"),
    )


def advantage_distribution(df: DataFrame, kind: str, strength: str) -> DataFrame:
    """Count, share and spread of the strength per advantage type."""
    out = df.groupBy(kind).agg(
        F.count(strength).alias("n"),
        F.avg(strength).alias("mean"),
        F.stddev_samp(strength).alias("std"),
        F.min(strength).alias("min"),
        F.max(strength).alias("max"),
    )
    total = out.select(F.sum("n")).scalar()
    return out.withColumn("share", F.col("n") / total)


def strength_distribution(df: DataFrame, strength: str) -> DataFrame:
    """One row: moments, quartiles and a five-band histogram."""
    s = F.col(strength)
    bands = df.agg(
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("std"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
        _count(s > 0.5).alias("strong_positive"),
        _count((s > 0) & (s <= 0.5)).alias("moderate_positive"),
        _count(s == 0).alias("neutral"),
        _count((s < 0) & (s >= -0.5)).alias("moderate_negative"),
        _count(s < -0.5).alias("strong_negative"),
    )
    values = df.select(F.lit(0).alias("__all"), s.cast("double").alias("__s"))
    quartiles = quantiles_within(values, "__all", "__s", [0.25, 0.5, 0.75], "q").select("q").scalar()
    bands = bands.withColumn("__q", quartiles)
    return bands.select("*", *[F.get("__q", i).alias(n) for i, n in enumerate(("q25", "median", "q75"))]).drop("__q")


def adjustment_effect(df: DataFrame, strength: str, adjustment: str) -> DataFrame:
    a = F.col(adjustment)
    return df.agg(
        F.avg(a).alias("mean_adjustment"),
        F.stddev_samp(a).alias("std_adjustment"),
        F.min(a).alias("min_adjustment"),
        F.max(a).alias("max_adjustment"),
        F.coalesce(correlation(strength, adjustment), F.lit(0.0)).alias("strength_correlation"),
        _count(a > 1).alias("large_positive"),
        _count((a > 0) & (a <= 1)).alias("moderate_positive"),
        _count(a == 0).alias("neutral"),
        _count((a < 0) & (a >= -1)).alias("moderate_negative"),
        _count(a < -1).alias("large_negative"),
    )


def adjustment_summary(df: DataFrame, adjustment: str, by: Sequence[str] = ()) -> DataFrame:
    """Boosted, penalised and significant adjustments and their spread."""
    a = F.col(adjustment)
    return df.groupBy(*by).agg(
        _count(F.abs(a) > 0.001).alias("total_horses_adjusted"),
        _count(a > 0).alias("horses_boosted"),
        _count(a < 0).alias("horses_penalized"),
        F.avg(a).alias("average_adjustment"),
        F.coalesce(F.max(F.when(a > 0, a)), F.lit(0.0)).alias("max_boost"),
        F.coalesce(F.min(F.when(a < 0, a)), F.lit(0.0)).alias("max_penalty"),
        F.stddev_pop(a).alias("adjustment_spread"),
        _count(F.abs(a) > 0.05).alias("significant_adjustments"),
    )


def impact_estimate(df: DataFrame, race: Sequence[str], before: str, after: str, competitiveness: str) -> DataFrame:
    """Per race: mean and largest change and the expected gain of R²."""
    change = F.abs(F.col(after) - F.col(before))
    out = df.groupBy(*race, competitiveness).agg(F.avg(change).alias("average_prediction_change"), F.max(change).alias("max_prediction_change"))
    level, mean = F.col(competitiveness), F.col("average_prediction_change")
    # Expected gains by level.
    gain = F.when((level == "high") & (mean > 0.05), 0.015).when((level == "moderate") & (mean > 0.03), 0.010).otherwise(0.005)
    sure = F.when(level == "high", "high").otherwise("moderate")
    return out.withColumns({"estimated_r2_improvement": gain, "confidence_level": sure})


def field_competitiveness(df: DataFrame, race: str, strength: str) -> DataFrame:
    """One row: races, mean size and strength, and the most and least competitive race."""
    per_race = df.groupBy(race).agg(
        F.count(strength).alias("n"), F.avg(strength).alias("mean"), F.stddev_samp(strength).alias("std")
    )
    known = F.col("std").isNotNull()
    return per_race.agg(
        F.count(F.lit(1)).alias("races_analyzed"),
        F.avg("n").alias("avg_horses_per_race"),
        F.avg("mean").alias("avg_field_strength"),
        F.max_by(race, F.when(known, F.struct(F.round("std", 9), -F.col(race)))).alias("most_competitive_race"),
        F.max("std").alias("most_competitive_std"),
        F.min_by(race, F.when(known, F.struct(F.round("std", 9), F.col(race)))).alias("least_competitive_race"),
        F.min("std").alias("least_competitive_std"),
    )


def race_insights(df: DataFrame, race: Sequence[str], kind: str, strength: str, adjustment: str, numero: str, none: str = "none") -> DataFrame:
    """Per race: strength range and variance, the top three and bottom two by adjustment."""
    stats = df.groupBy(*race).agg(
        F.count(F.lit(1)).alias("total_horses"),
        _count(F.col(kind) != none).alias("competitive_horses"),
        (F.max(strength) - F.min(strength)).alias("strength_range"),
        F.var_samp(strength).alias("strength_variance"),
        F.coalesce(F.stddev_samp(strength), F.lit(0.0)).alias("competitiveness_score"),
    )
    named = lambda order, k, name: (
        top_k(df, race, order, k, "__k")
        .groupBy(*race)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", numero))), lambda s: s[numero]).alias(name))
    )
    top = named([F.col(adjustment).desc(), F.col(numero).asc()], 3, "top_contenders")
    bottom = named([F.col(adjustment).asc(), F.col(numero).desc()], 2, "bottom_contenders")
    return join_on(join_on(stats, top, list(race)), bottom, list(race))


def spread_compression(df: DataFrame, group, score: str) -> DataFrame:
    """Per race: span of the scores against the span of the ranks."""
    g = as_grouping(df, group)
    out = df.groupBy(*g.keys).agg(
        F.count(F.lit(1)).alias("field_size"), (F.max(score) - F.min(score)).alias("span")
    )
    expected = F.col("field_size") - 1
    return out.withColumn("compression_pct", F.when(expected > 0, (1 - F.col("span") / expected) * 100))


def error_by_position(df: DataFrame, score: str, actual: str) -> DataFrame:
    error = F.col(score) - F.col(actual)
    return df.groupBy(actual).agg(
        F.count(error).alias("n"),
        F.avg(error).alias("mean_error"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """Correlation and mean distance of two models."""
    return df.agg(
        correlation(first, second).alias("correlation"),
        F.avg(F.abs(F.col(first) - F.col(second))).alias("mean_abs_difference"),
        F.count(F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), 1)).alias("n"),
    )


def pair_stats(df: DataFrame, horse: str, jockey: str, position: str) -> DataFrame:
    """Races, wins, places, rates and mean finish of each horse and jockey pair."""
    p = F.col(position)
    out = df.groupBy(horse, jockey).agg(
        F.count(F.lit(1)).alias("races_total"),
        _count(p == 1).alias("wins"),
        _count(p <= 3).alias("places"),
        F.avg(p).alias("avg_position"),
    )
    return out.withColumns(
        {"win_rate": F.col("wins") / F.col("races_total"), "place_rate": F.col("places") / F.col("races_total")}
    )


def jockey_profile(df: DataFrame, jockey: str, means: Sequence[str], races: str, lost: str, wins: str, places: str) -> DataFrame:
    """Mean features per jockey with experience, reliability and a performance index."""
    out = df.groupBy(jockey).agg(*[F.avg(m).alias(m) for m in means], F.max(races).alias(races))
    # Weights of the performance index.
    return out.withColumns(
        {
            "experience_factor": F.log1p(F.col(races)),
            "reliability": 1 - F.col(lost),
            "performance_index": (F.col(wins) * 3 + F.col(places) * 1.5) / 4.5,
        }
    )


def best_and_worst(df: DataFrame, score: str, actual: str, tie_break: Sequence[str], k: int = 5) -> DataFrame:
    """The k rows with the smallest and the k with the largest error."""
    rows = df.withColumn("error", F.abs(F.col(score) - F.col(actual))).where(F.col("error").isNotNull())
    ties = [F.asc(c) for c in tie_break]
    best = rows.orderBy(F.asc("error"), *ties).limit(k).withColumn("side", F.lit("best"))
    worst = rows.orderBy(F.desc("error"), *ties).limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)
