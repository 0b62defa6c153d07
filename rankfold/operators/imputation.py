"""Earnings imputation and field medians."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import as_grouping, join_on, quantiles_within

# Average prize per race type, and the limits of each rule.
WIN_PRIZE = {"Plat": 50_000, "Haies": 40_000, "Steeple": 45_000, "A": 35_000, "M": 30_000}
PLACE_PRIZE = {"Plat": 15_000, "Haies": 12_000, "Steeple": 13_000, "A": 10_000, "M": 8_000}
DEFAULT_WIN_PRIZE, DEFAULT_PLACE_PRIZE, OTHER_PRIZE = 40_000, 12_000, 5_000
EXPERIENCED_STARTS = 5
MIN_MEDIAN_RUNNERS = 3
FIELD_MEAN_DEFAULT, FIELD_MEAN_CEILING, FIELD_MEAN_RUNNERS = 100_000.0, 300_000.0, 2


def _prize(kind: Column, table: Mapping[str, int], default: int) -> Column:
    prizes = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(prizes[kind], F.lit(default))


def field_median(df: DataFrame, group, earnings: str, starts: str, name: str = "field_median") -> DataFrame:
    """Per race: median earnings of experienced earners, null below three of them."""
    g = as_grouping(df, group)
    valid = F.when((F.col(earnings) > 0) & (F.col(starts) >= EXPERIENCED_STARTS), F.col(earnings).cast("double"))
    rows = df.select(*g.keys, valid.alias("__v"))
    counts = rows.groupBy(*g.keys).agg(F.count("__v").alias("__n"))
    medians = quantiles_within(rows, g, "__v", [0.5], "__m")
    return join_on(counts, medians, g.keys).select(
        *g.keys, F.when(F.col("__n") >= MIN_MEDIAN_RUNNERS, F.get("__m", 0)).alias(name)
    )


def field_mean_earnings(df: DataFrame, group, earnings: str, starts: str, name: str = "field_mean") -> DataFrame:
    """Per race: median earnings per start of experienced runners, or the default."""
    g = as_grouping(df, group)
    per_start = F.when(F.col(starts) >= EXPERIENCED_STARTS, F.col(earnings) / F.col(starts))
    valid = F.when((F.col(earnings) > 0) & (per_start <= FIELD_MEAN_CEILING), per_start)
    rows = df.select(*g.keys, valid.alias("__v"))
    counts = rows.groupBy(*g.keys).agg(F.count("__v").alias("__n"))
    medians = quantiles_within(rows, g, "__v", [0.5], "__m")
    enough = F.when(F.col("__n") >= FIELD_MEAN_RUNNERS, F.get("__m", 0))
    return join_on(counts, medians, g.keys).select(*g.keys, F.coalesce(enough, F.lit(FIELD_MEAN_DEFAULT)).alias(name))


def impute_earnings(
    df: DataFrame, group, earnings: str, wins: str, places: str, starts: str, race_type: str, name: str = "gains_imputed"
) -> DataFrame:
    """Known earnings, else an estimate from wins and places, else the race median, else 0."""
    g = as_grouping(df, group)
    medians = field_median(df, g, earnings, starts)
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    win, place = _prize(F.col(race_type), WIN_PRIZE, DEFAULT_WIN_PRIZE), _prize(F.col(race_type), PLACE_PRIZE, DEFAULT_PLACE_PRIZE)
    others = F.greatest(n(starts) - n(wins) - n(places), F.lit(0))
    estimate = n(wins) * win + n(places) * place + others * OTHER_PRIZE
    value = (
        F.when(F.col(earnings) > 0, F.col(earnings))
        .when((n(wins) > 0) | (n(places) > 0), estimate)
        .when((n(starts) >= EXPERIENCED_STARTS) & F.col("field_median").isNotNull(), F.col("field_median"))
        .otherwise(0)
        .cast("double")
    )
    return join_on(df, medians, g.keys, "left").withColumn(name, value)


def imputation_counts(df: DataFrame, earnings: str, wins: str, places: str, starts: str) -> DataFrame:
    """One row: runners, missing or non-positive earnings, and which rule can fill them."""
    missing = F.coalesce(F.col(earnings) <= 0, F.lit(True))
    raced = (F.coalesce(F.col(wins), F.lit(0)) > 0) | (F.coalesce(F.col(places), F.lit(0)) > 0)
    experienced = F.coalesce(F.col(starts), F.lit(0)) >= EXPERIENCED_STARTS
    count = lambda c: F.count(F.when(c, 1))
    return df.agg(
        F.count(F.lit(1)).alias("total_horses"),
        count(missing).alias("missing_earnings"),
        count(missing & raced).alias("can_impute_performance"),
        count(missing & ~raced & experienced).alias("can_impute_field_median"),
        count(missing & ~raced & ~experienced).alias("will_be_zero"),
    )
