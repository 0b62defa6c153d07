"""Column profiles per day that add up without the rows behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import OUTLIER_IQR

# Sizes of the sketches. Their errors hold for merged profiles as for single ones.
HLL_BITS = 12  # distinct values: standard error 1.04 / sqrt(2 ** 12) = 1.6 %
QUANTILE_K = 200  # rank error of a quantile: 1.65 % of the rows at 99 % confidence
GRID = 400  # quantiles that the share of outliers is read from, 0.25 % apart
TRACKED = 1000  # frequent values: a count is off by 3.5 rows of 1000 * 0.75 at most


def _profile(c: str) -> Column:
    """The profile of one column as a struct of aggregates; NaN is a missing value."""
    raw = F.col(c).cast("double")
    v = F.when(~F.isnan(raw), raw)
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    n, spread = F.count(v), F.coalesce(F.var_pop(v), F.lit(0.0))
    shape = lambda f: F.coalesce(F.when(~F.isnan(f(v)), f(v)), F.lit(0.0))
    return F.struct(
        F.lit(c).alias("column"),
        F.count(F.lit(1)).alias("rows"),
        n.alias("known"),
        count(v == 0).alias("zeros"),
        count(v < 0).alias("negatives"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        (n * spread).alias("m2"),
        (n * F.pow(spread, 1.5) * shape(F.skewness)).alias("m3"),
        F.when(spread > 0, n * spread * spread * (shape(F.kurtosis) + 3)).otherwise(0.0).alias("m4"),
        F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(HLL_BITS)).alias("distinct"),
        F.kll_sketch_agg_double(v, F.lit(QUANTILE_K)).alias("quantiles"),
        F.call_function("approx_top_k_accumulate", v, F.lit(TRACKED)).alias("frequent"),
    )


def daily_profiles(df: DataFrame, columns: Sequence[str], day: str) -> DataFrame:
    """One row per day and column, from one pass in which only sketches move.

    A profile of a day is a few kilobytes whatever its rows. Store it and profile new days
    only; :func:`merged` adds up any set of them, a corrected day replaces its rows.
    """
    return df.groupBy(day).agg(F.array(*[_profile(c) for c in columns]).alias("p")).select(day, F.inline("p"))


def merged(profiles: DataFrame, *by: str) -> DataFrame:
    """The profiles of all days (per ``by``, if given) as one per column, with the columns of a column audit.

    Counts, extremes and moments are exact; distinct counts, quartiles, outlier shares and
    frequent values have the errors of their sketches. Moments are moved to the common
    mean, so they don't lose digits as sums of powers would.
    """
    keys = [*by, "column"]
    sums = [F.sum(c).alias(c) for c in ("rows", "known", "zeros", "negatives")]
    whole = profiles.groupBy(*keys).agg(
        *sums,
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        (F.sum(F.col("mean") * F.col("known")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("known")))).alias("__mean"),
        F.call_function("hll_union_agg", F.col("distinct")).alias("__distinct"),
        F.kll_merge_agg_double("quantiles").alias("__quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("__frequent"),
    )
    away = F.col("mean") - F.col("__mean")
    n, m2, m3, m4 = [F.col(c) for c in ("known", "m2", "m3", "m4")]
    parts = profiles.select(*keys, "known", "mean", "m2", "m3", "m4").join(whole.select(*keys, "__mean"), keys).groupBy(*keys).agg(
        F.sum(m2 + n * away * away).alias("__m2"),
        F.sum(m3 + 3 * away * m2 + n * F.pow(away, 3)).alias("__m3"),
        F.sum(m4 + 4 * away * m3 + 6 * away * away * m2 + n * F.pow(away, 4)).alias("__m4"),
    )
    out = whole.join(parts, keys)
    rows, known, m2 = F.col("rows"), F.col("known"), F.col("__m2")
    spread = m2 > 1e-12 * F.greatest(F.lit(1e-300), known * F.col("__mean") * F.col("__mean"))  # a constant but for rounding
    quantile = lambda q: F.when(known > 0, F.kll_sketch_get_quantile_double("__quantiles", F.lit(q)))
    out = out.withColumns({"q1": quantile(0.25), "median": quantile(0.5), "q3": quantile(0.75)})
    fence = OUTLIER_IQR * (F.col("q3") - F.col("q1"))
    grid = F.kll_sketch_get_quantile_double("__quantiles", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    beyond = F.filter(grid, lambda x: (x < F.col("q1") - fence) | (x > F.col("q3") + fence))
    outside = F.size(beyond) / (GRID + 1)
    top = F.get(F.call_function("approx_top_k_estimate", F.col("__frequent"), F.lit(1)), 0)
    share = lambda c: F.col(c) / rows * 100
    distinct = F.hll_sketch_estimate("__distinct")
    return out.select(
        *keys,
        "rows",
        (rows - known).alias("missing"),
        distinct.alias("distinct"),
        "zeros",
        "negatives",
        "min",
        "max",
        F.when(known > 0, top["item"]).alias("most_common"),
        F.when(known > 0, top["count"]).alias("most_common_count"),
        F.col("__mean").alias("mean"),
        F.when(known > 1, F.sqrt(F.when(spread, m2).otherwise(0.0) / (known - 1))).alias("std"),
        F.when(spread, F.sqrt(known) * F.col("__m3") / F.pow(m2, 1.5)).alias("skewness"),
        F.when(spread, known * F.col("__m4") / (m2 * m2) - 3).alias("kurtosis"),
        "q1",
        "median",
        "q3",
        ((rows - known) / rows * 100).alias("missing_pct"),
        share("zeros").alias("zero_pct"),
        (distinct / rows * 100).alias("distinct_pct"),
        F.when(known > 0, top["count"] / rows).alias("most_common_freq"),
        (F.col("max") - F.col("min")).alias("range"),
        F.when(known > 0, outside * 100).alias("outlier_pct"),
    )
