"""Audits of feature columns, completeness, drift and leakage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import correlation
from .cleaning import NUMERIC_TYPES
from ..session import reliable_checkpoint
from .grouping import MAX_COLUMN_VALUES, Grouping, quantiles_within

# Thresholds of the audit and words that hint at leakage.
HIGH_MISSING, ZERO_SHARE, LOW_VARIANCE, SKEW_LIMIT, OUTLIER_SHARE, HIGH_CORRELATION = 50.0, 50.0, 0.01, 5.0, 5.0, 0.95
OUTLIER_IQR = 3.0
LEAKAGE_WORDS = ("cl", "ecar", "place", "rank", "result", "finish", "arrived", "position")
RATIO_WORDS = ("ratio", "pct", "rate")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES]


def unpivot(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """(keep…, column, value) rows; an array of pairs is exploded inside the scan stage."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def weighted_moments(counts: DataFrame) -> DataFrame:
    """(column, mean, std, skewness, kurtosis) from (column, value, n) rows; central sums follow the means."""
    known = counts.where(F.col("value").isNotNull())
    means = known.groupBy("column").agg(F.sum("n").alias("__n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    away = F.col("value") - F.col("mean")
    sums = known.join(F.broadcast(means), "column").groupBy("column", "mean", "__n").agg(
        *[F.sum(F.pow(away, k) * F.col("n")).alias(f"__m{k}") for k in (2, 3, 4)]
    )
    n, m2 = F.col("__n"), F.col("__m2")
    return sums.select(
        "column",
        "mean",
        F.sqrt(F.try_divide(m2, n - 1)).alias("std"),
        F.try_divide(F.sqrt(n) * F.col("__m3"), F.pow(m2, 1.5)).alias("skewness"),
        (F.try_divide(n * F.col("__m4"), m2 * m2) - 3).alias("kurtosis"),
    )


def column_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts, moments, distinct share, most common value, quartiles, outliers, zeros."""
    long = unpivot(df, columns)
    # Each value of a column is counted once before anything is shuffled further.
    counts = reliable_checkpoint(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    v, n = F.col("value"), F.col("n")
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("missing"),
        F.count(v).alias("distinct"),
        F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zeros"),
        F.coalesce(F.sum(F.when(v < 0, n)), F.lit(0)).alias("negatives"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.max_by(v, F.when(v.isNotNull(), F.struct(n, -v))).alias("most_common"),
        F.max(F.when(v.isNotNull(), n)).alias("most_common_count"),
    )
    moments = weighted_moments(counts)
    by_column = Grouping.measure(counts, "column", max_rows=MAX_COLUMN_VALUES)
    quartiles = quantiles_within(counts, by_column, "value", [0.25, 0.5, 0.75], "q", "n").select(
        "column",
        F.get("q", 0).alias("q1"),
        F.get("q", 1).alias("median"),
        F.get("q", 2).alias("q3"),
    )
    fence = OUTLIER_IQR * (F.col("q3") - F.col("q1"))
    outside = (v < F.col("q1") - fence) | (v > F.col("q3") + fence)
    outliers = counts.join(F.broadcast(quartiles), "column").groupBy("column").agg(
        F.coalesce(F.sum(F.when(outside, n)), F.lit(0)).alias("outliers")
    )
    out = stats.join(moments, "column").join(quartiles, "column").join(outliers, "column")
    rows, known = F.col("rows"), F.col("rows") - F.col("missing")
    return out.withColumns(
        {
            "missing_pct": F.col("missing") / rows * 100,
            "zero_pct": F.col("zeros") / rows * 100,
            "distinct_pct": F.col("distinct") / rows * 100,
            "most_common_freq": F.col("most_common_count") / rows,
            "range": F.col("max") - F.col("min"),
            "outlier_pct": F.try_divide(F.col("outliers"), known) * 100,
        }
    )


def audit_flags(audit: DataFrame) -> DataFrame:
    """(column, issue, severity, recommendation) rows of an audit."""
    name = F.lower("column")
    words = F.lit(False)
    for w in LEAKAGE_WORDS:
        words = words | F.contains(name, F.lit(w))
    checks = (
        ("constant", "high", "drop_constant", F.col("distinct") == 1),
        ("missing", "high", "drop_or_fill", F.col("missing_pct") > HIGH_MISSING),
        ("all_zeros", "high", "drop_empty", F.col("zero_pct") == 100),
        ("skewed", "medium", "compress_scale", F.abs("skewness") > SKEW_LIMIT),
        ("leakage", "high", "check_time", words),
        (
            "low_variance", "low", "check_codes",
            (F.col("distinct") > 1) & (F.col("distinct_pct") / 100 < LOW_VARIANCE),
        ),
        ("outliers", "low", "clip", F.col("outlier_pct") > OUTLIER_SHARE),
        ("zeros", "low", "check_zeros", (F.col("zero_pct") > ZERO_SHARE) & (F.col("zero_pct") < 100)),
        ("negative", "low", "check_sign", F.col("negatives") > 0),
    )
    found = F.array_compact(
        F.array(*[
            F.when(test, F.struct(F.lit(issue).alias("issue"), F.lit(level).alias("severity"), F.lit(text).alias("recommendation")))
            for issue, level, text, test in checks
        ])
    )
    return audit.select("column", F.explode(found).alias("f")).select("column", "f.*")


def _pair_sums(size: int):
    """Per task: sums over the rows where both columns of a pair are known, shifted by the means."""

    def run(batches):
        total = np.zeros((6, size, size))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(np.float64)
            total += [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
        i, j = np.triu_indices(size, 1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, *(t[i, j] for t in total))], names=_PAIR_NAMES)

    return run


_PAIR_NAMES = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(first, second, correlation) of every pair of columns, over rows where both are known.

    Two scans whatever the number of columns: the means, then one table of pair sums per
    task, added up by pair. NaN counts as unknown; a pair without variance has a null.
    """
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    shifted = df.select(*[(v - F.lit(float(means[i] or 0.0))).alias(f"c{i}") for i, v in enumerate(values)])
    parts = shifted.mapInArrow(_pair_sums(len(columns)), "i long, j long, " + ", ".join(f"{c} double" for c in _PAIR_NAMES[2:]))
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _PAIR_NAMES[2:]])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)
    name = lambda i: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(i).cast("int") + 1)
    return sums.select(
        name("i").alias("first"),
        name("j").alias("second"),
        F.when(spread > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (n * F.col("sxy") - sx * sy) / F.sqrt(spread)))).alias("correlation"),
    )


def correlated_pairs(df: DataFrame, columns: Sequence[str], limit: float = HIGH_CORRELATION) -> DataFrame:
    """The pairs of :func:`pair_correlations` above the limit."""
    return pair_correlations(df, columns).where(F.abs("correlation") > limit)


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(column, correlation) with the target, strongest first."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), correlation(c, target).alias("correlation")) for c in columns])
    return df.agg(entries.alias("e")).select(F.inline("e")).orderBy(F.abs("correlation").desc_nulls_last())


def by_race(df: DataFrame, race: str, columns: Sequence[str]) -> DataFrame:
    """Rows, missing and zero percentages per race."""
    cells = F.count(F.lit(1)) * len(columns)
    nulls = sum((F.count(F.when(F.col(c).isNull(), 1)) for c in columns[1:]), F.count(F.when(F.col(columns[0]).isNull(), 1)))
    zeros = sum((F.count(F.when(F.col(c) == 0, 1)) for c in columns[1:]), F.count(F.when(F.col(columns[0]) == 0, 1)))
    return df.groupBy(race).agg(
        F.count(F.lit(1)).alias("horses"), (nulls / cells * 100).alias("missing_pct"), (zeros / cells * 100).alias("zero_pct")
    )


def completeness(df: DataFrame, limits: Mapping[str, float | None], by: Sequence[str] = ()) -> DataFrame:
    """(group…, column, filled_pct, status): share of filled values against a minimum."""
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            (F.avg(F.col(c).isNotNull().cast("int")) * 100).alias("filled_pct"),
            F.lit(None if limit is None else float(limit)).cast("double").alias("minimum"),
        )
        for c, limit in limits.items()
    ])
    out = df.groupBy(*by).agg(entries.alias("e")).select(*by, F.inline("e"))
    return out.withColumn("status", F.when(F.col("filled_pct") < F.col("minimum"), "fail").otherwise("pass"))


def value_rules(df: DataFrame, rules: Mapping[str, Column], *keep: str) -> DataFrame:
    """(keep…, issue) rows: one per broken rule; a rule is the condition of a bad value."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(*keep, F.explode(found).alias("issue"))


def runner_rules(age: str = "age", win_ratio: str = "ratio_victoires", odds: str = "cotedirect") -> dict[str, Column]:
    return {
        "age": (F.col(age) > 30) | (F.col(age) < 1),
        "win_ratio": F.col(win_ratio) > 1,
        "odds": F.col(odds) < 0,
    }


def schema_report(df: DataFrame, expected: Mapping[str, str] | None = None) -> DataFrame:
    """(column, type, category, missing, present): the frame's columns and expected ones it lacks."""
    category = lambda c: next(
        (name for name, starts in {
            "horse_form": ("che_",), "jockey_form": ("joc_",), "quinte": ("quinte_",), "equipment": ("blinkers", "shoeing", "equipment"),
            "handicap": ("handicap",), "last_race": ("last_race", "derni"),
        }.items() if c.startswith(starts)), "base",
    )
    types = dict(df.dtypes)
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.lit(category(c)).alias("category"),
            F.count(F.when(F.col(c).isNull(), 1)).alias("missing"), F.lit(True).alias("present"),
        )
        for c in df.columns
    ]
    entries += [
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(category(c)).alias("category"),
            F.count(F.lit(1)).alias("missing"), F.lit(False).alias("present"),
        )
        for c, t in (expected or {}).items() if c not in types
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def drift(train: DataFrame, daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and deviation of both sides per column; flagged beyond one training deviation."""
    side = lambda df, label: unpivot(df, [c for c in columns if c in df.columns]).groupBy("column").agg(
        F.avg("value").alias(f"{label}_mean"), F.stddev_samp("value").alias(f"{label}_std")
    )
    out = side(train, "train").join(side(daily, "daily"), "column", "full")
    shift = F.abs(F.col("train_mean") - F.col("daily_mean"))
    status = (
        F.when(F.col("daily_mean").isNull(), "missing in daily")
        .when(F.col("train_mean").isNull(), "extra in daily")
        .when(shift > F.col("train_std"), "drift")
        .otherwise("ok")
    )
    return out.withColumn("status", status)


def assertions(df: DataFrame, columns: Sequence[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """One row of counts: null, infinite and out-of-range values."""
    total = lambda test: sum((F.count(F.when(test(c), 1)) for c in columns[1:]), F.count(F.when(test(columns[0]), 1)))
    inf = float("inf")
    outside = lambda c: (F.lit(False) if low is None else F.col(c) < low) | (F.lit(False) if high is None else F.col(c) > high)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        total(lambda c: F.col(c).isNull()).alias("nulls"),
        total(lambda c: F.isnan(F.col(c).cast("double"))).alias("nans"),
        total(lambda c: F.abs(F.col(c).cast("double")) == inf).alias("infinite"),
        total(outside).alias("out_of_range"),
    )


def require(df: DataFrame, columns: Sequence[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Pass rows through; a bad value fails the job where it is read."""
    checked = {}
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        checked[c] = F.when(bad, F.raise_error(F.lit(f"bad value in {c}")).cast("double")).otherwise(F.col(c))
    return df.withColumns(checked)


def leak_check(df: DataFrame, horse: str, day: str, starts: str) -> DataFrame:
    """Per horse: does the as-of count ever include its own day or later? One row per violation.

    Rows of a horse are summed per day first, so a horse costs one row per day.
    """
    daily = df.groupBy(horse, day).agg(F.count(F.lit(1)).alias("n"), F.max(starts).alias("claimed"))
    before = Window.partitionBy(horse).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    checked = daily.withColumn("expected", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return checked.where(F.col("claimed") != F.col("expected")).select(horse, day, "claimed", "expected")


def varying_columns(df: DataFrame, race: str, columns: Sequence[str]) -> DataFrame:
    """Per race: how many distinct values each column has."""
    return df.groupBy(race).agg(*[F.count_distinct(c).alias(f"{c}_values") for c in columns])


def key_comparison(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(side, n) for keys shared, only left and only right; sides meet by aggregation, not by a join."""
    both = left.select(*keys).withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(
        right.select(*keys).withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1))
    )
    seen = both.groupBy(*keys).agg(F.max("__l").alias("l"), F.max("__r").alias("r"))
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "shared").when(F.col("l") == 1, "only_left").otherwise("only_right")
    return seen.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(df: DataFrame, status: str, by: Sequence[str] = ()) -> DataFrame:
    """Run summary: rows and share per status."""
    counts = df.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
    totals = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(totals))


def verdict(checks: DataFrame, status: str = "status") -> DataFrame:
    """One row: failed checks and the overall result."""
    failed = F.count(F.when(F.col(status) == "fail", 1))
    return checks.agg(
        F.count(F.lit(1)).alias("checks"), failed.alias("failed"), F.when(failed > 0, "fail").otherwise("pass").alias("overall")
    )
