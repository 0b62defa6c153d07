"""Bias detection by bucket and calibration of predicted scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bucket, clamp


@dataclass(frozen=True)
class Dimension:
    """A bias dimension: the column, its buckets (none = the value itself) and the limits of the test."""

    name: str
    column: str
    edges: tuple[float, ...] = ()
    labels: tuple[str, ...] = ()
    min_rows: int = 30
    min_error: float = 0.3
    severity: str = "MEDIUM"

    def label(self) -> Column:
        if not self.edges:
            return F.col(self.column).cast("string")
        return bucket(F.col(self.column), self.edges, self.labels)


# Buckets, minimum counts and error limits.
DIMENSIONS = (
    Dimension(
        "odds", "cotedirect", (0, 3, 5, 10, 20, 100),
        ("favorite", "second_choice", "mid_odds", "long_shot", "extreme"), 20,
    ),
    Dimension("post_position", "numero", (0, 3, 6, 10, 20), ("inside", "mid_inside", "mid_outside", "outside")),
    Dimension("field_size", "partant", (0, 10, 14, 18, 30), ("small", "medium", "large", "xlarge")),
    Dimension("distance", "distance", (0, 1600, 2000, 2800, 10000), ("sprint", "mile", "middle", "long"), severity="LOW"),
    Dimension("typec", "typec", min_error=0.4),
)
OVERALL = "systematic"
OVERALL_MIN_ERROR, OVERALL_HIGH_ERROR = 0.2, 0.5
NORMAL_QUANTILE = 1.959963984540054  # two-sided, at the level 0.05


def bias_table(df: DataFrame, predicted: str, actual: str, dimensions: Sequence[Dimension] = DIMENSIONS) -> DataFrame:
    """(bias_type, bucket, n, mean_error, std_error, t_stat) of all dimensions and the whole.

    One pass: a row contributes to each dimension, and only partial sums travel.
    """
    entries = [F.struct(F.lit(d.name).alias("bias_type"), d.label().alias("bucket")) for d in dimensions]
    entries.append(F.struct(F.lit(OVERALL).alias("bias_type"), F.lit("all").alias("bucket")))
    error = (F.col(predicted) - F.col(actual)).alias("error")
    long = df.select(error, F.explode(F.array(*entries)).alias("e")).select("error", "e.*")
    stats = long.where(F.col("bucket").isNotNull()).groupBy("bias_type", "bucket").agg(
        F.count("error").alias("n"),
        F.avg("error").alias("mean_error"),
        F.stddev_samp("error").alias("std_error"),
    )
    t = F.try_divide(F.col("mean_error"), F.col("std_error") / F.sqrt("n"))
    return stats.withColumn("t_stat", t)


def critical_t(n: Column, z: float = NORMAL_QUANTILE) -> Column:
    """Two-sided critical value of Student's t for n - 1 degrees of freedom, as a series around the normal one.

    Four terms; the error is below 1e-5 from 20 rows on.
    """
    v = n - 1
    # Coefficients of the expansion in 1 / v.
    terms = (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    out = F.lit(terms[0])
    for k, term in enumerate(terms[1:], 1):
        out = out + F.try_divide(F.lit(term), F.pow(v, k))
    return out


def significant_biases(stats: DataFrame, dimensions: Sequence[Dimension] = DIMENSIONS) -> DataFrame:
    """Bias rows with the critical value of t, verdict, severity and correction."""
    least = F.lit(1)
    limit = F.lit(OVERALL_MIN_ERROR)
    level = F.when(F.abs("mean_error") > OVERALL_HIGH_ERROR, "HIGH").otherwise("MEDIUM")
    for d in dimensions:
        mine = F.col("bias_type") == d.name
        least = F.when(mine, d.min_rows).otherwise(least)
        limit = F.when(mine, d.min_error).otherwise(limit)
        level = F.when(mine, d.severity).otherwise(level)
    tested = stats.where(F.col("n") >= least).withColumn("critical_t", critical_t(F.col("n")))
    significant = (F.abs("t_stat") > F.col("critical_t")) & (F.abs("mean_error") > limit)
    tested = tested.withColumns({"significant": F.coalesce(significant, F.lit(False)), "__severity": level})
    hits = tested.groupBy("bias_type").agg(
        F.count(F.when(F.col("significant"), 1)).alias("significant_buckets"),
        F.avg(F.when(F.col("significant"), F.abs("mean_error"))).alias("impact"),
    )
    wide_odds = (F.col("bias_type") == "odds") & (F.col("significant_buckets") > 2)
    return (
        tested.join(hits, "bias_type")
        .withColumn("severity", F.when(wide_odds, "HIGH").otherwise(F.col("__severity")))
        .withColumn("correction", -F.col("mean_error"))
        .drop("__severity")
    )


def corrections(biases: DataFrame) -> DataFrame:
    """(bias_type, bucket, correction) of every dimension with a significant bucket."""
    return biases.where(F.col("significant_buckets") > 0).select("bias_type", "bucket", "correction")


def apply_corrections(
    df: DataFrame,
    table: DataFrame,
    predicted: str,
    name: str = "calibrated_prediction",
    dimensions: Sequence[Dimension] = DIMENSIONS,
    field_size: str | None = "partant",
    mode: str = "sum",
) -> DataFrame:
    """Add the corrections of all dimensions, clipped to [1, field size].

    The table is the fitted calibration: one row per bucket. It is read once, like
    a saved model, and applied as constant lookups inside the scan stage.
    ``mode='single'`` applies the largest correction only, as the dimensions overlap.
    """
    if mode not in ("sum", "single"):
        raise ValueError(f"unknown mode {mode!r}")
    model = table.select("bias_type", "bucket", "correction").collect()
    parts = []
    for d in dimensions:
        known = [F.lit(v) for r in model if r["bias_type"] == d.name for v in (r["bucket"], float(r["correction"]))]
        if known and d.column in df.columns:
            parts.append(F.coalesce(F.try_element_at(F.create_map(*known), F.coalesce(d.label(), F.lit(""))), F.lit(0.0)))
    parts += [F.lit(float(r["correction"])) for r in model if r["bias_type"] == OVERALL]
    parts = parts or [F.lit(0.0)]
    if mode == "sum":
        total = sum(parts[1:], parts[0])
    else:
        total = F.array_max(F.array(*[F.struct(F.abs(p).alias("size"), p.alias("v")) for p in parts]))["v"]
    high = F.col(field_size).cast("double") if field_size in df.columns else F.lit(float("inf"))
    shifted = df.withColumn("__shifted", F.col(predicted) + total)
    return shifted.withColumn(name, clamp(F.col("__shifted"), F.lit(1.0), high)).drop("__shifted")


def improvement(df: DataFrame, predicted: str, calibrated: str, actual: str) -> DataFrame:
    """MAE before and after, gain in percent, and whether the calibration is accepted."""
    before = F.avg(F.abs(F.col(predicted) - F.col(actual)))
    after = F.avg(F.abs(F.col(calibrated) - F.col(actual)))
    return df.agg(before.alias("mae_before"), after.alias("mae_after")).withColumns(
        {
            "improvement": F.col("mae_before") - F.col("mae_after"),
            "improvement_pct": (F.col("mae_before") - F.col("mae_after")) / F.col("mae_before") * 100,
            "accepted": F.col("mae_after") < F.col("mae_before"),
        }
    )


def health(
    df: DataFrame, predicted: str, calibrated: str, actual: str, min_samples: int = 50, has_corrections: bool = True
) -> DataFrame:
    """One row: errors, and whether the calibration needs an update and why."""
    row = df.agg(
        F.avg(F.abs(F.col(calibrated) - F.col(actual))).alias("current_mae"),
        F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("baseline_mae"),
        F.avg(F.col(predicted) - F.col(actual)).alias("mean_error"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    enough = F.col("n_samples") >= min_samples
    drifting = F.abs("mean_error") > 0.3
    helps = F.col("current_mae") < F.col("baseline_mae") - 0.05
    hurts = F.col("current_mae") > F.col("baseline_mae") + 0.1
    reason = (
        F.when(~enough, "too_few_rows")
        .when(drifting, "bias")
        .when(~helps & F.lit(has_corrections), "no_effect")
        .when(hurts, "harm")
        .otherwise("ok")
    )
    return row.withColumns(
        {
            "systematic_bias_developing": drifting,
            "calibration_effective": helps,
            "enough_data": enough,
            "reason": reason,
            "should_update": ~reason.isin("too_few_rows", "ok"),
        }
    )


def split_by_time(df: DataFrame, day: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Newest ``share`` of the rows for fitting, the older rest for validation.

    The cut falls between days: days are counted, and their running count picks it. A
    newest day above the share is the fitting part by itself; rows without a day validate.
    """
    from pyspark.sql import Window

    days = df.where(F.col(day).isNotNull()).groupBy(day).count()  # one row per calendar day
    newest_first = Window.orderBy(F.col(day).desc())
    counted = days.select(
        day, F.sum("count").over(newest_first).alias("__run"), F.sum("count").over(Window.partitionBy(F.lit(1))).alias("__all")
    )
    within = F.min(F.when(F.col("__run") <= F.col("__all") * share, F.col(day)))
    cut = counted.select(F.coalesce(within, F.max(day))).scalar()
    newest = F.coalesce(F.col(day) >= cut, F.lit(False))
    return df.where(newest), df.where(~newest)
