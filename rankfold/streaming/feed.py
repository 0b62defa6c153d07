"""Daily feed, late results and rolling health as streams.

Every job takes a streaming frame and returns one, or starts a query with
``availableNow`` so that a scheduled run drains what has arrived and stops.
Checkpoints and tables live in the cluster's shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grouping import first_per_key
from ..sources.key_index import KeyIndex
from ..sources.tables import stage_path, upsert


def landed(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Stream of files landing in a folder, with a fixed schema."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(path)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, batch by batch, and stop."""
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append stream to a Parquet folder with exactly-once files."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def upsert_stream(
    stream: DataFrame, path: str, keys: Sequence[str], version: Sequence[Column], partition: str, checkpoint: str, index: KeyIndex | None = None
) -> StreamingQuery:
    """Keyed latest-wins table of re-delivered records.

    A batch that is run again after a failure writes the same rows, so the result
    does not change. With an index a batch reads the partitions it touches only.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(first_per_key(batch, keys, version), path, keys, version, partition, index=index)

    return drain(stream, write, checkpoint)


def ingest_races(
    feed: DataFrame,
    convert: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    key: str = "comp",
    day: str = "jour",
    supplement: DataFrame | None = None,
    delivered: str | None = None,
    index: KeyIndex | None = None,
) -> StreamingQuery:
    """Feed rows → converted race rows → table keyed by race; a supplement fills gaps by a stream–static join.

    ``delivered`` names the converted rows' delivery time: the latest delivery of a race
    stays. Without it a batch replaces what is stored and must hold a race once.
    """
    from ..sources.races import fill_from

    def write(batch: DataFrame, _: int) -> None:
        rows = convert(batch)
        if supplement is not None:
            rows = fill_from(rows, supplement, [key])
        if not rows.isEmpty():
            version = [F.desc_nulls_last(delivered)] if delivered else []
            upsert(rows, path, [key], version or [F.asc(key)], day, replace=delivered is None, index=index)

    return drain(feed, write, checkpoint)


def daily_counts(stream: DataFrame, ts: str, status: str, delay: str = "1 day", measure: str | None = None) -> DataFrame:
    """Records per day and status; a day closes when the watermark passes it."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    if measure:
        aggregates.append(F.sum(measure).alias("total"))
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day"), status)
        .agg(*aggregates)
        .select(F.col("window.start").cast("date").alias("day"), status, *[a for a in (["n", "total"] if measure else ["n"])])
    )


def first_deliveries(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """First delivery of each key; state is dropped behind the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def late_results(
    predictions: DataFrame, results: DataFrame, keys: Sequence[str], predicted_at: str, result_at: str, bound: str = "7 days", delay: str = "1 day"
) -> DataFrame:
    """Predictions joined with results that arrive within a bound; unmatched ones follow after it."""
    p = predictions.withWatermark(predicted_at, delay).alias("p")
    r = results.withWatermark(result_at, delay).select(*[F.col(k).alias(f"__{k}") for k in keys], result_at, *[c for c in results.columns if c not in (*keys, result_at)])
    on = F.expr(f"{result_at} >= {predicted_at} AND {result_at} <= {predicted_at} + INTERVAL {bound}")
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"__{k}"))
    return p.join(r, on, "leftOuter").drop(*[f"__{k}" for k in keys])


def daily_errors(stream: DataFrame, ts: str, predicted: str, actual: str, delay: str = "1 day") -> DataFrame:
    """Number of errors, their sum and the sum of their sizes per day."""
    error = F.col(predicted) - F.col(actual)
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day"))
        .agg(F.count(error).alias("n"), F.sum(F.abs(error)).alias("off"), F.sum(error).alias("error"))
        .select(F.col("window.start").cast("date").alias("day"), "n", "off", "error")
    )


def rolling_health(daily: DataFrame, length: int = 30) -> DataFrame:
    """MAE and mean error of the ``length`` days before each day, from the days of :func:`daily_errors`.

    One row per day is copied ``length`` times, never a record.
    """
    ends = F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", length)))
    return (
        daily.select(ends.alias("day"), "n", "off", "error")
        .groupBy("day")
        .agg(F.sum("n").alias("n"), F.sum("off").alias("off"), F.sum("error").alias("error"))
        .select("day", "n", F.try_divide("off", "n").alias("mae"), F.try_divide("error", "n").alias("mean_error"))
    )


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return stage_path(spark, f"{name}-checkpoint")
