"""Streaming jobs driven to the end over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.key_index import KeyIndex
from ..sources.snapshots import Snapshots
from ..sources.tables import stage_path, upsert
from ..streaming import feed
from ..streaming.ledger import Ledger
from ..streaming.totals import RunningTotals
from .registry import query
from .roles import rounded, table

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def land(df: DataFrame, name: str, kind: str = "parquet") -> str:
    """Write rows to a landing folder for a stream to read; files follow the time order."""
    path = stage_path(df.sparkSession, name)
    df.write.format(kind).save(path)
    return path


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = land(table(spark, sf, "events"), "events")
    return feed.landed(spark, path, EVENTS, "parquet")


def collected(stream: DataFrame, name: str) -> DataFrame:
    """Drain an append stream into a table and read it."""
    spark = stream.sparkSession
    path = stage_path(spark, name)
    feed.to_parquet(stream, path, feed.checkpoint_path(spark, name)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def latest_batches(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drain an update stream into a keyed table and read it."""
    spark = stream.sparkSession
    path = stage_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    feed.drain(stream, write, feed.checkpoint_path(spark, name), "update").awaitTermination()
    from ..operators.grouping import first_per_key

    return first_per_key(spark.read.parquet(path), keys, [F.desc("batch")]).drop("batch")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = feed.daily_counts(events_stream(spark, sf), "ts", "event_type", measure="value")
    return rounded(latest_batches(counts, "daily", ["day", "event_type"]), 4)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is delivered twice; the stream keeps one."""
    source = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    path = land(source.unionByName(source), "twice")
    stream = feed.landed(spark, path, "event_id bigint, ts timestamp, user_id bigint, event_type string", "parquet")
    once = feed.first_deliveries(stream, "ts", ["event_id"], "60 days")
    return collected(once, "once").drop("ts")


@query(
    """
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"""
)
def stream_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed table of the newest record per user, fed in deliveries that arrive newest first."""
    source = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", (F.col("user_id") % 8).alias("bucket"))
    path = stage_path(spark, "deliveries")
    for first, last in (("2024-01-21", "2999-01-01"), ("2024-01-11", "2024-01-21"), ("2024-01-01", "2024-01-11")):
        source.where((F.col("ts") >= first) & (F.col("ts") < last)).write.mode("append").parquet(path)
    stream = feed.landed(
        spark, path, "user_id bigint, event_id bigint, ts timestamp, value double, bucket bigint", "parquet", files_per_batch=1
    )
    out = stage_path(spark, "users")
    index = KeyIndex(spark, stage_path(spark, "users-index"), "user_id bigint", "bucket bigint")
    feed.upsert_stream(
        stream, out, ["user_id"], [F.desc("ts"), F.desc("event_id")], "bucket", feed.checkpoint_path(spark, "users"), index
    ).awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_id", "value")


@query(
    """
WITH p AS (SELECT event_id AS race_id, ts AS predicted_at, value FROM events),
r AS (SELECT event_id AS race_id, ts + INTERVAL 1 HOUR * (event_id % 300) AS result_at, user_id AS position FROM events WHERE event_type <> 'error')
SELECT p.race_id, round(p.value, 6) AS value, r.position FROM p LEFT JOIN r ON r.race_id = p.race_id AND result_at <= predicted_at + INTERVAL 7 DAY"""
)
def stream_results_join(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions meet results within seven days; the others are emitted unmatched once the bound has passed.

    A last pair of far-future records moves the watermark past every real one, as
    the next day's feed would; they are filtered out.
    """
    source = table(spark, sf, "events")
    late = F.expr("ts + make_interval(0, 0, 0, 0, event_id % 300, 0, 0)")
    predictions = source.select(F.col("event_id").alias("race_id"), F.col("ts").alias("predicted_at"), "value")
    results = source.where(F.col("event_type") != "error").select(
        F.col("event_id").alias("race_id"), late.alias("result_at"), F.col("user_id").alias("position")
    )
    p_path, r_path = land(predictions, "predictions"), land(results, "results")
    newest = source.agg(F.max("ts").alias("t"))
    ahead = F.expr("t + INTERVAL 365 DAYS")
    later = newest.select(F.lit(-1).cast("long").alias("race_id"), ahead.alias("predicted_at"), F.lit(0.0).alias("value"))
    later.coalesce(1).write.mode("append").parquet(p_path)
    newest.select(F.lit(-2).cast("long").alias("race_id"), ahead.alias("result_at"), F.lit(0).cast("long").alias("position")).coalesce(
        1
    ).write.mode("append").parquet(r_path)
    p = feed.landed(spark, p_path, "race_id bigint, predicted_at timestamp, value double", "parquet")
    r = feed.landed(spark, r_path, "race_id bigint, result_at timestamp, position bigint", "parquet")
    joined = feed.late_results(p, r, ["race_id"], "predicted_at", "result_at")
    out = collected(joined, "joined").where(F.col("race_id") >= 0)
    return rounded(out.select("race_id", "value", "position"))


@query(
    """
WITH e AS (SELECT CAST(ts AS DATE) AS d, value - user_id / 10 AS e FROM events),
days AS (SELECT CAST(range AS DATE) AS day FROM range((SELECT min(d) FROM e) + 1, (SELECT max(d) FROM e) + INTERVAL 31 DAY, INTERVAL 1 DAY))
SELECT day, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS mean_error FROM days JOIN e ON d < day AND d >= day - 30 GROUP BY day"""
)
def stream_rolling_health(spark: SparkSession, sf: str) -> DataFrame:
    stream = events_stream(spark, sf).withColumn("actual", F.col("user_id") / 10)
    daily = latest_batches(feed.daily_errors(stream, "ts", "value", "actual"), "health", ["day"])
    return rounded(feed.rolling_health(daily))


def measures() -> dict[str, Column]:
    return {"starts": F.lit(1), "wins": F.when(F.col("event_type") == "purchase", 1).otherwise(0), "earnings": F.col("value")}


_TOTALS = "SELECT user_id, count(*) AS starts, count(*) FILTER (WHERE event_type = 'purchase') AS wins, round(sum(value), 4) AS earnings FROM {} GROUP BY user_id"


def counted(sums: DataFrame) -> DataFrame:
    """Totals with their counts as whole numbers."""
    return rounded(sums.withColumns({c: F.col(c).cast("long") for c in ("starts", "wins")}), 4)


@query(_TOTALS.format("events"))
def stream_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per user, added up over batches of a file."""
    path = land(table(spark, sf, "events").withColumn("day", F.to_date("ts")).repartition(9, "event_id"), "events-in-files")
    stream = feed.landed(spark, path, f"{EVENTS}, day date", "parquet", files_per_batch=1)
    totals = RunningTotals(spark, stage_path(spark, "totals"), "user_id", "day", measures())
    totals.start(stream, feed.checkpoint_path(spark, "totals")).awaitTermination()
    return counted(totals.read())


@query(
    """
WITH e AS (SELECT CASE WHEN event_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS user_id, event_type,
  CASE WHEN event_id % 5 = 0 THEN 2 * value ELSE value END AS value FROM events)"""
    + _TOTALS.format("e")
)
def stream_corrected_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the events is delivered again on another day, for another user and with another value; later, all
    come once more as an older version.
    """
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    moved = events.where("event_id % 5 = 0").withColumns(
        {"user_id": F.col("user_id") + 1, "value": F.col("value") * 2, "day": F.date_add("day", 1)}
    )
    path = stage_path(spark, "corrected")
    for version, part in ((1, events), (2, moved), (0, events)):
        part.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(path)  # a delivery is a file
    stream = feed.landed(spark, path, f"{EVENTS}, day date, version int", "parquet", files_per_batch=1)
    out = stage_path(spark, "totals")
    totals = RunningTotals(spark, out, "user_id", "day", measures(), "event_id bigint", [F.desc("version")])
    totals.start(stream, feed.checkpoint_path(spark, "totals")).awaitTermination()
    return counted(totals.read().where("starts <> 0"))


@query(
    """
SELECT comp, jour, value FROM (
  SELECT user_id AS comp, CAST(ts AS DATE) AS jour, value,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 1000003 DESC, event_id DESC) AS k FROM events) WHERE k = 1"""
)
def ingest_redelivered(spark: SparkSession, sf: str) -> DataFrame:
    """Races delivered several times, in one batch and across batches, on changing days: the last delivery stays."""
    number = F.struct((F.col("event_id") * 7919 % 1000003).alias("a"), F.col("event_id").alias("b"))
    source = table(spark, sf, "events").select(
        F.col("user_id").alias("comp"), F.to_date("ts").alias("jour"), "value", number.alias("delivered")
    )
    path = stage_path(spark, "redelivered")
    for half in (1, 0):
        source.where(F.col("delivered.b") % 2 == half).write.mode("append").parquet(path)
    stream = feed.landed(
        spark, path, "comp bigint, jour date, value double, delivered struct<a: bigint, b: bigint>", "parquet", files_per_batch=8
    )
    out = stage_path(spark, "redelivered-races")
    feed.ingest_races(
        stream, lambda rows: rows, out, feed.checkpoint_path(spark, "redelivered"), delivered="delivered"
    ).awaitTermination()
    return spark.read.parquet(out).select("comp", "jour", "value")


@query(
    """
SELECT event_type, count(*) AS n, min(CAST(ts AS DATE)) AS first_day FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15' GROUP BY event_type"""
)
def incremental_window(spark: SparkSession, sf: str) -> DataFrame:
    """First run up to a day, second run over everything: the second sees only what the first has not."""
    source = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    ledger, order = Ledger(spark, stage_path(spark, "ledger"), "event_id bigint"), [F.asc("event_id")]
    ledger.run(source.where(F.col("day") <= "2024-01-15"), lambda rows: rows, order)
    fresh = ledger.fresh(source, order)
    return fresh.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"))


def three_deliveries(spark: SparkSession, sf: str) -> tuple[DataFrame, Snapshots]:
    """An archive and the corrections learnt from it, after three deliveries.

    The second holds the first once more and later days; the third holds everything: days
    before those already processed, and other values for a part. Each run archives the
    fresh rows by key and learns the corrections from the whole archive.
    """
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts")).select("event_id", "day", "user_id", "event_type", "value")
    early, on_time = F.col("day") <= "2024-01-12", F.col("event_id") % 17 != 0
    other = F.when(F.col("event_id") % 23 == 0, F.col("value") * 10).otherwise(F.col("value"))
    deliveries = (
        events.where(early & on_time),
        events.where((F.col("day") <= "2024-01-20") & on_time),
        events.withColumn("value", other),
    )
    ledger = Ledger(spark, stage_path(spark, "ledger"), "event_id bigint")
    path, index = stage_path(spark, "archive"), KeyIndex(spark, stage_path(spark, "archive-index"), "event_id bigint", "day date")
    learnt = Snapshots(spark, stage_path(spark, "corrections"))
    for number, delivery in enumerate(deliveries, 1):

        def process(fresh: DataFrame, number: int = number) -> DataFrame:
            rows = fresh.withColumn("run", F.lit(number))
            archive = upsert(rows, path, ["event_id"], [F.desc("run")], "day", index=index)
            error = F.col("value") - F.col("user_id") / 10
            learnt.write(archive.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error")))
            return rows.select("event_id", "run")

        ledger.run(delivery, process, [F.asc("event_id")])
    return spark.read.parquet(path), learnt


@query(
    """
SELECT event_id, CAST(ts AS DATE) AS day, round(CASE WHEN event_id % 23 = 0 THEN value * 10 ELSE value END, 4) AS value,
  CASE WHEN event_id % 17 = 0 OR event_id % 23 = 0 THEN 3 WHEN CAST(ts AS DATE) <= DATE '2024-01-12' THEN 1
    WHEN CAST(ts AS DATE) <= DATE '2024-01-20' THEN 2 ELSE 3 END AS run FROM events"""
)
def incremental_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Every event in its last version, with the run that processed it: late days and corrections come, repeats don't."""
    archive, _ = three_deliveries(spark, sf)
    return rounded(archive.select("event_id", "day", "value", "run"), 4)


@query(
    """
SELECT event_type, count(*) AS n, round(avg(CASE WHEN event_id % 23 = 0 THEN value * 10 ELSE value END - user_id / 10), 6) AS mean_error
FROM events GROUP BY event_type"""
)
def incremental_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """The corrections after the last run."""
    return rounded(three_deliveries(spark, sf)[1].read())


@query(
    """
SELECT event_id AS comp, CAST(ts AS DATE) AS jour, event_type AS typec, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, r_name AS region
FROM events LEFT JOIN region ON r_regionkey = user_id % 7"""
)
def stream_ingest_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Landed JSON text → converted records → table keyed by id, gaps filled from a static document."""
    source = table(spark, sf, "events")
    text = source.select(F.to_json(F.struct("event_id", "ts", "user_id", "event_type", "props")).alias("value"))
    path = stage_path(spark, "json")
    text.write.text(path)
    stream = feed.landed(spark, path, "event_id bigint, ts timestamp, user_id bigint, event_type string, props string")
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("slot"), F.col("r_name").alias("region"))

    def convert(batch: DataFrame) -> DataFrame:
        rows = batch.select(
            F.col("event_id").alias("comp"), F.to_date("ts").alias("jour"), F.col("event_type").alias("typec"),
            F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long")).alias("k"),
            (F.col("user_id") % 7).alias("slot"), F.lit("").alias("region"),
        )
        from ..sources.races import fill_from

        return fill_from(rows, regions, ["slot"]).drop("slot")

    out = stage_path(spark, "ingested")
    feed.ingest_races(stream, convert, out, feed.checkpoint_path(spark, "ingested")).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("comp", "jour", "typec", "k", F.when(F.col("region") != "", F.col("region")).alias("region"))
