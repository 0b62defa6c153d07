"""Stored tables: keyed upserts, back-fill, archive, retention, exports.

Tables are Parquet, partitioned by a day or month column. A write replaces only
the partitions it touches, through the file commit protocol.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.orders import order_array
from ..functions.text import handicap_columns
from ..operators.grouping import first_per_key, join_on, row_number_within
from ..operators.nesting import CHUNK, nest, unnest
from ..session import shared_folder
from .races import known_result, positions_of_orders


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def existing(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The stored table, or None before the first write; a given schema spares reading all footers."""
    files, hadoop_path = file_system(spark, path)
    if not files.exists(hadoop_path):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    return reader.parquet(path)


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions present in ``df``; leave the others alone."""
    (
        df.hint("rebalance", F.col(partition))  # large days are split over tasks, small ones merged
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def latest_rows(
    old: DataFrame | None, new: DataFrame, keys: Sequence[str], version: Sequence[Column], replace: bool = False
) -> DataFrame:
    """Old and new rows, one per key: the first by ``version``, of equal ones the new row.

    With ``replace`` a new row wins whatever its version.
    """
    rows = new.withColumn("__new", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    newer = F.desc("__new")
    return first_per_key(rows, keys, [newer, *version] if replace else [*version, newer]).drop("__new")


def upsert(
    new: DataFrame,
    path: str,
    keys: Sequence[str],
    version: Sequence[Column],
    partition: str,
    replace: bool = False,
    schema: StructType | None = None,
    index=None,
) -> DataFrame:
    """Keyed upsert into a partitioned table; reads and rewrites only touched partitions.

    Touched are the partitions of the new rows and those that hold an older row of their
    keys, so a race whose day is corrected moves. A null partition is one like others. The
    rewritten partitions are staged first, as a partition left empty is removed after the
    write. The driver receives one value per touched partition. ``schema`` is the stored
    table's; without it the footers of all files are read for columns added later.

    Without ``index`` the keys of all stored rows are read to find moved ones. A
    :class:`~rankfold.sources.key_index.KeyIndex` from the keys to the partition spares
    that. It learns the batch's partitions before the table is written and is committed
    after, so a run that fails in between leaves an index that knows both places. An
    empty index of a stored table is filled from the table once.
    """
    spark = new.sparkSession
    old = existing(spark, path, schema)
    if old is None:
        first = latest_rows(None, new, keys, version, replace)
        run = index.add(first.select(*keys, partition)) if index is not None else None
        write_partitions(first, path, partition)
        if index is not None:
            index.commit(run)
        return spark.read.schema(new.schema).parquet(path)
    old = old.withColumn(partition, F.col(partition).cast(new.schema[partition].dataType))
    if index is None:
        moved = join_on(old.select(*keys, partition), new.select(*keys), keys, "left_semi").select(partition)
    else:
        if not index.committed():
            index.commit(index.add(old.select(*keys, partition)))
        moved = index.lookup(new.select(*keys)).select(partition)
    touched = [r[0] for r in new.select(partition).union(moved).distinct().collect()]
    known = [v for v in touched if v is not None]
    hit = F.col(partition).isin(*known) if known else F.lit(False)
    old = old.where(hit | F.col(partition).isNull() if None in touched else hit)
    staged = stage_path(spark, "upsert")
    rows = latest_rows(old, new, keys, version, replace)
    rows.write.parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    if index is not None:
        run = index.add(join_on(rows.select(*keys, partition), new.select(*keys), keys, "left_semi"))
    write_partitions(rows, path, partition)
    filled = {r[0] for r in rows.select(partition).distinct().collect()}
    for value in touched:
        if value not in filled:
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
            files, folder = file_system(spark, f"{path}/{partition}={name}")
            files.delete(folder, True)
    if index is not None:
        index.commit(run)
    return spark.read.schema(rows.schema).parquet(path)


def race_rows(races: DataFrame, runners: DataFrame, key: str, number: str, fields: Sequence[str], handicap: str | None = None) -> DataFrame:
    """Race rows with nested participants and encoded handicap text."""
    nested = nest(runners, [key], number, fields, "participants")
    out = races.join(nested, key, "left").withColumn("part", F.coalesce("part", F.lit(0)))
    if handicap is not None:
        out = out.withColumns(handicap_columns(F.col(handicap)))
    return out


def result_rows(rows: DataFrame, race: str, position: str, number: str, horse: str) -> DataFrame:
    """Arrival arrays: numbers first in order, then codes.

    Entries carry their finish, so a very large race may come in several parts.
    """
    text = F.col(position).cast("string")
    number_ = F.when(text.rlike("^[0-9]+$"), text.cast("int"))
    # Parts follow the finish, so the first part starts with the winner.
    order = [number_.asc_nulls_last(), text.asc_nulls_last(), F.col(number).asc(), F.col(horse).asc()]
    placed = row_number_within(rows, race, order, "__place")
    entry = F.struct(
        F.col("__place"), text.alias("narrivee"), F.col(number).cast("int").alias("cheval"), F.col(horse).cast("long").alias("idche")
    )
    ordered = F.array_sort(F.collect_list(entry))
    plain = F.transform(ordered, lambda e: F.struct(e["narrivee"], e["cheval"], e["idche"]))
    part = F.floor((F.col("__place") - 1) / CHUNK).cast("long").alias("part")
    return placed.groupBy(race, part).agg(plain.alias("ordre_arrivee"))


def prediction_rows(df: DataFrame, ensemble: str, final: str, weights: Mapping[str, float]) -> DataFrame:
    """Prediction facts of a blend: the adjustment is final minus ensemble; the weights used are stored."""
    return df.withColumns(
        {
            "ensemble_prediction": F.col(ensemble),
            "final_prediction": F.col(final),
            "competitive_adjustment": F.col(final) - F.col(ensemble),
            **{f"ensemble_weight_{name}": F.lit(float(w)) for name, w in weights.items()},
        }
    )


def race_summaries(df: DataFrame, race: Sequence[str], rank: str, number: str, score: str) -> DataFrame:
    """Per race: top-five string, predicted winner, size."""
    picks = F.array_sort(F.collect_list(F.when(F.col(rank) <= 5, F.struct(F.col(rank).alias("r"), F.col(number).alias("n")))))
    out = df.groupBy(*race).agg(F.count(F.lit(1)).alias("total_horses"), F.min(score).alias("best_score"), picks.alias("__p"))
    names = F.transform("__p", lambda e: e["n"].cast("string"))
    return out.select(
        *race, "total_horses", "best_score", F.array_join(names, "-").alias("predicted_top5"),
        F.get("__p", 0)["n"].alias("predicted_winner"),
    )


def backfill(stored: DataFrame, results: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Actual results filled in; a late result overwrites, a missing one keeps the old value."""
    new = results.select(*keys, F.col(position).cast("int").alias("__new"))
    out = stored.join(new, list(keys), "left")
    actual = F.coalesce("__new", "actual_result")
    return out.withColumns({"actual_result": actual, "was_in_quinte": actual <= 5}).drop("__new")


def nested_predictions(races: DataFrame, rows: DataFrame, race: str, rank: str, fields: Sequence[str]) -> DataFrame:
    """Race rows with their predictions as a nested array."""
    nested = nest(rows, [race], rank, fields, "predictions")
    if "part" in races.columns:
        return races.drop("predictions").join(nested, [race, "part"], "left")
    return races.drop("predictions").join(nested, race, "left")


def archive(daily: DataFrame, archived: DataFrame | None, renames: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history rows, result rows, markers) of completed races not archived yet."""
    rows = daily.where(known_result())
    if archived is not None:
        rows = rows.join(archived.select("comp"), "comp", "left_anti")
    rows = rows.withColumnsRenamed(dict(renames or {"reun": "reunion"}))
    before = F.col("part") * CHUNK if "part" in rows.columns else F.lit(0)
    order = F.transform(
        order_array(F.col("actual_results")),
        lambda n, i: F.struct((i + 1 + before).cast("string").alias("narrivee"), n.try_cast("int").alias("cheval")),
    )
    results = rows.select("comp", order.alias("ordre_arrivee"))
    return rows.drop("actual_results", "predictions"), results, rows.select("comp", "jour")


def with_final_positions(races: DataFrame, order: str = "actual_results") -> DataFrame:
    """(comp, part, participants): nested participants carrying ``final_position`` from the order string."""
    rows = unnest(races.select("comp", "participants"), "participants")
    places = positions_of_orders(races, order).withColumnRenamed("position", "final_position")
    fields = [c for c in rows.columns if c not in ("comp", "numero")]
    return nest(rows.join(places, ["comp", "numero"], "left"), ["comp"], "numero", [*fields, "final_position"], "participants")


def expired(df: DataFrame, day: str, days: int, today: Column | None = None) -> Column:
    """True for rows older than ``days`` before today (default: the newest day of the table)."""
    reference = df.select(F.max(day)).scalar() if today is None else today
    return F.col(day) < F.date_sub(reference, days)


def retention_report(df: DataFrame, day: str, days: int) -> DataFrame:
    """Dry run: how many rows would go and stay."""
    old = F.col("__old")
    return df.withColumn("__old", expired(df, day, days)).agg(
        F.count(F.when(old, 1)).alias("to_delete"), F.count(F.when(~old, 1)).alias("to_keep"),
        F.min(F.when(old, F.col(day))).alias("oldest"),
    )


def retain(df: DataFrame, day: str, days: int) -> DataFrame:
    return df.where(~expired(df, day, days))


def delete_archived(daily: DataFrame, archived: DataFrame, day: str, days: int) -> DataFrame:
    """Daily races without those that are both archived and old."""
    gone = daily.where(expired(daily, day, days)).join(archived.select("comp"), "comp", "left_semi").select("comp")
    return daily.join(gone, "comp", "left_anti")


def write_checked(df: DataFrame, path: str, checks: Sequence[Callable[[DataFrame], None]] = ()) -> DataFrame:
    """Replace the table at ``path`` by ``df``, unsupported columns as JSON text, once its rows are counted and checked.

    A failure leaves the old rows: see :class:`~rankfold.sources.snapshots.Snapshots`,
    whose ``read`` gives the current ones.
    """
    from .snapshots import Snapshots

    plain = df.select(
        *[
            F.to_json(c).alias(c) if t.startswith("map") else (F.col(c).cast("string") if t in ("variant", "void") else F.col(c))
            for c, t in df.dtypes
        ]
    )
    return Snapshots(df.sparkSession, path).write(plain, checks)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def feature_export(df: DataFrame, race: str, number: str, fields: Sequence[str], keep: Sequence[str] = (), at_least: int = 1) -> DataFrame:
    """Nested feature rows per race for export."""
    nested = nest(df, [race, *keep], number, fields, "X_features")
    return nested.where(F.size("X_features") >= at_least)


def competitive_document(df: DataFrame, race: str, number: str, fields: Sequence[str], statistics: DataFrame) -> DataFrame:
    """One analysis document per race: statistics and the runners' scores, nested."""
    nested = nest(df, [race], number, fields, "runners")
    stats = statistics.select(race, F.struct(*[c for c in statistics.columns if c != race]).alias("field_statistics"))
    return nested.join(stats, race)
