"""Incremental runs over deliveries that may be late, repeated or corrected."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import first_per_key, join_on
from ..sources.key_index import KeyIndex
from ..sources.tables import stage_path

VERSION = "__version"


def content_version(df: DataFrame, keys: Sequence[str]) -> Column:
    """128 bits over all columns but the keys: a delivery with other values is another version."""
    values = sorted(c for c in df.columns if c not in keys)
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in values]), {"ignoreNullFields": "false"}).cast("binary"))


class Ledger:
    """Which version of which key has been processed, whatever its day.

    The pairs are kept in a :class:`KeyIndex`, so a look-up opens the slices that may hold
    a delivered key, not the whole ledger. Pairs count once their run is committed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: str, **options):
        self.index = KeyIndex(spark, path, keys, f"`{VERSION}` string", history=True, **options)
        self.keys = self.index.keys

    def fresh(self, rows: DataFrame, order: Sequence[Column], version: Column | None = None) -> DataFrame:
        """Rows whose version hasn't been processed, one per key, the first in ``order``, with their version."""
        marked = rows.withColumn(VERSION, content_version(rows, self.keys) if version is None else version.cast("string"))
        latest = first_per_key(marked, self.keys, order)
        staged = stage_path(rows.sparkSession, "delivery")
        latest.write.parquet(staged)
        latest = rows.sparkSession.read.schema(latest.schema).parquet(staged)
        known = self.index.lookup(latest, committed_only=True)
        return join_on(latest, known.select(*self.keys, VERSION), [*self.keys, VERSION], "left_anti")

    def run(
        self, rows: DataFrame, process: Callable[[DataFrame], DataFrame], order: Sequence[Column], version: Column | None = None
    ) -> DataFrame:
        """Hand the fresh rows to ``process``, store what it returns, then record them as processed.

        The record is committed last: a run that fails before is repeated whole by the
        next one, so ``process`` must write by key or replace. What it returns is stored
        before the commit.
        """
        spark = rows.sparkSession
        staged = stage_path(spark, "fresh")
        fresh = self.fresh(rows, order, version)
        fresh.write.parquet(staged)
        fresh = spark.read.schema(fresh.schema).parquet(staged)
        done = process(fresh.drop(VERSION))
        stored = stage_path(spark, "incremental")
        done.write.parquet(stored)
        self.index.commit(self.index.add(fresh.select(*self.keys, VERSION)))
        return spark.read.schema(done.schema).parquet(stored)
