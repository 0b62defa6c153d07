"""Line deduplication against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .registry import query, table
from .stages import staged

LEAST_LENGTH = 10
BATCHES = 4
FANOUT = 2
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


class Runs:
    """Sorted runs of (line hash, owner) in levels, each run a bucketed table.

    A run is written once, sorted within buckets of the hash, so joins with it move only
    the other side. When a level holds ``fanout`` runs they are compacted into one run of
    the next level; a key is in one run only. The number of runs stays logarithmic in the
    number of batches.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name)
        return name

    def add(self, rows: DataFrame) -> None:
        name, level = self._write(rows), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.spark.table(self.levels[level][0])
            for other in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(other))
            name = self._write(merged)
            self._forget(self.levels[level])
            self.levels[level], level = [], level + 1

    def _forget(self, names: list[str]) -> None:
        for old in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {old}")

    def close(self) -> None:
        for level in self.levels:
            self._forget(level)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` (one row per hash) with the owner that a run holds, and whether one does."""
        owner, known = F.lit(None).cast("long"), F.lit(False)
        for i, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).select(*KEY, F.col("owner").alias(f"o{i}"), F.lit(True).alias(f"k{i}"))
            keys = keys.join(run, KEY, "left")
            owner, known = F.coalesce(F.col(f"o{i}"), owner), F.coalesce(F.col(f"k{i}"), known)
        return keys.withColumn("run_owner", owner).withColumn("known", known)


def _lines() -> F.Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def line_keys(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per line that is long enough to be compared: its place and a 128-bit hash of its key."""
    key = F.translate(F.btrim(F.col("line"), F.lit(_BLANK)), _UPPER, _LOWER)
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines()).alias("pos", "line"))
        .withColumn("key", key)
        .where(F.char_length("key") >= least_length)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def dedup_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The rows and columns of ``docs`` with n_lines, n_dropped and kept_text.

    Batches are ranges of doc_id in ascending order. A batch looks its line hashes up in
    the runs of the batches before it; those found belong to an earlier document, the
    others to their smallest doc_id in the batch, and form a new run. A line goes when its
    key belongs to another document.

    A null or empty text is one empty line. Null ids come last and count as one document.
    Rows that repeat an id are one document for ownership, each with its own lines. An
    empty table gives no rows. Columns that have a new column's name give way to it; others pass
    through unchanged.

    Only hashes move for the decision: keys are combined in the tasks that scan them, a
    line that a third of the documents hold is one row per task, and marking its lines is
    a join whose hot side the adaptive join splits. The texts move once, by id.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).head()[0] or []
    batch = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(sum([(F.col("doc_id") > c).cast("int") for c in cuts], F.lit(0)))
    path = f"{shared_folder(spark)}/line-keys-{uuid.uuid4().hex}"
    line_keys(docs, least_length).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = "doc_id long, text_hash long, pos int, h1 long, h2 long, batch int"
    lines = spark.read.schema(schema).parquet(path)

    runs, repeated = Runs(spark, fanout), None
    try:
        for b in range(len(cuts) + 1):
            own = (
                lines.where(F.col("batch") == b)
                .groupBy(*KEY)
                .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
                .select(*KEY, "first", F.expr("not (first <=> last) or (nulls > 0 and first is not null)").alias("several"))
            )
            seen = staged(runs.lookup(own).select(*KEY, "first", "several", "run_owner", "known"), "line-batch")
            if b < len(cuts):
                runs.add(seen.where("not known").select(*KEY, F.col("first").alias("owner")))
            decided = seen.where("known or several").select(*KEY, F.expr("if(known, run_owner, first)").alias("owner"), F.lit(b).alias("batch"))
            repeated = decided if repeated is None else repeated.unionByName(decided)
    finally:
        runs.close()

    dropped = (
        lines.join(repeated, [*KEY, "batch"])
        .where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.collect_set("pos").alias("__dropped"))
    )
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    kept = F.expr(
        "array_join(transform(array_except(sequence(0, size(__lines) - 1), __dropped), i -> element_at(__lines, i + 1)), '\\n')"
    )
    return joined.withColumn("__lines", _lines()).select(
        *[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")],
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long").alias("n_dropped"),
        F.when(F.col("__dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )


@query(
    f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) pos from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') key from l),
o as (select key, min(doc_id) owner from k where length(key) >= {LEAST_LENGTH} group by key having count(distinct doc_id) > 1)
select doc_id, count(*)::bigint n_lines, count(*) filter (where owner <> doc_id)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where owner is null or owner = doc_id), '')) kept_sha256
from k left join o using (key) group by doc_id
"""
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )
