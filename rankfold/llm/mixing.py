"""Mixing sources to target weights by repetition rates and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .stages import staged

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # numerator and denominator of the mix's size over the corpus's size
MOST = 2
SEEDS = 8
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """Number of words of each text; 0 for a null one."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def draws() -> list:
    """SEEDS uniform 32-bit numbers of a document, from one SHA-256 of its id."""
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(SEEDS)]


def source_targets(totals: DataFrame) -> DataFrame:
    """Target of each source: weights 5, 2, 1 repeating by code point, nulls last.

    ``min(MOST * size, level * weight)`` is what is left of resharing the excess until no
    source is above its limit. Sources in order of limit / weight reach it first, so
    running sums give the level; all sums are whole numbers, with one division at the
    end. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("position"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level_top = SHARE[0] * F.sum("source_size").over(Window.partitionBy()) - SHARE[1] * MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level_bottom = SHARE[1] * F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    weighted = totals.withColumn("position", F.row_number().over(by_name)).withColumn(
        "weight", F.expr(f"element_at(array({', '.join(map(str, WEIGHTS))}), cast((position - 1) % {len(WEIGHTS)} + 1 as int))")
    )
    levels = weighted.withColumn("top", level_top).withColumn("bottom", level_bottom)
    levels = levels.withColumn("full", F.col("top") * F.col("weight") >= MOST * F.col("source_size") * F.col("bottom"))
    first = Window.orderBy(F.col("full").asc(), F.col("source_size") / F.col("weight"), F.col("position"))
    top, bottom = F.first("top").over(first), F.first("bottom").over(first)
    return levels.select(
        "source",
        "source_size",
        F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(top * F.col("weight") / bottom).alias("target"),
    )


def _copies(draw) -> F.Column:
    """floor(rate) copies, and one more if the draw is below the fraction."""
    return F.floor("rate") + (draw < (F.col("rate") - F.floor("rate")) * 4294967296.0).cast("long")


def source_rates(small: DataFrame) -> DataFrame:
    """(mixed, source_size, target, rate, seed) of each source, from (doc_id, source, size) rows.

    A rate is target / size. Of SEEDS hashes, a source uses the one that brings its words
    nearest to its target (the first of equals), found in the pass that sums them all.
    """
    totals = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )
    targets = staged(targets.withColumnRenamed("source", "mixed"), "mix-targets")
    joined = small.join(targets, F.col("source").eqNullSafe(F.col("mixed")))
    off = lambda draw: F.abs(F.sum(_copies(draw) * F.col("size")) - F.first("target"))
    seeds = joined.groupBy("mixed").agg(*[off(draw).alias(f"o{i}") for i, draw in enumerate(draws())])
    offs = F.array(*[F.col(f"o{i}") for i in range(SEEDS)])
    seeds = seeds.select(F.col("mixed").alias("seeded"), (F.array_position(offs, F.array_min(offs)) - 1).cast("int").alias("seed"))
    return staged(targets.join(seeds, F.col("mixed").eqNullSafe(F.col("seeded"))).drop("seeded"), "mix-rates")


def _small(docs: DataFrame) -> DataFrame:
    return staged(sizes(docs).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "size"), "mix-sizes")


def _chosen() -> F.Column:
    return F.element_at(F.array(*draws()), F.col("seed") + 1)


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, its source's size and target, copies and taken.

    Null sources are one source, the last. Null and empty texts have size 0 and take
    nothing of a target. Null ids share one draw, as do repeated ids. An empty table gives
    no rows. Results depend on ids and sizes alone, so reruns agree.

    Documents are reduced to id, source and size before anything moves; the sums of a hot
    source are combined in the tasks that scan it. The table of rates has one row per
    source, and its join is a broadcast only if its measured size allows.
    """
    small = _small(docs)
    joined = small.join(source_rates(small), F.col("source").eqNullSafe(F.col("mixed")))
    copies = joined.withColumn("copies", _copies(_chosen()))
    return copies.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of the mix: every document as often as its copies in ``mix_plan``.

    Only the rates move to the documents. Columns and their order are those of ``docs``;
    the rules for nulls and repeated rows are those of ``mix_plan``.
    """
    rates = source_rates(_small(docs)).select(F.col("mixed").alias("__source"), F.col("rate").alias("__rate"), F.col("seed").alias("__seed"))
    own = docs.join(rates, F.col("source").cast("string").eqNullSafe(F.col("__source")))
    draw = F.element_at(F.array(*draws()), F.col("__seed") + 1)
    copies = F.floor("__rate") + (draw < (F.col("__rate") - F.floor("__rate")) * 4294967296.0).cast("long")
    return own.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns)


@query(
    """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, row_number() over (order by source asc nulls last) p from s),
v as (select *, case (p - 1) % 3 when 0 then 5 when 1 then 2 else 1 end w from w),
l as (select *, 3 * sum(source_size) over () - 4 * coalesce(sum(source_size) over
        (order by source_size / w, p rows between unbounded preceding and 1 preceding), 0) top,
      2 * sum(w) over (order by source_size / w, p rows between current row and unbounded following) bottom from v),
f as (select *, top * w >= 2 * source_size * bottom as is_full from l),
r as (select *, first_value(top) over o top1, first_value(bottom) over o bottom1 from f
      window o as (order by is_full, source_size / w, p)),
t as (select source, source_size, case when is_full then (2 * source_size)::double
      else (top1 * w)::double / bottom1::double end target from r),
g as (select *, case when source_size > 0 then target / source_size else 0.0 end rate from t),
j as (select d.doc_id, d.source, d.size, g.source_size, g.target, g.rate,
      sha256(coalesce(d.doc_id::varchar, 'null')) h from d join g on d.source is not distinct from g.source),
u as (select j.*, i, floor(rate)::bigint + (('0x' || substr(h, 1 + 8 * i, 8))::bigint
      < (rate - floor(rate)) * 4294967296.0)::bigint copies from j, range(8) x(i)),
o as (select source, i, abs(sum(copies * size) - first(target)) off from u group by source, i),
k as (select source, i from (select *, row_number() over (partition by source order by off, i) n from o) where n = 1)
select u.doc_id, u.size, u.source_size, u.target, u.copies, (u.copies * u.size)::bigint taken
from u join k on u.source is not distinct from k.source and u.i = k.i
"""
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
