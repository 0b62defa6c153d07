"""Merkle manifest of a corpus, with proofs found by nested-interval labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import ranked
from .registry import query, table
from .stages import staged

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def run_of(fanout: int, level: int) -> Column:
    """The bucket of a label on ``level``: nodes of that level cover at most fanout ** level ranks each."""
    return F.expr(f"lo div {fanout**level}")


def grown(nodes: DataFrame, fanout: int, level: int) -> DataFrame:
    """The nodes of ``level`` above those given: a run of children becomes their hash, its interval covers theirs.

    ``parts`` holds the children in order with their intervals.
    """
    child = F.struct(*[c for c in nodes.columns if c not in ("tree", "total")])
    runs = nodes.groupBy("tree", "total", run_of(fanout, level).alias("bucket")).agg(F.array_sort(F.collect_list(child)).alias("parts"))
    return runs.select(
        "tree",
        "total",
        "bucket",
        F.expr("parts[0].lo").alias("lo"),
        F.expr("parts[size(parts) - 1].hi").alias("hi"),
        F.expr("sha2(array_join(transform(parts, p -> p.node), ''), 256)").alias("node"),
        "parts",
    )


def _step(parts: str, lo: str, hi: str) -> str:
    """The siblings of interval [lo, hi): what the parent, made of ``parts``, holds left and right of it."""
    left, right = [
        f"array_join(transform(filter({parts}, s -> {outside}), s -> s.node), '')" for outside in (f"s.hi <= {lo}", f"s.lo >= {hi}")
    ]
    return f"named_struct('left', {left}, 'right', {right})"


def with_ancestors(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The columns of ``leaves`` and, per leaf, its tree's top and the siblings on the way there.

    ``leaves`` has tree, lo, hi, total and node, a hash, besides others. ``path`` has one
    entry per level, from the leaf up, with the joined hashes of the siblings left and
    right of it. ``top`` of a tree of one leaf is the leaf, its path is empty.

    Labels go up level by level, each a table of at most a ``fanout``-th of the rows below.
    Then paths go down: a node meets the parent of its bucket that contains its interval,
    and what the parent's interval holds besides its own are its siblings. A parent has at
    most ``fanout`` children, so no join key is hot, and a leaf receives its parent's path
    from one row per run.
    """
    most = leaves.agg(F.max("total")).head()[0] or 0
    levels, covered = [], 1
    while covered < most:
        below = leaves if not levels else levels[-1].select("tree", "lo", "hi", "total", "node")
        covered *= fanout
        levels.append(staged(grown(below.where("hi - lo < total"), fanout, len(levels) + 1), "merkle-level"))
    own = leaves.columns
    empty = "cast(array() as array<struct<left: string, right: string>>)"
    lone = leaves.where("total = 1").select(*own, F.col("node").alias("top"), F.expr(empty).alias("path"))
    if not levels:
        return lone
    above = None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1]
        here = nodes.where("lo = 0 and hi = total").select(*nodes.columns, F.col("node").alias("top"), F.expr(empty).alias("path"))
        if above is not None:
            child = nodes.where("hi - lo < total").withColumn("over", run_of(fanout, level + 1)).alias("c")
            parent = above.select("tree", "bucket", "lo", "hi", "parts", "path", "top").alias("p")
            contained = F.expr("c.tree <=> p.tree and c.over = p.bucket and p.lo <= c.lo and c.hi <= p.hi")
            path = F.expr(f"concat(array({_step('p.parts', 'c.lo', 'c.hi')}), p.path)")
            attached = child.join(parent, contained)
            here = here.unionByName(attached.select(*[f"c.{c}" for c in nodes.columns], "p.top", path.alias("path")))
        above = here if level == 1 else staged(here, "merkle-paths")
    each = above.select("tree", "total", "top", "path", "parts", F.explode("parts").alias("leaf"))
    path = F.expr(f"concat(array({_step('parts', 'leaf.lo', 'leaf.hi')}), path)").alias("path")
    found = each.select(*[F.col(c) if c in ("tree", "total") else F.col(f"leaf.{c}").alias(c) for c in own], "top", path)
    return found.unionByName(lone)


def folded(leaf: str, path: str) -> Column:
    """The top that ``leaf`` and the siblings of ``path`` give."""
    return F.expr(f"aggregate({path}, {leaf}, (h, s) -> sha2(concat(s.left, h, s.right), 256))")


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of the document's FIELDS; per lang, leaves ascend by doc_id, and
    runs of ``fanout`` become their hash until one node, the subroot, is left. Subroots by
    lang give the root in the same way. ``proof_sha256`` hashes the siblings from the leaf
    to the root, left to right; ``folded_root`` is the root that they give with the leaf
    of the text at hand, in which the documents of ``tampered`` have A-Z lower-cased.

    Nulls are values of their own: a null lang is the first tree, a null doc_id the first
    leaf of its tree. Rows that repeat a doc_id are leaves of their own, ordered by their
    hash, equal rows next to each other. An empty table gives no rows. Texts of any length
    are hashed where they are read and never move; other columns are not read.
    """
    untouched = leaf_hash(*[F.col(c) for c in FIELDS])
    lowered = leaf_hash(*[F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS])
    shown = F.when(F.coalesce(tampered, F.lit(False)), lowered).otherwise(untouched) if tampered is not None else untouched
    hashed = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("tree"), untouched.alias("node"), shown.alias("shown"))
    columns = ["lo", "hi", "node", "tree", "total", "doc_id", "shown"]
    leaves = with_ancestors(ranked(hashed, "tree", ["doc_id", "node", "shown"]).select(*columns), fanout)

    subroots = leaves.where("lo = 0").select(F.col("tree").alias("lang"), F.col("top").alias("node"), F.lit("").alias("tree"))
    upper = with_ancestors(ranked(subroots, "tree", ["lang"]).select("lo", "hi", "node", "tree", "total", "lang"), fanout)
    upper = staged(upper.select("lang", F.col("top").alias("root"), F.col("path").alias("rest")), "merkle-subroots")
    joined = leaves.join(upper, F.col("tree").eqNullSafe(F.col("lang"))).withColumn("whole", F.concat("path", "rest"))
    out = joined.select(
        "doc_id",
        F.col("tree").alias("lang"),
        F.col("node").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        F.sha2(F.array_join(F.expr("transform(whole, s -> concat(s.left, s.right))"), ""), 256).alias("proof_sha256"),
        folded("shown", "whole").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(source: str, tree: str, count: int, name: str) -> str:
    """SQL of the levels of the trees of ``source`` (tree, i, h): node hashes, and the siblings of each node."""
    parts = [f"{name}0 as (select {tree}, i, h, count(*) over (partition by {tree}) n from {source})"]
    for k in range(count):
        run = f"partition by {tree}, i // {FANOUT} order by i rows between"
        parts.append(
            f"{name}s{k} as (select {tree}, i, n, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') l,"
            f" coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') r from {name}{k})"
        )
        parts.append(
            f"{name}{k + 1} as (select {tree}, i // {FANOUT} i, case when max(n) > 1 then sha256(string_agg(h, '' order by i)) else max(h) end h,"
            f" (max(n) + {FANOUT - 1}) // {FANOUT} n from {name}{k} group by {tree}, i // {FANOUT})"
        )
    return ",\n".join(parts)


def _climb(rows: str, tree: str, place: str, count: int, name: str, out: str, at: str, proof: str) -> str:
    """SQL that carries ``at`` (a hash) and ``proof`` (joined siblings) of each row of ``rows`` to the top."""
    parts, now = [], rows
    for k in range(count):
        parts.append(
            f"{out}{k + 1} as (select c.* replace (case when s.n > 1 then sha256(s.l || c.{at} || s.r) else c.{at} end as {at},"
            f" case when s.n > 1 then c.{proof} || s.l || s.r else c.{proof} end as {proof})"
            f" from {now} c join {name}s{k} s on c.{tree} is not distinct from s.{tree} and c.{place} // {FANOUT**k} = s.i)"
        )
        now = f"{out}{k + 1}"
    return ",\n".join(parts)


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar))::varchar || ':' || {column}::varchar, '-')"


def _oracle(depth: int = 7, upper: int = 3) -> str:
    """DuckDB has no recursion with groups, so levels are written out: 8^depth documents a lang, 8^upper langs."""
    leaf = lambda text: f"sha256({' || '.join(_field(text if c == 'text' else c) for c in FIELDS)})"
    bits = "list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, b: {bits}), 4294967295)"
    return f"""
with d as (
  select doc_id, lang, {leaf("text")} h,
         case when ({crc}) % 3 = 0 then {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} else {leaf("text")} end folded, '' proof from documents),
q as (select *, row_number() over (partition by lang order by doc_id nulls first, h, folded) - 1 i from d),
{_levels("q", "lang", depth, "t")},
sub as (select lang, h, 0 one, row_number() over (order by lang nulls first) - 1 i from t{depth}),
{_levels("sub", "one", upper, "u")},
{_climb("q", "lang", "i", depth, "t", "c", "folded", "proof")},
w as (select c.*, sub.h subroot, 0 one, sub.i place from c{depth} c join sub on c.lang is not distinct from sub.lang),
{_climb("w", "one", "place", upper, "u", "f", "folded", "proof")}
select doc_id, lang, f.h leaf, subroot, top.h root, sha256(proof) proof_sha256, folded folded_root, folded = top.h verified
from f{upper} f, u{upper} top
"""


@query(_oracle())
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    divided = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered=divided)
