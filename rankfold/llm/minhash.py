"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import connected_components
from .registry import query, table
from .stages import staged
from .words import grams, mix, slices, split_words

WORDS = 5
PERCENT = 85
UNIVERSE = 1 << 20
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
GROUP_DOCUMENTS = 500
WHOLE_CLUSTER = 2000
BLOCK = 1000


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    w = split_words(texts, lower=True)
    g = grams(w.hash, words)
    sets = []
    for start, end in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if end - start >= words:
            sets.append(np.unique(g[start : end - words + 1]))
        elif end > start:
            sets.append(grams(w.hash[start:end], end - start))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


class Circulant:
    """All signature coordinates of a set from two permutations of the universe.

    The first permutation places the elements. Coordinate k is the least value that the
    second one, shifted by k places around its circle, gives to a placed element, so the
    values of one element are a run of the second permutation.
    """

    def __init__(self, universe: int = UNIVERSE, coordinates: int = COORDINATES, seed: int = 5):
        draw = np.random.RandomState(seed)
        self.universe = universe
        self.first = draw.permutation(universe).astype(np.uint32)
        second = draw.permutation(universe).astype(np.uint32)
        circle = np.concatenate([second, second[:coordinates]])
        self.runs = np.lib.stride_tricks.sliding_window_view(circle, coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.first[(mix(shingles, 3) % np.uint64(self.universe)).astype(np.int64)]
        least = self.runs[places[:2048]].min(axis=0)
        for i in range(2048, len(places), 2048):
            np.minimum(least, self.runs[places[i : i + 2048]].min(axis=0), out=least)
        return least


def signer(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(coordinates=bands * rows)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, keys, signatures = [], [], []
                for s in shingle_sets(part.column("text"), words):
                    sizes.append(len(s))
                    if len(s):
                        keys.append(int((mix(s, 7).sum() ^ (mix(s, 8) * np.uint64(31)).sum()).astype(np.int64)))
                        signatures.append(circulant.signature(s))
                    else:
                        keys.append(None)
                        signatures.append(np.zeros(bands * rows, dtype=np.uint32))
                own = np.array(signatures, dtype=np.uint64).reshape(-1, bands, rows)
                folded = np.zeros(own.shape[:2], dtype=np.uint64)
                for r in range(rows):
                    folded = mix(folded * np.uint64(0x100000001B3) + own[:, :, r], r)
                values = pa.array(folded.astype(np.int64).ravel())
                offsets = pa.array(np.arange(0, folded.size + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands"],
                )

    return run


def linked(sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> list[int]:
    """For each set the first set of its component under ``100 * common >= percent * union``.

    An index from shingle to sets gives the common shingles of one set with all others at
    once. With sets of two blocks, only pairs across them count, as others are met elsewhere.
    """
    n = len(sets)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings = owner[np.argsort(ids, kind="stable")]
    starts = np.cumsum(counts) - counts
    edges = np.concatenate([[0], np.cumsum(sizes)])
    two = blocks.min() != blocks.max()
    for d in range(n):
        own = ids[edges[d] : edges[d + 1]]
        own = own[counts[own] > 1]
        lengths = counts[own]
        at = np.repeat(starts[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(postings[at], minlength=n)
        common[: d + 1] = 0
        if two:
            common[blocks == blocks[d]] = 0
        for other in np.flatnonzero(100 * common >= percent * (sizes[d] + sizes - common)).tolist():
            a, b = find(d), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def verifier(words: int, percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["cluster", "node"]).sort_values(["cluster", "node"])
        sets = shingle_sets(pa.array(rows["text"], pa.large_string()), words)
        cluster, node, block = (rows[c].to_numpy() for c in ("cluster", "node", "block"))
        edges = np.flatnonzero(np.diff(cluster)) + 1
        roots = np.zeros(len(rows), dtype=np.int64)
        for start, end in zip([0, *edges], [*edges, len(rows)]):
            roots[start:end] = node[start + np.array(linked(sets[start:end], block[start:end], percent), dtype=np.int64)]
        return pd.DataFrame({"node": node, "root": roots, "large": rows["large"].to_numpy()})

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every document.

    A document is its set of shingles of whole lower-cased texts. Documents of equal sets
    are one class from the start, so copies are neither compared nor expanded. Classes
    that share a band become candidate clusters; each cluster's texts meet in a task and
    every pair in it is compared on full sets. A cluster above WHOLE_CLUSTER classes is
    dealt to block pairs, each a task of bounded size, whose links are joined afterwards;
    nothing is capped. Band values that a third of the rows share are one hub with an edge
    per class.

    Null and empty texts have 0 shingles and are linked with nothing; so are texts of
    white space. A null doc_id is smaller than none: it is never a component's id unless
    the whole component has null ids. Repeated rows are all returned, and kept like each
    other. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = staged(
        docs.mapInArrow(signer(words, bands, rows), "doc_id long, text_hash long, n_shingles long, node long, bands array<long>"), "minhash"
    )
    classes = staged(
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("pick"), F.first("bands").alias("bands"))
        .select("node", F.col("pick.doc_id").alias("doc_id"), F.col("pick.text_hash").alias("text_hash"), "bands"),
        "minhash-classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("band", "value"))
    hubs = banded.groupBy("band", "value").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    hubs = staged(hubs, "minhash-hubs")  # a written side lets the adaptive join split a hot band value
    edges = banded.join(hubs, ["band", "value"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = staged(connected_components(edges).withColumnRenamed("root", "cluster"), "minhash-clusters")

    verified = _verified(docs, classes, clusters, words, percent)
    large = verified.where("large and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    small = verified.where("not large and node <> root").select("node", "root")
    roots = small if large.isEmpty() else small.unionByName(connected_components(large))

    merged = classes.select("node", F.col("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = merged.groupBy("root").agg(F.min("least").alias("component"))
    merged = merged.join(least, "root").select("node", "component")
    return signed.join(merged, "node", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
    )


def _verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root, large) links of the classes of each cluster, from their whole texts."""
    groups = max(1, -(-clusters.count() // GROUP_DOCUMENTS))
    sizes = staged(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "minhash-sizes")
    members = (
        clusters.join(sizes, "cluster")
        .withColumn("blocks", F.when(F.col("n") > WHOLE_CLUSTER, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int"))
        .withColumn("large", F.col("blocks") > 1)
        .withColumn("block", F.expr("cast(pmod(xxhash64(node, 1), blocks) as int)"))
        .join(classes.select("node", F.col("doc_id").alias("pick_id"), F.col("text_hash").alias("pick_hash")), "node")
    )
    texts = members.join(docs, F.col("pick_id").eqNullSafe(F.col("doc_id")) & (F.col("pick_hash") == F.col("text_hash")))
    dealt = (
        texts.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .withColumn("task", F.when(F.col("large"), F.col("cluster")).otherwise(F.expr(f"pmod(xxhash64(cluster), {groups})")))
    )
    found = dealt.select("task", "large", "i", "j", "cluster", "node", "block", "text").groupBy("task", "large", "i", "j")
    return staged(found.applyInPandas(verifier(words, percent), "node long, root long, large boolean"), "minhash-links")


@query(
    r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(ws[p : p + 4], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) p from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
h as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
l as (select a, b from h union all select b, a from h),
r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) component_id from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, d.doc_id = component_id kept
from documents d join c on c.a = d.doc_id left join n on n.doc_id = d.doc_id
"""
)
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
