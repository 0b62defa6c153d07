"""Near-duplicate vectors by small-world graphs per shard."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import connected_components
from .registry import query, table
from .stages import staged
from .vectors import cosine, matrix, pack_blocks, part_of, unit, unpacked, usable

THRESHOLD = 0.93
SHARD, BLOCK = 16384, 4096
NEIGHBOURS, BUILD_BEAM, BEAM = 12, 48, 48
AUDITED, RECALL = 256, 0.995
BATCH = 256
SLACK = 1e-5


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors.

    Levels are drawn geometrically from a seed. Nodes are inserted from the highest level
    down, in batches that search the graph built so far and one another; neighbours are
    chosen by the diversity rule (one that is nearer to a chosen neighbour than to the
    node comes last). Beams of many queries advance together.
    """

    def __init__(self, vectors: np.ndarray, degree: int = NEIGHBOURS, beam: int = BUILD_BEAM, seed: int = 7):
        self.vectors, n = vectors, len(vectors)
        draw = np.random.RandomState(seed)
        level = np.minimum((-np.log(1.0 - draw.random_sample(n)) / np.log(degree)).astype(int), 12)
        order = np.lexsort((draw.permutation(n), -level))
        self.entry = int(order[0]) if n else -1
        self.links = [np.full((n, 2 * degree if l == 0 else degree), -1, dtype=np.int32) for l in range(int(level.max(initial=0)) + 1)]
        at = 1
        while at < n:
            batch = order[at : at + max(1, min(BATCH, at))]
            self._insert(batch, level[batch], degree, beam)
            at += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray, degree: int, beam: int) -> None:
        queries = self.vectors[batch]
        peers = queries @ queries.T
        np.fill_diagonal(peers, -2.0)
        entry = np.full(len(batch), self.entry)
        for layer in range(len(self.links) - 1, -1, -1):
            here = level >= layer
            found, sims = self.search_layer(layer, queries, entry, beam if here.any() else 1)
            entry = found[np.arange(len(batch)), sims.argmax(axis=1)]
            own = np.flatnonzero(here)
            if not len(own):
                continue
            near = np.argsort(-peers[np.ix_(own, own)], axis=1, kind="stable")[:, :beam]
            near_sims = np.take_along_axis(peers[np.ix_(own, own)], near, axis=1)
            ids = np.concatenate([found[own], np.where(near_sims > -2.0, batch[own][near], -1)], axis=1)
            values = np.concatenate([sims[own], near_sims], axis=1)
            chosen = self._diverse(ids, values, degree, beam)
            self.links[layer][batch[own], :degree] = chosen
            self._link_back(layer, batch[own], chosen)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, count: int, pool: int) -> np.ndarray:
        """Of each row's candidates (-1 for none), up to ``count`` by the diversity rule, then by nearness."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :pool]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), count), -1, dtype=np.int32)
        for low in range(0, len(ids), 512):
            i, s = ids[low : low + 512], sims[low : low + 512]
            v = self.vectors[i]
            between = np.matmul(v, v.transpose(0, 2, 1))
            kept = np.zeros(i.shape, dtype=bool)
            for c in range(i.shape[1]):
                blocked = (np.where(kept, between[:, c, :], -2.0) > s[:, c, None]).any(axis=1)
                kept[:, c] = (i[:, c] >= 0) & ~blocked & (kept.sum(axis=1) < count)
            rank = np.argsort(np.where(kept, 0, 1) * i.shape[1] + np.arange(i.shape[1]) + np.where(i < 0, 10**6, 0), axis=1, kind="stable")
            best = np.take_along_axis(i, rank, 1)[:, :count]
            out[low : low + 512, : best.shape[1]] = best
        return out

    def _link_back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        links = self.links[layer]
        target, source = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        own, first, counts = np.unique(target, return_index=True, return_counts=True)
        new = np.full((len(own), counts.max()), -1, dtype=np.int32)
        new[np.repeat(np.arange(len(own)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        new[(new[:, :, None] == links[own][:, None, :]).any(axis=2)] = -1
        ids = np.concatenate([links[own], new], axis=1)
        width = links.shape[1]
        full = (ids >= 0).sum(axis=1) > width
        packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)[:, :width]
        links[own[~full]] = packed[~full]
        for rows in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // 2048)):
            if len(rows):
                i = ids[rows]
                sims = np.where(i >= 0, np.einsum("rcd,rd->rc", self.vectors[i], self.vectors[own[rows]]), -2.0)
                links[own[rows]] = self._diverse(i, sims, width, i.shape[1])

    def search_layer(self, layer: int, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes met for each query (-1 and -2.0 where there are fewer)."""
        n, count = len(self.vectors), len(queries)
        links, step = self.links[layer], max(1 if beam == 1 else 4, beam // 16)
        seen = np.zeros(count * n, dtype=bool)
        ids = np.full((count, beam), -1, dtype=np.int64)
        sims = np.full((count, beam), -2.0, dtype=np.float32)
        open_ = np.zeros((count, beam), dtype=bool)
        ids[:, 0], open_[:, 0] = entry, True
        sims[:, 0] = np.einsum("qd,qd->q", self.vectors[entry], queries)
        seen[np.arange(count) * n + entry] = True
        active = np.arange(count)
        while len(active):
            ready = np.where(open_[active], sims[active], -3.0)
            top = np.argpartition(-ready, min(step, beam) - 1, axis=1)[:, : min(step, beam)]
            usable_ = np.take_along_axis(open_[active], top, 1)
            nodes = np.where(usable_, np.take_along_axis(ids[active], top, 1), -1)
            open_[active[:, None], top] = False
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
            row, column = np.nonzero(near >= 0)
            flat = active[row] * n + near[row, column]
            flat = np.unique(flat[~seen[flat]])
            seen[flat] = True
            query_, node = flat // n, flat % n
            value = np.einsum("pd,pd->p", self.vectors[node], queries[query_])
            place = np.searchsorted(active, query_)
            counts = np.bincount(place, minlength=len(active))
            wide = max(int(counts.max(initial=0)), 1)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            new_ids = np.full((len(active), wide), -1, dtype=np.int64)
            new_sims = np.full((len(active), wide), -2.0, dtype=np.float32)
            new_ids[place, at], new_sims[place, at] = node, value
            all_ids = np.concatenate([ids[active], new_ids], axis=1)
            all_sims = np.concatenate([sims[active], new_sims], axis=1)
            all_open = np.concatenate([open_[active], new_ids >= 0], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1)
            active = active[open_[active].any(axis=1)]
        return ids, sims

    def near(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found at ``threshold`` or more; full beams of such nodes are widened."""
        beam = min(beam, len(self.vectors))
        entry = np.full(len(queries), self.entry)
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self.search_layer(layer, queries, entry, 1)[0][:, 0]
        out, left = [], np.arange(len(queries))
        while len(left):
            wider = []
            rows = max(16, min(512, (1 << 19) // beam))
            for low in range(0, len(left), rows):
                own = left[low : low + rows]
                ids, sims = self.search_layer(0, queries[own], entry[own], beam)
                cut = (sims.min(axis=1) >= threshold) & (beam < len(self.vectors))
                wider.append(own[cut])
                row, column = np.nonzero((sims >= threshold) & ~cut[:, None])
                out.append((own[row], ids[row, column]))
            left = np.concatenate(wider)
            beam = min(2 * beam, len(self.vectors))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def dump(self) -> bytes:
        data = io.BytesIO()
        np.savez(data, entry=self.entry, **{f"l{i}": x for i, x in enumerate(self.links)})
        return data.getvalue()

    @classmethod
    def load(cls, vectors: np.ndarray, data: bytes) -> SmallWorld:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            own.vectors, own.entry = vectors, int(parts["entry"])
            own.links = [parts[f"l{i}"] for i in range(len(parts.files) - 1)]
        return own


def audited_pairs(graph: SmallWorld, queries: np.ndarray, threshold: float, beam: int, recall: float = RECALL, audited: int = AUDITED):
    """Pairs of ``near``, with beams doubled until a brute-force audit of some queries passes."""
    sample = np.random.RandomState(3).permutation(len(queries))[:audited]
    truth = queries[sample] @ graph.vectors.T >= threshold
    while True:
        q, x = graph.near(queries, threshold, beam)
        found = np.zeros(len(queries), dtype=np.int64)
        np.add.at(found, q, 1)
        if beam >= len(graph.vectors) or np.minimum(found[sample], truth.sum(axis=1)).sum() >= recall * truth.sum():
            return q, x
        beam *= 2


def local_roots(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Smallest index reachable from each index over the edges (a, b)."""
    label = np.arange(count)
    while True:
        least, old = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == old).all():
            return label


def build_shard(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node")
    vectors = matrix(group["embedding"])
    head = {c: [group[c].iloc[0]] for c in ("label", "dim", "shard")}
    return pd.DataFrame(
        {
            **head,
            "shard_ids": [group["node"].to_numpy(np.int64).tobytes()],
            "shard_vectors": [vectors.tobytes()],
            "copies": [group["copies"].to_numpy(np.int64).tobytes()],
            "graph": [SmallWorld(unit(vectors)).dump()],
        }
    )


def searcher(threshold: float, beam: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in group.itertuples(index=False):
            ids, vectors = unpacked(row.shard_ids, row.shard_vectors)
            copies = np.frombuffer(row.copies, dtype=np.int64)
            own, queries = unpacked(row.block_ids, row.block_vectors)
            q, x = audited_pairs(SmallWorld.load(unit(vectors), row.graph), unit(queries), threshold - SLACK, beam)
            exact = np.zeros(len(q), dtype=bool)
            for low in range(0, len(q), 65536):
                s = slice(low, low + 65536)
                exact[s] = cosine(queries[q[s]], vectors[x[s]]) >= threshold
            exact &= own[q] != ids[x]
            q, x = q[exact], x[exact]
            nodes = np.unique(np.concatenate([own, ids[x]]))
            a, b = np.searchsorted(nodes, own[q]), np.searchsorted(nodes, ids[x])
            links = np.bincount(a, weights=copies[x], minlength=len(nodes)).astype(np.int64)
            out.append(pd.DataFrame({"node": nodes, "links": links, "root": nodes[local_roots(a, b, len(nodes))]}))
        out = pd.concat(out)
        return out[out["node"].ne(out["root"]) | out["links"].gt(0)]

    return run


def near_duplicate_vectors(
    embeddings: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, block: int = BLOCK, beam: int = BEAM
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; equal labels only.

    Equal vectors of a label are one class with a number of copies. Each label (and
    length of vector) is dealt to shards of about ``shard`` classes by hash, each with a
    graph of its own, so a hot label has more shards, not larger ones. Blocks of classes
    query every shard of their label; a beam that is full of links is widened, and all
    beams of a block are widened until an audit against brute force finds RECALL of the
    links. Links are confirmed in double precision. A task reports the number of links and
    one edge to the least node it reached per class, not the pairs; the edges of all tasks
    are joined to components.

    A vector that is null, empty, zero or holds a null or non-finite component, and one
    without a label, has no links and is its own component. Vectors of different length
    are not compared. Null ids take part but name no component unless all its ids are
    null. Repeated rows are copies linked with each other. An empty table gives no rows;
    other columns are not read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn(
        "node", F.when(usable() & F.col("label").isNotNull(), F.xxhash64("label", F.size("embedding"), "embedding"))
    )
    classes = staged(
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("embedding")),
        "vector-classes",
    )
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = sizes.selectExpr("label", "dim", f"cast(ceil(n / {shard}) as int) shards", f"cast(ceil(n / {block}) as int) blocks")
    dealt = classes.join(sizes, ["label", "dim"])

    label = classes.schema["label"].dataType.simpleString()
    schema = f"label {label}, dim int, shard int, shard_ids binary, shard_vectors binary, copies binary, graph binary"
    shards = dealt.withColumn("shard", part_of("node", 2, "shards")).select("label", "dim", "shard", "node", "copies", "embedding")
    shards = staged(shards.groupBy("label", "dim", "shard").applyInPandas(build_shard, schema), "vector-graphs")
    blocks = pack_blocks(dealt.withColumn("block", part_of("node", 3, "blocks")), ["label", "dim", "shards", "block"], "node", "block")
    blocks = blocks.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
    pairs = blocks.join(shards, ["label", "dim", "shard"]).groupBy("label", "dim", "shard", "block")
    found = staged(pairs.applyInPandas(searcher(threshold, beam), "node long, links long, root long"), "vector-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    merged = classes.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    merged = merged.join(merged.groupBy("root").agg(F.min("least").alias("component")), "root").join(links, "node", "left")
    merged = merged.select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", "node").join(merged, "node", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


@query(
    """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id a, vec_id b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) component_id from r group by a),
n as (select a, count(*) n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint n_links, component_id, vec_id = component_id kept
from embeddings join c on c.a = vec_id left join n on n.a = vec_id
"""
)
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
