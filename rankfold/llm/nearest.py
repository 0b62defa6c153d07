"""Approximate nearest neighbours by vantage-point trees per shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .stages import staged
from .vectors import cosine, matrix, pack_blocks, part_of, unit, unpacked, usable

NEAREST = 5
EVERY = 50
FACTOR = 1.0
SHARD, BLOCK, LEAF = 16384, 1024, 64
SLACK = 1e-5
CHUNK = 1 << 17


class VantageTree:
    """A vantage-point tree over unit vectors under the Euclidean distance.

    ``order`` lists the vectors so that each node is a range of it. A node's first vector
    is its vantage point; the others are halved by their distance from it. Arrays hold,
    per node, the range, the distance that halves it and the two children (-1 in a leaf).
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, seed: int = 9):
        draw = np.random.RandomState(seed)
        self.order = np.arange(len(vectors))
        nodes: list[list] = []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            low, high, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][3 + side] = me
            nodes.append([low, high, 0.0, -1, -1])
            if high - low <= leaf:
                continue
            pick = low + draw.randint(high - low)
            self.order[[low, pick]] = self.order[[pick, low]]
            rest = self.order[low + 1 : high]
            away = distance(vectors[self.order[low]][None], vectors[rest])[0]
            sort = np.argsort(away, kind="stable")
            middle = len(rest) // 2
            if away[sort[0]] == away[sort[-1]]:
                continue
            self.order[low + 1 : high] = rest[sort]
            nodes[me][2] = float(away[sort[middle]])
            todo += [(low + 1, low + 1 + middle, me, 0), (low + 1 + middle, high, me, 1)]
        self.ranges = np.array([n[:2] for n in nodes], dtype=np.int64)
        self.radius = np.array([n[2] for n in nodes])
        self.children = np.array([n[3:] for n in nodes], dtype=np.int64)

    def parts(self) -> dict[str, bytes]:
        return {"tree_order": self.order.tobytes(), "ranges": self.ranges.tobytes(), "radius": self.radius.tobytes(), "children": self.children.tobytes()}

    @classmethod
    def load(cls, tree_order: bytes, ranges: bytes, radius: bytes, children: bytes) -> VantageTree:
        own = cls.__new__(cls)
        own.order, own.radius = np.frombuffer(tree_order, np.int64), np.frombuffer(radius, np.float64)
        own.ranges, own.children = np.frombuffer(ranges, np.int64).reshape(-1, 2), np.frombuffer(children, np.int64).reshape(-1, 2)
        return own


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between unit vectors. Of double-precision ones they are within SLACK also near
    zero, where the root turns an error of the product into a far larger one."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Search:
    """Nearest candidates of a block of queries in one tree; queries move through it together."""

    def __init__(self, tree: VantageTree, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, count: int, factor: float):
        self.tree, self.vectors, self.queries, self.own, self.factor = tree, vectors, queries, own, factor
        self.best = np.full((len(queries), count), np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.measured = 0

    def offer(self, rows: np.ndarray, members: np.ndarray, away: np.ndarray) -> None:
        """Keep what may be among the nearest; a query itself isn't a candidate."""
        self.measured += away.size
        away = np.where(self.own[rows][:, None] == members[None, :], np.inf, away)
        count = self.best.shape[1]
        self.best[rows] = np.partition(np.concatenate([self.best[rows], away], axis=1), count - 1, axis=1)[:, :count]
        row, column = np.nonzero(away <= self.best[rows].max(axis=1)[:, None] + SLACK)
        self.kept.append((rows[row], members[column], away[row, column]))

    def visit(self, node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        low, high = self.tree.ranges[node]
        inner, outer = self.tree.children[node]
        members = self.tree.order[low : high if inner < 0 else low + 1]
        away = distance(self.queries[rows], self.vectors[members]).astype(np.float64)
        self.offer(rows, members, away)
        if inner < 0:
            return
        beyond = away[:, 0] - self.tree.radius[node]
        for first, second, mine in ((inner, outer, beyond < 0), (outer, inner, beyond >= 0)):
            own = rows[mine]
            self.visit(first, own)
            reach = self.best[own].max(axis=1) + SLACK
            self.visit(second, own[np.abs(beyond[mine]) * self.factor <= reach])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        rows, members, away = (np.concatenate(x) for x in zip(*self.kept))
        near = away <= self.best.max(axis=1)[rows] + SLACK
        return rows[near], members[near]


def least_copies(vectors: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` rows of each distinct vector, in order."""
    _, same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    return np.sort(order[place < count])


def shard_builder(count: int):
    """Of equal vectors the ``count`` + 1 of the smallest ids stay: ties go to those, and one may be the query itself."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        vectors = matrix(group["embedding"])
        head = {c: [group[c].iloc[0]] for c in ("dim", "shard")}
        keep = least_copies(vectors, count + 1)
        ids, vectors = group["vec_id"].to_numpy(np.int64)[keep], vectors[keep]
        tree = {k: [v] for k, v in VantageTree(unit(vectors, np.float64)).parts().items()}
        return pd.DataFrame({**head, "shard_ids": [ids.tobytes()], "shard_vectors": [vectors.tobytes()], **tree})

    return run


def searcher(count: int, factor: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in group.itertuples(index=False):
            ids, vectors = unpacked(row.shard_ids, row.shard_vectors)
            own, queries = unpacked(row.block_ids, row.block_vectors)
            tree = VantageTree.load(row.tree_order, row.ranges, row.radius, row.children)
            at = np.searchsorted(ids, own)
            at = np.where(ids[np.minimum(at, len(ids) - 1)] == own, at, -1)
            search = Search(tree, unit(vectors, np.float64), unit(queries, np.float64), at, count, factor)
            search.visit(0, np.arange(len(own)))
            q, x = search.pairs()
            score = np.empty(len(q))
            for i in range(0, len(q), CHUNK):
                score[i : i + CHUNK] = cosine(queries[q[i : i + CHUNK]], vectors[x[i : i + CHUNK]])
            order = np.lexsort((ids[x], -score, q))
            q, x, score = q[order], x[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = (place < count) & (own[q] != ids[x])
            out.append(pd.DataFrame({"query_id": own[q][keep], "vec_id": ids[x][keep], "score": score[keep]}))
        return pd.concat(out)

    return run


def nearest_vectors(
    candidates: DataFrame, queries: DataFrame, count: int = NEAREST, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``count`` nearest candidates of each query by cosine.

    Candidates are dealt to shards of about ``shard`` vectors by hash, each with a
    vantage-point tree; blocks of queries search every shard, and the best of all shards
    are ranked. The far side of a vantage point is entered while its bound times
    ``factor`` is within the distance of the nearest found so far: a larger factor enters
    less, and factor one is exact search by the triangle inequality. Scores come from the
    original vectors in double precision, as do the distances of the search; ties go to
    the smaller id. Of equal vectors a shard holds the ``count`` + 1 of the smallest ids,
    as no other can be among the nearest.

    Vectors that are null, empty, zero or hold a null or non-finite component, and null
    ids, take no part; vectors of another length are no candidates. A query gets fewer
    rows if there are fewer candidates, none if there is none. A vec_id that repeats is
    one vector, the one of the least values. An empty side gives no rows; other columns
    are not read.
    """
    plain = lambda df: (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(usable() & F.col("vec_id").isNotNull())
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding"))
    )
    rows = plain(candidates)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).selectExpr("dim", f"cast(ceil(n / {shard}) as int) shards")
    dealt = rows.join(sizes, "dim").withColumn("shard", part_of("vec_id", 2, "shards")).select("dim", "shard", "vec_id", "embedding")
    tree = "tree_order binary, ranges binary, radius binary, children binary"
    schema = f"dim int, shard int, shard_ids binary, shard_vectors binary, {tree}"
    shards = staged(dealt.groupBy("dim", "shard").applyInPandas(shard_builder(count), schema), "vector-trees")

    asked = plain(queries)
    blocks = asked.groupBy("dim").agg(F.count("*").alias("n")).selectExpr("dim", f"cast(ceil(n / {block}) as int) blocks")
    asked = asked.join(blocks, "dim").join(sizes, "dim").withColumn("block", part_of("vec_id", 3, "blocks"))
    asked = pack_blocks(asked, ["dim", "shards", "block"], "vec_id", "block").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
    pairs = asked.join(shards, ["dim", "shard"]).groupBy("dim", "shard", "block")
    found = pairs.applyInPandas(searcher(count, factor), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


@query()
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return nearest_vectors(embeddings, embeddings.where(F.col("vec_id") % EVERY == 0))
