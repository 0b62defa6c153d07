"""Vector operators against brute force in double precision."""

import math

import numpy as np
import pytest

from rankfold.llm import embedding_dedup, nearest
from rankfold.llm.vectors import unit


def vectors(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("node", "score", "shard", "dim", "block", "copies") if clashing else ():
        df = df.selectExpr("*", f"'x' {name}")
    return df


def sample(seed, count=260, size=16):
    """Clusters of near vectors, exact and scaled copies, and rows that take no part."""
    draw = np.random.RandomState(seed)
    centres = draw.normal(size=(25, size))
    rows = []
    for i in range(count):
        v = centres[draw.randint(25)] + draw.normal(size=size) * draw.choice([0.02, 0.2, 0.5])
        if i % 9 == 1:
            v = np.array(rows[draw.randint(len(rows))][1])
        rows.append((i * 10, [float(np.float32(x)) for x in v], int(draw.randint(3)) if i % 11 else None))
    for _ in range(30):
        rows.append((len(rows) * 10, rows[0][1], 1))
    rows.append((9001, [2 * x for x in rows[0][1]], 1))
    odd = [None, [], [0.0] * size, [math.nan] + [1.0] * (size - 1), [math.inf] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [1.0, 2.0], [1.0, 2.125]]
    return rows + [(9100 + 50 * i, v, 1) for i, v in enumerate(odd)]


def plays(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, dtype=float), np.array(b, dtype=float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def brute_links(rows, threshold=0.93):
    links = {i: [] for i, _, _ in rows}
    for x, (i, a, p) in enumerate(rows):
        for j, b, q in rows[x + 1 :]:
            if p is not None and p == q and plays(a) and plays(b) and len(a) == len(b) and cosine(a, b) >= threshold:
                links[i].append(j)
                links[j].append(i)
    out = {}
    for i in sorted(links):
        todo = [i] if i not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return {i: (len(links[i]), out[i], out[i] == i) for i in links}


@pytest.mark.parametrize("shard, block", [(16384, 4096), (20, 15)])
def test_links_and_components(spark, shard, block):
    rows = sample(1)
    got = embedding_dedup.near_duplicate_vectors(vectors(spark, rows, clashing=True), shard=shard, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(rows)


def test_repeated_rows_null_ids_and_nothing(spark):
    v = [1.0, 0.5]
    got = embedding_dedup.near_duplicate_vectors(vectors(spark, [(1, v, 1), (1, v, 1), (None, v, 1), (None, [0.0, -1.0], 1)])).collect()
    assert sorted((r.n_links, str(r.component_id), r.kept) for r in got) == [(0, "None", True), (2, "1", False), (2, "1", True), (2, "1", True)]
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, [(1, v, 1)]).where("false")).count() == 0


def test_graph_finds_what_brute_force_finds():
    draw = np.random.RandomState(4)
    x = unit(np.concatenate([draw.normal(size=(3000, 32)), draw.normal(size=(1, 32)) + 0.1 * draw.normal(size=(500, 32))]))
    graph = embedding_dedup.SmallWorld(x)
    truth = (x @ x.T >= 0.93).sum()
    assert len(graph.near(x, 0.93, 48)[0]) >= 0.99 * truth
    again = embedding_dedup.SmallWorld.load(x, graph.dump())
    q, n = embedding_dedup.audited_pairs(again, x, 0.93, 4)
    assert 0.99 * truth <= len(q) <= truth and len(set(zip(q.tolist(), n.tolist()))) == len(q)
    one = embedding_dedup.SmallWorld(x[:1])
    assert [a.tolist() for a in one.near(x[:1], 0.5, 48)] == [[0], [0]]


@pytest.mark.parametrize("shard, block", [(16384, 1024), (30, 3)])
def test_nearest_is_exact_at_factor_one(spark, shard, block):
    rows = sample(2)
    df = vectors(spark, rows, clashing=True)
    got = nearest.nearest_vectors(df, df.where("vec_id % 50 = 0"), shard=shard, block=block).collect()
    want = {}
    for i, a, _ in rows:
        if i % 50 == 0 and plays(a):
            others = [(-cosine(a, b), j) for j, b, _ in rows if j != i and plays(b) and len(a) == len(b)]
            for rank, (score, j) in enumerate(sorted(others)[:5], 1):
                want[i, rank] = (j, -score)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    assert want[9400, 1][0] == 9450 and (9400, 2) not in want


def test_nearest_among_hundreds_of_copies(spark):
    """Ties go to the smallest ids, whatever the order and shape of the products that measured the copies."""
    draw = np.random.RandomState(11)
    x = draw.normal(size=(3000, 64)).astype(np.float32)
    for first, copies in ((1, 900), (2, 400)):
        x[draw.choice(3000, copies, replace=False)] = x[first]
    x[draw.choice(3000, 300, replace=False)] = 3 * x[5] + 1e-4 * draw.normal(size=(300, 64))
    ids = draw.permutation(3000)
    df = vectors(spark, [(int(i), v.tolist(), 1) for i, v in zip(ids, x)])
    got = nearest.nearest_vectors(df, df.where("vec_id % 20 = 0")).collect()
    wide, order = x.astype(float)[np.argsort(ids)], np.arange(3000)
    want = {}
    for i in range(0, 3000, 20):
        score = (wide[i] * wide).sum(axis=1) / (np.sqrt((wide[i] * wide[i]).sum()) * np.sqrt((wide * wide).sum(axis=1)))
        for rank, j in enumerate([j for j in np.lexsort((order, -score)) if j != i][:5], 1):
            want[i, rank] = int(j)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == want


def test_nearest_of_few_and_none(spark):
    df = vectors(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 2), (None, [1.0, 0.0], 1), (0, [1.0, 0.0], 1)])
    got = nearest.nearest_vectors(df, df.where("vec_id = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)]
    assert nearest.nearest_vectors(df.where("false"), df).count() == 0
    assert nearest.nearest_vectors(df, df.where("false")).count() == 0


def test_larger_factor_measures_less():
    draw = np.random.RandomState(6)
    x = unit(draw.normal(size=(60, 24))[draw.randint(60, size=4000)] + 0.3 * draw.normal(size=(4000, 24)))
    own = np.arange(0, 4000, 50)
    truth = np.argsort(-np.where(np.arange(4000)[None] == own[:, None], -9, x[own] @ x.T), axis=1)[:, :5]
    measured, recall = [], []
    for factor in (1.0, 1.5):
        search = nearest.Search(nearest.VantageTree(x), x, x[own], own, 5, factor)
        search.visit(0, np.arange(len(own)))
        q, n = search.pairs()
        found = [set(n[q == i].tolist()) for i in range(len(own))]
        recall.append(np.mean([len(f & set(t)) / 5 for f, t in zip(found, truth.tolist())]))
        measured.append(search.measured)
    assert recall[0] == 1.0 and recall[1] >= 0.5 and measured[1] < measured[0] < 4000 * len(own)


def test_equal_vectors_make_one_leaf():
    x = unit(np.ones((300, 4)))
    tree = nearest.VantageTree(x)
    search = nearest.Search(tree, x, x[:2], np.array([0, 1]), 5, 1.0)
    search.visit(0, np.arange(2))
    q, n = search.pairs()
    assert (np.bincount(q) == 299).all() and len(n) == 598
