"""Line, passage and near-duplicate removal and components against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helpers import EDGES, documents, texts
from rankfold.llm import lines, minhash, substrings
from rankfold.llm.graph import connected_components
from rankfold.llm.words import grams, split_words

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(edges, nodes=()):
    parent = {n: n for e in edges for n in e} | {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components(spark, shape):
    draw = random.Random(shape)
    edges = {
        "random": [(draw.randint(0, 120), draw.randint(0, 120)) for _ in range(90)],
        "chain": [(i, i + 1) for i in range(70)],
        "star": [(500, i) for i in range(60)],
        "loops": [(4, 4), (None, 2)],
    }[shape]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots([e for e in edges if e[0] != e[1] and None not in e])


def test_words_and_grams():
    column = pa.array(["A b\x0bc\x85d", None, "", " \t", "x" * 3000 + " é B"]).slice(0)
    w = split_words(column, lower=True)
    assert np.diff(w.first).tolist() == [3, 0, 0, 0, 3]
    again = split_words(pa.array(["skip this", "a B", "é b"]).slice(1), lower=True)
    assert again.hash[0] == w.hash[0] and again.hash[1] == w.hash[1 + 4] == again.hash[3] and w.hash[4] == again.hash[2]
    assert grams(w.hash, 7).size == 0 and grams(w.hash, 6).size == 1
    assert split_words(pa.array([], pa.string())).start.size == 0


def brute_sets(text):
    own = (text or "").translate(UPPER).encode().split()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def near_rows(seed):
    rows = [(i, t) for i, t in enumerate(texts(seed, 120, 1, 120))] + [(200 + i, f"Short {i % 2}") for i in range(4)]
    base = texts(seed + 1, 1, 150, 151)[0].split(" ")
    draw = random.Random(seed)
    for i in range(40):  # near copies of one text and of one another, in a chain
        base = [*base]
        base[draw.randrange(len(base))] = f"edit{i}"
        rows.append((300 + i, " ".join(base)))
    return rows


@pytest.mark.parametrize("whole", [2000, 3])
def test_minhash_equals_all_pairs(spark, monkeypatch, whole):
    monkeypatch.setattr(minhash, "WHOLE_CLUSTER", whole)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = near_rows(5)
    sets = {i: brute_sets(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(edges, sets)
    assert len(set(want.values())) < len(rows) - 40
    got = minhash.near_duplicates(documents(spark, rows, clashing=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets
    }


def test_minhash_edges(spark):
    got = minhash.near_duplicates(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    own = {r.doc_id: r for r in got}
    assert [own[i].n_shingles for i in (900, 901, 902, 903)] == [0, 0, 0, 1]
    assert all(r.kept for r in got) and own[None].component_id is None and own[904].component_id == 904
    assert minhash.near_duplicates(documents(spark, EDGES).where("false")).count() == 0


def test_circulant_is_its_definition():
    own = minhash.Circulant(universe=64, coordinates=16, seed=1)
    shingles = np.array([3, 99, 12345], dtype=np.uint64)
    draw = np.random.RandomState(1)
    first, second = draw.permutation(64), draw.permutation(64)
    places = first[(minhash.mix(shingles, 3) % np.uint64(64)).astype(int)]
    assert own.signature(shingles).tolist() == [min(second[(p + k) % 64] for p in places) for k in range(16)]


def brute_lines(rows, least=10):
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    order = lambda i: (i is None, i or 0)
    owners = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                owners[key(line)].add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(owners[key(x)]) < 2 or min(owners[key(x)], key=order) == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def line_rows(seed):
    draw = random.Random(seed)
    pool = [f"a line number {i} of the pool" for i in range(30)] + ["short", "", "é" * 10, "é" * 9, "  Padded LINE here\t"]
    pool += ["padded line here", "PADDED line here\x0b"]
    rows = []
    for i in range(80):
        own = [draw.choice(pool) if draw.random() < 0.4 else f"own line {i} {j} of words" for j in range(draw.randint(0, 12))]
        rows.append((draw.randint(-500, 500) * 1000 + i, "\n".join(["everyone has this line", *own] if i % 3 else own)))
    return rows + [(r[0], r[1]) for r in EDGES] + [(None, "everyone has this line\na line of null ids"), (None, "a line of null ids")]


@pytest.mark.parametrize("batches, fanout", [(4, 2), (1, 2), (7, 3)])
def test_lines_equal_plain_search(spark, batches, fanout):
    rows = line_rows(batches)
    got = lines.dedup_lines(documents(spark, rows, clashing=True), batches=batches, fanout=fanout)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()]
    assert Counter(got) == Counter(brute_lines(rows))


def test_runs_are_compacted(spark):
    runs = lines.Runs(spark, fanout=2)
    for i in range(5):
        runs.add(spark.range(3).selectExpr(f"id + {i * 10} h1", "id h2", f"cast({i} as long) owner"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    found = runs.lookup(spark.createDataFrame([(11, 1), (11, 2), (40, 0)], "h1 long, h2 long")).collect()
    assert sorted((r.h1, r.h2, r.run_owner, r.known) for r in found) == [(11, 1, 1, True), (11, 2, None, False), (40, 0, 4, True)]
    runs.close()


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(documents(spark, EDGES).where("false")).count() == 0


def brute_passages(rows):
    seen = Counter()
    own = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in own:
        seen.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    out = []
    for i, w in own:
        gone = set()
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


@pytest.mark.parametrize("hot, block", [(2000, 4000), (3, 5), (1, 5)])
def test_passages_equal_plain_search(spark, hot, block):
    rows = [(i, t) for i, t in enumerate(texts(9, 90, 20, 160))]
    rows += [(500, "to be " * 120), (501, "no " * 35), (502, "no " * 36), (503, " ".join(f"w{i}" for i in range(3000)))]
    rows += [(600 + i, f"{i} " + " ".join(f"hot{j}" for j in range(40)) + f" {i}") for i in range(30)]
    rows += [(r[0], r[1]) for r in EDGES]
    got = substrings.dedup_passages(documents(spark, rows, clashing=True), hot=hot, block=block).collect()
    want = brute_passages(rows)
    assert sum(x[2] for x in want) > 1000
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter(want)


def test_passages_of_nothing_and_of_repeated_rows(spark):
    assert substrings.dedup_passages(documents(spark, EDGES).where("false")).count() == 0
    twice = [(1, " ".join(f"w{i}" for i in range(40)))] * 2
    assert [r.n_removed for r in substrings.dedup_passages(documents(spark, twice)).collect()] == [40, 40]


def test_greedy_factors_and_boundary_windows():
    tokens = np.array([1, 2, 3, 4, 5, 6, 90, 2, 3, 4, 5, 91, 4, 5, 6, 7, 92])
    index = substrings.Reference(tokens)
    assert index.longest[:6].tolist() == [0, 4, 3, 3, 2, 1]
    assert {(1, 5), (3, 6)} <= set(index.repeated(0, 6, 3)) <= {(1, 5), (2, 5), (3, 6)}


def test_queries_use_whole_tables(spark):
    from rankfold.llm import queries

    registry = queries.load()
    names = sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.QUERIES["op4_substring_dedup"](spark, sf).collect()}
    assert got == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute_passages(rows)}
    sets = {i: brute_sets(t) for i, t in rows}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.QUERIES["op9_minhash"](spark, sf).collect()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(edges, sets)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
