"""The manifest against a plain tree, and its odd inputs."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import EDGES, documents
from rankfold.llm import merkle

FANOUT = 8


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def siblings(tree, place):
    for level in tree[:-1]:
        first = place // FANOUT * FANOUT
        run = level[first : first + FANOUT]
        yield run[: place - first], run[place - first + 1 :]
        place //= FANOUT


def plain(rows):
    """Rows of the manifest, one per document, in any order."""
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row[0], leaf(*row), row))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = levels([r[1] for r in by_lang[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for place, (doc_id, own, row) in enumerate(by_lang[lang]):
            steps = [*siblings(trees[lang], place), *siblings(top, at)]
            text = row[1]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf(row[0], text, *row[2:])
            for left, right in steps:
                now = sha("".join(left) + now + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in steps))
            out.append((doc_id, lang, own, trees[lang][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def rows_of(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(df, tampered=tampered)
    assert got.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("count", [1, 8, 9, 73])
def test_manifest_equals_a_plain_tree(spark, count):
    rows = [(i * 7 % 1000, f"Text {i} É", "en" if i % 3 else "de", f"s{i % 2}", i) for i in range(count)]
    assert rows_of(documents(spark, rows).repartition(5)) == sorted(plain(rows), key=repr)


def test_manifest_of_odd_rows(spark):
    long = "Ab c" * 300_000
    rows = [*EDGES, (1, long, "en", "a", len(long)), (2, "x", "z", None, 1), (3, "Ä\x00B", "", "a", 3)]
    rows = [(*r, *[None] * (5 - len(r))) for r in rows]
    assert rows_of(documents(spark, rows, clashing=True)) == sorted(plain(rows), key=repr)


def test_manifest_of_many_small_trees_and_of_nothing(spark):
    rows = [(i, "t", f"lang{i % 70}", "a", 1) for i in range(100)]
    assert rows_of(documents(spark, rows)) == sorted(plain(rows), key=repr)
    assert rows_of(documents(spark, rows).where("false")) == []


def test_one_tree_over_many_slices(spark):
    rows = [(i, "A", "en", "a", 1) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(documents(spark, rows).repartition(7)) == sorted(plain(rows), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_change_anywhere_shows(spark):
    rows = [(i, f"text {i}", "en", "a", 1) for i in range(30)]
    before = {r[0]: r for r in rows_of(documents(spark, rows))}
    rows[17] = (17, "text 17!", "en", "a", 1)
    after = {r[0]: r for r in rows_of(documents(spark, rows))}
    assert before[17][2] != after[17][2] and before[3][2] == after[3][2]
    assert all(before[i][4] != after[i][4] for i in before)
