"""Phrases against plain counting, and the filters against plain tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import EDGES, documents
from rankfold.llm import collocations as co

SMALL = {"block_bytes": 300, "filter_grams": 40, "bucket_grams": 50, "mask_bits": 9}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, longest=5, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for row in rows:
        lang = row[2] if row[2] is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(row[1] or "")):
            own = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(own)
            for size in range(1, longest + 1):
                for i in range(len(own) - size + 1):
                    counts[lang][tuple(own[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {
            p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and a >= f[p[i:j]]
        }
        scored = []
        for p, a in often.items():
            if p not in gone:
                cuts = [(1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def rows_of(df, **options):
    got = co.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def corpus(seed, count):
    draw = random.Random(seed)
    words = ["the", "of", "Ökonomie", "new", "york", "x", "é", "A", "rare"] + [f"w{i}" for i in range(12)]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", " . "]
    out = []
    for i in range(count):
        text = "".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.randint(0, 60)))
        if i % 3 == 0:
            text += " in the City of New York today"
        out.append((i, text, draw.choice(["en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("least, options", [(6, SMALL), (6, {}), (2, {**SMALL, "longest": 3, "top": 7})])
def test_phrases_equal_plain_counting(spark, least, options):
    rows = corpus(least, 150)
    want = plain(rows, least, options.get("longest", 5), options.get("top", 2000))
    assert want and rows_of(documents(spark, rows).repartition(3), least=least, **options) == want


def test_ids_that_clash_are_drawn_anew(spark):
    rows = corpus(9, 60)
    assert rows_of(documents(spark, rows), least=5, id_bits=4) == plain(rows, 5)


def test_odd_rows(spark):
    long = "one long text without end " * 20_000
    rows = [*EDGES, (1, long, "en"), (2, "a b " * 50 + "c", ""), (3, "...", "en"), (4, "\x00 \x01 " * 9, "fr"), (5, "a b c " * 9, "fr")]
    assert rows_of(documents(spark, rows, clashing=True), least=5) == plain(rows, 5)


def test_nothing(spark):
    assert rows_of(documents(spark, EDGES).where("false")) == []
    assert rows_of(documents(spark, [(1, "a b c", "en")])) == []
    assert rows_of(documents(spark, [(1, "a, b, " * 300, "en")])) == []


def test_ties_go_by_the_phrase(spark):
    rows = [(i, f"{a} {b}.", "en") for i, (a, b) in enumerate([("zz", "y"), ("é", "b"), ("Z", "b2"), ("e", "f")] * 4)]
    got = rows_of(documents(spark, rows), least=4, top=3)
    assert got == plain(rows, 4, top=3) and [r[2] for r in got] == ["e f", "z b2", "zz y"]


@pytest.mark.parametrize("length, bits, bucket_bits", [(2, 1, 0), (2, 9, 3), (3, 25, 10), (4, 16, 0), (5, 25, 4), (3, 41, 6), (5, 32, 7), (5, 63, 9)])
def test_filters_lose_nothing(length, bits, bucket_bits):
    draw = np.random.RandomState(bits)
    ids = [draw.randint(0, min(1 << bits, 50), 4000).astype(np.uint64) for _ in range(length)]
    for column in ids:
        column[:700] = column[0]  # one n-gram more than 255 times
    mixed = co.permuted(ids, bits)
    assert all((a == b).all() for a, b in zip(ids, co.restored(mixed, bits)))
    keys, counts = co.counted(co.packed(mixed, bits))
    want, seen = Counter(zip(*[i.tolist() for i in ids])), Counter()
    bucket = (keys[0] >> np.uint64(64 - bucket_bits)).astype(int) if bucket_bits else np.zeros(len(counts), dtype=int)
    for b in np.unique(bucket):
        data = co.filter_bytes([k[bucket == b] for k in keys], counts[bucket == b], length * bits, bucket_bits)
        back, numbers = co.filter_keys(data, int(b), length * bits, bucket_bits)
        found = co.restored(co.unpacked(back, bits, length), bits)
        seen.update(dict(zip(zip(*[i.tolist() for i in found]), numbers.tolist())))
    assert seen == want and max(want.values()) >= 700


def test_permutation_is_one_to_one_and_even():
    pairs = np.arange(1 << 12, dtype=np.uint64)
    mixed = co.packed(co.permuted([pairs >> np.uint64(6), pairs & np.uint64(63)], 6), 6)[0]
    assert len(np.unique(mixed)) == 1 << 12
    some = co.packed(co.permuted([pairs[:1000], pairs[:1000]], 20), 20)[0]
    assert np.bincount((some >> np.uint64(61)).astype(int), minlength=8).min() > 80


def test_chunks_are_cut_at_breaks():
    data = b"one two, three four five six seven. eight"
    for limit in (1, 5, 9, 100):
        parts = list(co.chunks(data, limit))
        assert b"".join(parts) == data and all(p[-1:] in b",." for p in parts[:-1])
