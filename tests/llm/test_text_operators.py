"""Packing, token counts, language, toxicity and mixing against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import EDGES, documents, texts
from rankfold.llm import language, mixing, packing, token_counts, toxicity

LONG = " ".join(texts(3, 1, 9000, 9001))
ROWS = [*EDGES, (1, LONG, "en", "a", 1), (2, "Hello, world! <|endoftext|> it's", "en", "a", 1), (3, "été — 你好 😀", "fr", "b", 1)]


def test_packing_tiles_every_document(spark):
    got = packing.pack_sequences(documents(spark, ROWS, clashing=True).coalesce(1)).toPandas()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[(doc_id, len(ids))] += 1
        pieces = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id].sort_values("start")
        for start, length, crc in pieces[["start", "length", "ids_crc32"]].itertuples(index=False):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    for (doc_id, size), times in want.items():
        pieces = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id]
        assert set(pieces.doc_tokens) == {size} and pieces.length.sum() == size * times
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.offset.to_numpy() == np.cumsum(rows.length) - rows.length).all() and rows.length.sum() <= packing.CAPACITY
    total = got.length.sum()
    assert got.sequence_id.nunique() == -(-total // packing.CAPACITY)


def test_packing_of_nothing_and_in_pools(spark):
    assert packing.pack_sequences(documents(spark, EDGES).where("false")).count() == 0
    got = packing.pack_sequences(documents(spark, [(i, LONG[:4000]) for i in range(6)]).coalesce(1), pool_tokens=3000).toPandas()
    assert got.groupby("doc_id").length.sum().nunique() == 1
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_assign_prefers_the_cheapest_sequence_that_holds():
    pieces = packing.assign(np.array([100, 60, 50, 40, 250]), capacity=100)
    filled = defaultdict(int)
    for _, _, length, sequence, at in pieces:
        assert at == filled[sequence]
        filled[sequence] += length
    assert sum(filled.values()) == 500 and max(filled.values()) == 100 and len(filled) == 5


def brute_assign(lengths, capacity):
    """The cost rule with every open sequence looked at for every piece."""
    rest = sorted((-(n % capacity), d, n - n % capacity) for d, n in enumerate(lengths) if n % capacity)
    first = sum(n // capacity for n in lengths)
    open_ = {first + s: (0.0, 0) for s in range(-(-sum(-r[0] for r in rest) // capacity))}
    pieces = []
    while rest:
        rest.sort()
        negative, document, start = rest.pop(0)
        length = -negative
        holding = [(cost, s) for s, (cost, used) in open_.items() if capacity - used >= length]
        cost, s = min(holding or [(cost, s) for s, (cost, used) in open_.items() if used < capacity])
        used = open_[s][1]
        taken = min(length, capacity - used)
        pieces.append((document, start, taken, s, used))
        open_[s] = (cost + packing.LINEAR * taken + packing.QUADRATIC * taken * taken, used + taken)
        if taken < length:
            rest.append((taken - length, document, start + taken))
    return pieces


@pytest.mark.parametrize("seed, capacity", [(1, 100), (2, 100), (3, 7), (4, 2048)])
def test_assign_equals_the_rule(seed, capacity):
    draw = random.Random(seed)
    lengths = [draw.choice([1, 2, capacity // 3, capacity - 1, capacity, 3 * capacity + 5, draw.randint(1, 2 * capacity)]) for _ in range(150)]
    got = [p for p in packing.assign(np.array(lengths), capacity) if not (p[2] == capacity and p[1] % capacity == 0 and p[4] == 0)]
    assert got == [p for p in brute_assign(lengths, capacity) if p[2] < capacity]


def test_packing_of_two_million_blanks(spark):
    rows = [(1, " " * 2_000_000), (2, "\n" * 2_000_000), (3, " " * 2_000_000 + "a"), (4, "\n" * 2_000_000 + "a"), (5, "x")]
    got = packing.pack_sequences(documents(spark, rows).coalesce(1)).toPandas()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in rows:
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = got[got.doc_id == doc_id].sort_values("start")
        assert pieces.length.sum() == len(ids) == pieces.doc_tokens.iloc[0]
        for start, length, crc in pieces[["start", "length", "ids_crc32"]].itertuples(index=False):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc


def brute_count(word, scores, fallback=-20.0):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * fallback, 0, best[end - 1][1] + size)]
        options += [(best[s][0] + scores[word[s:end]], end - s, best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        top = max(options, key=lambda o: (o[0], o[1]))
        best[end] = (top[0], top[2])
    return best[-1][1]


def test_token_counts_equal_the_plain_recursion(spark):
    scores = token_counts.unigram_scores("piece_bpe_32k.model")
    got = token_counts.count_tokens(documents(spark, ROWS, clashing=True)).collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for doc_id, text, *_ in ROWS:
        words = [w for w in token_counts._SPACES.split(text or "") if w]
        counts = {w: brute_count("▁" + w, scores) for w in set(words)}
        want[(doc_id, len(words), sum(counts[w] for w in words))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in got) == want


def test_shared_prefixes_are_scored_once():
    forward = token_counts.SharedForward({"a": -1.0, "b": -2.0, "ab": -2.5, "abab": -4.9})
    assert forward.counts(["abab", "ab", "abac", "b"]) == {"abab": 1, "ab": 1, "abac": 3, "b": 1}
    assert forward.steps == len("abab") + len("c") + len("b") or forward.steps == len("ab") + len("ac") + len("bab") - 1 + len("b")


def test_token_counts_of_nothing(spark):
    assert token_counts.count_tokens(documents(spark, EDGES).where("false")).count() == 0


SF = "/root/testdata/sf0.01/documents.parquet"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(SF)
    got = language.identify_language(docs, language.language_dictionaries(docs.where(~language.held_out())), keep=("doc_id", "lang"))
    rows = got.where(language.held_out() & F.col("lang").isNotNull()).toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    docs = documents(spark, ROWS, clashing=True)
    dictionaries = {"en": b"the of and to in that is was for it with as his on be at by", "fr": "le la été des une est pour dans".encode()}
    got = language.identify_language(docs, dictionaries, keep=("doc_id", "score", "node")).toPandas()
    assert list(got.columns) == ["doc_id", "node", "lang_pred", "score", "lang_rejected"] and len(got) == len(ROWS)
    und = got[got.lang_pred == "und"]
    assert set(und.doc_id.dropna()) == {900, 901, 902, 903} and und.lang_rejected.all()
    none = language.identify_language(docs, {}).toPandas()
    assert set(none.lang_pred) == {"und"}
    assert language.identify_language(docs.where("false"), dictionaries).count() == 0
    assert language.language_dictionaries(docs.where("false")) == {}


def test_equal_sizes_take_the_first_dictionary():
    own = language.Compressors({"b": b"xyz" * 50, "a": b"xyz" * 50})
    assert own.choose("short words", 0.01)[0] == "b" and own.choose("short words", 0.01)[2] is False
    assert own.choose("words " * 40, 0.01)[2] is True


def test_toxicity_on_held_out_rows(spark):
    """Marked words among random ones; the labels of the smallest table are too few to learn all languages from."""
    draw, words = random.Random(8), texts(8, 1, 3000, 3001)[0].split(" ")
    marked = ["zzqbad", "zzqawful", "wxkvile", "qzqnasty"]
    rows = []
    for i in range(1600):
        own = [draw.choice(words) for _ in range(draw.randint(5, 120))]
        if i % 6 == 0:
            own[draw.randrange(len(own))] = draw.choice(marked) + draw.choice(["", "o", "isch"])
        rows.append((i, " ".join(own)))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(1600)], "doc_id long, toxic int")
    docs = documents(spark, rows)
    model = toxicity.fit(*toxicity.training_sample(docs.where(~language.held_out()), labels))
    got = toxicity.score_toxicity(docs.where(language.held_out()), model).join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    assert got[got.toxic == 1].predicted.mean() > 0.7 and got[got.toxic == 0].predicted.mean() < 0.02


def test_toxicity_of_odd_input(spark):
    docs = documents(spark, ROWS, clashing=True)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels)
    assert sample == ([ROWS[-2][1]], [0], None)  # the long text is left out
    for model in (toxicity.fit(["bad word", "fine words"], [1, 0], rounds=5), toxicity.fit([], []), toxicity.fit(["x"], [1])):
        got = toxicity.score_toxicity(docs, model).toPandas()
        assert len(got) == len(ROWS) and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0
    assert toxicity.training_sample(docs.where("false"), labels)[0] == []


def test_toxicity_learns_from_long_texts(spark, folder):
    """Toxic labels on long texts only: op7 trains on them and doesn't score all texts alike."""
    draw, words = random.Random(4), texts(9, 1, 3000, 3001)[0].split(" ")
    rows = []
    for i in range(240):
        own = [draw.choice(words) for _ in range(1800 if i % 4 == 0 else 60)]
        if i % 4 == 0:
            own[::40] = ["zzqbad"] * len(own[::40])
        rows.append((i, " ".join(own)))
    assert min(len(t) for i, t in rows if i % 4 == 0) > toxicity.CHARACTERS
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    got = toxicity.op7_toxicity(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 1].score.min() > got[got.toxic == 0].score.max()


def test_toxicity_sample_keeps_to_its_budget(spark):
    docs = documents(spark, [(i, "x" * (100 * (i % 5) + 100)) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    own, marks, _ = toxicity.training_sample(docs, labels, longest=None, budgets={1: 3000, 0: 6000})
    sizes = [sum(len(t) for t, m in zip(own, marks) if m == label) for label in (1, 0)]
    assert 3000 <= sizes[0] < 3500 and 6000 <= sizes[1] < 6500
    assert {len(t) for t in own} == {100, 200, 300, 400, 500}
    assert len(toxicity.training_sample(docs, labels, positives=5, negatives=7, longest=None)[0]) == 12


def brute_targets(totals):
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [s for s in totals if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(totals.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * totals[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * totals[s]
            open_.discard(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_meets_its_targets(spark, seed):
    draw = random.Random(seed)
    names = [None, "", "Zed", "a", "é", "hot", "z"]
    rows = [(i, "w " * draw.randint(0, 60), "en", draw.choice(names) if i % 3 else "hot", 0) for i in range(1500)] + EDGES
    docs = documents(spark, rows, clashing=True)
    got = mixing.mix_plan(docs).toPandas()
    assert len(got) == len(rows)
    totals = defaultdict(int)
    for _, text, _, source, *_ in rows:
        totals[source] += len((text or "").split())
    want = brute_targets(totals)
    for source, own in got.groupby("source", dropna=False):
        source = None if pd.isna(source) else source
        assert set(own.source_size) == {totals[source]} and own.target.iloc[0] == pytest.approx(want[source])
        assert own.taken.sum() == pytest.approx(want[source], rel=0.1, abs=60)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    again = mixing.mix_plan(docs.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert Counter(map(str, got[key].values.tolist())) == Counter(map(str, again[key].values.tolist()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == got.copies.sum()


def test_mixing_of_nothing(spark):
    empty = documents(spark, EDGES).where("false")
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = documents(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])
    assert [r.taken for r in mixing.mix_plan(blank).collect()] == [0, 0]
