"""Removal of repeated passages by relative Lempel-Ziv parsing against reference blocks.

The corpus is its own reference. Two equal windows of W words hold the same least word
n-gram, so windows are dealt to reference blocks by it, and only where that n-gram
repeats; this filter loses nothing. A block indexes its passages, and each passage is
factored greedily against the whole block: a factor is the longest run of words that
occurs elsewhere. Factors of W words are repeated; windows across a factor boundary are
looked up in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .stages import staged
from .words import Words, grams, mix, slices, split_words

WINDOW = 35
GRAM = 8
SAMPLED = 8
HOT = 2000
BLOCK_PASSAGES = 4000
ID = ["doc_id", "text_hash"]


def _running(values: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Least of each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = least(values[:-step], values[step:])
        done += step
    return values


class Windows:
    """Windows of one slice of texts and the n-gram that each is dealt by.

    A window's key is its least n-gram, the last of equals. One in SAMPLED n-grams counts
    as less than all others; whether one does depends on its words alone, so equal windows
    hold the same ones, and all of them must repeat.
    """

    def __init__(self, w: Words):
        self.words = w
        span = WINDOW - GRAM + 1
        self.gram = grams(w.hash, GRAM)
        count = max(0, len(self.gram) - span + 1)
        order = mix(self.gram, 21)
        sampled = order % np.uint64(SAMPLED) == 0
        order = np.where(sampled, order >> np.uint64(1), order | np.uint64(1 << 63))
        _, rank = np.unique(order, return_inverse=True)
        packed = (rank.astype(np.int64) << 32) | (len(rank) - 1 - np.arange(len(rank)))
        least = _running(packed, span)[:count] if count else np.zeros(0, dtype=np.int64)
        self.key = len(rank) - 1 - (least & 0xFFFFFFFF)
        self.doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        self.at = np.arange(len(w.start)) - w.first[:-1][self.doc]
        self.valid = self.doc[:count] == self.doc[WINDOW - 1 : WINDOW - 1 + count]
        inside = np.zeros(len(rank), dtype=bool)
        starts = np.flatnonzero(self.valid)
        if len(starts):
            edge = np.zeros(len(rank) + 1, dtype=np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + span, -1)
            inside = np.cumsum(edge)[:-1] > 0
        self.sampled = sampled & inside
        emitted = self.sampled.copy()
        emitted[self.key[self.valid]] = True
        self.emitted = np.flatnonzero(emitted)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Windows all of whose sampled n-grams, and whose key, are marked in ``repeated``."""
        alone = np.concatenate([[0], np.cumsum(self.sampled & ~repeated)])
        span, starts = WINDOW - GRAM + 1, np.flatnonzero(self.valid)
        return starts[repeated[self.key[starts]] & (alone[starts + span] == alone[starts])]


def emit_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            own = Windows(split_words(part.column("text")))
            rows = pa.array(own.doc[own.emitted])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(rows),
                    part.column("text_hash").take(rows),
                    pa.array(own.at[own.emitted], pa.int32()),
                    pa.array(own.gram[own.emitted].astype(np.int64)),
                ],
                names=[*ID, "pos", "gram"],
            )


def _marks(column: pa.Array, own: Windows) -> np.ndarray:
    """Positions in documents, one list per row, as a mark on the slice's n-grams."""
    marked = np.zeros(len(own.gram), dtype=bool)
    lengths = np.diff(column.offsets.to_numpy())
    first = np.repeat(own.words.first[:-1], lengths)
    marked[first + column.flatten().to_numpy(zero_copy_only=False)] = True
    return marked


PASSAGES = "doc_id long, text_hash long, start int, high int, gram long, passage binary, w1 long, w2 long, sure boolean"


def cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of consecutive candidate windows with one key; of hot keys, window hashes.

    Hot windows are combined within a slice of texts: those that occur twice there are
    spans at once, merged where they overlap, and stand once, marked as sure, for the
    windows of other slices. The others ask whether their hash occurs elsewhere.
    """
    for batch in batches:
        for part in slices(batch, "text"):
            own = Windows(split_words(part.column("text")))
            hot = _marks(part.column("hot"), own)
            found = own.candidates(hot | _marks(part.column("usual"), own))
            if len(found):
                is_hot = hot[own.key[found]]
                yield _passages(part, own, found[~is_hot])
                yield from _hot_windows(part, own, found[is_hot])


def _rows(part: pa.RecordBatch, own: Windows, start: np.ndarray, end: np.ndarray, **values) -> pa.RecordBatch:
    """Rows of PASSAGES for word ranges of the slice."""
    rows, n = pa.array(own.doc[start]), len(start)
    fields = {"gram": pa.int64(), "passage": pa.binary(), "w1": pa.int64(), "w2": pa.int64(), "sure": pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id").take(rows),
            part.column("text_hash").take(rows),
            pa.array(own.at[start], pa.int32()),
            pa.array(own.at[start] + (end - start), pa.int32()),
            *[pa.array(values[f], kind) if f in values else pa.nulls(n, kind) for f, kind in fields.items()],
        ],
        names=[*ID, "start", "high", *fields],
    )


def _runs(found: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and word ends of runs of windows; ``new`` marks those that begin a run."""
    first = np.flatnonzero(new)
    last = np.append(first, len(found))[1:] - 1
    return first, found[last] + WINDOW


def _passages(part: pa.RecordBatch, own: Windows, found: np.ndarray) -> pa.RecordBatch:
    key = own.key[found]
    first, end = _runs(found, np.concatenate([[True] * (len(found) > 0), (np.diff(found) != 1) | (np.diff(key) != 0)]))
    start, data = found[first], own.words.data.tobytes()
    text = [data[a:b] for a, b in zip(own.words.start[start].tolist(), own.words.end[end - 1].tolist())]
    return _rows(part, own, start, end, gram=own.gram[key[first]].astype(np.int64), passage=text)


def _hot_windows(part: pa.RecordBatch, own: Windows, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    w = own.words.hash
    w1, w2 = grams(w, WINDOW)[found], mix(grams(mix(w, 5), WINDOW)[found], 6)
    _, once, same, count = np.unique(w1, return_index=True, return_inverse=True, return_counts=True)
    sure = found[count[same] > 1]
    first, end = _runs(sure, np.concatenate([[True] * (len(sure) > 0), (np.diff(sure) > WINDOW) | (np.diff(own.doc[sure]) != 0)]))
    yield _rows(part, own, sure[first], end)
    yield _rows(
        part, own, found[once], found[once] + WINDOW, w1=w1[once].astype(np.int64), w2=w2[once].astype(np.int64), sure=count > 1
    )


class Reference:
    """An index of the runs of words of a block: ranks of all runs of 1, 2, 4, ... 64 words.

    ``longest[i]`` is the length, up to the last level, of the longest run from word i that
    also starts elsewhere in the block: the better of its two neighbours in sorted order.
    """

    def __init__(self, tokens: np.ndarray, depth: int = 64):
        n = len(tokens)
        ranks, width = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)], 1
        while width < depth:
            last = ranks[-1]
            following = np.zeros(n, dtype=np.int64)
            following[: max(0, n - width)] = last[width:] + 1
            ranks.append(np.unique(last * (n + 2) + following, return_inverse=True)[1].astype(np.int64))
            width *= 2
        order = np.argsort(ranks[-1], kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(0, n - 1), dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            fits = (a < n) & (b < n)
            same = np.zeros(len(a), dtype=bool)
            same[fits] = ranks[level][a[fits]] == ranks[level][b[fits]]
            step = same * (1 << level)
            common, a, b = common + step, a + step, b + step
        self.longest = np.zeros(n, dtype=np.int64)
        self.longest[order[1:]] = common
        self.longest[order[:-1]] = np.maximum(self.longest[order[:-1]], common)

    def repeated(self, low: int, high: int, window: int) -> list[tuple[int, int]]:
        """Spans of words low .. high - 1 under windows that occur elsewhere, by greedy factoring."""
        spans, i = [], low
        while i < high:
            for p in range(max(low, i - window + 1), i):  # windows across the boundary at i
                if self.longest[p] >= window:
                    spans.append((p, p + window))
            length = int(min(self.longest[i], high - i))
            if length >= window:
                spans.append((i, i + length))
            i += max(1, length)
        return spans


def factor_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.reset_index(drop=True)
    w = split_words(pa.array(rows["passage"], pa.binary()).cast(pa.string()))
    lengths = np.diff(w.first)
    tokens = np.unique(w.hash, return_inverse=True)[1].astype(np.int64)
    padded = np.zeros(len(tokens) + len(rows), dtype=np.int64)
    place = np.arange(len(tokens)) + np.repeat(np.arange(len(rows)), lengths)
    padded[place] = tokens
    ends = w.first[1:] + np.arange(len(rows))
    padded[ends] = len(tokens) + 1 + np.arange(len(rows))
    index = Reference(padded)
    row, low, high = [], [], []
    for r, (start, end) in enumerate(zip((w.first[:-1] + np.arange(len(rows))).tolist(), ends.tolist())):
        for a, b in index.repeated(start, end, WINDOW):
            if low and row[-1] == r and a - start <= high[-1]:
                low[-1], high[-1] = min(low[-1], a - start), max(high[-1], b - start)
            else:
                row.append(r)
                low.append(a - start)
                high.append(b - start)
    at = rows["start"].to_numpy()[row] if row else np.zeros(0, dtype=np.int64)
    out = rows.loc[row, ID].reset_index(drop=True)
    return out.assign(low=(at + np.array(low, dtype=np.int64)).astype(np.int32), high=(at + np.array(high, dtype=np.int64)).astype(np.int32))


def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = split_words(part.column("text"))
            gone = np.zeros(len(w.start) + 1, dtype=np.int64)
            for column, sign in (("lows", 1), ("highs", -1)):
                own = part.column(column)
                np.add.at(gone, np.repeat(w.first[:-1], np.diff(own.offsets.to_numpy())) + own.flatten().to_numpy(zero_copy_only=False), sign)
            kept = np.cumsum(gone)[:-1] <= 0
            data = w.data.tobytes()
            texts, removed = [], []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                rows = np.flatnonzero(kept[a:b]) + a
                removed.append(b - a - len(rows))
                texts.append(b" ".join([data[x:y] for x, y in zip(w.start[rows].tolist(), w.end[rows].tolist())]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(w.first), pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def dedup_passages(docs: DataFrame, hot: int = HOT, block: int = BLOCK_PASSAGES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (words joined by one space) of every text.

    A word goes if a window of WINDOW words over it occurs anywhere else, in the same
    document too. Windows are those of the input.

    Only sampled n-grams move first, and their counts are combined before the shuffle. The
    passages left go to blocks of about ``block`` by their n-gram. An n-gram with more
    than ``hot`` occurrences is not gathered in a block: its windows are counted by a
    128-bit hash, combined before the shuffle, which is exact as well. Counts are written
    before they are joined, so that the adaptive join can split a hot side.

    Null and empty texts have no words. Every row is a document, so rows that repeat are
    elsewhere to one another whatever their ids; null ids are an id like others. An empty
    table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = docs.mapInArrow(emit_grams, "doc_id long, text_hash long, pos int, gram long")
    counts = staged(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "passage-grams")
    usual = F.collect_set(F.when(F.col("n") <= hot, F.col("pos"))).alias("usual")
    marks = found.join(counts, "gram").groupBy(*ID).agg(usual, F.collect_set(F.when(F.col("n") > hot, F.col("pos"))).alias("hot"))
    passages = staged(_with(docs, marks, "inner").select(*ID, "text", "usual", "hot").mapInArrow(cut_passages, PASSAGES), "passages")
    usual_ones = passages.where("passage is not null")
    blocks = max(1, -(-usual_ones.count() // block))
    dealt = usual_ones.withColumn("block", F.expr(f"pmod(xxhash64(gram), {blocks})")).select("block", *ID, "start", "passage")
    spans = dealt.groupBy("block").applyInPandas(factor_block, "doc_id long, text_hash long, low int, high int")
    single = passages.where("w1 is not null")
    often = staged(single.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.bool_or("sure").alias("known")).where("n > 1 or known"), "hot-windows")
    span = [*ID, F.col("start").alias("low"), "high"]
    spans = spans.unionByName(passages.where("passage is null and w1 is null").select(*span))
    spans = spans.unionByName(single.where("not sure").join(often.select("w1", "w2"), ["w1", "w2"], "left_semi").select(*span))
    gone = staged(spans.groupBy(*ID).agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")), "passage-spans")
    none = F.array().cast("array<int>")
    joined = _with(docs, gone, "left").select("doc_id", "text", F.coalesce("lows", none).alias("lows"), F.coalesce("highs", none).alias("highs"))
    return joined.mapInArrow(remove_spans, "doc_id long, n_words long, n_removed long, kept_text string")


def _with(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    marks = marks.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_hash", "__hash")
    return docs.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), how)


@query(
    r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, p, array_to_string(ws[p : p + 34], ' ') k from (select doc_id, ws, unnest(range(1, len(ws) - 33)) p from w)),
d as (select k from g group by k having count(*) > 1),
c as (select distinct doc_id, unnest(range(p, p + 35)) i from g where k in (from d)),
x as (select doc_id, list(i) gone from c group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda e, i: gone is null or not list_contains(gone, i)), ' '), '')) kept_sha256
from w left join x using (doc_id)
"""
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
