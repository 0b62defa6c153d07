"""Phrases of words that occur together, counted in counting quotient filters."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .stages import staged
from .words import mix, slices

LONGEST = 5
LEAST = 100
TOP = 2000
BLOCK_BYTES = 2 << 20
FILTER_GRAMS = 1 << 19  # n-grams that a task gathers before it writes a filter
BUCKET_GRAMS = 1 << 18  # n-grams of the corpus per quotient bucket, that is per merge
MASK_BITS = 26  # as a power of two, bits of a mask of frequent n-grams: 8 MB at any size of the corpus
ROUNDS = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(_BREAKS)] = 2
_BREAK = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_ODD = (np.random.RandomState(13).randint(1, 1 << 62, LONGEST).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


# --- Words ------------------------------------------------------------------------


def chunks(data: bytes, limit: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``limit`` bytes, cut at breaks only; longer where no break comes."""
    at = 0
    while len(data) - at > limit:
        found = _BREAK.search(data, at + limit)
        if found is None:
            break
        yield data[at : found.end()]
        at = found.end()
    yield data[at:]


def coded(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their counts, word numbers from 1 in text order with a 0 at each break)."""
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    kind = _KIND[raw]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = kind == 0
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    offsets = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=offsets[1:])
    letters = raw[inside[1:-1]]
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    numbers = words.dictionary_encode()
    ids = numbers.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    place = np.arange(len(ids))
    if len(ids):
        place[1:] += np.cumsum(piece[1:] != piece[:-1])
    sequence = np.zeros(place[-1] + 1 if len(ids) else 0, dtype=np.uint32)
    sequence[place] = ids + 1
    return numbers.dictionary, np.bincount(ids, minlength=len(numbers.dictionary)), sequence


def narrow(values: np.ndarray) -> bytes:
    """Numbers below 2**32, in two bytes each if they fit; the first byte tells."""
    wide = len(values) and int(values.max()) > 0xFFFF
    return b"\x04" + values.astype("<u4").tobytes() if wide else b"\x02" + values.astype("<u2").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4" if data[0] == 4 else "<u2", offset=1).astype(np.uint64)


def hashed(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """64-bit hash of each word of a language."""
    start, out = hashlib.blake2b(f"{seed}:{lang}:".encode(), digest_size=8), []
    for word in words:
        own = start.copy()
        own.update(word)
        out.append(own.digest())
    return np.frombuffer(b"".join(out), dtype="<i8")


def with_hashes(seed: int):
    """Adds ``hash`` to rows of lang and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch.column("lang").to_pylist(), batch.column("word").cast(pa.binary()).to_pylist()
            own = [hashed([word], lang, seed)[0] for lang, word in zip(langs, words)]
            yield batch.append_column("hash", pa.array(own, pa.int64()))

    return run


BLOCKS = pa.schema(
    [
        ("lang", pa.string()),
        ("words", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())),
        ("hashes", pa.list_(pa.int64())),
        ("sequence", pa.binary()),
    ]
)


def block_writer(limit: int, seed: int):
    """Texts of a task to blocks: runs of texts of one language with their own word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def block(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for data in chunks(b"\n".join(pending.pop(lang)), limit):
                words, counts, sequence = coded(data)
                if len(words):
                    hashes = hashed(words.cast(pa.binary()).to_pylist(), lang, seed)
                    lists = [pa.ListArray.from_arrays([0, len(words)], v) for v in (words, pa.array(counts), pa.array(hashes))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), *lists, pa.array([narrow(sequence)], pa.binary())], schema=BLOCKS)

        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                for lang, text in zip(part.column(0).to_pylist(), texts):
                    if text:
                        pending.setdefault(lang, []).append(text)
                        sizes[lang] = sizes.get(lang, 0) + len(text)
                        if sizes[lang] >= limit:
                            yield from block(lang)
                if sum(sizes.values()) >= 4 * limit:  # many languages with little text each
                    for lang in list(pending):
                        yield from block(lang)
        for lang in list(pending):
            yield from block(lang)

    return run


def word_ids(docs: DataFrame, least: int, block_bytes: int, mask_bits: int, id_bits: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, words, bits): texts in blocks, and (lang, word, f, id, slot) of the words that occur ``least`` times or more.

    A word's id is the head of its hash, so a task knows it without a look-up. The length
    is taken from the number of words, so that a frequent word hardly ever shares its id;
    that none does is checked over all words, rare ones included, and the hash is changed
    until it holds. So ids are as good as numbers.
    """
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("string")
    docs = docs.select(lang.alias("lang"), text.alias("text"))
    for seed in range(64):
        schema = "lang string, words array<string>, counts array<long>, hashes array<long>, sequence binary"
        blocks = staged(docs.mapInArrow(block_writer(block_bytes, seed), schema), "phrase-blocks")
        each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        counts = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
        counts = staged(counts.mapInArrow(with_hashes(seed), "lang string, word string, f long, hash long"), "phrase-words")
        every, often = counts.agg(F.count(F.lit(1)), F.count_if(F.col("f") >= least)).head()
        bits = min(63, (id_bits or max(1, every * often).bit_length() + 4) + seed)
        counts = counts.withColumn("id", F.shiftrightunsigned("hash", 64 - bits))
        shared = counts.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")).where((F.col("n") > 1) & (F.col("f") >= least))
        if shared.isEmpty():
            break
    else:
        raise RuntimeError("no hash of words without clashes was found")

    def with_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.uint64)
            yield batch.append_column("slot", pa.array(slot([ids], mask_bits).astype(np.int64)))

    frequent = counts.where(F.col("f") >= least).select("lang", "word", "f", "id")
    return blocks, staged(frequent.mapInArrow(with_slots, "lang string, word string, f long, id long, slot long"), "phrase-ids"), bits


# --- Counting quotient filters ----------------------------------------------------


def _others(columns: list[np.ndarray], but: int, seed: int, bits: int) -> np.ndarray:
    total = np.zeros(len(columns[0]), dtype=np.uint64)
    for j, column in enumerate(columns):
        if j != but:
            total += column * _ODD[j]
    return mix(total, seed) >> np.uint64(64 - bits)


def permuted(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """An invertible permutation of n-grams of ``bits``-bit ids: each id in turn is mixed with the others."""
    columns = [i.astype(np.uint64) for i in ids]
    for step in range(ROUNDS * len(columns)):
        i = step % len(columns)
        columns[i] = columns[i] ^ _others(columns, i, step + 1, bits)
    return columns


def restored(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The inverse of ``permuted``."""
    columns = list(columns)
    for step in reversed(range(ROUNDS * len(columns))):
        i = step % len(columns)
        columns[i] = columns[i] ^ _others(columns, i, step + 1, bits)
    return columns


def packed(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of ``bits`` bits side by side in 64-bit words, the first bits highest."""
    out = [np.zeros(len(columns[0]), dtype=np.uint64) for _ in range(-(-len(columns) * bits // 64))]
    for i, column in enumerate(columns):
        word, at = divmod(i * bits, 64)
        over = at + bits - 64
        if over <= 0:
            out[word] |= column << np.uint64(-over)
        else:
            out[word] |= column >> np.uint64(over)
            out[word + 1] |= column << np.uint64(64 - over)
    return out


def unpacked(words: list[np.ndarray], bits: int, count: int) -> list[np.ndarray]:
    """The inverse of ``packed``."""
    mask, out = np.uint64((1 << bits) - 1), []
    for i in range(count):
        word, at = divmod(i * bits, 64)
        over = at + bits - 64
        if over <= 0:
            out.append((words[word] >> np.uint64(-over)) & mask)
        else:
            out.append(((words[word] << np.uint64(over)) | (words[word + 1] >> np.uint64(64 - over))) & mask)
    return out


def counted(keys: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in ascending order and their counts, or the sums of their weights."""
    if len(keys) == 1 and weights is None:
        keys = [np.sort(keys[0])]
    else:
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        keys = [k[order] for k in keys]
        weights = weights[order] if weights is not None else None
    if not len(keys[0]):
        return keys, np.zeros(0, dtype=np.int64)
    first = np.ones(len(keys[0]), dtype=bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(first)
    sums = np.diff(np.append(starts, len(first))) if weights is None else np.add.reduceat(weights, starts)
    return [k[starts] for k in keys], sums


def filter_bytes(keys: list[np.ndarray], counts: np.ndarray, bits: int, bucket_bits: int) -> bytes:
    """A counting quotient filter of sorted keys of ``bits`` bits that share their first ``bucket_bits``.

    The next bits are the quotient, as many as give about one key per quotient; it is kept
    as the length of its run. The remainder is all that is left of the key, so nothing is
    lost. Counts take a byte; those from 255 on follow in full.
    """
    quotient_bits = min(max(len(counts).bit_length() - 1, 1), min(bits, 64) - bucket_bits)
    top = keys[0] << np.uint64(bucket_bits)
    quotient = (top >> np.uint64(64 - quotient_bits)).astype(np.int64) if quotient_bits else np.zeros(len(top), dtype=np.int64)
    runs = np.bincount(quotient, minlength=1 << quotient_bits)
    wide = int(runs.max()) > 255
    octets = np.stack(keys, axis=1).astype(">u8").view(np.uint8).reshape(len(counts), -1)
    rest = octets[:, (bucket_bits + quotient_bits) // 8 : -(-bits // 8)]
    big = counts[counts >= 255].astype("<u8")
    head = struct.pack("<QBBQ", len(counts), quotient_bits, wide, len(big))
    short = np.minimum(counts, 255).astype(np.uint8)
    return b"".join([head, runs.astype("<u4" if wide else "u1").tobytes(), rest.tobytes(), short.tobytes(), big.tobytes()])


def filter_keys(data: bytes, bucket: int, bits: int, bucket_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and counts of a filter: the inverse of ``filter_bytes``."""
    size, quotient_bits, wide, bigs = struct.unpack_from("<QBBQ", data)
    at = struct.calcsize("<QBBQ")
    runs = np.frombuffer(data, "<u4" if wide else "u1", 1 << quotient_bits, at)
    at += runs.nbytes
    first, last, words = (bucket_bits + quotient_bits) // 8, -(-bits // 8), -(-bits // 64)
    octets = np.zeros((size, 8 * words), dtype=np.uint8)
    octets[:, first:last] = np.frombuffer(data, np.uint8, size * (last - first), at).reshape(size, -1)
    at += size * (last - first)
    counts = np.frombuffer(data, np.uint8, size, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", bigs, at + size).astype(np.int64)
    keys = [k.astype(np.uint64) for k in octets.view(">u8").T]
    fixed = np.uint64(bucket_bits + quotient_bits)
    known = (np.uint64(bucket) << np.uint64(quotient_bits)) | np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), runs)
    if fixed:
        keys[0] = (keys[0] & ~(((np.uint64(1) << fixed) - np.uint64(1)) << (np.uint64(64) - fixed)) if fixed < 64 else np.uint64(0)) | (
            known << (np.uint64(64) - fixed)
        )
    return keys, counts


def slot(ids: list[np.ndarray], mask_bits: int) -> np.ndarray:
    """Place of an n-gram in the mask."""
    total = np.zeros(len(ids[0]), dtype=np.uint64)
    for column, odd in zip(ids, _ODD):
        total += column.astype(np.uint64) * odd
    return mix(total, 77) >> np.uint64(64 - mask_bits)


def gram_filters(length: int, bits: int, bucket_bits: int, word_mask, mask, mask_bits: int, gather: int):
    """Blocks of a task to filters of their n-grams, one per bucket for every ``gather`` n-grams.

    ``word_mask`` holds every frequent word and ``mask`` every frequent (n-1)-gram; an
    n-gram is counted if all that it consists of may be frequent. A false hit costs its
    counting, nothing else.
    """

    def held(mask, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        return (mask.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def grams(sequence: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        own = hashes.view(np.uint64) >> np.uint64(64 - bits)
        number = sequence.astype(np.int64)
        known = np.concatenate([[False], held(word_mask, slot([own], mask_bits))])[number]
        ids = np.concatenate([np.zeros(1, dtype=np.uint64), own])[number]
        count = len(ids) - length + 1
        use = np.all([known[j : count + j] for j in range(length)], axis=0)
        if mask is not None:
            hit = held(mask, slot([ids[j : count + 1 + j] for j in range(length - 1)], mask_bits))
            use &= hit[:-1] & hit[1:]
        return [ids[j : count + j][use] for j in range(length)]

    def filters(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        keys = [np.concatenate(column) for column in zip(*parts)]
        parts.clear()
        keys, counts = counted(keys)
        bucket = (keys[0] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(counts), dtype=np.int64)
        found, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(bucket))
        rows = [filter_bytes([k[a:b] for k in keys], counts[a:b], length * bits, bucket_bits) for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for data, hashes in zip(batch.column(0), batch.column(1)):
                sequence = widened(data.as_py())
                if len(sequence) < length:
                    continue
                part = grams(sequence, hashes.values.to_numpy(zero_copy_only=False).astype(np.int64))
                if len(part[0]):
                    parts.append(packed(permuted(part, bits), bits))
                    size += len(part[0])
                if size >= gather:
                    yield filters(parts)
                    size = 0
        if parts:
            yield filters(parts)

    return run


def filter_merge(length: int, bits: int, bucket_bits: int, mask_bits: int, least: int):
    """The filters of one bucket to the n-grams that occur at least ``least`` times in all."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        found = [filter_keys(data.as_py(), bucket, length * bits, bucket_bits) for data in group.column("filter")]
        keys, counts = counted([np.concatenate(k) for k in zip(*[f[0] for f in found])], np.concatenate([f[1] for f in found]))
        often = counts >= least
        ids = restored(unpacked([k[often] for k in keys], bits, length), bits)
        flat = np.stack(ids, axis=1).astype(np.int64).ravel()
        offsets = np.arange(0, len(flat) + 1, length, dtype=np.int32)
        places = slot(ids, mask_bits).astype(np.int64)
        arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(counts[often]), pa.array(places)]
        return pa.Table.from_arrays(arrays, names=["ids", "f", "slot"])

    return run


def mask_of(grams: DataFrame, mask_bits: int):
    """The mask of the places of ``grams`` on every executor, or None without any.

    The driver receives at most one row per 64 bits of the mask, whatever the corpus.
    """
    words = grams.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    rows = words.toArrow()
    if not rows.num_rows:
        return None
    mask = np.zeros(1 << mask_bits >> 6, dtype="<i8")
    mask[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return grams.sparkSession.sparkContext.broadcast(mask.view(np.uint8))


# --- Phrases ----------------------------------------------------------------------


def phrase_counts(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    block_bytes: int = BLOCK_BYTES,
    filter_grams: int = FILTER_GRAMS,
    bucket_grams: int = BUCKET_GRAMS,
    mask_bits: int = MASK_BITS,
    id_bits: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): words with ids, (ids, f) of every phrase of 2 to ``longest`` words, words per language.

    Only phrases that occur at least ``least`` times are kept, so their parts are too: a
    word that is rarer ends a run of words, and an n-gram is counted only if the
    (n-1)-grams at its ends may be frequent. What may be frequent is told by a mask of
    fixed size, which has no false misses.

    A task turns its texts into blocks; the distinct words of a block are counted. Then
    each task counts its n-grams in filters, cut by the first bits of the permuted n-gram,
    and the filters of a bucket are merged. The permutation spreads n-grams evenly, and a
    frequent one is in a filter once, so buckets are even; their number grows with the
    corpus.
    """
    blocks, words, bits = word_ids(docs, least, block_bytes, mask_bits, id_bits)
    in_block = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    totals = staged(blocks.groupBy("lang").agg(F.sum(in_block).alias("n")), "phrase-totals")
    total = totals.agg(F.sum("n")).head()[0] or 0
    bucket_bits = min(max(-(-total // bucket_grams) - 1, 0).bit_length(), 2 * bits, 32)
    word_mask, mask, phrases = mask_of(words, mask_bits), None, []
    if word_mask is None:
        return words, words.select(F.array("id").alias("ids"), "f").where("false"), totals
    for length in range(2, longest + 1):
        filters = blocks.select("sequence", "hashes").mapInArrow(
            gram_filters(length, bits, bucket_bits, word_mask, mask, mask_bits, filter_grams), "bucket long, filter binary"
        )
        merged = filters.groupBy("bucket").applyInArrow(
            filter_merge(length, bits, bucket_bits, mask_bits, least), "ids array<long>, f long, slot long"
        )
        merged = staged(merged, "phrase-grams")
        phrases.append(merged.select("ids", "f"))
        if length < longest:
            mask = mask_of(merged, mask_bits)
            if mask is None:
                break
    found = phrases[0]
    for more in phrases[1:]:
        found = found.unionByName(more)
    return words, found, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **sizes: int) -> DataFrame:
    """Each language's ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into
    words ``[^\\x20\\x09]+``. A phrase of 2 to ``longest`` words that occurs a >= ``least``
    times is scored by the cut that scores lowest, the first of equals: floor(1000 * a * n
    / (l * r)), with l and r the counts of its parts and n all words of the language. A
    phrase inside a longer one of the same count goes; as counts only fall with length, it
    is enough to look one word further.

    A null language is ``und``, a null text empty. Repeated rows count as often as they
    are there. Ties of score and count go by the phrase in UTF-8 order. An empty table, or
    one without a frequent phrase, gives no rows. Very long texts are cut at breaks; other
    columns are not read.
    """
    words, phrases, totals = phrase_counts(docs, least, longest, **sizes)
    counts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    counts = staged(counts.withColumn("size", F.size("ids")), "phrase-counts")
    candidates = counts.where("size > 1")

    cuts = candidates.select("ids", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("head", F.expr("slice(ids, 1, k)")).withColumn("tail", F.expr("slice(ids, k + 1, size(ids) - k)"))
    cuts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    language = words.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("first", F.expr("ids[0]")).join(language, "first")
    wide = "cast({} as decimal(38, 0))".format
    score = F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "n", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where("size > 2").select("f", F.explode(F.expr("array(slice(ids, 1, size - 1), slice(ids, 2, size - 1))")).alias("part"))
    inside = (F.col("ids") == F.col("part")) & (F.col("a") == F.col("f"))
    kept = scored.join(longer.distinct(), inside, "left_anti").select("lang", "n", "ids", "a", "cut.score", "cut.l", "cut.r")
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    kept = staged(kept.withColumn("near", F.rank().over(near)).where(F.col("near") <= top), "phrase-top")

    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("own"))
    spelled = spelled.select("ids", F.array_join(F.transform("own", lambda w: w["word"]), " ").alias("phrase"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = kept.join(spelled, "ids").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


@query(
    f"""
with d as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') ws from d),
t as (select lang, sum(len(ws))::bigint n from w group by lang),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) i from w),
g as materialized (select lang, p, count(*) f from (
        select lang, ws[i:i + k - 1] p from s, range(1, {LONGEST + 1}) x(k) where i + k - 1 <= len(ws)) group by lang, p),
v as materialized (select {{'l': lang, 'p': p}} key, f from g where f >= {LEAST}),
c as materialized (select * from g where len(p) > 1 and f >= {LEAST}),
x as materialized (select lang, p, f a, k, {{'l': lang, 'p': p[1:k]}} head, {{'l': lang, 'p': p[k + 1:]}} tail from c, range(1, {LONGEST}) x(k) where k < len(p)),
u as (select x.lang, x.p, a, k, l.f l, r.f r, t.n, (1000::hugeint * a * t.n) // (l.f::hugeint * r.f) score
      from x join t using (lang) join v l on l.key = head join v r on r.key = tail),
b as (select * from u qualify row_number() over (partition by lang, p order by score, k) = 1),
o as (select distinct lang, p[i:j] p, f from c, range(1, {LONGEST + 1}) x(i), range(1, {LONGEST + 1}) y(j)
      where i < j and j <= len(p) and j - i + 1 < len(p)),
k as (select b.* from b where not exists (select 1 from o where o.lang = b.lang and o.p = b.p and o.f >= b.a)),
r as (select *, array_to_string(p, ' ') phrase from k)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score::bigint score
from r qualify rank <= {TOP}
"""
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
