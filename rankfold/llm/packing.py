"""Cost-balanced packing of token sequences.

Documents become token ids, are cut at the capacity, and the pieces are dealt to
sequences by estimated attention cost. One pass, no shuffle: a task packs its rows in
pools of bounded size, so memory does not depend on the table or on a hot source.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .registry import query, table

CAPACITY = 2048
POOL_TOKENS = 4_000_000
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
SEQUENCES_OF_A_TASK = 1 << 36
_NONE = (float("inf"), 0, 0)

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("cost", pa.float64()),
    ]
)


def load_encoding(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level vocabulary, loaded in the task from the installed file."""
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
    )


class Sequences:
    """Open sequences by remaining capacity; the cheapest one that holds a length is found in a tree over capacities.

    A leaf is a heap of the (cost, number) of the sequences with that much room, an inner
    node the least below it.
    """

    def __init__(self, count: int, capacity: int):
        self.capacity, self.size = capacity, 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least = [_NONE] * (2 * self.size)
        self.heaps[capacity] = [(0.0, s) for s in range(count)]
        self._update(capacity)

    def _update(self, room: int) -> None:
        at = self.size + room
        heap, least = self.heaps[room], self.least
        least[at] = (*heap[0], room) if heap else _NONE
        while at > 1:
            at //= 2
            least[at] = min(least[2 * at], least[2 * at + 1])

    def put(self, cost: float, number: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, number))
        self._update(room)

    def take(self, length: int) -> tuple[float, int, int] | None:
        """(cost, number, room) of the cheapest sequence with room for ``length``, which is removed; None without one."""
        best, at, end = _NONE, self.size + length, 2 * self.size
        while at < end:
            if at & 1:
                best = min(best, self.least[at])
                at += 1
            at, end = at // 2, end // 2
        if best is _NONE:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._update(best[2])
        return best


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Deal documents to sequences: (document, start, length, sequence, offset) per piece.

    Full-capacity pieces of long documents take sequences of their own. The rest go, in
    descending length, to the sequence of lowest estimated cost (linear plus quadratic in
    the piece lengths, of equal ones the first) that still holds them. A piece that none
    holds is cut to fill the cheapest one with room, and its rest is dealt on. There are
    as many sequences as the tokens need, so only their sum's remainder is padding.
    """
    pieces, sequences, rest = [], 0, []
    for document, length in enumerate(lengths.tolist()):
        full, tail = divmod(length, capacity)
        for i in range(full):
            pieces.append((document, i * capacity, capacity, sequences, 0))
            sequences += 1
        if tail:
            rest.append((-tail, document, full * capacity))
    heapq.heapify(rest)
    held = Sequences(-(-sum(-r[0] for r in rest) // capacity), capacity)
    while rest:
        negative, document, start = heapq.heappop(rest)
        length = -negative
        cost, s, room = held.take(length) or held.take(1)
        taken = min(length, room)
        pieces.append((document, start, taken, sequences + s, capacity - room))
        if taken < room:
            held.put(cost + LINEAR * taken + QUADRATIC * taken * taken, s, room - taken)
        if taken < length:
            heapq.heappush(rest, (taken - length, document, start + taken))
    return pieces


class Encoder:
    """Ids of a text by the fast form of the vocabulary, or by the plain one where that can't tell.

    The fast one gives up on runs of white space of about 700,000 characters; both give the same ids.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary, self.fast, self.plain = vocabulary, load_encoding(vocabulary), None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:
            if self.plain is None:
                self.plain = Tokenizer.from_file(public_tokenizers.path(self.vocabulary.removesuffix(".tiktoken") + ".json"))
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")


def packer(vocabulary: str, capacity: int, pool_tokens: int):
    def packed(ids: list, tokens: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        pieces = assign(np.array([len(t) for t in tokens]), capacity)
        rows = [
            (ids[d], start, length, zlib.crc32(tokens[d][start : start + length].data), len(tokens[d]), base + s, at, LINEAR * length + QUADRATIC * length * length)
            for d, start, length, s, at in pieces
        ]
        arrays = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), SCHEMA)]
        return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA), base + 1 + max(p[3] for p in pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        end = np.array([END_ID], dtype="<u4")
        ids, tokens, size = [], [], 0
        base = TaskContext.get().partitionId() * SEQUENCES_OF_A_TASK
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own = np.concatenate([encoder.ids(text.as_py() or ""), end])
                ids.append(doc_id.as_py())
                tokens.append(own)
                size += len(own)
                if size >= pool_tokens:
                    out, base = packed(ids, tokens, base)
                    yield out
                    ids, tokens, size = [], [], 0
        if ids:
            yield packed(ids, tokens, base)[0]

    return run


def pack_sequences(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    capacity: int = CAPACITY,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """One row per piece of a document: where it starts, how long it is, its sequence and offset.

    Token ids are those of the vocabulary with its special token, then id 1 as the end.
    ``cost`` is the piece's estimated attention cost. Null and empty texts are the end id
    alone. Texts of any length are encoded whole, runs of white space too. Repeated rows
    and null ids are packed like others; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not read. Sequence ids count on
    within a task and leave gaps between tasks; they repeat on a rerun as long as the
    input deals the same rows to its partitions, as files do.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
    return docs.select("doc_id", "text").mapInArrow(packer(vocabulary, capacity, pool_tokens), schema)


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"))
