"""Token counts under a unigram vocabulary, by dynamic programming over a shared trie.

Distinct pre-tokens of a task are sorted, which walks their trie depth first: the best
score and token count of every prefix stay on a stack, and a pre-token reuses those of
the prefix it shares with the one before. Terminal counts are kept and summed by
document. Nothing is shuffled, as the distinct words of a corpus grow with it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .words import slices

MARK = "▁"
KNOWN_LIMIT = 300_000
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def unigram_scores(model: str) -> dict[str, float]:
    """Log-probability of each ordinary piece, from its rank by Zipf's law.

    The file holds merge ranks and no probabilities; rank r gets -log(r + 2).
    """
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    kept = [pieces.id_to_piece(i) for i in range(len(pieces)) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
    return {piece: -math.log(rank + 2.0) for rank, piece in enumerate(kept)}


class SharedForward:
    """Forward scores of pre-tokens; each prefix that sorted pre-tokens share is scored once.

    A character that no piece covers costs one token per UTF-8 byte, at ``fallback`` each.
    Of equal scores, the longest last piece wins.
    """

    def __init__(self, scores: dict[str, float], fallback: float = -20.0):
        self.scores, self.fallback = scores, fallback
        self.longest = max(map(len, scores), default=1)
        self.steps = 0

    def counts(self, pretokens) -> dict[str, int]:
        out, best, tokens, last = {}, [0.0], [0], ""
        get, longest = self.scores.get, self.longest
        for word in sorted(pretokens):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top, count = best[end - 1] + size * self.fallback, tokens[end - 1] + size
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    own = get(word[start:end])
                    if own is not None and best[start] + own >= top:
                        top, count = best[start] + own, tokens[start] + 1
                best.append(top)
                tokens.append(count)
            self.steps += len(word) - shared
            out[word] = tokens[-1]
            last = word
        return out


def counter(model: str, fallback: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, known = SharedForward(unigram_scores(model), fallback), {}
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = [_SPACES.split(t) if t else [] for t in part.column("text").to_pylist()]
                new = set().union(*texts) - known.keys() - {""}
                if len(known) + len(new) > KNOWN_LIMIT:
                    known, new = {}, set().union(*texts) - {""}
                known |= {w[1:]: n for w, n in forward.counts(MARK + w for w in new).items()}
                known[""] = 0
                n_words = [sum(map(bool, t)) for t in texts]
                n_tokens = [sum(map(known.__getitem__, t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    return run


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", fallback: float = -20.0) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text under the best unigram segmentation.

    Pre-tokens are the words between ASCII white space, each with a leading mark. Null and
    empty texts have 0 of both. Rows stay as they are, repeated ones too; an empty table
    gives no rows; other columns are not read.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.mapInArrow(counter(model, fallback), "doc_id long, n_words long, n_tokens long")


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
