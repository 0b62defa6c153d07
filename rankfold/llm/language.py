"""Language identification by compression with raw-content dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table

SAMPLE_DOCUMENTS = 300
SPARE = 4
SAMPLE_CHARACTERS = 1500
DICTIONARY_BYTES = 1 << 19
CHUNK_BYTES = 1024
# A window as long as a dictionary, and tables small enough to be cleared for every chunk.
PARAMETERS = zstandard.ZstdCompressionParameters(
    strategy=zstandard.STRATEGY_GREEDY, window_log=19, hash_log=17, chain_log=16, search_log=3, min_match=4
)
MARGIN = 0.01
EVIDENCE = 40
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, with one space for whatever lies between letters."""
    return _OTHER.sub(" ", text.lower())


def held_out() -> F.Column:
    """Rows kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_dictionaries(
    docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, characters: int = SAMPLE_CHARACTERS, size: int = DICTIONARY_BYTES
) -> dict[str, bytes]:
    """Raw dictionary content per language, from a bounded sample of the labelled rows.

    Each non-null ``lang`` gives the texts of its ``documents`` smallest hashes, one piece
    of at most ``characters`` from a place that the hash picks; the sample is at most
    languages x documents x characters and goes to the driver. A first draw by hash leaves
    a few times the sample of each language, so its window does not grow with the table.
    Languages come in descending number of rows, which decides between equal sizes.
    """
    counts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    texts: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    if not texts:
        return {}
    slots = 1 << 20  # the share of slots that leaves about SPARE times the sample of each language
    share = {r["lang"]: max(1, min(slots, (SPARE * documents * slots) // r["count"])) for r in counts}
    shares = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
    order = Window.partitionBy("lang").orderBy("draw", "text")
    sample = (
        docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
        .where(F.pmod(F.col("draw"), F.lit(slots)) < shares[F.col("lang")])
        .withColumn("from", F.expr(f"1 + pmod(draw, greatest(char_length(text) - {characters} + 1, 1))"))
        .select("lang", "draw", F.substring("text", F.col("from").cast("int"), F.lit(characters)).alias("text"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= documents)
        .select("lang", "place", "text")
    )
    for row in sorted(sample.collect()):
        texts.setdefault(row.lang, []).append(letters(row.text))
    return {lang: "\n".join(own).encode()[-size:] for lang, own in texts.items() if own}


class Compressors:
    """Compressed size of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], chunk: int = CHUNK_BYTES):
        self.languages, self.chunk, self.own = list(dictionaries), chunk, []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=PARAMETERS)
            self.own.append(zstandard.ZstdCompressor(dict_data=content, compression_params=PARAMETERS))

    def sizes(self, text: str) -> np.ndarray:
        """The whole text in chunks, so that what it repeats itself doesn't hide the dictionary."""
        data = letters(text).encode("utf-8", "surrogatepass")
        chunks = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        return np.array([sum(len(c.compress(x)) for x in chunks) for c in self.own], dtype=np.float64)

    def choose(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected.

        The score is 1 - best / second-best size, scaled so that a quarter saved gives 1.
        """
        if not text or not self.own or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        narrow = margin if len(text) >= EVIDENCE else 0.0
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.languages[0], 1.0, False
        saved = 1.0 - sizes[best] / np.partition(sizes, 1)[1]
        return self.languages[best], float(min(1.0, 4.0 * saved)), bool(saved < narrow)


def predictor(dictionaries: dict[str, bytes], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(dictionaries)
        for batch in batches:
            found = [compressors.choose(t, margin) for t in batch.column(batch.num_columns - 1).to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            added = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "lang_pred", "score", "lang_rejected"])

    return run


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with lang_pred, score and lang_rejected, from the text alone.

    A null text or one without a letter is ``und`` with score 0 and rejected; so is a text
    of EVIDENCE characters or more whose best dictionary saves less than ``margin`` over
    the second (its language is still given; shorter texts are too little to reject them
    by). Equal sizes take the first dictionary given. Without any dictionary every text is
    ``und``. Columns of ``keep`` that have a new column's name give
    way to it.
    """
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "lang_rejected")]
    docs = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[: len(keep)])
    return docs.mapInArrow(predictor(dictionaries, margin), f"{schema}, lang_pred string, score double, lang_rejected boolean")


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_dictionaries(docs.where(~held_out()))
    return identify_language(docs, dictionaries).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")
