"""Toxicity by a linear classifier over character n-grams scaled by log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .language import held_out
from .registry import query, table
from .stages import staged
from .words import mix, slices

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
POSITIVES, NEGATIVES, CHARACTERS = 2000, 4000, 6000
BUDGETS = {1: POSITIVES * CHARACTERS, 0: NEGATIVES * CHARACTERS}
ROUNDS, RATE, PENALTY = 60, 0.03, 1e-5
CHUNK = 1 << 20
SPARE = 4
THRESHOLD = 0.3


def features(text: str | None, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """The distinct hashed byte n-grams of the lower-cased text between two spaces."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)
    seen = np.zeros(buckets, dtype=bool)
    rolled = raw + np.uint64(1)
    for length in range(2, max(orders) + 1):
        if len(raw) < length:
            break
        rolled = rolled[:-1] * np.uint64(257) + raw[length - 1 :] + np.uint64(1)
        if length in orders:
            seen[mix(rolled, length) & np.uint64(buckets - 1)] = True
    return np.flatnonzero(seen)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = float(self.weights[features(text, buckets=len(self.weights))].sum()) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


def fit(texts: list[str | None], labels: list[int], odds: float | None = None, buckets: int = BUCKETS, rounds: int = ROUNDS) -> Model:
    """Logistic regression on presence features, each scaled by its naive Bayes log-count ratio.

    Adagrad over the whole sample, a fixed number of rounds. ``odds`` of label 1 among all
    labelled rows correct the bias for a sample that holds another share. Without both
    labels the model gives the share of label 1 (one half without rows).
    """
    y = np.array(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros(buckets), float(np.log(share / (1 - share))))
    own = [features(t, buckets=buckets).astype(np.int32) for t in texts]
    row = np.repeat(np.arange(len(own), dtype=np.int32), [len(f) for f in own])
    column = np.concatenate(own)
    del own
    chunks = [slice(i, i + CHUNK) for i in range(0, len(row), CHUNK)]
    p = 1.0 + sum(np.bincount(column[c], weights=y[row[c]], minlength=buckets) for c in chunks)
    q = 2.0 + sum(np.bincount(column[c], minlength=buckets) for c in chunks) - p
    ratio = np.log((p / (y.sum() + 2)) / (q / ((1 - y).sum() + 2)))
    w, squares, b, b_squares = np.zeros(buckets), np.full(buckets, 1e-12), 0.0, 1e-8
    for _ in range(rounds):
        scaled = w * ratio
        z = sum(np.bincount(row[c], weights=scaled[column[c]], minlength=len(y)) for c in chunks) + b
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))) - y) / len(y)
        gradient = ratio * sum(np.bincount(column[c], weights=error[row[c]], minlength=buckets) for c in chunks) + PENALTY * w
        squares += gradient * gradient
        b_squares += error.sum() ** 2
        w -= RATE * gradient / np.sqrt(squares)
        b -= 0.1 * error.sum() / np.sqrt(b_squares)
    if odds is not None:
        b += float(np.log(odds * (1 - y).sum() / y.sum()))
    return Model(w * ratio, b)


def within_budget(rows: list[Row], most: int, budget: int | None) -> list[Row]:
    """The first ``most`` rows by their draw, or fewer once their characters have used the budget."""
    taken, used = [], 0
    for row in sorted(rows)[:most]:
        if budget is not None and used >= budget:
            break
        taken.append(row)
        used += row.characters
    return taken


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    longest: int | None = CHARACTERS,
    budgets: dict[int, int] | None = None,
) -> tuple[list[str], list[int], float | None]:
    """Texts, labels and the odds of label 1 among all labelled rows; at most
    ``positives`` and ``negatives`` texts, those of the smallest hashes of their ids.

    Texts are never cut, as their label may rest on any part. ``longest`` leaves longer
    ones out whole, which op7 doesn't do: ``budgets`` holds a total of characters for each
    label, and rows are taken in the order of their hashes, long ones whole, until it is
    used. The driver receives the budgets and one text more for each label, or (positives
    + negatives) x ``longest``. Ids are chosen first and only their texts move: a draw by
    hash leaves a few times the sample, and the chosen ids, at most positives + negatives,
    are broadcast to the scan. An id that repeats gives its least text.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    if longest is not None:
        usable = usable.where(F.char_length("text") <= longest)
    sizes = usable.select("doc_id", F.char_length("text").alias("characters")).groupBy("doc_id").agg(F.max("characters").alias("characters"))
    known = staged(marked.join(sizes, "doc_id"), "toxicity-labels")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most, slots = {1: positives, 0: negatives}, 1 << 20
    near = F.lit(False)
    for label, count in counts.items():
        share = max(1, min(slots, SPARE * most[label] * slots // count))
        near = near | ((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share))
    drawn = known.where(near).select(F.xxhash64("doc_id").alias("draw"), "doc_id", "toxic", "characters").collect()
    chosen = {
        r.doc_id: int(r.toxic)
        for label in (1, 0)
        for r in within_budget([r for r in drawn if r.toxic == label], most[label], (budgets or {}).get(label))
    }
    if not chosen:
        return [], [], None
    ids = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    odds = counts[1] / counts[0] if len(counts) == 2 else None
    return [r.text for r in sorted(rows)], [chosen[r.doc_id] for r in sorted(rows)], odds


def scorer(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                scores = [model.score(t) for t in part.column("text").to_pylist()]
                predicted = [int(s >= threshold) for s in scores]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())],
                    names=[*part.schema.names[:-1], "score", "predicted"],
                )

    return run


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every whole text, from the text alone.

    The model travels with the task closure (2 MB, whatever the data). Null and empty
    texts score what the bias and the padding give. Repeated rows score alike; an empty
    table gives no rows; other columns are not read.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.mapInArrow(scorer(model, threshold), "doc_id long, score double, predicted int")


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_sample(docs.where(~held_out()), table(spark, sf_dir, "labels"), longest=None, budgets=BUDGETS))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
