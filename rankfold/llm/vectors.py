"""Helpers for tables of vectors: which rows count, exact cosine, shards and query blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> Column:
    """Not null or empty, no null, NaN or infinite component, not all zero."""
    inf = "cast('Infinity' as double)"
    return F.coalesce(
        F.expr(
            f"size({embedding}) > 0 and forall({embedding}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < {inf})"
            f" and exists({embedding}, x -> x <> 0)"
        ),
        F.lit(False),
    )


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit(vectors: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Vectors of length one, in float32 by default, scaled first so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(kind)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of matching rows in double precision; equal pairs give equal values."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def part_of(key: str, salt: int, parts: str) -> Column:
    """A part number from 0 to ``parts`` - 1 that depends on the key alone."""
    return F.expr(f"cast(pmod(xxhash64({key}, {salt}), {parts}) as int)")


def pack_blocks(rows: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """One row per block: its keys and vectors as binary arrays."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in by) + f", {name}_ids binary, {name}_vectors binary"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        head = {c: [group[c].iloc[0]] for c in by}
        return pd.DataFrame({**head, f"{name}_ids": [group[key].to_numpy(np.int64).tobytes()], f"{name}_vectors": [matrix(group["embedding"]).tobytes()]})

    return rows.select(*by, key, "embedding").groupBy(*by).applyInPandas(run, schema)


def unpacked(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, dtype=np.int64)
    return own, np.frombuffer(vectors, dtype=np.float64).reshape(len(own), -1)
