"""Nested race records: participants as an array, and order strings.

An array holds at most ``CHUNK`` entries. A larger race continues in further
rows numbered by ``part``, so no task builds an unbounded array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

CHUNK = 10_000


def _part(number: str, chunk: int) -> Column:
    return F.floor((F.col(number) - 1) / chunk).cast("long")


def nest(df: DataFrame, keys: Sequence[str], number: str, fields: Sequence[str], name: str, chunk: int = CHUNK) -> DataFrame:
    """(keys…, part, array of structs) ordered by the row number ``number``."""
    entry = F.struct(F.col(number), *[F.col(f) for f in fields if f != number])
    return (
        df.groupBy(*keys, _part(number, chunk).alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias(name))
    )


def unnest(df: DataFrame, array: str, prefer: str = "race", computed: bool = False) -> DataFrame:
    """One row per array entry. On a name clash the race column or the entry wins.

    Below a plain explode the optimizer asks for arrays with entries as early as it can, in a join below at worst. That
    spares reading a stored array, but an array that is ``computed`` from text would be parsed there again for each mention.
    """
    entry_fields = df.schema[array].dataType.elementType.names
    race_fields = [c for c in df.columns if c != array]
    if computed:
        exploded = df.select(*race_fields, F.posexplode_outer(array).alias("__place", "__entry")).where(F.col("__place").isNotNull())
    else:
        exploded = df.select(*race_fields, F.explode(array).alias("__entry"))
    if prefer == "race":
        entry_fields = [f for f in entry_fields if f not in race_fields]
    elif prefer == "entry":
        race_fields = [c for c in race_fields if c not in entry_fields]
    else:
        raise ValueError(f"prefer must be 'race' or 'entry', not {prefer!r}")
    return exploded.select(*race_fields, *[F.col(f"__entry.{f}").alias(f) for f in entry_fields])


def parse_nested(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Nested JSON text to an array: a list, a single object or {participants: [...]}."""
    text = F.trim(F.col(column))
    listed = F.from_json(text, f"array<struct<{schema}>>")
    names = DataType.fromDDL(f"struct<{schema}>").names
    if "participants" in [n.lower() for n in names]:
        wrapped = F.from_json(text, f"participants array<struct<{schema}>>")["participants"]
        parsed = F.when(text.startswith("["), listed).when(wrapped.isNotNull(), wrapped)
        parsed = parsed.when(text.startswith("{"), F.array(F.from_json(text, f"struct<{schema}>")))
        return df.withColumn(column, parsed)
    # An object is read once, as both shapes. With an option its fields stay one reading, else each became its own.
    both = F.when(~text.startswith("["), F.from_json(text, f"struct<participants: array<struct<{schema}>>, {schema}>", {"mode": "PERMISSIVE"}))
    wrapped, single = F.col("__object")["participants"], F.struct(*[F.col("__object")[n].alias(n) for n in names])
    df = df.withColumn("__object", both)
    parsed = F.when(text.startswith("["), listed).when(wrapped.isNotNull(), wrapped).when(text.startswith("{"), F.array(single))
    return df.withColumn(column, parsed).drop("__object")


def order_strings(
    df: DataFrame, keys: Sequence[str], rank: str, number: str, name: str, top: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Order string per group, '4-7-1'. With ``top`` only the leading entries."""
    entry = F.struct(F.col(rank).alias("r"), F.col(number).alias("n"))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["n"].cast("string")), "-"
    ).alias(name)
    if top is not None:
        return df.where(F.col(rank) <= top).groupBy(*keys).agg(joined)
    return df.groupBy(*keys, _part(rank, chunk).alias("part")).agg(joined)
