"""Numeric column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finish codes and the number each stands for.
FINISH_CODES = {
    15.0: ("DAI", "DISTANTE", "DIST"),
    16.0: ("ARR", "ARRETE", "STOPPED"),
    17.0: ("TOMBE", "FALLEN"),
    18.0: ("NP", "NON_PARTANT", "DID_NOT_START"),
}
MISSING_TEXTS = ("", "N/A", "NULL")
UNKNOWN_TEXT_VALUE = 12.0
EARNINGS_CEILING = 1_000_000.0
RAIL_WORDS = {
    -1.0: ("gauche", "left"),
    99.0: ("droite", "right"),
    50.0: ("milieu", "middle", "centre", "center"),
}


def to_double(column: Column) -> Column:
    """Text or number to double; what does not parse becomes null."""
    return column.try_cast("double")


def number_or_code(column: Column, default: float | None = 0.0) -> Column:
    """Number, or the number a finish code stands for."""
    text = F.upper(F.trim(column.cast("string")))
    out = F.when(text.isNull() | text.isin(*MISSING_TEXTS), F.lit(default).cast("double"))
    for value, codes in FINISH_CODES.items():
        out = out.when(text.isin(*codes), F.lit(value))
    return out.otherwise(F.coalesce(to_double(text), F.lit(UNKNOWN_TEXT_VALUE)))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also for null)."""
    return F.when(condition, 1.0).otherwise(0.0)


def ratio(numerator: Column, denominator: Column, default: float | Column = 0.0) -> Column:
    """Quotient where the denominator is positive, else the default."""
    fallback = default if isinstance(default, Column) else F.lit(float(default))
    return F.when(denominator > 0, numerator / denominator).otherwise(fallback)


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Quotient, or the default for a zero or missing denominator or a non-finite result."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(float(default))).otherwise(value)


def clamp(column: Column, low: float | Column, high: float | Column) -> Column:
    """Value held between two bounds; null stays null."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(column.isNotNull(), F.greatest(low, F.least(high, column)))


def earnings_quality(earnings: Column, starts: Column, ceiling: float = EARNINGS_CEILING) -> Column:
    """Earnings per start on a log scale between 0 and 1."""
    per_start = F.least(F.greatest(earnings, F.lit(0.0)) / starts, F.lit(ceiling))
    scaled = F.log1p(per_start) / F.log1p(F.lit(ceiling))
    return F.when(starts > 0, clamp(scaled, 0, 1)).otherwise(0.0)


def bucket(column: Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = True) -> Column:
    """Label of the interval a value falls in; outside or null gives null."""
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        if right_closed:
            inside = (column > low) & (column <= high)
        else:
            inside = (column >= low) & (column < high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def money(column: Column) -> Column:
    """Amount text such as '12 500,00' without blanks and commas, as a number."""
    return F.coalesce(to_double(F.regexp_replace(column.cast("string"), "[\\s,]", "")), F.lit(0.0))


def rail_code(column: Column) -> Column:
    """Rail draw: a number, or a word for inside, outside and middle; else 0."""
    text = F.lower(F.trim(column.cast("string")))
    word = F.lit(None).cast("double")
    for value, words in RAIL_WORDS.items():
        word = F.coalesce(word, F.when(text.isin(*words), F.lit(value)))
    # Parsing text without a number raises an exception inside, which costs more than all the rest of a row.
    number = F.when(text.rlike(r"[0-9]|inf|nan"), to_double(text))
    return F.coalesce(word, number, F.lit(0.0))


def correlation(first: str, second: str) -> Column:
    """Aggregate: Pearson correlation; null when a side is constant, in every SQL mode."""
    a = F.when(F.col(second).isNotNull(), F.col(first).cast("double"))
    b = F.when(F.col(first).isNotNull(), F.col(second).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
