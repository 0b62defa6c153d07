"""Text column parsers: race times, handicap conditions, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import to_double

# The three accepted spellings of a race time.
TIME_PATTERNS = (
    r"^\s*(\d+)'(\d+)\"(\d+)",
    r"^\s*(\d+):(\d+)\.(\d+)",
    r"^\s*(\d+)\.(\d+)\.(\d+)",
)

# Handicap wording and scores.
HANDICAP_DIVISIONS = {"première": 1, "deuxième": 2, "troisième": 3, "quatrième": 4}
CATEGORY_HANDICAP_TEXTS = ("handicap de catégorie", "handicap de categorie")
CATEGORY_HANDICAP_SCORE = 1000
STANDARD_HANDICAP_SCORE = 500
HANDICAP_DIVISION_SCORES = {0: 150, 1: 200, 2: 100, 3: 50, 4: 25}
HANDICAP_LABELS = (
    (1100, "Category Handicap - Premier Division"),
    (1050, "Category Handicap - Undivided"),
    (1025, "Category Handicap - Lower Division"),
    (700, "Standard Handicap - Premier Division"),
    (650, "Standard Handicap - Undivided"),
    (525, "Standard Handicap - Lower Division"),
)
NO_HANDICAP_LABEL = "Non-Handicap Race"

# Discipline names of a race and their one-letter codes.
DISCIPLINES = {
    "attelé": "A",
    "monté": "M",
    "plat": "P",
    "haies": "H",
    "steeple-chase": "S",
    "trot": "T",
    "cross-country": "C",
}


def clean_text(column: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(F.trim(column.cast("string")), F.lit(""))


def blank_to_null(column: Column) -> Column:
    return F.when(F.trim(column) == "", None).otherwise(column)


def race_time_seconds(column: Column) -> Column:
    """Seconds of a time such as 2'42"53, 2:42.53 or 2.42.53; other text gives null."""
    readings = []
    for pattern in TIME_PATTERNS:
        part = lambda i: F.regexp_extract(column, pattern, i).try_cast("double")
        readings.append(part(1) * 60 + part(2) + part(3) / 100)
    return F.coalesce(*readings)


def race_time_millis(column: Column, last_group: str = "hundredths") -> Column:
    """Milliseconds of a record time. The last group reads as hundredths or as tenths."""
    scale = {"hundredths": 10, "tenths": 100}[last_group]
    readings = []
    for pattern in TIME_PATTERNS:
        part = lambda i: F.regexp_extract(column, pattern, i).try_cast("long")
        readings.append(part(1) * 60_000 + part(2) * 1_000 + part(3) * scale)
    return F.coalesce(*readings)


def handicap_columns(column: Column) -> dict[str, Column]:
    """Flags, division and level score of a handicap condition text."""
    text = F.lower(clean_text(column))
    handicap = F.contains(text, F.lit("handicap"))
    category = F.lit(False)
    for phrase in CATEGORY_HANDICAP_TEXTS:
        category = category | F.contains(text, F.lit(phrase))
    division = F.coalesce(
        *[F.when(F.contains(text, F.lit(word)), F.lit(number)) for word, number in HANDICAP_DIVISIONS.items()],
        F.lit(0),
    )
    division = F.when(handicap, division).otherwise(0)
    bonus = F.coalesce(*[F.when(division == number, F.lit(s)) for number, s in HANDICAP_DIVISION_SCORES.items()])
    base = F.when(category, CATEGORY_HANDICAP_SCORE).otherwise(STANDARD_HANDICAP_SCORE)
    return {
        "is_handicap": handicap,
        "is_category_handicap": category,
        "handicap_division": division,
        "handicap_level_score": F.when(handicap, base + bonus).otherwise(0),
    }


def handicap_label(score: Column) -> Column:
    """Prestige label of a level score."""
    return F.coalesce(*[F.when(score >= floor, F.lit(label)) for floor, label in HANDICAP_LABELS], F.lit(NO_HANDICAP_LABEL))


def keyword_class(column: Column, keywords: dict[str, int], default: int = 0) -> Column:
    """Number of the first keyword found in the text."""
    text = F.lower(clean_text(column))
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(n)) for w, n in keywords.items()], F.lit(default))


def discipline_code(column: Column, strict: bool = False) -> Column:
    """One-letter discipline of a code or name. Unknown names give null, or fail when strict."""
    text = F.lower(F.trim(column))
    codes = sorted(set(DISCIPLINES.values()))
    out = F.when(F.upper(text).isin(*codes), F.upper(text))
    for name, code in DISCIPLINES.items():
        out = out.when(text == name, F.lit(code))
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown race type: "), column)).cast("string")
        out = out.when(text.isNull() | (text == ""), F.lit(None).cast("string")).otherwise(unknown)
    return out


def all_numeric(column: Column) -> Column:
    """Aggregate: true when every non-null value parses as a number."""
    return F.count(F.when(to_double(column).isNull() & column.isNotNull(), 1)) == 0
