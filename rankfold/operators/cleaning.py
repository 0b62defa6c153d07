"""Cleaning and defaulting of participant rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import FINISH_CODES, number_or_code, to_double
from ..functions.text import blank_to_null, race_time_millis
from ..session import reliable_checkpoint
from .grouping import MAX_COLUMN_VALUES, Grouping, quantiles_within

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Fields with blanks, and defaults where 0 would be wrong.
BLANK_FIELDS = ("derniereplace", "tempstot", "oeil", "defoeil", "defoeilPrec", "proprietaire", "dernierOeil")
HIGH_NULL_FIELDS = ("recordG", "proprietaire")
DEFAULTS = {
    "age": 5.0,
    "derniereplace": 10.0,
    "dernierecote": 10.0,
    "dernieredist": 2000.0,
    "derniernbpartants": 10.0,
}
ZERO_DEFAULTS = (
    "victoirescheval", "placescheval", "coursescheval", "gainsCarriere", "pourcVictChevalHippo",
    "pourcPlaceChevalHippo", "pourcVictJockHippo", "pourcPlaceJockHippo", "nbCourseCouple", "nbVictCouple",
    "nbPlaceCouple", "TxVictCouple", "ratio_victoires", "ratio_places", "gains_par_course", "efficacite_couple",
    "regularite_couple", "progression_couple", "perf_cheval_hippo", "perf_jockey_hippo", "dernierealloc", "txreclam",
    "tempstot", "ecar", "vha", "dernierTxreclam",
)
TEXT_DEFAULTS = ("musiqueche", "musiquejoc", "cheval")

# Feed names and the standard field each one fills.
FEED_NAMES = {
    "idChe": "idche",
    "cote": "cotedirect",
    "cotedirecte": "cotedirect",
    "num": "numero",
    "jockeid": "idJockey",
    "entid": "idEntraineur",
    "prop": "proprietaire",
    "recordGains": "recordG",
    "lastPlace": "derniereplace",
    "lastOdds": "dernierecote",
    "lastPurse": "dernierealloc",
    "claimingTax": "txreclam",
    "lastDistance": "dernieredist",
    "lastFieldSize": "derniernbpartants",
    "personalBest": "recordG",
    "currentTrainer": "entraineur",
    "previousTrainer": "dernierEnt",
    "totalTime": "tempstot",
    "margin": "ecar",
    "careerEarnings": "gainsCarriere",
}

# Columns dropped before training, and columns replaced by logs.
CONSTANT_FEATURES = (
    "is_handicap_quinte", "handicap_division", "weather_clear", "weather_rain", "weather_cloudy",
    "post_position_track_bias", "che_weighted_nb_courses", "che_weighted_trend", "joc_weighted_nb_courses",
    "joc_weighted_trend", "ratio_victoires", "efficacite_couple", "regularite_couple", "progression_couple",
)
GLOBAL_STATS = ("avg_pos", "recent_perf", "consistency", "pct_top3", "total_races", "dnf_rate", "trend", "nb_courses")
GLOBAL_FEATURES = tuple(f"{p}_global_{s}" for p in ("che", "joc") for s in GLOBAL_STATS) + ("perf_jockey_hippo",)
LOG_COLUMNS = {"recence": "recence_log", "cotedirect": "cotedirect_log"}

# Result codes and their distance behind the last finisher.
RESULT_CODE_STEPS = {
    10: ("D", "DI", "DP", "DAI", "DIS"),
    20: ("RET", "TOM", "ARR", "FER"),
    30: ("NP", "ABS"),
}
UNKNOWN_RESULT_STEP, BLANK_RESULT_STEP, DEFAULT_MAX_POSITION = 40, 50, 20


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def standard_names(df: DataFrame, allowed: Sequence[str], aliases: Mapping[str, str] = FEED_NAMES) -> DataFrame:
    """Keep allowed fields; feed names fill the standard field when it is empty."""
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        target = aliases.get(name, name)
        if target in allowed:
            sources.setdefault(target, []).append(name)
    pick = lambda target, names: F.coalesce(*[F.col(n) for n in sorted(names, key=lambda n: n != target)])
    return df.select(*[pick(target, names).alias(target) for target, names in sources.items()])


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c)) for c in _present(df, columns)})


def blanks_to_null(df: DataFrame, columns: Sequence[str] = BLANK_FIELDS) -> DataFrame:
    strings = [c for c, t in df.dtypes if t == "string" and c in columns]
    return df.withColumns({c: blank_to_null(F.col(c)) for c in strings})


def _finish_code(column: Column) -> Column:
    text = F.upper(F.trim(column))
    out = F.lit(None).cast("string")
    for value, codes in FINISH_CODES.items():
        out = F.when(text.isin(*codes), F.lit(str(value))).otherwise(out)
    return F.coalesce(out, column)


def mixed_to_numbers(df: DataFrame) -> DataFrame:
    """Finish codes to numbers, names of former trainers to 0."""
    out = {}
    types = dict(df.dtypes)
    if types.get("derniereplace") == "string":
        out["derniereplace"] = _finish_code(F.col("derniereplace"))
    if types.get("dernierEnt") == "string":
        named = F.col("dernierEnt").rlike("[a-zA-Z]")
        out["dernierEnt"] = F.when(named, F.lit("0")).otherwise(F.col("dernierEnt"))
    return df.withColumns(out) if out else df


def parse_records(df: DataFrame, column: str = "recordG", last_group: str = "hundredths") -> DataFrame:
    """Record time text to milliseconds; a column already numeric is left alone."""
    if dict(df.dtypes).get(column) != "string":
        return df
    return df.withColumn(column, race_time_millis(F.col(column), last_group).cast("double"))


def fill_all(df: DataFrame) -> DataFrame:
    numbers = [c for c, t in df.dtypes if t in NUMERIC_TYPES]
    strings = [c for c, t in df.dtypes if t == "string"]
    return df.na.fill(0, numbers).na.fill("", strings)


def fill_defaults(df: DataFrame, defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Per-column defaults on columns that exist."""
    wanted = dict(defaults) if defaults is not None else {**{c: 0.0 for c in ZERO_DEFAULTS}, **DEFAULTS}
    types = dict(df.dtypes)
    numbers = {c: v for c, v in wanted.items() if types.get(c) in NUMERIC_TYPES}
    texts = {c: "" for c in TEXT_DEFAULTS if types.get(c) == "string"}
    return df.na.fill({**numbers, **texts}) if numbers or texts else df


def clean(df: DataFrame) -> DataFrame:
    """Full chain; running it again changes nothing."""
    return (
        df.transform(blanks_to_null)
        .transform(mixed_to_numbers)
        .transform(parse_records)
        .transform(fill_all)
    )


def cleaning_counts(df: DataFrame) -> DataFrame:
    """One row with what :func:`clean` will change."""
    types = dict(df.dtypes)
    total = lambda parts: sum(parts[1:], parts[0]) if parts else F.lit(0)
    count = lambda condition: F.count(F.when(condition, 1))
    blanks = [count(F.trim(F.col(c)) == "") for c in _present(df, BLANK_FIELDS) if types[c] == "string"]
    codes = [
        count(F.upper(F.trim(F.col("derniereplace"))).isin(*[x for cs in FINISH_CODES.values() for x in cs]))
    ] if types.get("derniereplace") == "string" else []
    names = [count(F.col("dernierEnt").rlike("[a-zA-Z]"))] if types.get("dernierEnt") == "string" else []
    times = [count(race_time_millis(F.col("recordG")).isNotNull())] if types.get("recordG") == "string" else []
    nulls = [count(F.col(c).isNull()) for c in df.columns]
    return df.agg(
        total(blanks).alias("empty_strings_replaced"),
        total(codes).alias("racing_positions_converted"),
        total(names).alias("trainer_fields_cleaned"),
        total(times).alias("time_records_parsed"),
        total(nulls).alias("total_nans_before"),
    )


def high_null_columns(df: DataFrame, columns: Sequence[str], limit: float = 50.0) -> DataFrame:
    """(column, null_pct) of listed columns above the limit."""
    shares = F.array(
        *[F.struct(F.lit(c).alias("column"), (F.avg(F.col(c).isNull().cast("int")) * 100).alias("null_pct")) for c in columns]
    )
    return df.agg(shares.alias("s")).select(F.inline("s")).where(F.col("null_pct") > limit)


def drop_features(df: DataFrame, expected: Sequence[str] | None = None) -> DataFrame:
    """Keep the expected columns, or drop the known constant and global ones."""
    if expected is not None:
        return df.select(*[c for c in df.columns if c in expected])
    return df.drop(*CONSTANT_FEATURES, *GLOBAL_FEATURES)


def log_columns(df: DataFrame, names: Mapping[str, str] = LOG_COLUMNS) -> DataFrame:
    found = {old: new for old, new in names.items() if old in df.columns}
    return df.select(*[c for c in df.columns if c not in found], *[F.log1p(o).alias(n) for o, n in found.items()])


def align_columns(df: DataFrame, expected: Sequence[str], min_share: float = 0.7) -> DataFrame:
    """Expected columns in order; missing ones and nulls are 0. Fails below the share of columns present."""
    share = len(_present(df, expected)) / max(len(expected), 1)
    if share < min_share:
        raise ValueError(f"only {share:.0%} of the expected columns are present")
    value = lambda c: F.coalesce(to_double(F.col(c)), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.select(*[value(c).alias(c) for c in expected])


def require_columns(df: DataFrame, defaults: Mapping[str, object], drop: Sequence[str] = ()) -> DataFrame:
    """Add absent columns with a default and drop the target."""
    out = df.drop(*drop)
    return out.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in out.columns})


def numeric_or_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns whose every value parses become numbers. Checks all columns in one pass."""
    strings = [c for c, t in df.dtypes if t == "string" and c in columns]
    if not strings:
        return df
    bad = df.agg(*[F.count(F.when(to_double(F.col(c)).isNull() & F.col(c).isNotNull(), 1)).alias(c) for c in strings]).first()
    return df.withColumns({c: to_double(F.col(c)) for c in strings if bad[c] == 0})


def category_codes(df: DataFrame, column: str, name: str, unknown: str = "unknown") -> DataFrame:
    """Integer code of the value's place in the sorted values; missing counts as ``unknown``.

    The distinct values are counted, not the rows: a value's code is the number
    of smaller values.
    """
    value = F.coalesce(F.col(column), F.lit(unknown))
    values = df.select(value.alias("__value")).distinct()
    from .grouping import row_number_within

    everything = values.withColumn("__all", F.lit(0))
    codes = row_number_within(everything, "__all", [F.col("__value").asc()], name)
    codes = codes.select("__value", (F.col(name) - 1).alias(name))
    return df.withColumn("__value", value).join(codes, "__value", "left").drop("__value")


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null numbers become the column's median; medians of all columns come from one pass.

    Equal values of a column are counted first, so a column costs its values, not its rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(pairs))
    counts = reliable_checkpoint(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    medians = quantiles_within(counts, Grouping.measure(counts, "column", max_rows=MAX_COLUMN_VALUES), "value", [0.5], "m", "n")
    fitted = {r["column"]: r["m"] for r in medians.select("column", F.get("m", 0).alias("m")).collect()}  # one row per column
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fitted.get(c)).cast("double")) for c in columns})


def null_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.when(to_double(F.col(c)).isNull(), 1).otherwise(0)).alias(c) for c in columns]).first()
    return row.asDict()


def model_ready(df: DataFrame, drop: Sequence[str], codes: Sequence[str] = (), max_null: float = 0.3) -> DataFrame:
    """Numeric frame for training: drop, coerce, code or drop sparse columns, median-fill the rest."""
    out = df.drop(*drop)
    shares = null_shares(out, out.columns)
    coded = [c for c in codes if shares.get(c, 0) > max_null]
    kept = [c for c in out.columns if shares[c] <= max_null]
    for c in coded:
        out = category_codes(out, c, f"{c}_code")
    out = out.select(*[to_double(F.col(c)).alias(c) for c in kept], *[f"{c}_code" for c in coded])
    return fill_median(out, kept)


def with_date_parts(df: DataFrame, column: str) -> DataFrame:
    """Year, month and weekday (Monday = 0)."""
    return df.withColumns(
        {"year": F.year(column), "month": F.month(column), "dayofweek": F.weekday(column)}
    )


def result_numbers(df: DataFrame, column: str, name: str, drop_empty: bool = False) -> DataFrame:
    """Finish text to number; codes rank behind the last finisher of the table."""
    text = F.upper(F.trim(F.col(column)))
    highest = df.agg(F.coalesce(F.max(to_double(F.col(column))), F.lit(float(DEFAULT_MAX_POSITION)))).scalar()
    blank = F.coalesce(text, F.lit("")) == ""
    behind = F.when(blank, F.lit(None if drop_empty else BLANK_RESULT_STEP).cast("int"))
    for step, codes in RESULT_CODE_STEPS.items():
        behind = behind.when(text.isin(*codes), step)
    value = F.coalesce(to_double(text), highest + behind.otherwise(UNKNOWN_RESULT_STEP))
    out = df.withColumn(name, value)
    return out.where(F.col(name).isNotNull()) if drop_empty else out


def target(df: DataFrame, position: str, kind: str, name: str = "target") -> DataFrame:
    """Training target: 'regression', 'class' (win, place, other) or 'rank'."""
    place = number_or_code(F.col(position), None)
    if kind == "regression":
        return df.withColumn(name, place)
    if kind == "class":
        return df.withColumn(name, F.when(place == 1, "win").when(place <= 3, "place").otherwise("other"))
    raise ValueError(f"unknown target kind {kind!r}; use rank_within for 'rank'")


def detect_target(columns: Sequence[str], candidates: Sequence[str] = ("final_position", "cl", "narrivee", "position")) -> str | None:
    return next((c for c in candidates if c in columns), None)


def data_gaps(df: DataFrame) -> Column:
    """Label of what a runner lacks: 'horse_career', 'jockey_context' or null."""
    lacks = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string").isin("", "0", "0.0")), 1).otherwise(0)
    career = sum(lacks(c) for c in ("coursescheval", "victoirescheval", "placescheval", "musiqueche"))
    jockey = sum(lacks(c) for c in ("musiquejoc", "pourcVictJockHippo", "pourcPlaceJockHippo"))
    return F.when(career >= 2, "horse_career").when(jockey >= 2, "jockey_context")


def major_race(quinte: str = "quinte", group: str = "groupe", purse: str = "cheque") -> Column:
    """Quinté, group race, or a purse above 50 000."""
    return F.coalesce(
        F.coalesce(F.col(quinte).cast("boolean"), F.lit(False))
        | F.coalesce(F.col(group).isin("1", "2", "3", "I", "II", "III"), F.lit(False))
        | F.coalesce(F.col(purse) > 50_000, F.lit(False)),
        F.lit(False),
    )


def position_class(position: Column) -> Column:
    """Class 0 to 4 of a finish: 1-3, 4-6, 7-9, 10-12, 13 and more."""
    return F.least(F.floor((position - 1) / 3), F.lit(4)).cast("int")


def valid_finish(df: DataFrame, position: str) -> DataFrame:
    p = F.col(position).cast("double")
    return df.where((p > 0) & (p < 50) & ~F.isnan(p))


def drop_implausible(df: DataFrame, race: Sequence[str], score: str, max_mean: float = 15.0, max_score: float = 35.0) -> DataFrame:
    """Remove races whose scores look broken."""
    bad = df.groupBy(*race).agg(F.avg(score).alias("__m"), F.max(score).alias("__x"))
    bad = bad.where((F.col("__m") > max_mean) | (F.col("__x") > max_score)).select(*race)
    return df.join(bad, list(race), "left_anti")


def model_columns(df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = (), critical: Sequence[str] = (), at_least: int = 1) -> list[str]:
    """Numeric columns chosen by name or prefix; fails when too few or a critical one is absent."""
    found = [
        c for c, t in df.dtypes if t in NUMERIC_TYPES and (c in names or any(c.startswith(p) for p in prefixes))
    ]
    missing = [c for c in critical if c not in found]
    if missing or len(found) < at_least:
        raise ValueError(f"{len(found)} model columns, missing {missing}")
    return found
