"""Leak-free history: what was known about an entity strictly before a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, flag, ratio
from .grouping import as_grouping, join_on, previous_rows, top_k

# Neutral priors for an entity without history.
NEUTRAL_POSITION = 10.0
NEUTRAL_ABILITY = 0.5
NEVER_DAYS = 999
LARGE_FIELD = 15
SPECIALIST_MARGIN = 2.0


def asof_totals(df: DataFrame, group, day: str, **measures: Column) -> DataFrame:
    """Add sums of ``measures`` over the entity's rows of strictly earlier days.

    ``day`` is a date. Rows of one day do not see one another. A null total means
    no earlier row with a value.
    """
    g = as_grouping(df, group)
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    if g.hot is None:
        earlier = (
            Window.partitionBy(*g.keys).orderBy(number).rangeBetween(Window.unboundedPreceding, -1)
        )
        return df.select("*", *[F.sum(m).over(earlier).alias(name) for name, m in measures.items()])
    # One row per entity and day bounds the window by the calendar; the sums per
    # day are built before the shuffle.
    daily = df.groupBy(*g.keys, day).agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    earlier = Window.partitionBy(*g.keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    totals = daily.select(*g.keys, day, *[F.sum(name).over(earlier).alias(name) for name in measures])
    return join_on(df, totals, [*g.keys, day], "left")


def asof_last_day(df: DataFrame, group, day: str, name: str) -> DataFrame:
    """Add the entity's latest day strictly before the row's day."""
    g = as_grouping(df, group)
    days = df.select(*g.keys, day).distinct()
    lagged = days.withColumn(name, F.lag(day).over(Window.partitionBy(*g.keys).orderBy(day)))
    if g.hot is None:
        number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
        earlier = Window.partitionBy(*g.keys).orderBy(number).rangeBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.max(day).over(earlier))
    return join_on(df, lagged, [*g.keys, day], "left")


def career_totals(df: DataFrame, horse, day: str, position: str, earnings: str) -> DataFrame:
    """Starts, wins, places (first three), earnings and ratios before each day."""
    pos = F.col(position)
    out = asof_totals(
        df,
        horse,
        day,
        coursescheval=F.lit(1),
        victoirescheval=F.when(pos == 1, 1).otherwise(0),
        placescheval=F.when(pos <= 3, 1).otherwise(0),
        gainsCarriere=F.col(earnings).cast("double"),  # as it is, else the shuffle carries it twice
    )
    zero = {"coursescheval": 0, "victoirescheval": 0, "placescheval": 0, "gainsCarriere": 0.0}
    out = out.na.fill(zero)
    return out.withColumns(
        {
            "ratio_victoires": ratio(F.col("victoirescheval"), F.col("coursescheval")),
            "ratio_places": ratio(F.col("placescheval"), F.col("coursescheval")),
        }
    )


def _ability(mean_position: Column) -> Column:
    return F.coalesce(clamp(1 - (mean_position - 1) / 15, 0, 1), F.lit(NEUTRAL_ABILITY))


def event_career(
    df: DataFrame,
    horse,
    day: str,
    position: str,
    handicap: str,
    field_size: str,
    going: str,
    large_field: int = LARGE_FIELD,
) -> DataFrame:
    """Career of a horse in one class of events, before each day, with neutral priors."""
    g = as_grouping(df, horse)
    pos, known = F.col(position), F.col(position).isNotNull()
    of = lambda condition: F.when(known & condition, pos)
    count = lambda condition: F.when(known & condition, 1)
    out = asof_totals(
        df,
        g,
        day,
        __starts=F.lit(1),
        __runs=count(F.lit(True)),
        __wins=count(pos == 1),
        __top5=count(pos <= 5),
        __sum=of(F.lit(True)),
        __h_sum=of(F.col(handicap)),
        __h_n=count(F.col(handicap)),
        __c_sum=of(~F.col(handicap)),
        __c_n=count(~F.col(handicap)),
        __l_sum=of(F.col(field_size) >= large_field),
        __l_n=count(F.col(field_size) >= large_field),
    )
    out = asof_last_day(out, g, day, "__last")
    out = asof_totals(out, g.with_keys(going), day, __g_sum=of(F.lit(True)), __g_n=count(F.lit(True)))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    mean = lambda total, n: F.try_divide(F.col(total), F.col(n))
    in_handicaps = F.coalesce(mean("__h_sum", "__h_n"), F.lit(NEUTRAL_POSITION))
    in_others = F.coalesce(mean("__c_sum", "__c_n"), F.lit(NEUTRAL_POSITION))
    rest = F.datediff(F.col(day), F.col("__last"))
    features = {
        "quinte_career_starts": zero("__starts").cast("double"),
        "quinte_win_rate": ratio(zero("__wins"), zero("__runs")),
        "quinte_top5_rate": ratio(zero("__top5"), zero("__runs")),
        "avg_quinte_position": F.coalesce(mean("__sum", "__runs"), F.lit(NEUTRAL_POSITION)),
        "days_since_last_quinte": F.least(F.coalesce(rest, F.lit(NEVER_DAYS)), F.lit(NEVER_DAYS)).cast("double"),
        "quinte_handicap_specialist": flag(in_handicaps < in_others - SPECIALIST_MARGIN),
        "quinte_conditions_specialist": flag(in_others < in_handicaps - SPECIALIST_MARGIN),
        "quinte_large_field_ability": _ability(mean("__l_sum", "__l_n")),
        "quinte_track_condition_fit": _ability(mean("__g_sum", "__g_n")),
    }
    return out.select(*df.columns, *[c.alias(name) for name, c in features.items()])


def recent_runs(df: DataFrame, horse: Sequence[str], order: Sequence[Column], k: int = 20, name: str = "run_no") -> DataFrame:
    """Latest k rows per horse with their number (1 = latest)."""
    return top_k(df, horse, order, k, name)


def recent_runs_within(
    df: DataFrame, horse: Sequence[str], day: str, order: Sequence[Column], until: Column, days: int = 365, k: int = 20
) -> DataFrame:
    """Latest k rows per horse in the look-back period before ``until``."""
    window = (F.col(day) < until) & (F.col(day) >= F.date_sub(until, days))
    return recent_runs(df.where(window), horse, order, k)


def previous_sequence(
    df: DataFrame, horse, order: Sequence[Column], values: Sequence[str], k: int = 5, name: str = "sequence"
) -> DataFrame:
    """Rows with a full sequence of their k previous races (arrays of doubles)."""
    out = previous_rows(df, horse, order, values, k, name)
    as_array = F.transform(F.col(name), lambda s: F.array(*[s[v].cast("double") for v in values]))
    return out.where(F.size(name) == k).withColumn(name, as_array)


def gate_bias(df: DataFrame, number: str, position: str, gates: int = 20) -> DataFrame:
    """Starts, wins, first-five counts and bias per starting gate."""
    at_gate = df.where(F.col(number).between(1, gates))
    counts = at_gate.groupBy(number).agg(
        F.count(F.lit(1)).alias("starts"),
        F.count(F.when(F.col(position) == 1, 1)).alias("wins"),
        F.count(F.when(F.col(position) <= 5, 1)).alias("top5"),
    )
    # Expected shares 1/16 and 5/16 of a typical field.
    bias = (F.col("wins") / F.col("starts") / 0.0625 + F.col("top5") / F.col("starts") / 0.3125) / 2
    return counts.withColumn("post_position_bias", bias)


def fill_age(df: DataFrame, horse, order: Sequence[Column], age: str = "age", default: float = 5.0) -> DataFrame:
    """Fill a missing value from the nearest earlier row, else the nearest later row.

    Rows and values meet on (horse, day) positions, so the carry only needs the
    known values around each row.
    """
    g = as_grouping(df, horse)
    w = Window.partitionBy(*g.keys).orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    fill = lambda rows: rows.withColumn(
        age,
        F.coalesce(F.last(age, True).over(back), F.first(age, True).over(ahead), F.lit(default)),
    )
    if g.hot is None:
        return fill(df)
    from .grouping import Grouping, row_number_within

    plain, hot = g.split(df)
    numbered = row_number_within(hot, Grouping(g.keys, g.hot), order, "__no")
    # Blocks of rows bound every window; block edges carry values across blocks.
    blocked = numbered.withColumn("__block", F.floor(F.col("__no") / 100_000))
    edges = blocked.groupBy(*g.keys, "__block").agg(
        F.max_by(age, F.when(F.col(age).isNotNull(), F.col("__no"))).alias("__last"),
        F.min_by(age, F.when(F.col(age).isNotNull(), F.col("__no"))).alias("__first"),
    )
    by_block = Window.partitionBy(*g.keys).orderBy("__block")
    edges = edges.select(
        *g.keys,
        "__block",
        F.last("__last", True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", True).over(by_block.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    inside = Window.partitionBy(*g.keys, "__block").orderBy("__no")
    filled = join_on(blocked, edges, [*g.keys, "__block"], "left").withColumn(
        age,
        F.coalesce(
            F.last(age, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            F.col("__before"),
            F.first(age, True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
            F.col("__after"),
            F.lit(default),
        ),
    )
    return fill(plain).unionByName(filled.select(*plain.columns))
