"""Form strings: a competitor's earlier finishes as one text of tokens.

A token is a finish and a discipline letter (``3a``) or a mark for a run that
was not finished (``Da``). Everything is array expressions, so a form string is
parsed inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of unfinished runs, shares of the weighted statistics.
UNFINISHED_MARKS = ("D", "DA", "DI", "DP", "RET", "NP", "ABS")
SAME_DISCIPLINE_SHARE = 0.7
ALL_RUNS_SHARE = 0.3
RECENT_RUNS = 3
WEIGHTED_STATS = ("avg_pos", "recent_perf", "consistency", "pct_top3")


def form_runs(form: Column, newest_first: bool = True, keep_year_marks: bool = False) -> Column:
    """Array of (place, discipline, unfinished, token); ``newest_first`` reads the text from its end."""
    tokens = F.filter(F.split(F.upper(F.trim(form)), r"\s+"), lambda t: t != "")
    if not keep_year_marks:
        tokens = F.filter(tokens, lambda t: ~t.rlike(r"^\(\d+\)$"))
    if newest_first:
        tokens = F.reverse(tokens)

    def read(token: Column) -> Column:
        unfinished = F.lit(False)
        for mark in UNFINISHED_MARKS:
            unfinished = unfinished | token.startswith(mark)
        digits = F.regexp_extract(token, r"(\d+)", 1).try_cast("int")
        letter = F.regexp_extract(token, r"([AMPHSTC])", 1)
        place = F.when(~unfinished, digits)
        return F.struct(
            place.alias("place"),
            F.when(~unfinished & (letter != ""), letter).alias("discipline"),
            unfinished.alias("unfinished"),
            token.alias("token"),
        )

    return F.transform(tokens, read)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def _stats(places: Column, mean: Column, total: Column, unfinished: Column) -> Column:
    """Statistics struct of an array of places (doubles, newest first) and its mean."""
    n = F.size(places)
    squares = F.aggregate(places, F.lit(0.0), lambda acc, v: acc + v * v)
    # The mean of squared deviations, as a sum of squares: places are small whole numbers.
    spread = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))
    first = F.get(places, 0)
    number = lambda ok, value: F.when(ok, value).otherwise(0.0)
    return F.struct(
        number(n > 0, mean).alias("avg_pos"),
        number(n > 0, _mean(F.slice(places, 1, RECENT_RUNS))).alias("recent_perf"),
        number(n > 1, spread).alias("consistency"),
        number(n > 1, first - (mean * n - first) / (n - 1)).alias("trend"),
        number(n > 0, F.size(F.filter(places, lambda v: v <= 3)) / n).alias("pct_top3"),
        n.cast("long").alias("nb_courses"),
        total.cast("long").alias("total_races"),
        F.when(total > 0, F.when(n > 0, unfinished / total).otherwise(1.0)).otherwise(0.0).alias("dnf_rate"),
    )


def weighted_stats(every: Column, bytype: Column) -> Column:
    """Same-discipline statistics backed by the statistics of all runs."""
    blended = [
        (bytype[s] * SAME_DISCIPLINE_SHARE + every[s] * ALL_RUNS_SHARE).alias(s) for s in WEIGHTED_STATS
    ]
    return F.struct(
        *blended,
        bytype["nb_courses"].alias("nb_courses"),
        every["total_races"].alias("total_races"),
        every["dnf_rate"].alias("dnf_rate"),
        bytype["trend"].alias("trend"),
    )


def with_form_stats(df, form: str, discipline: str, prefix: str, newest_first: bool = True):
    """Add structs ``{prefix}_global``, ``{prefix}_bytype`` (runs of the given discipline) and ``{prefix}_weighted``.

    The steps are separate projections, so that every array is built once.
    """
    empty = F.array().cast("array<struct<place:int,discipline:string,unfinished:boolean,token:string>>")
    kind = F.coalesce(F.col(discipline), F.lit(""))
    out = df.withColumn("__runs", F.coalesce(form_runs(F.col(form), newest_first), empty))
    doubles = lambda runs: F.transform(runs, lambda r: r["place"].cast("double"))
    out = out.withColumns(
        {
            "__all": doubles(F.filter("__runs", lambda r: r["place"].isNotNull())),
            "__same": doubles(F.filter("__runs", lambda r: r["place"].isNotNull() & (r["discipline"] == kind))),
            "__lost": F.size(F.filter("__runs", lambda r: r["unfinished"] & F.contains(r["token"], kind))),
            "__total": F.size("__runs"),
        }
    )
    out = out.withColumns({"__all_mean": _mean(F.col("__all")), "__same_mean": _mean(F.col("__same"))})
    # Without a finished run of the discipline nothing is known about it.
    lost = F.when(F.size("__same") > 0, F.col("__lost")).otherwise(0)
    every, bytype = f"{prefix}_global", f"{prefix}_bytype"
    out = out.withColumns(
        {
            every: _stats(F.col("__all"), F.col("__all_mean"), F.col("__total"), F.col("__total") - F.size("__all")),
            bytype: _stats(F.col("__same"), F.col("__same_mean"), F.size("__same") + lost, lost),
        }
    )
    out = out.withColumn(f"{prefix}_weighted", weighted_stats(F.col(every), F.col(bytype)))
    return out.drop("__runs", "__all", "__same", "__lost", "__total", "__all_mean", "__same_mean")


def flatten_stats(df, *prefixes: str):
    """One column per statistic (``che_global_avg_pos`` …) in place of the structs."""
    structs = [f"{p}_{kind}" for p in prefixes for kind in ("global", "bytype", "weighted")]
    flat = [
        F.col(f"{s}.{f.name}").alias(f"{s}_{f.name}") for s in structs if s in df.columns for f in df.schema[s].dataType
    ]
    return df.select(*[c for c in df.columns if c not in structs], *flat)
