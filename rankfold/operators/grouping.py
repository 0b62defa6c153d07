"""Groups that may hold a large share of all rows.

Most groups here (runners of one race, races of one horse) fit one task, and a
plain window over them costs one shuffle. A group that does not fit is found by
a count and treated apart: its rows are range-sliced over many tasks. Both ways
give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

MAX_GROUP_ROWS = 1_000_000  # rows of one group that one task may sort
MAX_COLUMN_VALUES = 100_000  # distinct values of a column that one task may hold for its quantiles
MAX_LAGS = 8
KEY_BUCKETS, LISTED_BUCKETS = 1 << 16, 1000  # sums that the rows of all keys are dealt to, and how many of them a filter may list
SMALL_INPUT_BYTES = 256 << 20  # below this no group can be too large for a task


def input_bytes(df: DataFrame) -> int:
    """Optimizer's size of all tables that ``df`` reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on key columns where null equals null; the columns are those of ``left``, then the rest of ``right``."""
    names = {k: f"__on_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    match = F.lit(True)
    for k, other in names.items():
        match = match & F.col(k).eqNullSafe(F.col(other))
    joined = left.join(renamed, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


@dataclass(frozen=True)
class Grouping:
    """Key columns plus the keys whose groups exceed the row limit (if any)."""

    keys: tuple[str, ...]
    hot: DataFrame | None = None

    @classmethod
    def measure(cls, df: DataFrame, *keys: str, max_rows: int | None = None) -> Grouping:
        """Count the groups once; skip the count when the whole input is small.

        A hot group fills the bucket that its key hashes to, so the keys of the other buckets need not be counted
        nor shuffled. Hot keys, a null one too, stay a table in the shared folder.
        """
        limit = MAX_GROUP_ROWS if max_rows is None else max_rows
        if max_rows is None and input_bytes(df) <= SMALL_INPUT_BYTES:
            return cls(tuple(keys))
        bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
        filled = [r[0] for r in df.groupBy(bucket.alias("__bucket")).count().where(F.col("count") > limit).select("__bucket").collect()]
        if not filled:
            return cls(tuple(keys))
        counted = df.where(bucket.isin(filled)) if len(filled) <= LISTED_BUCKETS else df
        large = reliable_checkpoint(counted.groupBy(*keys).count().where(F.col("count") > limit).select(*keys))
        return cls(tuple(keys), None if large.isEmpty() else large)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of ordinary groups, rows of hot groups).

        Hot keys are few, at most one per ``MAX_GROUP_ROWS`` rows, so they are broadcast: a
        shuffle by key would bring a whole hot group into one task.
        """
        keys = [k for k in self.keys if k in self.hot.columns]
        hot = F.broadcast(self.hot)
        return join_on(df, hot, keys, "left_anti"), join_on(df, hot, keys, "left_semi")

    def with_keys(self, *extra: str) -> Grouping:
        """Finer grouping below the same keys; hotness is inherited."""
        return Grouping(self.keys + extra, self.hot)


def as_grouping(df: DataFrame, group: Grouping | str | Sequence[str]) -> Grouping:
    if isinstance(group, Grouping):
        return group
    return Grouping.measure(df, *([group] if isinstance(group, str) else group))


def _sliced(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-slice rows by (keys, order) and fix the slice number of every row."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return reliable_checkpoint(ranged.withColumn("__slice", F.spark_partition_id()))


def _running_before(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column) -> DataFrame:
    """Add ``__before``: sum of ``weight`` over the earlier rows of the group.

    Slice totals give each slice its start, so no task sees a whole group.
    ``order`` must be total.
    """
    sliced = _sliced(rows.withColumn("__weight", weight), keys, order)
    by_slice = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.sum("__weight").alias("__total"))
        .select(*keys, "__slice", F.coalesce(F.sum("__total").over(by_slice), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = sliced.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    return (
        join_on(counted, starts, [*keys, "__slice"])
        .withColumn("__before", F.col("__start") + F.col("__inside"))
        .drop("__slice", "__weight", "__inside", "__start")
    )


def row_number_within(df: DataFrame, group, order: Sequence[Column], name: str) -> DataFrame:
    """1..n inside each group; ``order`` must be total (add a tie-break)."""
    g = as_grouping(df, group)
    window = Window.partitionBy(*g.keys).orderBy(*order)
    if g.hot is None:
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    plain, hot = g.split(df)
    plain = plain.withColumn(name, F.row_number().over(window).cast("long"))
    hot = _running_before(hot, g.keys, order, F.lit(1)).withColumn(name, F.col("__before").cast("long") + 1)
    return plain.unionByName(hot.drop("__before"))


def rank_within(df: DataFrame, group, value: str, name: str, method: str = "min", descending: bool = False) -> DataFrame:
    """Rank of ``value`` inside each group with ties: 'min' or 'average'; null last."""
    g = as_grouping(df, group)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()

    def plain_rank(rows: DataFrame) -> DataFrame:
        rank = F.rank().over(Window.partitionBy(*g.keys).orderBy(order)).cast("long")
        if method == "average":
            ties = F.count(F.lit(1)).over(Window.partitionBy(*g.keys, value))
            rank = rank + (ties - 1) / 2
        return rows.withColumn(name, rank)

    if g.hot is None:
        return plain_rank(df)
    plain, hot = g.split(df)
    # Equal values share one entry, so a tie of any size costs one row here.
    values = hot.groupBy(*g.keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = _running_before(values, g.keys, [order], F.col("__n"))
    rank = F.col("__before").cast("long") + 1
    if method == "average":
        rank = rank + (F.col("__n") - 1) / 2
    ranked = ranked.select(
        *[F.col(k).alias(f"__{k}") for k in g.keys], F.col(value).alias("__value"), rank.alias(name)
    )
    match = F.col(value).eqNullSafe(F.col("__value"))
    for k in g.keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    hot = hot.join(ranked, match, "left").drop("__value", *[f"__{k}" for k in g.keys])
    return plain_rank(plain).unionByName(hot)


def with_group_stats(df: DataFrame, group, **aggregates: Column) -> DataFrame:
    """Give every row aggregates of its group."""
    g = as_grouping(df, group)
    if g.hot is None:
        window = Window.partitionBy(*g.keys)
        return df.select("*", *[agg.over(window).alias(name) for name, agg in aggregates.items()])
    # Partial aggregation shrinks a hot group before the shuffle; the adaptive
    # skew join splits its rows when the one-row statistics are joined back.
    stats = df.groupBy(*g.keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return join_on(df, stats, g.keys, "left")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str | None = None) -> DataFrame:
    """First k rows per group. Spark limits each group before the shuffle."""
    rank = name or "__rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    out = out.where(F.col(rank) <= k)
    return out if name else out.drop(rank)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (latest-wins upserts, de-duplication)."""
    return top_k(df, keys, order, 1)


def previous_rows(df: DataFrame, group, order: Sequence[Column], values: Sequence[str], k: int, name: str) -> DataFrame:
    """Array of the k preceding rows' ``values`` structs, oldest first."""
    g = as_grouping(df, group)
    item = F.struct(*values)
    window = Window.partitionBy(*g.keys).orderBy(*order)
    if k <= MAX_LAGS:  # a few lags are cheaper than collecting a sliding frame
        before = F.array_compact(F.array(*[F.lag(item, i).over(window) for i in range(k, 0, -1)]))
    else:
        before = F.collect_list(item).over(window.rowsBetween(-k, -1))
    if g.hot is None:
        return df.withColumn(name, before)
    plain, hot = g.split(df)
    plain = plain.withColumn(name, before)
    # Each row announces itself to its k successors; (key, number) is unique.
    numbered = row_number_within(hot, Grouping(g.keys, g.hot), order, "__no")
    sent = numbered.select(
        *g.keys,
        F.col("__no").alias("__from"),
        item.alias("__item"),
        F.explode(F.sequence(F.col("__no") + 1, F.col("__no") + k)).alias("__no"),
    )
    got = sent.groupBy(*g.keys, "__no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__from", "__item"))), lambda s: s["__item"]).alias(name)
    )
    hot = (
        join_on(numbered, got, [*g.keys, "__no"], "left")
        .withColumn(name, F.coalesce(F.col(name), F.array().cast(plain.schema[name].dataType)))
        .drop("__no")
    )
    return plain.unionByName(hot)


def quantiles_within(
    df: DataFrame, group, value: str, probs: Sequence[float], name: str, count: str | None = None
) -> DataFrame:
    """Exact interpolated quantiles per group as an array; nulls are ignored.

    ``count`` names a column that says how often a row's value occurs.
    """
    g = as_grouping(df, group)
    keys = list(g.keys)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    often = F.lit(1) if count is None else F.col(count)
    if g.hot is None:
        return df.groupBy(*keys).agg(F.percentile(value, wanted, often).alias(name))
    plain, hot = g.split(df)
    plain = plain.groupBy(*keys).agg(F.percentile(value, wanted, often).alias(name))
    # Equal values are counted before the shuffle, then found by cumulative count.
    values = hot.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(often).alias("__n"))
    totals = F.broadcast(values.groupBy(*keys).agg(F.sum("__n").alias("__size")))  # one row per hot group
    placed = join_on(_running_before(values, keys, [F.col(value).asc()], F.col("__n")), totals, keys)
    at = placed.select(*keys, value, "__before", "__n", "__size", F.posexplode(wanted).alias("__i", "__p"))
    target = F.col("__p") * (F.col("__size") - 1)
    holds = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
    picked = at.groupBy(*keys, "__i").agg(
        F.max(F.when(holds(F.floor(target)), F.col(value))).alias("__lo"),
        F.max(F.when(holds(F.ceil(target)), F.col(value))).alias("__hi"),
        F.max(target - F.floor(target)).alias("__part"),
    )
    between = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__part")
    point = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(between)  # infinite values have no difference
    hot = picked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", point.alias("v")))), lambda s: s["v"]).alias(name)
    )
    return plain.unionByName(join_on(hot_keys(g, df), hot, keys, "left"))


def hot_keys(g: Grouping, df: DataFrame) -> DataFrame:
    """The groups of ``df`` under the hot keys, also those of finer groupings."""
    return g.split(df.select(*g.keys).distinct())[1]
