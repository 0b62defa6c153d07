"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import staged


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with lo, the rank from 0 within ``tree`` by ``order``, hi = lo + 1 and total, the tree's size.

    Rows are dealt to ranges of (tree, order) and numbered where they lie; the number of
    rows of a tree before a range is added. So no tree has to fit one task. Rows that are
    equal in all of these keep the order of the stored input.
    """
    rows = staged(rows, "rank-input").withColumn("__seq", F.monotonically_increasing_id())
    keys = [tree, *order, "__seq"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__seq")
    placed = staged(dealt.withColumn("__at", F.monotonically_increasing_id()), "rank-order")
    placed = placed.withColumn("__slice", F.shiftright("__at", 33))
    by_slice = Window.partitionBy("__tree").orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        placed.groupBy(F.col(tree).alias("__tree"), F.col("__slice").alias("__cut"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(by_slice), F.lit(0)))
        .withColumn("total", F.sum("__n").over(Window.partitionBy("__tree")))
    )
    slices = staged(slices, "rank-slices")
    on = F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__slice") == F.col("__cut"))
    lo = F.col("__at") - F.col("__first") + F.col("__before")
    out = placed.join(slices, on).withColumn("lo", lo).withColumn("hi", lo + 1)
    return out.drop("__at", "__slice", "__tree", "__cut", "__n", "__first", "__before")
