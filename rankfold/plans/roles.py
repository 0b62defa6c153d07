"""The given tables in the roles of races, runners and their history.

race = order, runner = line item, horse = part, jockey = supplier, venue = the
customer's nation, purse = order total, model scores = quantity and the scaled root of the price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import Grouping, row_number_within, with_group_stats


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


NUMBER_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")
FINISH_ORDER = ("l_shipdate", "l_extendedprice", *NUMBER_ORDER)


def runners(spark: SparkSession, sf: str) -> tuple[DataFrame, Grouping]:
    """Runner rows with number and finish, and their grouping by race."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "race_id")
    by_race = Grouping.measure(lines, "race_id")
    lines = row_number_within(lines, by_race, [F.col(c).asc() for c in NUMBER_ORDER], "numero")
    lines = row_number_within(lines, by_race, [F.col(c).asc() for c in FINISH_ORDER], "position")
    return (
        lines.select(
            "race_id",
            F.col("l_partkey").alias("horse_id"),
            F.col("l_suppkey").alias("jockey_id"),
            "numero",
            "position",
            F.col("l_quantity").alias("pred_a"),
            (F.sqrt("l_extendedprice") / 6).alias("pred_b"),
            F.col("l_quantity").alias("odds"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_shipdate").cast("date").alias("ship_day"),
        ),
        by_race,
    )


def races(spark: SparkSession, sf: str) -> DataFrame:
    """Race rows: day, type, purse, distance and customer."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("race_id"),
        F.col("o_orderdate").cast("date").alias("jour"),
        F.col("o_orderpriority").alias("typec"),
        F.col("o_totalprice").alias("cheque"),
        F.col("o_orderstatus").alias("natpis"),
        F.col("o_custkey").alias("cust_id"),
        (1000 + 100 * (F.col("o_custkey") % 25)).cast("double").alias("dist"),
    )


def venues(spark: SparkSession, sf: str) -> DataFrame:
    """(cust_id, hippo, region) rows; the optimizer broadcasts what is small."""
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("cust_id"), F.col("n_name").alias("hippo"), F.col("r_name").alias("region"))
    )


def field(spark: SparkSession, sf: str) -> tuple[DataFrame, Grouping]:
    """Runners with their race's attributes and field size ``partant``."""
    rows, by_race = runners(spark, sf)
    rows = with_group_stats(rows, by_race, partant=F.count(F.lit(1)))
    return rows.join(races(spark, sf), "race_id"), by_race


def r6(column: Column | str, digits: int = 6) -> Column:
    """Rounded, so that sums agree whatever their order."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[r6(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# The same roles in SQL.
RUNNERS = """
runners AS (
  SELECT l_orderkey AS race_id, l_partkey AS horse_id, l_suppkey AS jockey_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS numero,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_shipdate, l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS position,
         l_quantity AS pred_a, sqrt(l_extendedprice) / 6 AS pred_b, l_quantity AS odds, l_extendedprice AS price,
         l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status,
         l_linenumber AS line_no, CAST(l_shipdate AS DATE) AS ship_day
  FROM lineitem)"""
RACES = """
races AS (
  SELECT o_orderkey AS race_id, CAST(o_orderdate AS DATE) AS jour, o_orderpriority AS typec, o_totalprice AS cheque,
         o_orderstatus AS natpis, o_custkey AS cust_id, CAST(1000 + 100 * (o_custkey % 25) AS DOUBLE) AS dist
  FROM orders)"""
VENUES = """
venues AS (
  SELECT c_custkey AS cust_id, n_name AS hippo, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FIELD = """
field AS (
  SELECT r.*, count(*) OVER (PARTITION BY r.race_id) AS partant, a.jour, a.typec, a.cheque, a.natpis, a.cust_id, a.dist
  FROM runners r JOIN races a ON r.race_id = a.race_id)"""
WITH_FIELD = "WITH" + RUNNERS + "," + RACES + "," + FIELD
WITH_RUNNERS = "WITH" + RUNNERS
