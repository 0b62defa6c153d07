"""Cleaning, coding, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import bucket, money, number_or_code, rail_code, safe_divide
from ..functions.text import keyword_class
from ..operators import cleaning, imputation
from ..operators.grouping import Grouping, rank_within
from .history import horse_field
from .registry import query
from .roles import WITH_FIELD, WITH_RUNNERS, rounded, runners, table

# Line items as raw participant fields with blanks, codes and nulls.
RAW_SQL = """
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_partkey % 11 WHEN 0 THEN 'DAI' WHEN 1 THEN ' arr ' WHEN 2 THEN 'TOMBE' WHEN 3 THEN 'NP' WHEN 4 THEN ''
      WHEN 5 THEN 'xx' WHEN 6 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS derniereplace,
    CASE l_suppkey % 4 WHEN 0 THEN 'Trainer' || l_suppkey WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS "dernierEnt",
    CASE l_returnflag WHEN 'A' THEN ' ' WHEN 'R' THEN 'O' ELSE NULL END AS oeil,
    CASE l_partkey % 3 WHEN 0 THEN CAST(1 + l_linenumber AS VARCHAR) || '''' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') || '"' || CAST(l_linenumber AS VARCHAR)
      WHEN 1 THEN 'none' END AS "recordG",
    CASE WHEN l_discount >= 0.03 THEN l_quantity END AS age
  FROM lineitem)
"""


def raw_fields(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("l_partkey") % 11
    text = lambda c: F.col(c).cast("string")
    place = (
        F.when(kind == 0, "DAI").when(kind == 1, " arr ").when(kind == 2, "TOMBE").when(kind == 3, "NP").when(kind == 4, "")
        .when(kind == 5, "xx").when(kind == 6, None).otherwise(text("l_linenumber"))
    )
    owner = F.col("l_suppkey") % 4
    trainer = (
        F.when(owner == 0, F.concat(F.lit("Trainer"), text("l_suppkey"))).when(owner == 1, "0").when(owner == 2, None)
        .otherwise(text("l_suppkey"))
    )
    record = F.concat(
        (1 + F.col("l_linenumber")).cast("string"), F.lit("'"),
        F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0"), F.lit('"'), text("l_linenumber"),
    )
    third = F.col("l_partkey") % 3
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        place.alias("derniereplace"),
        trainer.alias("dernierEnt"),
        F.when(F.col("l_returnflag") == "A", " ").when(F.col("l_returnflag") == "R", "O").alias("oeil"),
        F.when(third == 0, record).when(third == 1, "none").alias("recordG"),
        F.when(F.col("l_discount") >= 0.03, F.col("l_quantity")).alias("age"),
    )


@query(
    RAW_SQL
    + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  coalesce(CASE upper(trim(derniereplace)) WHEN 'DAI' THEN '15.0' WHEN 'ARR' THEN '16.0' WHEN 'TOMBE' THEN '17.0' WHEN 'NP' THEN '18.0'
    WHEN '' THEN NULL ELSE derniereplace END, '') AS derniereplace,
  CASE WHEN "dernierEnt" LIKE 'Trainer%' THEN '0' ELSE coalesce("dernierEnt", '') END AS "dernierEnt",
  coalesce(nullif(trim(oeil), ''), '') AS oeil,
  CAST(CASE WHEN l_partkey % 3 = 0 THEN (1 + l_linenumber) * 60000 + (l_suppkey % 60) * 1000 + l_linenumber * 10 ELSE 0 END AS DOUBLE) AS "recordG",
  coalesce(age, 0.0) AS age
FROM raw"""
)
def clean_and_default(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(raw_fields(spark, sf))


@query(
    RAW_SQL
    + """
SELECT count(*) FILTER (WHERE derniereplace = '') + count(*) FILTER (WHERE trim(oeil) = '') AS empty_strings_replaced,
  count(*) FILTER (WHERE upper(trim(derniereplace)) IN ('DAI', 'ARR', 'TOMBE', 'NP')) AS racing_positions_converted,
  count(*) FILTER (WHERE "dernierEnt" LIKE 'Trainer%') AS trainer_fields_cleaned,
  count(*) FILTER (WHERE l_partkey % 3 = 0) AS time_records_parsed,
  count(*) * 5 - count(derniereplace) - count("dernierEnt") - count(oeil) - count("recordG") - count(age) AS total_nans_before
FROM raw"""
)
def cleaning_counters(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.cleaning_counts(raw_fields(spark, sf))


@query(
    RAW_SQL
    + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN derniereplace IS NULL OR trim(derniereplace) = '' THEN 10.0 ELSE
    CASE upper(trim(derniereplace)) WHEN 'DAI' THEN 15.0 WHEN 'ARR' THEN 16.0 WHEN 'TOMBE' THEN 17.0 WHEN 'NP' THEN 18.0
      ELSE coalesce(try_cast(derniereplace AS DOUBLE), 12.0) END END::DOUBLE AS place,
  coalesce(age, 5.0)::DOUBLE AS age
FROM raw"""
)
def code_or_number(spark: SparkSession, sf: str) -> DataFrame:
    raw = cleaning.fill_defaults(raw_fields(spark, sf))
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", number_or_code(F.col("derniereplace"), 10.0).alias("place"), "age"
    )


@query(
    """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    CASE l_linenumber WHEN 1 THEN 'gauche' WHEN 2 THEN 'Droite' WHEN 3 THEN 'centre' WHEN 4 THEN '?' ELSE CAST(l_linenumber AS VARCHAR) END AS corde
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber WHEN 1 THEN -1.0 WHEN 2 THEN 99.0 WHEN 3 THEN 50.0 WHEN 4 THEN 0.0 ELSE l_linenumber END::DOUBLE AS rail,
  floor(l_extendedprice)::DOUBLE AS amount,
  round(CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE l_quantity / (l_linenumber % 3) END, 6) AS share,
  CASE WHEN l_quantity <= 3 THEN 'favorite' WHEN l_quantity <= 5 THEN 'second_choice' WHEN l_quantity <= 10 THEN 'mid_odds'
    WHEN l_quantity <= 20 THEN 'long_shot' ELSE 'extreme' END AS odds_bucket,
  CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS left_bucket
FROM t"""
)
def scalar_helpers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    rail = F.when(n == 1, "gauche").when(n == 2, "Droite").when(n == 3, "centre").when(n == 4, "?").otherwise(n.cast("string"))
    amount = F.format_number(F.floor("l_extendedprice"), 0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        rail_code(rail).alias("rail"),
        money(amount).alias("amount"),
        F.round(safe_divide(F.col("l_quantity"), n % 3, -1.0), 6).alias("share"),
        bucket(
            F.col("l_quantity"), [0, 3, 5, 10, 20, 100], ["favorite", "second_choice", "mid_odds", "long_shot", "extreme"]
        ).alias("odds_bucket"),
        bucket(F.col("l_quantity"), [0, 10, 30, 1000], ["low", "mid", "high"], right_closed=False).alias("left_bucket"),
    )


@query(
    """
WITH v AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'unknown' ELSE p_type END AS v FROM part),
c AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM v))
SELECT p_partkey, code AS type_code FROM v JOIN c USING (v)"""
)
def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("p_type"))
    return cleaning.category_codes(parts, "p_type", "type_code").select("p_partkey", "type_code")


@query(
    """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount >= 0.03 THEN l_quantity END AS q,
    CASE WHEN l_quantity > 5 THEN l_extendedprice END AS p FROM lineitem),
m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(p, 0.5) AS mp FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(q, mq) AS q, round(coalesce(p, mp), 4) AS p FROM v, m"""
)
def median_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_discount") >= 0.03, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")).alias("p"),
    )
    return rounded(cleaning.fill_median(rows, ["q", "p"]), 4)


@query(
    RAW_SQL
    + """,
m AS (SELECT max(try_cast(derniereplace AS DOUBLE)) AS top FROM raw)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN coalesce(trim(derniereplace), '') = '' THEN top + 50
    WHEN try_cast(derniereplace AS DOUBLE) IS NOT NULL THEN try_cast(derniereplace AS DOUBLE)
    ELSE top + CASE upper(trim(derniereplace)) WHEN 'DAI' THEN 10 WHEN 'ARR' THEN 20 WHEN 'NP' THEN 30 ELSE 40 END END AS result
FROM raw, m"""
)
def result_codes_to_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_fields(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "derniereplace")
    return cleaning.result_numbers(rows, "derniereplace", "result").drop("derniereplace")


@query(
    WITH_RUNNERS
    + """
SELECT race_id, numero, CAST(position AS DOUBLE) AS target,
  CASE WHEN position = 1 THEN 'win' WHEN position <= 3 THEN 'place' ELSE 'other' END AS target_class,
  rank() OVER (PARTITION BY race_id ORDER BY odds) AS target_rank,
  CAST(least((position - 1) // 3, 4) AS INTEGER) AS target_bin
FROM runners"""
)
def training_targets(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = runners(spark, sf)
    rows = cleaning.target(rows, "position", "regression")
    rows = cleaning.target(rows, "position", "class", "target_class")
    rows = rank_within(rows, by_race, "odds", "target_rank")
    return rows.select(
        "race_id", "numero", "target", "target_class", "target_rank", cleaning.position_class(F.col("position")).alias("target_bin")
    )


@query(
    """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dayofweek, round(ln(o_totalprice + 1), 6) AS cheque_log,
  CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 5 WHEN lower(o_orderpriority) LIKE '%high%' THEN 4
    WHEN lower(o_orderpriority) LIKE '%medium%' THEN 3 ELSE 0 END AS class_no,
  CASE WHEN o_totalprice > 50000 OR o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS major
FROM orders"""
)
def date_parts_and_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.with_date_parts(table(spark, sf, "orders"), "o_orderdate")
    rows = rows.withColumns({"quinte": F.col("o_orderpriority") == "1-URGENT", "groupe": F.lit(None).cast("string")})
    rows = cleaning.log_columns(rows.withColumn("cheque", F.col("o_totalprice")), {"o_totalprice": "cheque_log"})
    return rows.select(
        "o_orderkey",
        "year",
        "month",
        "dayofweek",
        F.round("cheque_log", 6).alias("cheque_log"),
        keyword_class(F.col("o_orderpriority"), {"urgent": 5, "high": 4, "medium": 3}).alias("class_no"),
        cleaning.major_race().cast("int").alias("major"),
    )


@query(
    WITH_FIELD
    + """,
e AS (
  SELECT race_id, numero, typec, CASE WHEN line_no % 2 = 0 THEN price ELSE 0 END AS gains,
    CASE WHEN odds > 30 THEN CAST(odds AS BIGINT) % 4 ELSE 0 END AS wins, CASE WHEN odds > 40 THEN 2 ELSE 0 END AS places,
    CAST(odds AS BIGINT) AS starts,
    CASE typec WHEN '1-URGENT' THEN 'Plat' WHEN '2-HIGH' THEN 'Haies' WHEN '3-MEDIUM' THEN 'A' ELSE 'other' END AS kind
  FROM field),
m AS (
  SELECT race_id, CASE WHEN count(v) >= 3 THEN quantile_cont(v, 0.5) END AS med
  FROM (SELECT race_id, CASE WHEN gains > 0 AND starts >= 5 THEN gains END AS v FROM e) GROUP BY race_id)
SELECT e.race_id, numero, round(med, 4) AS field_median,
  round(CASE WHEN gains > 0 THEN gains
    WHEN wins > 0 OR places > 0 THEN wins * CASE kind WHEN 'Plat' THEN 50000 WHEN 'Haies' THEN 40000 WHEN 'A' THEN 35000 ELSE 40000 END
      + places * CASE kind WHEN 'Plat' THEN 15000 WHEN 'Haies' THEN 12000 WHEN 'A' THEN 10000 ELSE 12000 END
      + greatest(starts - wins - places, 0) * 5000
    WHEN starts >= 5 AND med IS NOT NULL THEN med ELSE 0 END, 4)::DOUBLE AS gains_imputed
FROM e JOIN m ON e.race_id = m.race_id"""
)
def impute_by_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = earnings_rows(spark, sf)
    out = imputation.impute_earnings(rows, by_race, "gains", "wins", "places", "starts", "kind")
    return rounded(out.select("race_id", "numero", "field_median", "gains_imputed"), 4)


def earnings_rows(spark: SparkSession, sf: str):
    from .roles import field

    rows, by_race = field(spark, sf)
    t = F.col("typec")
    rows = rows.select(
        "race_id",
        "numero",
        F.when(F.col("line_no") % 2 == 0, F.col("price")).otherwise(0.0).alias("gains"),
        F.when(F.col("odds") > 30, F.col("odds").cast("long") % 4).otherwise(0).alias("wins"),
        F.when(F.col("odds") > 40, 2).otherwise(0).alias("places"),
        F.col("odds").cast("long").alias("starts"),
        F.when(t == "1-URGENT", "Plat").when(t == "2-HIGH", "Haies").when(t == "3-MEDIUM", "A").otherwise("other").alias("kind"),
    )
    return rows, by_race


@query(
    """
WITH e AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE 0 END AS gains,
    CASE WHEN l_quantity > 30 THEN CAST(l_quantity AS BIGINT) % 4 ELSE 0 END AS wins, CASE WHEN l_quantity > 40 THEN 2 ELSE 0 END AS places,
    CAST(l_quantity AS BIGINT) AS starts
  FROM lineitem)
SELECT count(*) AS total_horses, count(*) FILTER (WHERE gains <= 0) AS missing_earnings,
  count(*) FILTER (WHERE gains <= 0 AND (wins > 0 OR places > 0)) AS can_impute_performance,
  count(*) FILTER (WHERE gains <= 0 AND wins = 0 AND places = 0 AND starts >= 5) AS can_impute_field_median,
  count(*) FILTER (WHERE gains <= 0 AND wins = 0 AND places = 0 AND starts < 5) AS will_be_zero
FROM e"""
)
def imputation_counts(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).otherwise(0.0).alias("gains"),
        F.when(q > 30, q.cast("long") % 4).otherwise(0).alias("wins"),
        F.when(q > 40, 2).otherwise(0).alias("places"),
        q.cast("long").alias("starts"),
    )
    return imputation.imputation_counts(rows, "gains", "wins", "places", "starts")


@query(
    """
WITH v AS (SELECT l_orderkey AS race_id, CASE WHEN l_quantity >= 5 AND l_extendedprice / l_quantity <= 300000 THEN l_extendedprice / l_quantity END AS v FROM lineitem)
SELECT race_id, round(CASE WHEN count(v) >= 2 THEN quantile_cont(v, 0.5) ELSE 100000 END, 8) AS field_mean FROM v GROUP BY race_id"""
)
def field_mean_earnings(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("race_id"), "l_extendedprice", "l_quantity")
    by_race = Grouping.measure(lines, "race_id")
    return rounded(imputation.field_mean_earnings(lines, by_race, "l_extendedprice", "l_quantity"), 8)


@query(
    WITH_FIELD
    + """
SELECT race_id, numero, CASE WHEN (CASE WHEN odds < 10 THEN 1 ELSE 0 END) + (CASE WHEN position > 3 THEN 1 ELSE 0 END)
      + (CASE WHEN discount < 0.03 THEN 1 ELSE 0 END) + (CASE WHEN flag = 'N' THEN 1 ELSE 0 END) >= 2 THEN 'horse_career'
    WHEN (CASE WHEN status = 'O' THEN 1 ELSE 0 END) + (CASE WHEN tax < 0.02 THEN 1 ELSE 0 END)
      + (CASE WHEN odds > 25 THEN 1 ELSE 0 END) >= 2 THEN 'jockey_context' END AS gap
FROM field"""
)
def data_gap_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = horse_field(spark, sf)
    rows = rows.select(
        "race_id",
        "numero",
        F.when(F.col("odds") >= 10, F.col("odds")).alias("coursescheval"),
        F.when(F.col("position") <= 3, F.col("position")).otherwise(0).alias("victoirescheval"),
        F.when(F.col("discount") >= 0.03, F.lit(1.0)).alias("placescheval"),
        F.when(F.col("flag") != "N", F.col("flag")).otherwise("").alias("musiqueche"),
        F.when(F.col("status") != "O", F.col("status")).alias("musiquejoc"),
        F.when(F.col("tax") >= 0.02, F.lit(1.0)).alias("pourcVictJockHippo"),
        F.when(F.col("odds") <= 25, F.col("odds")).alias("pourcPlaceJockHippo"),
    )
    return rows.select("race_id", "numero", cleaning.data_gaps(rows).alias("gap"))


@query(
    WITH_RUNNERS
    + """,
bad AS (SELECT race_id FROM runners GROUP BY race_id HAVING avg(pred_a) > 30 OR max(pred_a) > 48)
SELECT race_id, numero FROM runners WHERE race_id NOT IN (SELECT race_id FROM bad) AND position < 50"""
)
def drop_implausible_races(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    kept = cleaning.drop_implausible(rows, ["race_id"], "pred_a", 30.0, 48.0)
    return cleaning.valid_finish(kept, "position").select("race_id", "numero")


@query(
    """
WITH v AS (SELECT l_quantity AS a, CASE WHEN l_discount > 0.02 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END AS n,
    CASE l_linenumber % 4 WHEN 0 THEN 'gauche' WHEN 1 THEN 'droite' WHEN 2 THEN 'x' END AS corde FROM lineitem),
m AS (SELECT quantile_cont(try_cast(n AS DOUBLE), 0.5) AS med FROM v),
c AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT DISTINCT coalesce(corde, 'unknown') AS k FROM v)),
r AS (SELECT a, coalesce(try_cast(n AS DOUBLE), med) AS n, code AS corde_code FROM v JOIN c ON c.k = coalesce(v.corde, 'unknown'), m)
SELECT corde_code, count(*) AS rows, round(sum(a), 4) AS a_sum, round(sum(n), 4) AS n_sum FROM r GROUP BY corde_code"""
)
def prepared_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric training frame: text coerced and median-filled, a sparse category coded, an unusable column dropped."""
    kind = F.col("l_linenumber") % 4
    rows = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"),
        F.when(F.col("l_discount") > 0.02, F.col("l_suppkey").cast("string")).otherwise("").alias("n"),
        F.when(kind == 0, "gauche").when(kind == 1, "droite").when(kind == 2, "x").alias("corde"),
        F.col("l_returnflag").alias("unusable"),
        F.col("l_orderkey").alias("comp"),
    )
    ready = cleaning.model_ready(rows, ["comp"], codes=["corde"])
    out = ready.groupBy("corde_code").agg(F.count(F.lit(1)).alias("rows"), F.sum("a").alias("a_sum"), F.sum("n").alias("n_sum"))
    return rounded(out, 4)
