"""Audits over the numeric columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, profiles, quality
from ..operators.grouping import with_group_stats
from ..sources.tables import stage_path
from .history import horse_field
from .registry import query
from .roles import WITH_FIELD, rounded, table

AUDITED = ("l_quantity", "price_root", "disc", "tax", "flag_no", "constant", "sparse", "spike", "l_linenumber")

_AUDIT_ROWS = """
WITH a AS (
  SELECT l_orderkey, l_quantity, sqrt(l_extendedprice) AS price_root, CASE WHEN l_discount > 0 THEN l_discount END AS disc,
    l_tax AS tax, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.0 ELSE -1.0 END AS flag_no, 7.0 AS constant,
    CASE WHEN l_quantity > 40 THEN l_quantity ELSE 0 END AS sparse, CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 1000.0 ELSE 1.5 END AS spike,
    l_linenumber, l_quantity * 2 + l_tax * 0.1 AS doubled
  FROM lineitem)"""
_LONG = _AUDIT_ROWS + """,
long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM a" for c in AUDITED) + """),
vals AS (SELECT col, v, count(*) AS n FROM long GROUP BY col, v),
common AS (SELECT col, v AS most_common, n AS most_common_count FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS k FROM vals WHERE v IS NOT NULL) WHERE k = 1),
m AS (SELECT col, count(*) AS rows, count(*) - count(v) AS missing, count(DISTINCT v) AS dist, count(*) FILTER (WHERE v = 0) AS zeros,
    count(*) FILTER (WHERE v < 0) AS negatives, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_samp(v) AS std, stddev_pop(v) AS sp,
    quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY col),
mm AS (SELECT l.col, CASE WHEN any_value(sp) > 0 THEN avg(pow((v - mean) / nullif(sp, 0), 3)) END AS skew,
    CASE WHEN any_value(sp) > 0 THEN avg(pow((v - mean) / nullif(sp, 0), 4)) - 3 END AS kurt,
    count(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS outliers FROM long l JOIN m ON l.col = m.col GROUP BY l.col),
audit AS (SELECT m.*, most_common, most_common_count, skew, kurt, outliers, missing / rows * 100 AS missing_pct, zeros / rows * 100 AS zero_pct,
    dist / rows * 100 AS distinct_pct, outliers / (rows - missing) * 100 AS outlier_pct FROM m JOIN common USING (col) JOIN mm USING (col))"""


def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    q, one = F.col("l_quantity"), F.lit(1.0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        F.sqrt("l_extendedprice").alias("price_root"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("disc"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.0).otherwise(-1.0).alias("flag_no"),
        (one * 7).alias("constant"),
        F.when(q > 40, q).otherwise(0.0).alias("sparse"),
        F.when((q == 50) & (F.col("l_linenumber") == 7), 1000.0).otherwise(1.5).alias("spike"),
        "l_linenumber",
        (q * 2 + F.col("l_tax") * 0.1).alias("doubled"),
    )


@query(
    _LONG
    + """
SELECT col AS "column", rows, missing, dist AS "distinct", zeros, negatives, round(lo, 6) AS min, round(hi, 6) AS max, round(most_common, 6) AS most_common,
  most_common_count, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis, round(q1, 6) AS q1,
  round(median, 6) AS median, round(q3, 6) AS q3, outliers, round(missing_pct, 6) AS missing_pct, round(zero_pct, 6) AS zero_pct,
  round(distinct_pct, 6) AS distinct_pct, round(most_common_count / rows, 6) AS most_common_freq, round(hi - lo, 6) AS range, round(outlier_pct, 6) AS outlier_pct
FROM audit"""
)
def column_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(quality.column_audit(audit_rows(spark, sf), AUDITED))
    return out.withColumns({c: F.round(c, 4) for c in ("skewness", "kurtosis")})


@query(
    _LONG
    + """
SELECT col AS "column", rows, missing, zeros, negatives, round(lo, 9) AS min, round(hi, 9) AS max, round(mean, 9) AS mean, round(std, 9) AS std,
  round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis, round(missing_pct, 9) AS missing_pct, round(zero_pct, 9) AS zero_pct FROM audit"""
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The exact part of a column audit from profiles of 31 days, stored day by day and added up."""
    rows = audit_rows(spark, sf).withColumn("day", F.col("l_orderkey") % 31)
    path = stage_path(spark, "profiles")
    for late in (False, True):  # new days are profiled alone and put beside the others
        part = rows.where((F.col("day") >= 20) == F.lit(late))
        profiles.daily_profiles(part, AUDITED, "day").write.mode("append").parquet(path)
    exact = ("rows", "missing", "zeros", "negatives", "min", "max", "mean", "std", "skewness", "kurtosis", "missing_pct", "zero_pct")
    out = rounded(profiles.merged(spark.read.parquet(path)).select("column", *exact), 9)
    return out.withColumns({c: F.round(c, 4) for c in ("skewness", "kurtosis")})


@query(
    _LONG
    + """
SELECT col AS "column", 'constant' AS issue, 'high' AS severity FROM audit WHERE dist = 1
UNION ALL SELECT col, 'missing', 'high' FROM audit WHERE missing_pct > 50
UNION ALL SELECT col, 'all_zeros', 'high' FROM audit WHERE zero_pct = 100
UNION ALL SELECT col, 'skewed', 'medium' FROM audit WHERE abs(skew) > 5
UNION ALL SELECT col, 'leakage', 'high' FROM audit WHERE regexp_matches(lower(col), 'cl|ecar|place|rank|result|finish|arrived|position')
UNION ALL SELECT col, 'low_variance', 'low' FROM audit WHERE dist > 1 AND distinct_pct < 1
UNION ALL SELECT col, 'outliers', 'low' FROM audit WHERE outlier_pct > 5
UNION ALL SELECT col, 'zeros', 'low' FROM audit WHERE zero_pct > 50 AND zero_pct < 100
UNION ALL SELECT col, 'negative', 'low' FROM audit WHERE negatives > 0"""
)
def audit_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    audit = quality.column_audit(audit_rows(spark, sf), AUDITED)
    return quality.audit_flags(audit).select("column", "issue", "severity")


@query(
    _AUDIT_ROWS
    + """
SELECT 'l_quantity' AS first, 'doubled' AS second, round(corr(l_quantity, doubled), 6) AS correlation FROM a HAVING corr(l_quantity, doubled) > 0.95"""
)
def correlated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit_rows(spark, sf).drop("l_orderkey", "constant")
    return rounded(quality.correlated_pairs(rows, quality.numeric_columns(rows)))


@query(
    _AUDIT_ROWS
    + """
SELECT * FROM (SELECT 'price_root' AS "column", round(corr(price_root, l_quantity), 6) AS correlation FROM a
UNION ALL SELECT 'tax', round(corr(tax, l_quantity), 6) FROM a UNION ALL SELECT 'doubled', round(corr(doubled, l_quantity), 6) FROM a
UNION ALL SELECT 'sparse', round(corr(sparse, l_quantity), 6) FROM a)"""
)
def feature_target_correlation(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit_rows(spark, sf)
    return rounded(quality.target_correlation(rows, ["price_root", "tax", "doubled", "sparse"], "l_quantity"))


@query(
    _AUDIT_ROWS
    + """
SELECT l_orderkey, count(*) AS horses, round((count(*) - count(disc)) / (count(*) * 4) * 100, 6) AS missing_pct,
  round((count(*) FILTER (WHERE tax = 0) + count(*) FILTER (WHERE sparse = 0) + count(*) FILTER (WHERE flag_no = 0)) / (count(*) * 4) * 100, 6) AS zero_pct
FROM a GROUP BY l_orderkey"""
)
def audit_by_race(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.by_race(audit_rows(spark, sf), "l_orderkey", ["disc", "tax", "sparse", "flag_no"]))


_COMPLETE = """
WITH a AS (SELECT l_shipdate, l_returnflag, CASE WHEN l_discount > 0.02 THEN l_discount END AS cheque,
    CASE WHEN l_quantity > 20 THEN l_quantity END AS derniereplace, l_tax AS ecar FROM lineitem),
s AS (SELECT l_returnflag, avg(CASE WHEN cheque IS NOT NULL THEN 1 ELSE 0 END) * 100 AS c,
    avg(CASE WHEN derniereplace IS NOT NULL THEN 1 ELSE 0 END) * 100 AS d, 100.0 AS e FROM a GROUP BY l_returnflag),
checks AS (SELECT l_returnflag, 'cheque' AS col, c AS filled_pct, 80.0 AS minimum FROM s UNION ALL SELECT l_returnflag, 'derniereplace', d, 60.0 FROM s
  UNION ALL SELECT l_returnflag, 'ecar', e, NULL FROM s)"""


def filled(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("cheque"),
        F.when(F.col("l_quantity") > 20, F.col("l_quantity")).alias("derniereplace"),
        F.col("l_tax").alias("ecar"),
    )
    return quality.completeness(rows, {"cheque": 80, "derniereplace": 60, "ecar": None}, ["l_returnflag"])


@query(
    _COMPLETE
    + """
SELECT l_returnflag, col AS "column", round(filled_pct, 6)::DOUBLE AS filled_pct, minimum::DOUBLE AS minimum,
  CASE WHEN filled_pct < minimum THEN 'fail' ELSE 'pass' END AS status FROM checks"""
)
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(filled(spark, sf))


@query(
    _COMPLETE
    + """
SELECT count(*) AS checks, count(*) FILTER (WHERE filled_pct < minimum) AS failed,
  CASE WHEN count(*) FILTER (WHERE filled_pct < minimum) > 0 THEN 'fail' ELSE 'pass' END AS overall FROM checks"""
)
def completeness_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return quality.verdict(filled(spark, sf))


@query(
    """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 5 AS age, l_discount * 12 AS win, l_tax - 0.02 AS odds FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, issue FROM (
  SELECT *, 'age' AS issue FROM a WHERE age > 30 OR age < 1 UNION ALL SELECT *, 'win_ratio' FROM a WHERE win > 1
  UNION ALL SELECT *, 'odds' FROM a WHERE odds < 0)"""
)
def value_rules(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(
        *keys,
        (F.col("l_quantity") - 5).alias("age"),
        (F.col("l_discount") * 12).alias("ratio_victoires"),
        (F.col("l_tax") - 0.02).alias("cotedirect"),
    )
    return quality.value_rules(rows, quality.runner_rules(), *keys)


@query(
    """
WITH t AS (SELECT sqrt(l_extendedprice) AS a, l_quantity AS b, l_discount AS c FROM lineitem WHERE l_linestatus = 'F'),
d AS (SELECT sqrt(l_extendedprice) AS a, l_quantity + 100 AS b FROM lineitem WHERE l_linestatus = 'O')
SELECT 'a' AS "column", round((SELECT avg(a) FROM t), 6) AS train_mean, round((SELECT stddev_samp(a) FROM t), 6) AS train_std,
  round((SELECT avg(a) FROM d), 6) AS daily_mean, round((SELECT stddev_samp(a) FROM d), 6) AS daily_std, 'ok' AS status
UNION ALL SELECT 'b', round((SELECT avg(b) FROM t), 6), round((SELECT stddev_samp(b) FROM t), 6), round((SELECT avg(b) FROM d), 6), round((SELECT stddev_samp(b) FROM d), 6), 'drift'
UNION ALL SELECT 'c', round((SELECT avg(c) FROM t), 6), round((SELECT stddev_samp(c) FROM t), 6), NULL, NULL, 'missing in daily'"""
)
def drift(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    root = F.sqrt("l_extendedprice").alias("a")
    train = lines.where(F.col("l_linestatus") == "F").select(root, F.col("l_quantity").alias("b"), F.col("l_discount").alias("c"))
    daily = lines.where(F.col("l_linestatus") == "O").select(root, (F.col("l_quantity") + 100).alias("b"))
    return rounded(quality.drift(train, daily, ["a", "b", "c"]))


@query(
    """
SELECT count(*) AS rows, count(*) - count(CASE WHEN l_discount > 0.02 THEN l_discount END) AS nulls, CAST(0 AS BIGINT) AS nans,
  count(*) FILTER (WHERE l_quantity = 1) AS infinite, count(*) FILTER (WHERE l_quantity = 1) + count(*) FILTER (WHERE l_quantity > 1 AND 1 / (l_quantity - 1) > 0.5) AS out_of_range
FROM lineitem"""
)
def data_assertions(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(
        F.when(q == 1, float("inf")).otherwise(F.try_divide(F.lit(1.0), q - 1)).alias("x"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("y"),
    )
    return quality.assertions(rows, ["x", "y"], high=0.5)


@query(
    """
SELECT c AS "column", t AS type, 'base' AS category, m AS missing, p AS present FROM (
  SELECT 'p_partkey' AS c, 'bigint' AS t, count(*) - count(p_partkey) AS m, 1 AS p FROM part UNION ALL SELECT 'p_size', 'int', count(*) - count(p_size), 1 FROM part
  UNION ALL SELECT 'p_brand', 'string', count(*) - count(p_brand), 1 FROM part UNION ALL SELECT 'age', 'double', count(*), 0 FROM part)"""
)
def schema_report(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    return quality.schema_report(parts, {"age": "double"}).withColumn("present", F.col("present").cast("int"))


@query(
    WITH_FIELD
    + """
SELECT race_id, count(DISTINCT odds) AS odds_values, count(DISTINCT jour) AS jour_values FROM field GROUP BY race_id"""
)
def varying_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = horse_field(spark, sf)
    return quality.varying_columns(rows, "race_id", ["odds", "jour"])


@query(
    WITH_FIELD
    + """,
d AS (SELECT horse_id, jour, count(*) AS n FROM field GROUP BY horse_id, jour),
e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY horse_id ORDER BY jour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT horse_id, jour, CAST(before + n AS BIGINT) AS claimed, CAST(before AS BIGINT) AS expected FROM e WHERE n > 1"""
)
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    """Checks a leaky count (one that includes the same day when a horse runs twice) against the as-of count."""
    rows, by_horse = horse_field(spark, sf)
    rows = history.asof_totals(rows, by_horse, "jour", starts=F.lit(1)).na.fill(0, ["starts"])
    leaky = with_group_stats(rows.select("horse_id", "jour", "starts"), by_horse.with_keys("jour"), same_day=F.count(F.lit(1)))
    leaky = leaky.where(F.col("horse_id").isNotNull() & F.col("jour").isNotNull())
    starts = F.col("starts") + F.when(F.col("same_day") > 1, F.col("same_day")).otherwise(0)
    return quality.leak_check(leaky.withColumn("starts", starts), "horse_id", "jour", "starts")


@query(
    """
WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)
SELECT CASE WHEN l.k IS NULL THEN 'only_right' WHEN r.k IS NULL THEN 'only_left' ELSE 'shared' END AS side, count(*) AS n FROM l FULL JOIN r ON l.k = r.k GROUP BY 1"""
)
def key_comparison(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "k")
    left = lines.where(F.col("l_returnflag") == "A")
    right = lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25))
    return quality.key_comparison(left, right, ["k"])


@query(
    """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)), 6) AS share
FROM events GROUP BY 1, 2"""
)
def collection_statistics(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), "event_type")
    return rounded(quality.status_counts(events, "event_type", ["day"]))
