"""Mergeable profiles against exact audits, the paired comparison, and residual models by folder."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import models, profiles, quality
from rankfold.plans import quality as plans_quality

COLUMNS = ["flat", "wide", "sparse", "skewed", "empty", "constant"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    data = [
        (
            i % 13,
            float(draw.randint(0, 9)),
            draw.random() * 1e6,
            None if i % 3 else draw.choice([0.0, float("nan"), -2.0]),
            math.exp(draw.gauss(0, 2)),
            None,
            1e9 + 7.0,
        )
        for i in range(20_000)
    ]
    return spark.createDataFrame(data, "day int, " + ", ".join(f"{c} double" for c in COLUMNS)).cache()


def test_added_up_days_equal_one_audit(spark, rows, folder):
    for late in (True, False):
        part = rows.where((F.col("day") > 6) == F.lit(late))
        profiles.daily_profiles(part, COLUMNS, "day").write.mode("append").parquet(folder + "/p")
    stored = spark.read.parquet(folder + "/p")
    assert stored.count() == 13 * len(COLUMNS)
    got = {r["column"]: r for r in profiles.merged(stored).collect()}
    clean = rows.select("day", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in COLUMNS])
    want = {r["column"]: r for r in quality.column_audit(clean, COLUMNS).collect()}
    assert set(got) == set(COLUMNS)
    for c in ("flat", "wide", "sparse", "skewed", "constant"):
        for name in ("rows", "missing", "zeros", "negatives", "min", "max"):
            assert got[c][name] == want[c][name], (c, name)
        for name in ("mean", "missing_pct", "zero_pct", "range"):
            assert got[c][name] == pytest.approx(want[c][name], rel=1e-9)
        for name in ("std", "skewness", "kurtosis"):
            if c != "constant":
                assert got[c][name] == pytest.approx(want[c][name], rel=1e-6), (c, name)
        assert abs(got[c].distinct - want[c].distinct) <= 4 * 0.016 * want[c].distinct + 1
        values = np.sort([r[0] for r in clean.select(c).where(f"{c} is not null").collect()])
        for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
            low, high = np.searchsorted(values, got[c][name], "left"), np.searchsorted(values, got[c][name], "right")
            assert low / len(values) - 0.0165 <= q <= high / len(values) + 0.0165, (c, name)
        assert abs((got[c].outlier_pct or 0) - (want[c].outlier_pct or 0)) < 3
    assert got["constant"].std == 0 and got["constant"].skewness is None
    assert got["flat"].most_common_count == want["flat"].most_common_count
    empty = got["empty"]
    assert (empty.rows, empty.missing, empty.distinct) == (20_000, 20_000, 0) and empty["mean"] is None and empty.q1 is None
    assert {r.issue for r in quality.audit_flags(profiles.merged(stored).where("`column` = 'constant'")).collect()} >= {"constant"}


def test_a_corrected_day_replaces_its_profile(spark, rows):
    first = profiles.daily_profiles(rows, ["flat"], "day")
    other = profiles.daily_profiles(rows.withColumn("flat", F.col("flat") + 100).where("day = 3"), ["flat"], "day")
    both = profiles.merged(first.where("day <> 3").unionByName(other)).collect()[0]
    want = rows.withColumn("flat", F.when(F.col("day") == 3, F.col("flat") + 100).otherwise(F.col("flat")))
    assert both["mean"] == pytest.approx(want.agg(F.avg("flat")).head()[0]) and both["max"] == 109.0


def scores(spark, gain):
    draw = random.Random(8)
    data = []
    for race in range(300):
        luck = draw.gauss(0, 1)
        for _ in range(6):
            actual = draw.uniform(1, 10)
            data.append((race, actual, actual + luck, actual + luck * (1 - gain) + draw.gauss(0, 0.01)))
    return spark.createDataFrame(data, "race long, actual double, old double, new double")


def test_paired_gain_tells_a_gain_from_none(spark):
    better = models.paired_gain(scores(spark, 0.3), "race", "old", "new", "actual").collect()
    assert len(better) == 1 and better[0].rows == 1800
    assert better[0].certain and better[0].significant and better[0].gain_low < better[0].gain < better[0].gain_high
    assert better[0].gain == pytest.approx(1 - better[0].refit_mae / better[0].baseline_mae)
    same = models.paired_gain(scores(spark, 0.0), "race", "old", "new", "actual").collect()[0]
    assert not same.certain and not same.significant
    again = models.paired_gain(scores(spark, 0.3).repartition(7), "race", "old", "new", "actual").collect()[0]
    assert again.gain_low == pytest.approx(better[0].gain_low)
    nothing = models.paired_gain(scores(spark, 0.3).where("false"), "race", "old", "new", "actual").collect()[0]
    assert (nothing.gain, nothing.certain, nothing.significant) == (None, False, False)


def test_residual_models_of_odd_types(spark, monkeypatch):
    monkeypatch.setattr(models, "MIN_TYPE_ROWS", 20)
    kinds = ["a/b=c", "", None, "few", "42"]
    data = [(i, float(i % 7), 5.0, 5.0 + kinds_shift(kinds[i % 5]), kinds[i % 5] if i % 5 != 3 or i < 30 else "42") for i in range(400)]
    df = spark.createDataFrame(data, "id long, x double, base double, y double, kind string")
    model = models.ResidualModels(["x"], "base", "y", "kind").fit(df, numTrees=3, maxDepth=2)
    assert set(model.by_kind) == {"a/b=c", "", "42"}
    other = spark.createDataFrame([(9999, 1.0, 5.0, None, "unknown")], df.schema)
    out = {r.id: r for r in model.transform(df.unionByName(other)).collect()}
    assert len(out) == 401 and out[0].corrected_prediction == pytest.approx(7.0) and out[1].corrected_prediction == pytest.approx(4.0)
    assert out[9999].corrected_prediction >= 1 and [c for c in model.transform(other).columns] == [*df.columns, "corrected_prediction"]


def kinds_shift(kind):
    return {"a/b=c": 2.0, "": -1.0, None: 0.5, "few": 0.0, "42": 3.0}[kind]


def test_leak_check_reads_its_tables_once(spark, folder):
    spark.createDataFrame(
        [(1, 7, 1), (1, 7, 2), (2, 7, 1), (2, None, 2), (3, 8, 1), (3, 8, 2)], "l_orderkey long, l_partkey long, l_linenumber int"
    ).selectExpr(
        "*", "1L AS l_suppkey", "1D AS l_quantity", "1D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'A' AS l_returnflag",
        "'F' AS l_linestatus", "timestamp'2024-01-01' AS l_shipdate",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, None)], "o_orderkey long, d string").selectExpr(
        "o_orderkey", "1L AS o_custkey", "'F' AS o_orderstatus", "1D AS o_totalprice", "to_timestamp(d) AS o_orderdate", "'1-URGENT' AS o_orderpriority"
    ).write.parquet(f"{folder}/orders.parquet")
    out = plans_quality.leak_check(spark, folder)
    assert [tuple(map(str, r)) for r in out.collect()] == [("7", "2024-01-01", "2", "0")]
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
