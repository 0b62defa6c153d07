"""Groups above the row limit take another way to the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rankfold.operators import cleaning, history, quality
from rankfold.operators.grouping import (
    Grouping,
    previous_rows,
    quantiles_within,
    rank_within,
    row_number_within,
    top_k,
    with_group_stats,
)



def by_day():
    return [F.col("day").asc(), F.col("id").asc()]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    # Key 0 and the missing key hold a third of all rows each, with many ties.
    out = []
    for i in range(900):
        key = (0, None, rng.randint(1, 60))[i % 3]
        day = f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"
        out.append((i, key, day, rng.randint(0, 12), None if rng.random() < 0.5 else float(rng.randint(1, 9)), rng.choice("ab")))
    return spark.createDataFrame(out, "id long, k long, day string, v long, age double, going string").withColumn(
        "day", F.to_date("day")
    ).cache()


@pytest.fixture(scope="module")
def groupings(data):
    hot = Grouping.measure(data, "k", max_rows=100)
    assert {r["k"] for r in hot.hot.collect()} == {0, None}
    return Grouping(("k",)), hot


def same(data, groupings, operator):
    plain, hot = (rows(operator(data, g)) for g in groupings)
    assert plain == hot
    return plain


def test_small_input_is_not_counted(data):
    assert Grouping.measure(data, "k").hot is None


def test_row_number(data, groupings):
    got = same(data, groupings, lambda d, g: row_number_within(d, g, [F.col("v").desc(), *by_day()], "no").select("id", "k", "no"))
    numbers = sorted(r[2] for r in got if r[1] == 0)
    assert numbers == list(range(1, len(numbers) + 1))


@pytest.mark.parametrize("method", ["min", "average"])
def test_rank_with_ties(data, groupings, method):
    got = same(data, groupings, lambda d, g: rank_within(d, g, "v", "r", method).select("id", "k", "v", "r"))
    values = [r[2] for r in got if r[1] == 0]
    for _, k, v, r in got:
        if k == 0:
            below, equal = sum(x < v for x in values), values.count(v)
            assert r == (below + 1 if method == "min" else below + (equal + 1) / 2)


def test_group_stats(data, groupings):
    same(data, groupings, lambda d, g: with_group_stats(d, g, n=F.count(F.lit(1)), m=F.max("v")).select("id", "n", "m"))


def test_quantiles(data, groupings):
    got = same(
        data, groupings,
        lambda d, g: quantiles_within(d, g, "v", [0.1, 0.5, 0.77], "q").select(
            "k", *[F.round(F.get("q", i), 9).alias(f"q{i}") for i in range(3)]
        ),
    )
    values = sorted(r["v"] for r in data.where("k = 0").collect())
    middle = next(r for r in got if r[0] == 0)[2]
    n = len(values)
    assert middle == (values[(n - 1) // 2] + values[n // 2]) / 2


def test_previous_rows(data, groupings):
    text = F.array_join(F.transform("p", lambda s: s["v"].cast("string")), ",")
    same(data, groupings, lambda d, g: previous_rows(d, g, by_day(), ["v"], 5, "p").select("id", text.alias("p")))


def test_asof_totals_against_brute_force(data, groupings):
    got = same(data, groupings, lambda d, g: history.asof_totals(d, g, "day", n=F.lit(1), s=F.col("v")).select("id", "n", "s"))
    source = {r["id"]: r for r in data.collect()}
    for i, n, s in got:
        earlier = [r["v"] for r in source.values() if r["k"] == source[i]["k"] and r["day"] < source[i]["day"]]
        assert (n or 0) == len(earlier) and (s or 0) == sum(earlier)


def test_event_career(data, groupings):
    career = lambda d, g: history.event_career(
        d.withColumn("h", F.col("going") == "a").withColumn("p", F.when(F.col("v") > 0, F.col("v"))), g, "day", "p", "h", "v", "going"
    ).drop("day", "age", "going", "h", "p", "v")
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])
    same(data, groupings, lambda d, g: rounded(career(d, g)))


def test_fill_age(data, groupings):
    got = same(data, groupings, lambda d, g: history.fill_age(d, g, by_day()).select("id", "age"))
    assert all(r[1] is not None for r in got)


def test_one_value_in_the_hot_group(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 2).alias("k"), F.lit(5).alias("v"))
    hot = Grouping.measure(df, "k", max_rows=10)
    assert {r["r"] for r in rank_within(df, hot, "v", "r", "average").collect()} == {75.5}


def test_top_k_is_limited_before_the_shuffle(data):
    plan = top_k(data, ["k"], by_day(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_gated_by_day(spark):
    """Rows of one day never see one another."""
    df = spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-01-01", 2), (1, "2024-01-02", 4)], "h long, d string, v long")
    df = df.withColumn("d", F.to_date("d"))
    got = sorted((r["v"], r["s"]) for r in history.asof_totals(df, ["h"], "d", s=F.col("v")).collect())
    assert got == [(1, None), (2, None), (4, 3)]


def test_recent_runs_and_priors(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 3)], "h long, d string, p int").withColumn("d", F.to_date("d"))
    df = df.withColumns({"hc": F.lit(True), "n": F.lit(16), "g": F.lit("PS")})
    row = history.event_career(df, ["h"], "d", "p", "hc", "n", "g").first()
    assert row["avg_quinte_position"] == 10.0 and row["days_since_last_quinte"] == 999.0
    assert row["quinte_large_field_ability"] == 0.5 and row["quinte_career_starts"] == 0.0


def test_hot_rows_are_not_shuffled_by_key(spark, data):
    g = Grouping.measure(data, "k", max_rows=100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [part._jdf.queryExecution().executedPlan().toString() for part in g.split(data)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert all("BroadcastHashJoin" in p and "hashpartitioning(k" not in p for p in plans)


def test_medians_of_columns_with_many_values(spark, monkeypatch):
    """Values are counted first, and a column of many distinct values is range-sliced."""
    seen = []

    def spy(df, group, *args, **kwargs):
        seen.append((df.columns, group.hot is not None))
        return quantiles_within(df, group, *args, **kwargs)

    monkeypatch.setattr(cleaning, "quantiles_within", spy)
    monkeypatch.setattr(cleaning, "MAX_COLUMN_VALUES", 5)
    numbers = [1.0, 2.0, 2.0, 9.0, 3.0, 4.0, 5.0, 6.0, float("inf"), None]
    table = [(i, v, 7 if i % 2 else None, None) for i, v in enumerate(numbers)]
    out = cleaning.fill_median(spark.createDataFrame(table, "id int, a double, b int, c double"), ["a", "b", "c"])
    want = [(i, 4.0 if v is None else v, 7.0, None) for i, v in enumerate(numbers)]
    assert rows(out, "id") == want
    top = spark.createDataFrame([(1.0,), (2.0,)] + [(float("inf"),)] * 5 + [(None,)], "a double")
    monkeypatch.setattr(cleaning, "MAX_COLUMN_VALUES", 2)
    assert cleaning.fill_median(top, ["a"]).where("a = double('infinity')").count() == 6
    assert seen == [(["column", "value", "n"], True)] * 2


def test_audit_slices_columns_with_many_values(spark, monkeypatch):
    table = spark.createDataFrame([(float(i % 40), 1.0 if i % 3 else None) for i in range(200)], "a double, b double")
    plain = rows(quality.column_audit(table, ["a", "b"]), "column")
    taken = []
    monkeypatch.setattr(quality, "MAX_COLUMN_VALUES", 10)
    monkeypatch.setattr(quality, "quantiles_within", lambda df, g, *a: taken.append(g.hot.count()) or quantiles_within(df, g, *a))
    assert rows(quality.column_audit(table, ["a", "b"]), "column") == plain
    assert taken == [1]
