import re

import pytest
from pyspark.sql import functions as F

from rankfold.operators import blending
from rankfold.operators.grouping import Grouping, input_bytes

SCORES = [(1.2, 1.1, 1.3), (2.1, 2.3, 2.0), (3.5, 3.2, 3.6), (4.0, 4.1, 3.9), (5.3, 5.1, 5.4)]
RULES = [
    {"condition": {"typec": ["P"], "dist_min": 800, "dist_max": 1400}, "weights": {"rf": 0.6, "lstm": 0.2, "tabnet": 0.2}},
    {"condition": {"typec": ["P"], "dist_min": 2000, "dist_max": 4000}, "weights": {"rf": 0.2, "lstm": 0.6, "tabnet": 0.2}},
    {"condition": {"partant_min": 12}, "weights": {"rf": 0.4, "lstm": 0.4, "tabnet": 0.2}},
]
DEFAULT = {"rf": 0.5, "lstm": 0.25, "tabnet": 0.25}


def frame(spark, rows=SCORES):
    return spark.createDataFrame(rows, "rf double, lstm double, tabnet double")


def blended(spark, weights, rows=SCORES):
    return [r[0] for r in frame(spark, rows).select(blending.blend(weights)).collect()]


def test_arithmetic(spark):
    got = blended(spark, {"rf": 0.6, "lstm": 0.2, "tabnet": 0.2})
    assert got == pytest.approx([0.6 * a + 0.2 * b + 0.2 * c for a, b, c in SCORES])


def test_weights_are_renormalised(spark):
    assert blended(spark, {"rf": 3, "lstm": 1}) == pytest.approx([0.75 * a + 0.25 * b for a, b, _ in SCORES])


def test_weight_one_is_the_single_model(spark):
    assert blended(spark, {"rf": 1.0, "lstm": 0.0}) == pytest.approx([a for a, _, _ in SCORES])


def test_zero_weights_mean_equal_weights(spark):
    assert blended(spark, {"rf": 0, "lstm": 0}) == pytest.approx([(a + b) / 2 for a, b, _ in SCORES])


def test_missing_scores_drop_out(spark):
    assert blended(spark, {"rf": 0.5, "lstm": 0.5}, [(None, 2.0, 1.0), (None, None, 1.0)]) == [2.0, None]


def test_fixed_blend_falls_back(spark):
    df = frame(spark, [(1.0, 2.0, None), (None, 2.0, None), (1.0, None, None)])
    assert [r[0] for r in df.select(blending.blend_fixed("rf", "lstm", 0.6)).collect()] == pytest.approx([1.4, 2.0, 1.0])


@pytest.mark.parametrize("weights", [{}, {"rf": -0.1, "lstm": 1.1}])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        blending.check_weights(weights)


def test_sum_check():
    blending.check_weights({"a": 0.4, "b": 0.6}, must_sum_to_one=True)
    with pytest.raises(ValueError, match="sum"):
        blending.check_weights({"a": 0.4, "b": 0.7}, must_sum_to_one=True)


@pytest.mark.parametrize(
    "race, rule",
    [
        (("P", 1000, 20), 1), (("P", 800, 5), 1), (("P", 1400, 5), 1), (("P", 1401, 5), 0), (("P", 2500, 20), 2),
        (("A", 1000, 12), 3), (("A", 1000, 11), 0), ((None, None, None), 0),
    ],
)
def test_first_rule_wins(spark, race, rule):
    races = spark.createDataFrame([race], "typec string, dist int, partant int")
    row = blending.first_rule(races, RULES, DEFAULT).first()
    assert row["rule_no"] == rule
    assert row["rf"] == (RULES[rule - 1]["weights"]["rf"] if rule else DEFAULT["rf"])


def test_all_rules(spark):
    races = spark.createDataFrame([(1, "P", 1000, 20), (2, "A", 900, 3)], "race int, typec string, dist int, partant int")
    got = sorted((r["race"], r["rule_no"]) for r in blending.all_rules(races, RULES).collect())
    assert got == [(1, 1), (1, 3)]
    assert blending.all_rules(races, RULES, include_all=True).count() == 6


def test_rule_on_absent_field_never_matches(spark):
    races = spark.createDataFrame([("P",)], "typec string")
    assert blending.first_rule(races, [{"condition": {"dist_min": 1}, "weights": {"rf": 1}}], {"rf": 0.5}).first()["rule_no"] == 0
    assert blending.first_rule(races, [{"condition": {}, "weights": {"rf": 1}}], {"rf": 0.5}).first()["rule_no"] == 1


def test_shift_to_alternatives():
    out = blending.shift_to_alternatives({"rf": 0.6, "lstm": 0.4}, ["rf", "lstm"], ["t", "e"], 0.3)
    assert out == pytest.approx({"rf": 0.42, "lstm": 0.28, "t": 0.15, "e": 0.15})


def test_weight_search_with_a_hot_race(spark):
    df = spark.range(400).select(
        F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 40 + 1).alias("race"), F.col("id").alias("numero"),
        F.hash("id").cast("double").alias("a"), F.hash(F.col("id") + 1000).cast("double").alias("b"),
        (F.col("id") % 9 + 1).alias("position"),
    )
    results = []
    for g in (Grouping(("race",)), Grouping.measure(df, "race", max_rows=50)):
        ranked, _ = blending.over_weights(df, g, "a", "b", blending.weight_steps(0.25), ["numero"])
        results.append(sorted(map(tuple, blending.weight_results(ranked, ["race"], "numero", "position").collect())))
    assert results[0] == results[1] and len(results[0]) == 5
    best = blending.best_weight(blending.weight_results(ranked, ["race"], "numero", "position")).first()
    assert best["winner_accuracy"] == max(r[1] for r in results[0])


def test_weight_search_deals_more_parts_to_more_weights(spark, monkeypatch, folder):
    spark.range(1000).select((F.col("id") % 50).alias("race"), F.col("id").alias("numero"), F.rand(1).alias("a"), F.rand(2).alias("b")).write.parquet(f"{folder}/r")
    df = spark.read.parquet(f"{folder}/r")
    monkeypatch.setattr(blending, "WEIGHTED_BYTES", input_bytes(df) // 4)
    for group in (Grouping(("race",)), Grouping(("race",), spark.createDataFrame([(0,)], "race long"))):
        ranked, _ = blending.over_weights(df, group, "a", "b", blending.weight_steps(0.1), ["numero"])
        assert ranked.count() == 11_000
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        parts = [int(n) for n in re.findall(r"RepartitionByExpression \[race#\d+L\], (\d+)", plan)]
        assert parts and parts[0] >= 44  # every part holds a bounded size after the weights have multiplied it


def test_weight_steps():
    assert blending.weight_steps(0.1) == [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
