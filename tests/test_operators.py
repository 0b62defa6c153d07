import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rankfold.operators import calibration, evaluation, imputation, models, quality, relative
from rankfold.operators.nesting import nest, order_strings, parse_nested, unnest
from rankfold.sources import races as scans
from rankfold.sources import schemas, tables


# --- Nesting ---------------------------------------------------------------------


def test_large_race_comes_in_parts(spark):
    df = spark.range(1, 26).select(F.lit("r").alias("race"), F.col("id").alias("numero"), (26 - F.col("id")).alias("rank"))
    nested = nest(df, ["race"], "numero", ["rank"], "p", chunk=10)
    assert [(r["part"], len(r["p"])) for r in nested.orderBy("part").collect()] == [(0, 10), (1, 10), (2, 5)]
    assert rows(unnest(nested, "p").select("race", "numero", "rank")) == rows(df)
    text = order_strings(df, ["race"], "rank", "numero", "o", chunk=10).orderBy("part").collect()
    assert text[0]["o"].startswith("25-24-23") and text[2]["o"] == "5-4-3-2-1"


def test_clash_precedence(spark):
    df = spark.createDataFrame([("r", 1, [(7, 2)])], "race string, x int, p array<struct<x:int,y:int>>")
    assert unnest(df, "p", "race").first().asDict() == {"race": "r", "x": 1, "y": 2}
    assert unnest(df, "p", "entry").first().asDict() == {"race": "r", "x": 7, "y": 2}
    with pytest.raises(ValueError):
        unnest(df, "p", "both")


def test_feed_shapes(spark):
    df = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"participants":[{"a":3}]}',), ('{"a":4}',), ("",)], "j string")
    got = [[e["a"] for e in r["j"]] if r["j"] else [] for r in parse_nested(df, "j", "a:int").collect()]
    assert got == [[1, 2], [3], [4], []]


# --- Evaluation --------------------------------------------------------------------


def test_scorecard_with_unknown_finishes(spark):
    data = [(1, n, float(n), n, n if n <= 4 else None) for n in range(1, 8)]
    df = spark.createDataFrame(data, "comp int, numero long, predicted_position double, predicted_rank long, actual_position long")
    row = evaluation.per_race(df, ["comp"]).first()
    assert row["winner_correct"] == 1 and row["horses_in_quinte"] == 4 and row["pct_in_quinte"] == 80.0
    assert row["pct_exact_order"] == 0.0  # fewer than five known finishes
    assert row["top5_bonus4"] == 1 and row["top5_quinte_desordre"] == 0 and row["actual_arrive"] == "1,2,3,4"


def test_spearman(spark):
    data = [("a", 1.0, 1), ("a", 2.0, 2), ("a", 3.0, 3), ("b", 1.0, 1), ("b", 1.0, 2), ("c", 3.0, 1), ("c", 1.0, 2)]
    df = spark.createDataFrame(data, "race string, s double, a int")
    got = {r["race"]: r["spearman"] for r in evaluation.spearman(df, ["race"], "s", "a").collect()}
    assert got["a"] == pytest.approx(1) and got["b"] is None and got["c"] == pytest.approx(-1)


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5, 2), (3.5, 4)], "p double, a int")
    assert df.agg(evaluation.error_metrics("p", "a")["exact_correct"]).first()[0] == 2


# --- Calibration ---------------------------------------------------------------------


@pytest.mark.parametrize("n, critical", [(20, 2.093024), (31, 2.042272), (121, 1.979930), (1_000_001, 1.959966)])
def test_critical_values(spark, n, critical):
    got = spark.range(1).select(calibration.critical_t(F.lit(n))).first()[0]
    assert got == pytest.approx(critical, abs=2e-5)


def test_split_by_time_keeps_every_row(spark):
    rows = [("2024-01-02",)] * 9 + [("2024-01-01",), (None,)]
    df = spark.createDataFrame(rows, "day string").withColumn("day", F.to_date("day"))
    fit, validate = calibration.split_by_time(df, "day", 0.8)
    assert (fit.count(), validate.count()) == (9, 2)


def test_selector_uses_pairs_of_known_values(spark):
    from rankfold.operators.models import FeatureSelector

    rows = [(float(i), float(i) * 2 if i % 2 else None, None if i % 2 else float(i % 5), float(-i % 7)) for i in range(80)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = FeatureSelector().fit(df)
    assert got.removed["correlated"] == ["a"] and got.selected == ["b", "c", "d"]


def test_isotonic_keeps_rows_without_a_score(spark):
    from rankfold.operators.models import apply_isotonic, fit_isotonic

    df = spark.createDataFrame([(float(i), float(i % 9 + 1)) for i in range(100)] + [(None, 3.0), (float("nan"), 3.0)], "s double, y double")
    out = apply_isotonic(df, fit_isotonic(df, "s", "y"), "s", "c")
    assert out.count() == 102 and out.where("c is null").count() == 2


def test_bias_needs_enough_rows(spark):
    data = [(2.0 + 0.01 * i, 1.0, 2.0, 1, 8, 1500.0, "P") for i in range(40)] + [(9.0, 1.0, 15.0, 12, 8, 1500.0, "A")] * 5
    df = spark.createDataFrame(data, "p double, a double, cotedirect double, numero int, partant int, distance double, typec string")
    out = calibration.significant_biases(calibration.bias_table(df, "p", "a"))
    found = {(r["bias_type"], r["bucket"]): r for r in out.collect()}
    assert ("typec", "A") not in found and ("odds", "long_shot") not in found
    assert found[("odds", "favorite")]["significant"] and found[("odds", "favorite")]["correction"] < -1


def test_corrections_are_clipped(spark):
    df = spark.createDataFrame([(1.2, 2.0, 5), (9.0, 50.0, 5)], "p double, cotedirect double, partant int")
    table = spark.createDataFrame([("odds", "favorite", -1.0), ("systematic", "all", -0.5)], "bias_type string, bucket string, correction double")
    got = [r[0] for r in calibration.apply_corrections(df, table, "p").select("calibrated_prediction").collect()]
    assert got == [1.0, 5.0]
    single = calibration.apply_corrections(df.withColumn("p", F.lit(4.0)), table, "p", mode="single")
    assert [r[0] for r in single.select("calibrated_prediction").collect()] == [3.0, 3.5]


def test_calibration_health_reasons(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0)] * 60, "p double, c double, a double")
    assert calibration.health(df, "p", "c", "a").first()["reason"] == "no_effect"
    assert calibration.health(df, "p", "c", "a", has_corrections=False).first()["reason"] == "ok"
    assert calibration.health(df.limit(3), "p", "c", "a").first()["reason"] == "too_few_rows"


# --- Imputation, quality ---------------------------------------------------------------


def test_imputation_order(spark):
    data = [(1, 500.0, 0, 0, 9, "Plat"), (1, 700.0, 0, 0, 9, "Plat"), (1, 900.0, 0, 0, 9, "Plat"), (1, None, 1, 2, 4, "Plat"), (1, -5.0, 0, 0, 6, "Plat"), (1, 0.0, 0, 0, 2, "Plat")]
    df = spark.createDataFrame(data, "race int, g double, w int, p int, s int, t string")
    got = [r["gains_imputed"] for r in imputation.impute_earnings(df, ["race"], "g", "w", "p", "s", "t").orderBy("s", "g").collect()]
    assert sorted(got) == [0.0, 500.0, 700.0, 700.0, 900.0, 85_000.0]


def test_audit_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 0.0, None if i else 2.0) for i in range(10)], "flat double, zero double, sparse double")
    audit = quality.column_audit(df, ["flat", "zero", "sparse"])
    got = {(r["column"], r["issue"]) for r in quality.audit_flags(audit).collect()}
    assert ("flat", "constant") in got and ("zero", "all_zeros") in got and ("sparse", "missing") in got


def test_required_values_fail_the_job(spark):
    df = spark.createDataFrame([(0.5,), (1.5,)], "x double")
    assert quality.require(df, ["x"], 0, 2).count() == 2
    with pytest.raises(Exception, match="bad value in x"):
        quality.require(df, ["x"], 0, 1).collect()


# --- Relative scores ---------------------------------------------------------------------


def test_each_leader_tops_its_dimension(spark):
    base = dict(gains=1000.0, starts=10.0, pct=5.0, runs=6, drop=0.0, ratio=1.0, trend=0.0, recent=3.0, joc=0.0, jw=0, tw=0, rides=1, last=1000.0)
    field = [dict(base, numero=n) for n in range(1, 7)]
    field[0]["gains"], field[1]["pct"], field[2]["drop"], field[3]["trend"] = 90_000.0, 40.0, 0.9, 2.0
    field[4].update(gains=95_000.0, pct=45.0, drop=0.95, trend=2.5, recent=6.0, jw=1, tw=1, last=2000.0)
    df = spark.createDataFrame([dict(r, race=1, purse=60_000.0, dist=2000.0) for r in field])
    df = relative.earnings_scores(df, ["race"], "gains", "starts", "purse")
    df = relative.track_scores(df, ["race"], "pct", "runs")
    df = relative.class_scores(df, ["race"], "drop", "ratio")
    df = relative.form_scores(df, ["race"], "trend", "recent", "joc")
    df = relative.connection_scores(df, "jw", "tw", "rides")
    df = relative.distance_scores(df, "dist", "last").cache()
    for score in ("earnings_score", "track_score", "class_score", "form_score", "connection_score", "comfort_score"):
        assert df.orderBy(F.desc(score)).first()["numero"] == 5
        assert df.where(F.abs(score) > 1).count() == 0
    out = relative.adjust(relative.composite(df).withColumn("base", F.lit(4.0)), "base")
    best = out.orderBy("final_prediction").first()
    assert best["numero"] == 5 and best["competitive_strength"] == "dominant" and best["primary_advantage_type"] == "multiple"
    assert out.agg(F.min("total_adjustment")).first()[0] >= -0.5


def test_field_of_one_scores_zero(spark):
    df = spark.createDataFrame([(1, 500.0, 5.0, 1000.0)], "race int, g double, s double, purse double")
    row = relative.earnings_scores(df, ["race"], "g", "s", "purse").first()
    assert row["earnings_score"] == 0.0 and row["earnings_rank"] == 1


# --- Models ----------------------------------------------------------------------------


def selector_frame(spark):
    f = lambda seed: F.rand(seed)
    df = spark.range(1000).select(
        f(1).alias("feature1"), f(2).alias("feature2"), F.lit(1.0).alias("constant_feature"),
        F.when(f(3) < 0.9, 0.0).otherwise(f(4)).alias("sparse_feature"), f(5).alias("feature_base"), f(6).alias("noise"),
        f(7).alias("che_global_avg_pos"),
    )
    return df.select(
        "*", (F.col("feature_base") + F.col("noise") * 0.01).alias("feature_corr"),
        (F.col("che_global_avg_pos") + F.col("noise") * 0.01).alias("che_weighted_avg_pos"),
        (F.col("che_global_avg_pos") - F.col("noise") * 0.01).alias("che_bytype_avg_pos"),
    ).drop("noise").cache()


def test_feature_selector(spark, folder):
    df = selector_frame(spark)
    s = models.FeatureSelector().fit(df)
    assert s.removed["constant"] == ["constant_feature"] and s.removed["sparse"] == ["sparse_feature"]
    assert [c for c in s.selected if c.startswith("che_")] == ["che_bytype_avg_pos"]
    assert len({"feature_base", "feature_corr"} & set(s.selected)) == 1
    s.save(spark, folder + "/s")
    again = models.FeatureSelector.load(spark, folder + "/s")
    assert again.selected == s.selected and again.transform(df).columns == s.selected
    with pytest.raises(ValueError):
        again.transform(df.drop(s.selected[0]))


def test_selector_importance(spark):
    df = selector_frame(spark)
    weights = {"feature1": 0.9, "feature2": 0.5}
    s = models.FeatureSelector(target_features=2).fit(df, importances=weights)
    assert s.selected == ["feature1", "feature2"]


def test_split_never_cuts_a_race(spark):
    df = spark.range(5000).withColumn("race", F.col("id") % 700)
    split = models.race_split(df, "race", 0.2, 0.1)
    assert split.groupBy("race").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert split.count() == 5000


def test_isotonic_is_monotone_and_clipped(spark):
    df = spark.range(400).select((F.col("id") / 10).alias("x"), (F.col("id") / 12 + F.rand(3) * 6 - 2).alias("y"))
    out = models.apply_isotonic(df, models.fit_isotonic(df, "x", "y"), "x", "c").orderBy("x").collect()
    values = [r["c"] for r in out]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:])) and min(values) >= 1 and max(values) <= 20
    with pytest.raises(ValueError, match="too few"):
        models.fit_isotonic(df.limit(10), "x", "y")


def test_residual_models(spark):
    df = spark.range(600).select(
        (F.col("id") % 7).cast("double").alias("f"), F.lit(2.0).alias("base"), ((F.col("id") % 7) + 1.0).alias("y"),
        F.when(F.col("id") < 500, "P").otherwise(F.when(F.col("id") < 590, "A")).alias("t"),
    )
    model = models.ResidualModels(["f"], "base", "y", "t").fit(df, numTrees=3, maxDepth=4)
    out = model.transform(df)
    assert set(model.by_kind) == {"P"} and out.count() == 600
    assert out.where("corrected_prediction < 1").count() == 0
    assert out.agg(F.avg(F.abs(F.col("corrected_prediction") - F.col("y")))).first()[0] < 0.5


def test_vector_default(spark):
    table = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0])], "j int, vector array<double>")
    df = spark.createDataFrame([(1,), (9,)], "j int")
    got = {r["j"]: r["vector"] for r in models.lookup_vectors(df, table, "j", "vector").collect()}
    assert got == {1: [1.0, 3.0], 9: [2.0, 4.0]}


# --- Tables -----------------------------------------------------------------------------


def test_upsert_touches_only_its_days(spark, folder):
    path = folder + "/t"
    first = spark.createDataFrame([("a", "d1", 1), ("b", "d2", 1)], "comp string, jour string, v int")
    tables.upsert(first, path, ["comp"], [F.desc("v")], "jour")
    before = {r[0] for r in spark.read.parquet(path).where("jour = 'd2'").select("_metadata.file_path").collect()}
    second = spark.createDataFrame([("a", "d1", 2, "new"), ("c", "d1", 1, "x")], "comp string, jour string, v int, extra string")
    out = tables.upsert(second, path, ["comp"], [F.desc("v")], "jour")
    assert rows(out.select("comp", "jour", "v", "extra")) == [("a", "d1", 2, "new"), ("b", "d2", 1, None), ("c", "d1", 1, "x")]
    after = {r[0] for r in spark.read.parquet(path).where("jour = 'd2'").select("_metadata.file_path").collect()}
    assert before == after


def test_backfill_keeps_and_overwrites(spark):
    stored = spark.createDataFrame([(1, 1, None), (1, 2, 9), (2, 1, 4)], "race int, n int, actual_result int")
    results = spark.createDataFrame([(1, 1, 3), (1, 2, 7)], "race int, n int, position int")
    got = rows(tables.backfill(stored, results, ["race", "n"]).select("race", "n", "actual_result", "was_in_quinte"))
    assert got == [(1, 1, 3, True), (1, 2, 7, False), (2, 1, 4, True)]


def test_results_put_numbers_before_codes(spark):
    df = spark.createDataFrame([(1, "DAI", 4, 40), (1, "10", 5, 50), (1, "2", 6, 60)], "comp int, cl string, numero int, idche long")
    order = tables.result_rows(df, "comp", "cl", "numero", "idche").first()["ordre_arrivee"]
    assert [e["narrivee"] for e in order] == ["2", "10", "DAI"]


def test_schemas_parse(spark):
    for ddl in (schemas.RACE, schemas.DAILY_RACE, schemas.RESULT, schemas.PREDICTION_FACT, schemas.FEED_RACE):
        assert spark.createDataFrame([], ddl).count() == 0


def test_daily_scans(spark):
    ddl = "comp string, jour date, quinte boolean, participants array<struct<numero:bigint>>, predictions array<struct<numero:bigint,predicted_rank:bigint>>, actual_results string"
    import datetime as dt

    d = dt.date(2024, 1, 2)
    df = spark.createDataFrame(
        [("a", d, True, [(1,)], [(1, 1)], "1-2"), ("b", d, True, [(1,)], [], "pending"), ("c", d, False, [], None, ""), ("d", d, True, [(1,)], None, None)], ddl
    )
    assert rows(scans.to_predict(df).select("comp")) == [("b",), ("d",)]
    assert rows(scans.to_predict(df, force=True).select("comp")) == [("a",), ("b",), ("d",)]
    assert rows(scans.completed(df).select("comp")) == [("a",)]
    archived = spark.createDataFrame([("a",)], "comp string")
    assert scans.completed(df, archived=archived).count() == 0
    assert rows(scans.nested_predictions(df).select("comp", "numero", "actual_position")) == [("a", 1, 1)]


def test_fill_from_prefers_own_values(spark):
    own = spark.createDataFrame([(1, "x", None), (2, " ", 4.0), (3, None, None)], "k int, s string, v double")
    other = spark.createDataFrame([(1, "o", 1.0), (2, "p", 2.0)], "k int, s string, v double")
    assert rows(scans.fill_from(own, other, ["k"])) == [(1, "x", 1.0), (2, "p", 4.0), (3, None, None)]


def test_checked_write(spark, folder):
    df = spark.range(10).select("id", F.create_map(F.lit("a"), F.col("id")).alias("m"))
    back = tables.write_checked(df, folder + "/w")
    assert back.count() == 10 and dict(back.dtypes)["m"] == "string"


def test_nan_is_not_a_finish(spark):
    from rankfold.operators.cleaning import valid_finish

    df = spark.createDataFrame([(1.0,), (math.nan,), (60.0,), (0.0,), (None,)], "p double")
    assert rows(valid_finish(df, "p")) == [(1.0,)]
