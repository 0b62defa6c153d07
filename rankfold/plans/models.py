"""Models, vectors, feature selection, and the scoring job."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import families
from ..operators import calibration, history, models, scoring
from ..operators.grouping import row_number_within
from ..session import reliable_checkpoint
from ..sources import tables
from .blending import DEFAULT, RULES
from .history import horse_field
from .participants import participants
from .quality import AUDITED, audit_rows
from .registry import query
from .relative import adjusted
from .roles import WITH_FIELD, WITH_RUNNERS, field, races, rounded, runners, table

FEATURES = ("pred_a", "pred_b", "discount", "tax", "partant", "dist", "coursescheval", "ratio_places")


def learning_rows(spark: SparkSession, sf: str):
    """Runner rows with as-of features and the finish as target."""
    _, by_race = field(spark, sf)
    rows, by_horse = horse_field(spark, sf)
    rows = history.career_totals(rows, by_horse, "jour", "position", "price")
    keep = ["race_id", "numero", "horse_id", "jockey_id", "position", "typec", "odds", "jour", "cheque"]
    return rows.select(*keep, *[c for c in FEATURES if c not in keep]).withColumn("y", F.col("position").cast("double")), by_race


@query(
    """
WITH a AS (
  SELECT l_quantity, sqrt(l_extendedprice) AS price_root, CASE WHEN l_discount > 0 THEN l_discount END AS disc, l_tax AS tax,
    CASE WHEN l_quantity > 40 THEN l_quantity ELSE 0 END AS sparse, l_quantity * 2 + l_tax * 0.1 AS doubled, l_linenumber FROM lineitem),
s AS (SELECT avg(CASE WHEN sparse = 0 THEN 1 ELSE 0 END) AS z, corr(l_quantity, doubled) AS c FROM a)
SELECT * FROM (VALUES ('price_root', 'selected'), ('disc', 'selected'), ('tax', 'selected'), ('flag_no', 'selected'), ('l_linenumber', 'selected'),
  ('constant', 'constant'), ('doubled', 'selected')) t(feature, status)
UNION ALL SELECT 'sparse', CASE WHEN z > 0.7 THEN 'sparse' ELSE 'selected' END FROM s
UNION ALL SELECT 'l_quantity', CASE WHEN c > 0.95 THEN 'correlated' ELSE 'selected' END FROM s
UNION ALL SELECT 'spike', CASE WHEN count(DISTINCT CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 1000.0 ELSE 1.5 END) = 1 THEN 'constant' ELSE 'selected' END FROM lineitem"""
)
def feature_selector(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit_rows(spark, sf).drop("l_orderkey")
    selector = models.FeatureSelector().fit(rows, [*AUDITED, "doubled"])
    return selector.summary(spark)


@query(
    WITH_FIELD
    + """,
f AS (SELECT 'pred_a' AS c, corr(pred_a, position) AS r, count(*) AS n FROM field UNION ALL SELECT 'pred_b', corr(pred_b, position), count(*) FROM field
  UNION ALL SELECT 'discount', corr(discount, position), count(*) FROM field UNION ALL SELECT 'tax', corr(tax, position), count(*) FROM field
  UNION ALL SELECT 'partant', corr(partant, position), count(*) FROM field)
SELECT c AS "column", round(r * r / (1 - r * r) * (n - 2), 3) AS f_score FROM f ORDER BY f_score DESC, c LIMIT 3"""
)
def best_features(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = field(spark, sf)
    scores = models.f_scores(rows, ["pred_a", "pred_b", "discount", "tax", "partant"], "position")
    return rounded(models.best_features(scores, 3), 3)


@query(
    WITH_RUNNERS
    + """,
s AS (SELECT avg(pred_b) AS m, stddev_pop(pred_b) AS d FROM runners)
SELECT race_id, numero, round((pred_b - m) / d, 6) AS z, 0.0::DOUBLE AS flat FROM runners, s"""
)
def standard_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    rows = rows.select("race_id", "numero", F.col("pred_b").alias("z"), F.lit(3.0).alias("flat"))
    return rounded(models.standardize(rows, ["z", "flat"]))


@query(
    WITH_FIELD
    + """,
r AS (SELECT race_id, natpis, typec, sqrt(cheque) AS purse, dist FROM races),
n AS (SELECT natpis, dense_rank() OVER (ORDER BY natpis) AS k FROM (SELECT DISTINCT natpis FROM r)),
t AS (SELECT typec, dense_rank() OVER (ORDER BY typec) AS k FROM (SELECT DISTINCT typec FROM r)),
s AS (SELECT avg(purse) AS pm, stddev_samp(purse) AS ps, avg(dist) AS dm, stddev_samp(dist) AS ds FROM r),
v AS (SELECT race_id, n.k / ((SELECT count(*) FROM n) + 1) AS natpis, t.k / ((SELECT count(*) FROM t) + 1) AS typec, (purse - pm) / ps AS purse, (dist - dm) / ds AS dist
      FROM r JOIN n ON n.natpis = r.natpis JOIN t ON t.typec = r.typec, s)
SELECT race_id, round(natpis, 6) AS natpis, round(typec, 6) AS typec, round(purse, 6) AS purse, round(dist, 6) AS dist,
  round(natpis * dist, 6) AS going_distance, round(typec * purse, 6) AS type_purse FROM v"""
)
def course_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = races(spark, sf).withColumn("purse", F.sqrt("cheque"))
    crosses = {"going_distance": ("natpis", "dist"), "type_purse": ("typec", "purse")}
    return rounded(models.course_vectors(rows, "race_id", ["natpis", "typec"], ["purse", "dist"], crosses))


@query(
    WITH_RUNNERS
    + """,
j AS (SELECT jockey_id, avg(pred_b) AS a, avg(sqrt(odds)) AS b FROM runners WHERE flag = 'R' AND odds > 45 GROUP BY jockey_id),
m AS (SELECT avg(a) AS a, avg(b) AS b FROM j)
SELECT race_id, numero, round(coalesce(j.a, m.a), 6) AS v1, round(coalesce(j.b, m.b), 6) AS v2 FROM runners LEFT JOIN j ON j.jockey_id = runners.jockey_id, m"""
)
def vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Jockey vectors with the mean vector for unknown jockeys."""
    rows, _ = runners(spark, sf)
    known = rows.where((F.col("flag") == "R") & (F.col("odds") > 45))
    table_ = known.groupBy("jockey_id").agg(F.avg("pred_b").alias("a"), F.avg(F.sqrt("odds")).alias("b"))
    table_ = table_.select("jockey_id", F.array("a", "b").alias("vector"))
    out = models.lookup_vectors(rows.select("race_id", "numero", "jockey_id"), table_, "jockey_id", "vector")
    return rounded(out.select("race_id", "numero", F.get("vector", 0).alias("v1"), F.get("vector", 1).alias("v2")))


@query(
    WITH_RUNNERS + " SELECT race_id, numero, round(greatest(1.0, 0.05 * pred_a + 0.05 * pred_b), 6)::DOUBLE AS blended FROM runners"
)
def floored_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    rows = rows.select("race_id", "numero", (F.col("pred_a") / 10).alias("a"), (F.col("pred_b") / 10).alias("b"))
    return rounded(rows.select("race_id", "numero", models.ensemble({"a": 0.5, "b": 0.5}).alias("blended")))


_SPLIT = """,
h AS (SELECT *, ('0x' || substr(md5(race_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS slot FROM runners)"""


@query(
    WITH_RUNNERS
    + _SPLIT
    + """
SELECT CASE WHEN slot < 0.2 THEN 'test' WHEN slot < 0.3 THEN 'validation' ELSE 'train' END AS split, count(*) AS rows, count(DISTINCT race_id) AS races
FROM h GROUP BY 1"""
)
def race_aware_split(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    split = models.race_split(rows, "race_id", 0.2, 0.1)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("race_id").alias("races"))


@query()
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = learning_rows(spark, sf)
    split = models.race_split(rows, "race_id")
    model = models.fit_boosted(split.where(F.col("split") == "train"), FEATURES, "y")
    scored = models.predict(model, split.where(F.col("split") == "test"), FEATURES, "prediction")
    return scored.select("race_id", "numero", "position", "prediction")


@query()
def gbt_importances(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = learning_rows(spark, sf)
    model = models.fit_boosted(rows, FEATURES, "y")
    return models.best_features(models.importances(model.stages[-1], FEATURES, spark), 5, "importance")


@query()
def forest_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Refit on failures; metrics of baseline and refit on the same held-out races."""
    rows, by_race = learning_rows(spark, sf)
    rows = row_number_within(rows, by_race, [F.col("pred_a").asc(), F.col("numero").asc()], "rank")
    rows = rows.withColumn("score", F.col("pred_a") * 0.2)
    return scoring.incremental_refit(rows, "race_id", FEATURES, "score", "rank", "y", "odds")


@query()
def isotonic(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = learning_rows(spark, sf)
    curve = models.fit_isotonic(rows, "pred_b", "y")
    out = models.apply_isotonic(rows, curve, "pred_b", "calibrated")
    return models.calibrator_usable(models.calibration_metadata(out, "pred_b", "calibrated", "y"))


@query()
def calibrated_regressor(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = learning_rows(spark, sf)
    split = models.race_split(rows, "race_id")
    model = models.CalibratedRegressor(FEATURES, "y").fit(split.where(F.col("split") == "train"))
    out = model.transform(split.where(F.col("split") == "test"))
    return out.select("race_id", "numero", "raw_prediction", "prediction")


@query()
def residual_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections of races that the error models haven't seen."""
    rows, _ = learning_rows(spark, sf)
    split = models.race_split(rows.withColumn("base", F.col("pred_b") / 5), "race_id")
    model = models.ResidualModels(["discount", "tax", "partant", "coursescheval"], "base", "y", "typec")
    model.fit(split.where(F.col("split") == "train"))
    return model.transform(split.where(F.col("split") == "test")).select("race_id", "numero", "base", "corrected_prediction")


@query(
    WITH_FIELD
    + """,
h AS (SELECT *, ('0x' || substr(md5(race_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS slot FROM field)
SELECT typec, count(*) AS rows, count(DISTINCT race_id) AS races, round(avg(abs(pred_b / 5 - position)), 6) AS base_mae, true AS at_least_one, true AS better
FROM h WHERE slot < 0.2 GROUP BY typec"""
)
def residual_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Per race type, on races that the error models haven't seen: every row corrected once, and nearer to the finish."""
    rows, _ = learning_rows(spark, sf)
    split = models.race_split(rows.withColumn("base", F.col("pred_b") / 5), "race_id")
    model = models.ResidualModels(["discount", "tax", "partant", "coursescheval"], "base", "y", "typec")
    model.fit(split.where(F.col("split") == "train"))
    out = model.transform(split.where(F.col("split") == "test"))
    off = lambda c: F.avg(F.abs(F.col(c) - F.col("y")))
    return rounded(
        out.groupBy("typec").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("race_id").alias("races"),
            off("base").alias("base_mae"),
            F.bool_and(F.col("corrected_prediction") >= 1).alias("at_least_one"),
            (off("corrected_prediction") < off("base")).alias("better"),
        )
    )


@query(
    WITH_RUNNERS
    + """,
g AS (SELECT ('0x' || substr(md5(race_id::VARCHAR), 1, 8))::BIGINT % 1000 AS bucket, count(*) AS n, sum(abs(pred_a * 0.2 - position)) AS b,
        sum(abs(pred_b / 12 - position)) AS r FROM runners GROUP BY 1),
e AS (SELECT g.*, draw, ('0x' || substr(md5(bucket || ':' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM g, range(201) d(draw)),
w AS (SELECT *, CASE WHEN draw = 0 THEN 1 ELSE """
    + " + ".join(f"(u >= {chance})::INT" for chance in models.POISSON_STEPS)
    + """ END AS t FROM e),
s AS (SELECT draw, sum(n * t) AS n, sum(b * t) AS b, sum(r * t) AS r FROM w GROUP BY draw),
o AS (SELECT max(n) FILTER (WHERE draw = 0) AS rows, max(b / n) FILTER (WHERE draw = 0) AS baseline_mae, max(r / n) FILTER (WHERE draw = 0) AS refit_mae,
        max((b - r) / b) FILTER (WHERE draw = 0) AS gain, quantile_cont((b - r) / b, 0.025) FILTER (WHERE draw > 0) AS gain_low,
        quantile_cont((b - r) / b, 0.975) FILTER (WHERE draw > 0) AS gain_high FROM s)
SELECT rows::BIGINT AS rows, round(baseline_mae, 6) AS baseline_mae, round(refit_mae, 6) AS refit_mae, round(gain, 6) AS gain, round(gain_low, 6) AS gain_low,
  round(gain_high, 6) AS gain_high, gain > 0.02 AS significant, gain_low > 0 AS certain FROM o"""
)
def refit_significance(spark: SparkSession, sf: str) -> DataFrame:
    """Whether one score beats another: by the fixed limit, and by an interval from races drawn anew."""
    rows, _ = runners(spark, sf)
    rows = rows.withColumns({"old": F.col("pred_a") * 0.2, "new": F.col("pred_b") / 12})
    return rounded(models.paired_gain(rows, "race_id", "old", "new", "position"))


@query(
    WITH_RUNNERS
    + """,
p AS (SELECT round(pred_b, 0) AS x, avg(least(20.0, greatest(1.0, position::DOUBLE))) AS y, count(*) AS w FROM runners GROUP BY 1),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(y * w) OVER (ORDER BY x) AS s, sum(w) OVER (ORDER BY x) AS v FROM p),
z AS (SELECT i, s, v FROM c UNION ALL SELECT 0, 0.0, 0),
m AS (SELECT k.x, a.i AS a, min((b.s - a.s) / (b.v - a.v)) AS least FROM c k JOIN z a ON a.i < k.i JOIN c b ON b.i >= k.i GROUP BY k.x, a.i)
SELECT x AS score, round(max(least), 6) AS calibrated FROM m GROUP BY x"""
)
def isotonic_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The curve at every score: the greatest over starts of the least mean over ends, by its definition."""
    rows, _ = runners(spark, sf)
    rows = rows.select(F.round("pred_b", 0).alias("score"), F.col("position").cast("double").alias("y"))
    curve = models.fit_isotonic(rows, "score", "y", digits=0)
    return rounded(models.apply_isotonic(rows.select("score").distinct(), curve, "score", "calibrated"))


@query(
    WITH_RUNNERS
    + """,
u AS (UNPIVOT (SELECT corr(pred_a, pred_b) AS ab, corr(pred_a, discount) AS ad, corr(pred_a, tax) AS at, corr(pred_b, discount) AS bd,
        corr(pred_b, tax) AS bt, corr(discount, tax) AS dt FROM runners) ON COLUMNS(*) INTO NAME pair VALUE r)
SELECT 4.0::DOUBLE AS variance, round(4 + 2 * sum(r * r), 6) AS squares, true AS uncorrelated, true AS descending FROM u"""
)
def pca_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What no sign or rotation changes: all variance is kept, the sum of its squares is that of all correlations,
    components are uncorrelated and in descending order.
    """
    rows, _ = runners(spark, sf)
    columns = ["pred_a", "pred_b", "discount", "tax"]
    rows = rows.withColumn("key", F.concat_ws(":", "race_id", "numero"))
    out, _ = models.vectors(rows, columns, 4, "key")
    parts = out.select(*[F.get("vector", i).alias(f"p{i}") for i in range(4)])
    spread = [F.var_samp(f"p{i}") for i in range(4)]
    mixed = [F.abs(F.covar_samp(f"p{i}", f"p{j}")) for i in range(4) for j in range(i)]
    row = parts.agg(F.array(*spread).alias("v"), F.greatest(*mixed).alias("m"))
    total = lambda f: F.aggregate("v", F.lit(0.0), f)
    return rounded(
        row.select(
            total(lambda a, b: a + b).alias("variance"),
            total(lambda a, b: a + b * b).alias("squares"),
            (F.col("m") < 1e-6).alias("uncorrelated"),
            (F.sort_array("v", asc=False) == F.col("v")).alias("descending"),
        )
    )


@query(
    WITH_RUNNERS
    + """
SELECT count(DISTINCT (horse_id, jockey_id)) AS pairs, count(DISTINCT horse_id) AS horses, count(DISTINCT jockey_id) AS jockeys,
  true AS better_than_the_mean, true AS unknown_is_zero FROM runners"""
)
def als_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Products of the pair vectors come nearer to the ratings than their mean; an unknown pair has zeros."""
    rows, _ = runners(spark, sf)
    horses, jockeys = models.pair_vectors(rows, "horse_id", "jockey_id", "position")
    rated = rows.groupBy("horse_id", "jockey_id").agg(F.avg((F.col("position") <= 3).cast("double")).alias("rating"))
    unknown = rated.limit(1).select(F.lit(-1).cast("long").alias("horse_id"), "jockey_id", F.lit(None).cast("double").alias("rating"))
    both = models.pair_vector_lookup(rated.unionByName(unknown), horses, jockeys, "horse_id", "jockey_id", models.PAIR_RANK)
    guess = F.aggregate("pair_vector", F.lit(0.0), lambda a, b: a + b)
    known = F.col("horse_id") >= 0
    off = F.avg(F.when(known, F.pow(guess - F.col("rating"), 2)))
    return both.agg(
        F.count(F.when(known, 1)).alias("pairs"),
        F.count_distinct(F.when(known, F.col("horse_id"))).alias("horses"),
        F.count_distinct(F.when(known, F.col("jockey_id"))).alias("jockeys"),
        (off < F.var_pop("rating")).alias("better_than_the_mean"),
        F.bool_and(known | (F.array_max(F.transform("pair_vector", F.abs)) == 0)).alias("unknown_is_zero"),
    )


@query(
    WITH_RUNNERS
    + """,
m AS (SELECT covar_pop(pred_b, position) AS cb, covar_pop(discount, position) AS cd, var_pop(pred_b) AS bb, var_pop(discount) AS dd,
        covar_pop(pred_b, discount) AS bd, avg(pred_b) AS b, avg(discount) AS d, avg(position) AS y FROM runners),
w AS (SELECT (cb * dd - cd * bd) / (bb * dd - bd * bd) AS wb, (cd * bb - cb * bd) / (bb * dd - bd * bd) AS wd, b, d, y FROM m)
SELECT race_id, numero, round(y + wb * (pred_b - b) + wd * (discount - d), 4) AS prediction FROM runners, w"""
)
def stacked_model(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    rows = rows.withColumn("y", F.col("position").cast("double"))
    model = models.fit_stacked(rows, ["pred_b", "discount"], "y")
    return rounded(models.predict(model, rows, ["pred_b", "discount"], "prediction").select("race_id", "numero", "prediction"), 4)


@query()
def pca_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Principal components of the embedding rows, 64 numbers to 8."""
    rows = table(spark, sf, "embeddings")
    wide = rows.select("vec_id", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(64)])
    out, _ = models.vectors(wide, [f"e{i}" for i in range(64)], 8, "vec_id")
    return out.select("vec_id", *[F.get("vector", i).alias(f"p{i}") for i in range(8)])


@query()
def als_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    horses, jockeys = models.pair_vectors(rows, "horse_id", "jockey_id", "position")
    pairs = rows.select("horse_id", "jockey_id").distinct()
    out = models.pair_vector_lookup(pairs, horses, jockeys, "horse_id", "jockey_id", models.PAIR_RANK)
    return out.select("horse_id", "jockey_id", *[F.get("pair_vector", i).alias(f"v{i}") for i in range(models.PAIR_RANK)])


@query()
def all_features(spark: SparkSession, sf: str) -> DataFrame:
    """All feature families of a runner in one projection."""
    return families.with_families(participants(spark, sf), *families.ALL_FAMILIES)


@query(
    WITH_RUNNERS
    + _SPLIT
    + """,
t AS (SELECT count(*) AS n, count(DISTINCT race_id) AS races FROM h WHERE slot < 0.2)
SELECT m AS model, n, races, true AS in_range, true AS better_than_the_mean FROM t, (VALUES ('boosted'), ('forest'), ('isotonic')) v(m)"""
)
def model_properties(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold for each model on held-out races: every row scored once, near the target's range, better than the mean."""
    rows = reliable_checkpoint(learning_rows(spark, sf)[0])
    split = models.race_split(rows, "race_id")
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    low, high, mean = train.agg(F.min("y"), F.max("y"), F.avg("y")).first()
    high = max(high, models.POSITION_RANGE[1])
    low, high = low - (high - low), high + (high - low)  # boosted trees add up and may pass the ends
    scored = {
        "boosted": models.predict(models.fit_boosted(train, FEATURES, "y"), test, FEATURES, "s"),
        "forest": models.predict(models.fit_forest(train, FEATURES, "y"), test, FEATURES, "s"),
        "isotonic": models.apply_isotonic(test, models.fit_isotonic(train, "partant", "y"), "partant", "s"),
    }
    error = lambda c: F.avg(F.pow(c - F.col("y"), 2))
    out = None
    for name, part in scored.items():
        row = part.agg(
            F.count("s").alias("n"),
            F.count_distinct("race_id").alias("races"),
            F.coalesce(F.bool_and(F.col("s").between(low, high)), F.lit(False)).alias("in_range"),
            (error(F.col("s")) < error(F.lit(mean))).alias("better_than_the_mean"),
        ).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    WITH_RUNNERS
    + " SELECT race_id, count(*) AS n, count(*) AS ranks, (count(*) * (count(*) + 1) // 2)::BIGINT AS rank_sum FROM runners GROUP BY race_id"
)
def scored_and_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The scoring job end to end: features stored once, models saved and loaded, corrections from races the
    models have not seen, scores upserted twice; ranks of the stored rows are a permutation in every race.
    """
    rows, by_race = learning_rows(spark, sf)
    rows = reliable_checkpoint(rows)
    split = models.race_split(rows, "race_id", 0.2)
    train, unseen = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    folder = tables.stage_path(spark, "models")
    models.fit_boosted(train, FEATURES, "y").write().overwrite().save(f"{folder}/rf")
    models.fit_stacked(train, FEATURES, "y").write().overwrite().save(f"{folder}/tabnet")
    scorers = {name: (PipelineModel.load(f"{folder}/{name}"), FEATURES) for name in ("rf", "tabnet")}
    names = {"odds": "cotedirect", "dist": "distance"}
    stats = calibration.bias_table(
        scoring.score_races(unseen, by_race, scorers, RULES, DEFAULT).withColumnsRenamed(names), "final_prediction", "position"
    )
    corrections = calibration.corrections(calibration.significant_biases(stats))
    scored = scoring.score_races(rows, by_race, scorers, RULES, DEFAULT).withColumnsRenamed(names)
    final = calibration.apply_corrections(scored, corrections, "final_prediction", "final_prediction", mode="single")
    order = [F.col("final_prediction").asc_nulls_last(), F.col("numero").asc()]
    ranked = row_number_within(final.drop("predicted_rank"), by_race, order, "predicted_rank")
    facts = tables.prediction_rows(ranked, "ensemble_prediction", "final_prediction", DEFAULT)
    facts = facts.select("race_id", "numero", F.year("jour").alias("year"), "predicted_rank", "final_prediction", F.lit(1).alias("version"))
    path = tables.stage_path(spark, "predictions")
    for version in (1, 2):
        stored = tables.upsert(facts.withColumn("version", F.lit(version)), path, ["race_id", "numero"], [F.desc("version")], "year")
    return stored.groupBy("race_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("predicted_rank").alias("ranks"), F.sum("predicted_rank").alias("rank_sum")
    )


@query()
def scored_races(spark: SparkSession, sf: str) -> DataFrame:
    """The scoring job: two models, rule weights, competitive adjustment, calibration, order per race."""
    rows, by_race = learning_rows(spark, sf)
    rows = models.race_split(rows, "race_id", name="part")
    train = rows.where(F.col("part") == "train")
    tree = models.fit_boosted(train, FEATURES, "y")
    line = models.fit_stacked(train, FEATURES, "y")
    shift = adjusted(spark, sf).select("race_id", "numero", "total_adjustment")
    rows = rows.join(shift, ["race_id", "numero"])
    scorers = {"rf": (tree, FEATURES), "tabnet": (line, FEATURES)}
    plain = scoring.score_races(rows, by_race, scorers, RULES, DEFAULT, adjustment="total_adjustment")
    plain = plain.withColumnsRenamed({"odds": "cotedirect", "dist": "distance"})
    unseen = plain.where(F.col("part") == "test")  # corrections come from races that the models haven't seen
    stats = calibration.bias_table(unseen, "final_prediction", "position")
    table_ = stats.select("bias_type", "bucket", (-F.col("mean_error")).alias("correction"))
    final = calibration.apply_corrections(plain, table_, "final_prediction", "final_prediction", mode="single")
    ranked = row_number_within(
        final.drop("predicted_rank"), by_race, [F.col("final_prediction").asc(), F.col("numero").asc()], "predicted_rank"
    )
    return scoring.predicted_orders(ranked, ["race_id"])
