"""Bias, calibration, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, failures
from ..operators.grouping import row_number_within
from .registry import query
from .roles import WITH_FIELD, field, rounded

# Scores on the scale of positions.
_CAL = (
    WITH_FIELD
    + """,
cal AS (SELECT race_id, numero, position, pred_b / 5 AS predicted, odds, partant, dist, typec, jour FROM field),
b AS (
  SELECT 'odds' AS bias_type, CASE WHEN odds <= 3 THEN 'favorite' WHEN odds <= 5 THEN 'second_choice' WHEN odds <= 10 THEN 'mid_odds'
      WHEN odds <= 20 THEN 'long_shot' WHEN odds <= 100 THEN 'extreme' END AS bucket, predicted - position AS e FROM cal
  UNION ALL SELECT 'post_position', CASE WHEN numero <= 3 THEN 'inside' WHEN numero <= 6 THEN 'mid_inside' WHEN numero <= 10 THEN 'mid_outside'
      WHEN numero <= 20 THEN 'outside' END, predicted - position FROM cal
  UNION ALL SELECT 'field_size', CASE WHEN partant <= 10 THEN 'small' WHEN partant <= 14 THEN 'medium' WHEN partant <= 18 THEN 'large'
      WHEN partant <= 30 THEN 'xlarge' END, predicted - position FROM cal
  UNION ALL SELECT 'distance', CASE WHEN dist <= 1600 THEN 'sprint' WHEN dist <= 2000 THEN 'mile' WHEN dist <= 2800 THEN 'middle'
      WHEN dist <= 10000 THEN 'long' END, predicted - position FROM cal
  UNION ALL SELECT 'typec', typec, predicted - position FROM cal
  UNION ALL SELECT 'systematic', 'all', predicted - position FROM cal),
s AS (SELECT bias_type, bucket, count(*) AS n, avg(e) AS mean_error, stddev_samp(e) AS std_error,
        avg(e) / (stddev_samp(e) / sqrt(count(*))) AS t_stat FROM b WHERE bucket IS NOT NULL GROUP BY bias_type, bucket)"""
)
# Every bucket corrects here: the SQL has no t distribution to test with.
_CORR = _CAL + """,
c AS (
  SELECT cal.*, greatest(1.0, least(partant, predicted
    - (SELECT mean_error FROM s WHERE bias_type = 'systematic')
    - coalesce(o.mean_error, 0) - coalesce(p.mean_error, 0) - coalesce(f.mean_error, 0) - coalesce(d.mean_error, 0) - coalesce(t.mean_error, 0))) AS calibrated
  FROM cal
  LEFT JOIN s o ON o.bias_type = 'odds' AND o.bucket = CASE WHEN odds <= 3 THEN 'favorite' WHEN odds <= 5 THEN 'second_choice' WHEN odds <= 10 THEN 'mid_odds' WHEN odds <= 20 THEN 'long_shot' ELSE 'extreme' END
  LEFT JOIN s p ON p.bias_type = 'post_position' AND p.bucket = CASE WHEN numero <= 3 THEN 'inside' WHEN numero <= 6 THEN 'mid_inside' WHEN numero <= 10 THEN 'mid_outside' ELSE 'outside' END
  LEFT JOIN s f ON f.bias_type = 'field_size' AND f.bucket = CASE WHEN partant <= 10 THEN 'small' WHEN partant <= 14 THEN 'medium' WHEN partant <= 18 THEN 'large' ELSE 'xlarge' END
  LEFT JOIN s d ON d.bias_type = 'distance' AND d.bucket = CASE WHEN dist <= 1600 THEN 'sprint' WHEN dist <= 2000 THEN 'mile' WHEN dist <= 2800 THEN 'middle' ELSE 'long' END
  LEFT JOIN s t ON t.bias_type = 'typec' AND t.bucket = typec)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = field(spark, sf)
    return rows.select(
        "race_id", "numero", "position", (F.col("pred_b") / 5).alias("predicted"), F.col("odds").alias("cotedirect"),
        "partant", F.col("dist").alias("distance"), "typec", "jour",
    )


@query(
    _CAL
    + """
SELECT bias_type, bucket, n, round(mean_error, 6) AS mean_error, round(std_error, 6) AS std_error, round(t_stat, 4) AS t_stat FROM s"""
)
def bias_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(calibration.bias_table(scored(spark, sf), "predicted", "position"))
    return out.withColumn("t_stat", F.round("t_stat", 4))


@query(
    _CAL
    + """,
v AS (SELECT *, (n - 1)::DOUBLE AS v, 1.959963984540054::DOUBLE AS z, CASE bias_type WHEN 'systematic' THEN 0.2 WHEN 'typec' THEN 0.4 ELSE 0.3 END AS least FROM s
      WHERE n >= CASE bias_type WHEN 'odds' THEN 20 WHEN 'systematic' THEN 1 ELSE 30 END),
c AS (SELECT *, z + (z^3 + z) / 4 / v + (5 * z^5 + 16 * z^3 + 3 * z) / 96 / v^2 + (3 * z^7 + 19 * z^5 + 17 * z^3 - 15 * z) / 384 / v^3
      + (79 * z^9 + 776 * z^7 + 1482 * z^5 - 1920 * z^3 - 945 * z) / 92160 / v^4 AS critical FROM v),
g AS (SELECT *, coalesce(abs(t_stat) > critical AND abs(mean_error) > least, false) AS significant FROM c),
h AS (SELECT bias_type, count(*) FILTER (WHERE significant) AS significant_buckets, avg(abs(mean_error)) FILTER (WHERE significant) AS impact FROM g GROUP BY bias_type)
SELECT bias_type, bucket, n, round(mean_error, 6) AS mean_error, round(critical, 6) AS critical_t, significant, significant_buckets,
  round(impact, 6) AS impact, CASE WHEN bias_type = 'odds' AND significant_buckets > 2 THEN 'HIGH' WHEN bias_type = 'distance' THEN 'LOW'
    WHEN bias_type = 'systematic' AND abs(mean_error) > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(-mean_error, 6) AS correction
FROM g JOIN h USING (bias_type)"""
)
def significant_biases(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets whose error is beyond the critical value of t and the least error of their kind."""
    stats = calibration.bias_table(scored(spark, sf), "predicted", "position")
    out = calibration.significant_biases(stats)
    names = ("bias_type", "bucket", "n", "mean_error", "critical_t", "significant", "significant_buckets", "impact", "severity", "correction")
    return rounded(out.select(*names))


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    stats = calibration.bias_table(rows, "predicted", "position")
    table = stats.select("bias_type", "bucket", (-F.col("mean_error")).alias("correction"))
    return calibration.apply_corrections(rows, table, "predicted")


@query(_CORR + " SELECT race_id, numero, round(calibrated, 6) AS calibrated_prediction FROM c")
def apply_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibrated(spark, sf).select("race_id", "numero", "calibrated_prediction"))


@query(
    _CORR
    + """,
h AS (SELECT avg(abs(calibrated - position)) AS current_mae, avg(abs(predicted - position)) AS baseline_mae, avg(predicted - position) AS mean_error, count(*) AS n_samples FROM c)
SELECT round(current_mae, 6) AS current_mae, round(baseline_mae, 6) AS baseline_mae, round(mean_error, 6) AS mean_error, n_samples,
  CASE WHEN n_samples < 50 THEN 'too_few_rows' WHEN abs(mean_error) > 0.3 THEN 'bias'
    WHEN NOT current_mae < baseline_mae - 0.05 THEN 'no_effect' WHEN current_mae > baseline_mae + 0.1 THEN 'harm'
    ELSE 'ok' END AS reason,
  CAST(n_samples >= 50 AND (abs(mean_error) > 0.3 OR NOT current_mae < baseline_mae - 0.05) AS INTEGER) AS should_update FROM h"""
)
def calibration_health(spark: SparkSession, sf: str) -> DataFrame:
    out = calibration.health(calibrated(spark, sf), "predicted", "calibrated_prediction", "position")
    return rounded(
        out.select(
            "current_mae", "baseline_mae", "mean_error", "n_samples", "reason", F.col("should_update").cast("int").alias("should_update")
        )
    )


@query(
    _CORR
    + """,
h AS (SELECT avg(abs(predicted - position)) AS mae_before, avg(abs(calibrated - position)) AS mae_after FROM c)
SELECT round(mae_before, 6) AS mae_before, round(mae_after, 6) AS mae_after, round(mae_before - mae_after, 6) AS improvement,
  round((mae_before - mae_after) / mae_before * 100, 6) AS improvement_pct, CAST(mae_after < mae_before AS INTEGER) AS accepted FROM h"""
)
def calibration_gain(spark: SparkSession, sf: str) -> DataFrame:
    out = calibration.improvement(calibrated(spark, sf), "predicted", "calibrated_prediction", "position")
    return rounded(out.withColumn("accepted", F.col("accepted").cast("int")))


@query(
    _CAL
    + """,
d AS (SELECT jour, count(*) AS n FROM cal GROUP BY jour),
r AS (SELECT jour, sum(n) OVER (ORDER BY jour DESC) AS run, sum(n) OVER () AS total FROM d),
k AS (SELECT min(jour) AS cut FROM r WHERE run <= total * 0.8)
SELECT CASE WHEN jour >= cut THEN 'fit' ELSE 'validate' END AS part, count(*) AS n, min(jour) AS first_day, max(jour) AS last_day FROM cal, k GROUP BY 1"""
)
def time_ordered_split(spark: SparkSession, sf: str) -> DataFrame:
    fit, validate = calibration.split_by_time(scored(spark, sf), "jour")
    both = fit.select(F.lit("fit").alias("part"), "jour").unionByName(validate.select(F.lit("validate").alias("part"), "jour"))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("jour").alias("first_day"), F.max("jour").alias("last_day")
    )


_FAIL = (
    WITH_FIELD
    + """,
r AS (SELECT *, pred_a * 0.2 AS score, row_number() OVER (PARTITION BY race_id ORDER BY pred_a, numero) AS rank FROM field),
c0 AS (
  SELECT race_id, any_value(natpis) AS natpis, count(*) AS field_size, count(*) FILTER (WHERE rank <= 5 AND position <= 5) AS overlap,
    count(*) FILTER (WHERE rank <= 5 AND position <= 4) AS h4, count(*) FILTER (WHERE rank <= 5 AND position <= 3) AS h3,
    coalesce(array_to_string(list(numero ORDER BY numero) FILTER (WHERE position <= 5 AND rank > 5), ','), '') AS missed_horses,
    coalesce(array_to_string(list(numero ORDER BY numero) FILTER (WHERE rank <= 5 AND position > 5), ','), '') AS false_positives,
    round(avg(abs(score - position)), 9) AS mae, bool_or(position <= 5 AND rank > 5 AND odds < 5) AS missed_favorite,
    bool_or(position <= 5 AND rank > 5 AND odds > 20) AS missed_longshot, bool_or(rank <= 5 AND position > 5 AND odds < 5) AS over_weighted_favorite
  FROM r GROUP BY race_id),
c AS (
  SELECT *, overlap = 5 AS quinte_desordre, h4 = 4 AS bonus_4, h3 = 3 AS bonus_3,
    CASE WHEN overlap = 5 THEN 'success' WHEN h4 = 4 THEN 'bonus_4_miss' WHEN h3 = 3 THEN 'bonus_3_miss' ELSE 'quinte_desordre_miss' END AS failure_type,
    CASE WHEN field_size < 14 THEN 'small' WHEN field_size <= 16 THEN 'medium' ELSE 'large' END AS field_size_category FROM c0),
f AS (
  SELECT *, greatest(CASE failure_type WHEN 'success' THEN 1.0 WHEN 'bonus_4_miss' THEN 5.0 WHEN 'bonus_3_miss' THEN 3.0 ELSE 10.0 END,
    CASE WHEN mae > 3 THEN 2.0 ELSE 0.0 END)::DOUBLE AS failure_weight FROM c)"""
)


def failure_rows(spark: SparkSession, sf: str):
    rows, by_race = field(spark, sf)
    rows = row_number_within(rows, by_race, [F.col("pred_a").asc(), F.col("numero").asc()], "rank")
    rows = rows.withColumn("score", F.col("pred_a") * 0.2)
    card = failures.analyze(rows, ["race_id"], "numero", "score", "rank", "position", "odds", ["natpis"])
    return rows, card


@query(
    _FAIL
    + """
SELECT race_id, field_size, overlap, CAST(quinte_desordre AS INTEGER) AS quinte_desordre, CAST(bonus_4 AS INTEGER) AS bonus_4, CAST(bonus_3 AS INTEGER) AS bonus_3,
  missed_horses, false_positives, round(mae, 6) AS mae, CAST(missed_favorite AS INTEGER) AS missed_favorite, CAST(missed_longshot AS INTEGER) AS missed_longshot,
  CAST(over_weighted_favorite AS INTEGER) AS over_weighted_favorite, failure_type, failure_weight, field_size_category FROM f"""
)
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    _, card = failure_rows(spark, sf)
    flags = ("quinte_desordre", "bonus_4", "bonus_3", "missed_favorite", "missed_longshot", "over_weighted_favorite")
    text = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
    out = card.drop("natpis").withColumns({c: F.col(c).cast("int") for c in flags})
    return rounded(out.withColumns({c: text(c) for c in ("missed_horses", "false_positives")}))


_PATTERN = _FAIL + """,
s AS (
  SELECT natpis, count(*) AS total_failures, count(*) FILTER (WHERE failure_type = 'quinte_desordre_miss') AS quinte_desordre_misses,
    count(*) FILTER (WHERE failure_type = 'bonus_4_miss') AS bonus_4_misses, count(*) FILTER (WHERE failure_type = 'bonus_3_miss') AS bonus_3_misses,
    count(*) FILTER (WHERE missed_favorite) AS missed_favorites_count, count(*) FILTER (WHERE missed_longshot) AS missed_longshots_count,
    count(*) FILTER (WHERE over_weighted_favorite) AS over_weighted_favorites_count, count(*) FILTER (WHERE mae > 3) AS high_mae_count,
    count(*) FILTER (WHERE mae > 3.5) AS very_high_mae_count, avg(mae) AS avg_mae, count(*) FILTER (WHERE field_size < 14) AS small_fields,
    count(*) FILTER (WHERE field_size < 14 AND failure_type <> 'success') AS small_field_failures
  FROM f GROUP BY natpis),
q AS (SELECT *, missed_favorites_count / total_failures * 100 AS missed_favorites_pct, missed_longshots_count / total_failures * 100 AS missed_longshots_pct,
    over_weighted_favorites_count / total_failures * 100 AS over_weighted_favorites_pct FROM s)"""


@query(
    _PATTERN
    + """
SELECT natpis, total_failures, quinte_desordre_misses, bonus_4_misses, bonus_3_misses, missed_favorites_count, missed_longshots_count,
  over_weighted_favorites_count, high_mae_count, very_high_mae_count, round(avg_mae, 6) AS avg_mae, small_fields, small_field_failures,
  round(missed_favorites_pct, 6) AS missed_favorites_pct, round(missed_longshots_pct, 6) AS missed_longshots_pct,
  round(over_weighted_favorites_pct, 6) AS over_weighted_favorites_pct FROM q"""
)
def failure_patterns(spark: SparkSession, sf: str) -> DataFrame:
    _, card = failure_rows(spark, sf)
    return rounded(failures.patterns(card, ["natpis"]).drop("medium_fields", "large_fields", "medium_field_failures", "large_field_failures"))


@query(
    _PATTERN
    + """,
w AS (SELECT *, CASE WHEN missed_longshots_pct > 30 THEN least(0.15, missed_longshots_pct / 200) ELSE 0 END
    - CASE WHEN missed_favorites_pct > 30 THEN least(0.15, missed_favorites_pct / 200) ELSE 0 END
    - CASE WHEN over_weighted_favorites_pct > 40 THEN least(0.075, over_weighted_favorites_pct / 400) ELSE 0 END AS adjustment FROM q)
SELECT natpis, round(adjustment, 6)::DOUBLE AS adjustment, round(greatest(0, least(0.6, 0.3 + adjustment)), 6)::DOUBLE AS suggested_weight,
  CASE WHEN small_field_failures / total_failures > 0.5 THEN 1.25 ELSE 1.0 END::DOUBLE AS field_size_features,
  CASE WHEN very_high_mae_count / total_failures > 0.4 THEN 1.2 ELSE 1.0 END::DOUBLE AS quinte_career_features FROM w"""
)
def suggested_weights(spark: SparkSession, sf: str) -> DataFrame:
    _, card = failure_rows(spark, sf)
    out = failures.feature_factors(failures.weight_change(failures.patterns(card, ["natpis"])))
    return rounded(out.select("natpis", "adjustment", "suggested_weight", "field_size_features", "quinte_career_features"))


@query(
    _PATTERN
    + """,
a AS (
  SELECT natpis, 'missed_favorites' AS issue, missed_favorites_pct AS value FROM q WHERE missed_favorites_pct > 30
  UNION ALL SELECT natpis, 'missed_longshots', missed_longshots_pct FROM q WHERE missed_longshots_pct > 30
  UNION ALL SELECT natpis, 'over_weighted_favorites', over_weighted_favorites_pct FROM q WHERE over_weighted_favorites_pct > 40
  UNION ALL SELECT natpis, 'high_mae', avg_mae FROM q WHERE avg_mae > 3.5
  UNION ALL SELECT natpis, 'small_fields', small_fields / total_failures * 100 FROM q WHERE small_fields / total_failures > 0.5)
SELECT natpis, issue, round(value, 6) AS value FROM a
UNION ALL SELECT natpis, 'none', 0.0 FROM q WHERE natpis NOT IN (SELECT natpis FROM a)"""
)
def failure_advice(spark: SparkSession, sf: str) -> DataFrame:
    _, card = failure_rows(spark, sf)
    return rounded(failures.advice(failures.patterns(card, ["natpis"]), ["natpis"]))


@query(
    _FAIL
    + """
SELECT natpis, field_size_category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY natpis), 6) AS share
FROM f GROUP BY natpis, field_size_category"""
)
def failure_distribution(spark: SparkSession, sf: str) -> DataFrame:
    _, card = failure_rows(spark, sf)
    return rounded(failures.distribution(card, "field_size_category", ["natpis"]))


@query(
    _FAIL
    + """
SELECT natpis, count(*) AS races, round(avg(CAST(quinte_desordre AS INTEGER)), 6) AS quinte_desordre_rate, round(avg(CAST(bonus_4 AS INTEGER)), 6) AS bonus_4_rate,
  round(avg(CAST(bonus_3 AS INTEGER)), 6) AS bonus_3_rate, round(avg(mae), 6) AS avg_mae FROM f GROUP BY natpis"""
)
def baseline_rates(spark: SparkSession, sf: str) -> DataFrame:
    _, card = failure_rows(spark, sf)
    return rounded(failures.baseline_rates(card, ["natpis"]))


@query(_FAIL + " SELECT r.race_id, numero, failure_weight, failure_type FROM r JOIN f ON r.race_id = f.race_id")
def failure_weighted_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, card = failure_rows(spark, sf)
    return failures.weighted_rows(rows, card, ["race_id"]).select("race_id", "numero", "failure_weight", "failure_type")


@query(
    _FAIL
    + """,
v AS (SELECT race_id, failure_weight, failure_weight * CASE WHEN overlap = 0 THEN 2 ELSE 1 END * CASE WHEN mae > 3.5 THEN 1.5 ELSE 1 END AS severity_score FROM f),
k AS (SELECT *, row_number() OVER (ORDER BY severity_score DESC, race_id) AS no FROM v)
SELECT r.race_id, r.numero, k.failure_weight * 2 AS failure_weight, severity_score::DOUBLE AS severity_score
FROM r JOIN k ON r.race_id = k.race_id WHERE no <= floor((SELECT count(*) FROM f) * 0.2)"""
)
def hard_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows, card = failure_rows(spark, sf)
    out = failures.hard_examples(rows.select("race_id", "numero"), card, "race_id")
    return out.select("race_id", "numero", "failure_weight", "severity_score")
