"""Selections of races, columns and weights that other queries don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.orders import order_array
from ..operators import blending, cleaning, failures, models, relative, scoring
from ..operators.grouping import row_number_within
from ..operators.nesting import order_strings
from ..sources import races as scans
from ..sources import tables
from .models import FEATURES, learning_rows
from .registry import query
from .relative import _INPUT, scored
from .roles import RACES, WITH_RUNNERS, races, rounded, runners

NEWEST = 100


def named(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).withColumnsRenamed({"race_id": "comp", "cust_id": "reunion"}).withColumn("prix", F.col("comp"))


@query(
    WITH_RUNNERS
    + ","
    + RACES
    + f"""
SELECT race_id AS comp, jour, horse_id AS winner FROM (
  SELECT race_id, jour FROM races WHERE typec = '2-HIGH' AND jour <= DATE '1996-06-30' ORDER BY jour DESC, race_id LIMIT {NEWEST})
LEFT JOIN (SELECT race_id, horse_id FROM runners WHERE position = 1) USING (race_id)"""
)
def historical_races(spark: SparkSession, sf: str) -> DataFrame:
    """The newest races of a type up to a day, with their winners."""
    rows, _ = runners(spark, sf)
    winners = rows.where("position = 1").select(F.col("race_id").alias("comp"), F.col("horse_id").alias("winner"))
    out = scans.historical(named(spark, sf), winners, kind="2-HIGH", before="1996-06-30", limit=NEWEST)
    return out.select("comp", "jour", "winner")


@query(
    "WITH"
    + RACES
    + f""",
q AS (SELECT race_id AS comp, jour FROM races WHERE race_id % 7 = 0)
SELECT 'day' AS kind, comp, jour FROM q WHERE jour = (SELECT max(jour) FROM q)
UNION ALL SELECT 'newest', * FROM (SELECT * FROM q ORDER BY jour DESC, comp LIMIT {NEWEST})"""
)
def quinte_races(spark: SparkSession, sf: str) -> DataFrame:
    """Marked races: those of the newest day, and the newest of all."""
    rows = named(spark, sf).withColumn("quinte", F.col("comp") % 7 == 0)
    day = rows.where("quinte").select(F.max("jour")).scalar()
    parts = {"day": scans.quinte(rows, day=day), "newest": scans.quinte(rows, limit=NEWEST)}
    day, newest = [part.select(F.lit(kind).alias("kind"), "comp", "jour") for kind, part in parts.items()]
    return day.unionByName(newest)


@query(WITH_RUNNERS + " SELECT race_id, numero, 2 AS kept, round(discount, 6) AS discount FROM runners")
def dropped_features(spark: SparkSession, sf: str) -> DataFrame:
    """Known constant and global columns go; a list of expected columns keeps no others."""
    rows, _ = runners(spark, sf)
    useless = {c: F.lit(1.0) for c in (*cleaning.CONSTANT_FEATURES, *cleaning.GLOBAL_FEATURES)}
    rows = cleaning.drop_features(rows.select("race_id", "numero", "discount", "tax").withColumns(useless))
    rows = rows.withColumn("kept", F.lit(len(rows.columns) - 2))
    return rounded(cleaning.drop_features(rows, ["race_id", "numero", "kept", "discount"]))


@query(WITH_RUNNERS + " SELECT race_id, numero, odds * 2 AS twice, flag || '!' AS marked FROM runners")
def numbers_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A text column whose values are all numbers becomes one, another stays a text."""
    rows, _ = runners(spark, sf)
    rows = rows.select("race_id", "numero", F.col("odds").cast("string").alias("odds"), "flag")
    rows = cleaning.numeric_or_text(rows, ["odds", "flag"])
    return rows.select("race_id", "numero", (F.col("odds") * 2).alias("twice"), F.concat("flag", F.lit("!")).alias("marked"))


@query(
    WITH_RUNNERS
    + """,
s AS (SELECT avg((discount < 0.06)::INT) * 100 AS discount, avg((tax < 0.01)::INT) * 100 AS tax, avg((odds < 40)::INT) * 100 AS odds FROM runners),
u AS (UNPIVOT s ON discount, tax, odds INTO NAME "column" VALUE null_pct)
SELECT "column", round(null_pct, 6) AS null_pct FROM u WHERE null_pct > 50"""
)
def sparse_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    known = {"discount": F.col("discount") >= 0.06, "tax": F.col("tax") >= 0.01, "odds": F.col("odds") >= 40}
    rows = rows.withColumns({c: F.when(test, F.col(c)) for c, test in known.items()})
    return rounded(cleaning.high_null_columns(rows, list(known)))


@query(
    WITH_RUNNERS
    + ","
    + RACES
    + " SELECT race_id, numero, dist / 1000 AS distance, round(sqrt(cheque), 6) AS purse FROM runners JOIN races USING (race_id)"
)
def runners_with_course(spark: SparkSession, sf: str) -> DataFrame:
    """Runners carrying the vector of their race."""
    rows, _ = runners(spark, sf)
    course = races(spark, sf).select("race_id", (F.col("dist") / 1000).alias("distance"), F.sqrt("cheque").alias("purse"))
    out = models.race_representation(rows.select("race_id", "numero"), course, "race_id")
    vector = [F.get("course_vector", i).alias(c) for i, c in enumerate(("distance", "purse"))]
    return rounded(out.select("race_id", "numero", *vector))


@query(
    WITH_RUNNERS
    + " SELECT race_id, numero, round(0.42 * pred_a + 0.28 * pred_b + 0.3 * 100 * discount, 6) AS blended FROM runners"
)
def blend_with_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the weight, nearly, moves from two models to a new one."""
    rows, _ = runners(spark, sf)
    weights = blending.shift_to_alternatives({"pred_a": 0.6, "pred_b": 0.4}, ["pred_a", "pred_b"], ["other"])
    rows = rows.withColumn("other", F.col("discount") * 100)
    return rounded(rows.select("race_id", "numero", blending.blend(weights).alias("blended")))


@query("WITH" + RACES + " SELECT race_id AS comp, jour FROM races WHERE jour >= (SELECT max(jour) FROM races) - 365")
def retained_races(spark: SparkSession, sf: str) -> DataFrame:
    """What a year's retention leaves."""
    return tables.retain(named(spark, sf), "jour", 365).select("comp", "jour")


@query(
    _INPUT
    + """
SELECT race_id, count(*) AS runners, round(max(composite_score), 6)::DOUBLE AS best_score, 2 AS version FROM s GROUP BY race_id"""
)
def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis documents stored by race, delivered twice: the second replaces the first."""
    rows = relative.composite(scored(spark, sf))
    statistics = relative.field_statistics(rows, ["race_id"])
    documents = tables.competitive_document(rows, "race_id", "numero", ["composite_score"], statistics)
    documents = documents.withColumn("slot", (F.col("race_id") % 8).cast("int"))
    made = tables.stage_path(spark, "made")  # both deliveries read them from here, an upsert several times
    documents.write.parquet(made)
    documents = spark.read.schema(documents.schema).parquet(made)
    path = tables.stage_path(spark, "documents")
    for version in (1, 2):
        stored = tables.upsert(
            documents.withColumn("version", F.lit(version)), path, ["race_id", "part"], [F.desc("version")], "slot"
        )
    out = stored.groupBy("race_id").agg(
        F.sum(F.size("runners")).alias("runners"),
        F.max(F.array_max(F.transform("runners", lambda r: r["composite_score"]))).alias("best_score"),
        F.max("version").alias("version"),
    )
    return rounded(out)


@query(
    WITH_RUNNERS
    + """
SELECT race_id, numero, round(pred_b, 6) AS predicted_position, position AS actual_position FROM runners WHERE position <= 3"""
)
def rows_to_learn_from(spark: SparkSession, sf: str) -> DataFrame:
    """Stored predictions of the runners whose result is known by now."""
    rows, _ = runners(spark, sf)
    path = tables.stage_path(spark, "predictions")
    rows.select("race_id", "numero", F.col("pred_b").alias("predicted_position")).write.parquet(path)
    results = rows.where("position <= 3").select("race_id", "numero", "position")
    return rounded(scoring.training_rows(spark.read.parquet(path), results, ["race_id", "numero"]))


@query(
    WITH_RUNNERS
    + """,
o AS (SELECT race_id, list(numero ORDER BY pred_a, numero)[1:5] AS p, list(numero ORDER BY position)[1:5] AS a FROM runners GROUP BY race_id),
h AS (SELECT *, len(list_intersect(p, a)) AS h5, len(list_intersect(p, a[1:4])) AS h4, len(list_intersect(p, a[1:3])) AS h3 FROM o)
SELECT race_id, CASE WHEN h5 = 5 THEN 'success' WHEN h4 = 4 THEN 'bonus_4_miss' WHEN h3 = 3 THEN 'bonus_3_miss' ELSE 'quinte_desordre_miss' END AS failure_type,
  (len(a) - h5)::INT AS missed, (len(p) - h5)::INT AS wrong FROM h"""
)
def failures_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Failure types from stored order strings."""
    rows, by_race = runners(spark, sf)
    ranked = row_number_within(rows, by_race, [F.col("pred_a").asc(), F.col("numero").asc()], "rank")
    predicted = order_strings(ranked, ["race_id"], "rank", "numero", "predicted").select("race_id", "predicted")
    actual = order_strings(ranked, ["race_id"], "position", "numero", "actual").select("race_id", "actual")
    both = predicted.join(actual, "race_id").withColumns({c: order_array(F.col(c)) for c in ("predicted", "actual")})
    out = failures.from_orders(both, "predicted", "actual")
    return out.select(
        "race_id", "failure_type", F.size("missed_horses").alias("missed"), F.size("false_positives").alias("wrong")
    )


@query(f"SELECT {len(FEATURES)} AS columns, 1.0::DOUBLE AS total, true AS none_negative")
def importance_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Importances of all columns: a share each."""
    rows, _ = learning_rows(spark, sf)
    model = models.fit_forest(rows, FEATURES, "y")
    out = models.importances(model.stages[-1], FEATURES, spark)
    shares = out.agg(F.count(F.lit(1)).cast("int").alias("columns"), F.sum("importance").alias("total"), F.bool_and(F.col("importance") >= 0).alias("none_negative"))
    return rounded(shares)
