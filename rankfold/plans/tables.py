"""Scans, joins and sinks over nested race tables built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import discipline_code
from ..operators import cleaning
from ..operators.grouping import row_number_within
from ..operators.nesting import nest, order_strings, parse_nested, unnest
from ..sources import races as scans
from ..sources import tables
from ..sources.key_index import KeyIndex
from ..sources.snapshots import Snapshots
from .registry import query
from .roles import WITH_FIELD, WITH_RUNNERS, field, races, rounded, runners, table, venues

_RANKS = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY pred_b, numero) AS rank FROM field)"""
_STATUS = "WHERE natpis <> 'P'"  # races with predictions
_DONE = "WHERE natpis = 'F'"  # races with a result


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily race rows: nested participants, nested predictions, result text."""
    rows, by_race = runners(spark, sf)
    rows = row_number_within(rows, by_race, [F.col("pred_b").asc(), F.col("numero").asc()], "predicted_rank")
    rows = rows.select(
        "race_id",
        F.col("numero"),
        F.col("horse_id").alias("idche"),
        F.col("odds").alias("cotedirect"),
        F.col("pred_b").alias("predicted_position"),
        "predicted_rank",
        "position",
    )
    # One grouping builds both nested columns of a race.
    nested = nest(rows, ["race_id"], "numero", ["idche", "cotedirect", "predicted_position", "predicted_rank"], "__all")
    order = order_strings(rows, ["race_id"], "position", "numero", "__order")
    sizes = rows.groupBy("race_id").agg(F.count(F.lit(1)).alias("partant"))
    nested = nested.join(order, ["race_id", "part"]).join(sizes, "race_id").withColumns(
        {
            "participants": F.transform("__all", lambda e: F.struct(e["numero"], e["idche"], e["cotedirect"])),
            "__pred": F.transform(
                "__all", lambda e: F.struct(e["idche"], e["numero"], e["predicted_position"], e["predicted_rank"])
            ),
        }
    )
    out = races(spark, sf).join(nested, "race_id").join(venues(spark, sf), "cust_id")
    status = F.col("natpis")
    return out.select(
        F.col("race_id").alias("comp"),
        "part",
        "jour",
        "typec",
        "natpis",
        "cheque",
        F.col("dist"),
        "partant",
        "hippo",
        (F.col("cheque") > 50_000).alias("quinte"),
        "participants",
        F.when(status != "P", F.col("__pred")).alias("predictions"),
        F.when(status == "F", F.col("__order")).when(status == "O", "pending").otherwise("").alias("actual_results"),
    )


@query(
    WITH_FIELD
    + """
SELECT race_id AS comp, jour, typec, 1 AS has_processed_data, CASE WHEN natpis <> 'P' THEN 1 ELSE 0 END AS has_predictions,
  CASE WHEN natpis = 'F' THEN 1 ELSE 0 END AS has_results FROM field GROUP BY race_id, jour, typec, natpis"""
)
def daily_race_list(spark: SparkSession, sf: str) -> DataFrame:
    return scans.race_list(daily(spark, sf))


@query(WITH_FIELD + " SELECT race_id AS comp, numero, horse_id AS idche FROM field WHERE typec LIKE '1%'")
def runners_of_listed_races(spark: SparkSession, sf: str) -> DataFrame:
    """Races of a list of ids, exploded."""
    ids = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("comp"))
    return scans.runners_of(daily(spark, sf), ids=ids).select("comp", "numero", "idche")


@query(WITH_FIELD + " SELECT DISTINCT race_id AS comp, partant FROM field WHERE jour = (SELECT max(jour) FROM field)")
def races_of_a_day(spark: SparkSession, sf: str) -> DataFrame:
    stored = daily(spark, sf)
    return scans.selected(stored, day=stored.select(F.max("jour")).scalar()).select("comp", "partant")


@query(WITH_FIELD + " SELECT race_id AS comp, jour FROM field GROUP BY race_id, jour ORDER BY jour DESC, race_id LIMIT 25")
def latest_races(spark: SparkSession, sf: str) -> DataFrame:
    return scans.selected(daily(spark, sf), latest=25).select("comp", "jour")


@query(
    WITH_FIELD
    + " SELECT race_id AS comp, numero, horse_id AS idche, round(odds, 6) AS cotedirect FROM field WHERE race_id = (SELECT max(race_id) FROM field)"
)
def one_decoded_race(spark: SparkSession, sf: str) -> DataFrame:
    """One race whose participants are stored as text."""
    stored = daily(spark, sf)
    text = stored.withColumn("document", F.to_json("participants")).drop("participants")
    race = scans.one_race(text, text.select(F.max("comp")).scalar())
    rows = parse_nested(race, "document", "numero bigint, idche bigint, cotedirect double")
    return rounded(unnest(rows.select("comp", "document"), "document", computed=True).select("comp", "numero", "idche", "cotedirect"))


@query(
    """
SELECT o_orderkey AS comp, CASE WHEN o_orderstatus = 'P' THEN 'stored' ELSE o_orderpriority END AS typec,
  CAST(o_orderdate AS DATE) AS jour FROM orders WHERE o_orderkey IS NOT NULL"""
)
def race_or_prediction_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Race attributes; those of the prediction table where the race lacks them."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("comp"), "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("jour"))
    known = F.col("o_orderstatus") != "P"
    own = orders.where(known | (F.col("comp") % 2 == 0)).select("comp", F.when(known, F.col("o_orderpriority")).alias("typec"), F.when(known, F.col("jour")).alias("jour"))
    stored = orders.select("comp", F.lit("stored").alias("typec"), "jour")
    return scans.result_or_prediction(own, stored, "typec", "jour")


@query(
    WITH_FIELD
    + " SELECT race_id, numero, round(pred_b, 6) AS pred_b, coalesce(CASE WHEN tax > 0.02 THEN tax END, 0)::DOUBLE AS tax, 0.0::DOUBLE AS absent, discount FROM field"
)
def aligned_model_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns in a model's order: text parsed, nulls and missing columns 0."""
    rows, _ = field(spark, sf)
    own = rows.select("race_id", "numero", F.col("discount").cast("string").alias("discount"), "pred_b", F.when(F.col("tax") > 0.02, F.col("tax")).alias("tax"))
    out = cleaning.align_columns(own, ["race_id", "numero", "pred_b", "tax", "absent", "discount"])
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("race_id", "numero")}))


@query(WITH_FIELD + " SELECT race_id, round(pred_a, 6) AS pred_a, round(pred_b, 6) AS pred_b, tax FROM field")
def chosen_model_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric columns by prefix and name; text ones are not chosen."""
    rows, _ = field(spark, sf)
    own = rows.withColumn("pred_text", F.lit("x"))
    return rounded(own.select("race_id", *cleaning.model_columns(own, ["tax"], ["pred_"], ["pred_a"], at_least=3)))


@query(
    WITH_RUNNERS
    + """ SELECT race_id, numero, round(0.6 * pred_a + 0.4 * pred_b, 6) AS ensemble_prediction, round(pred_b, 6) AS final_prediction,
  round(pred_b - (0.6 * pred_a + 0.4 * pred_b), 6) AS competitive_adjustment, 0.6::DOUBLE AS ensemble_weight_rf, 0.4::DOUBLE AS ensemble_weight_tabnet FROM runners"""
)
def prediction_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    rows = rows.withColumn("both", F.lit(0.6) * F.col("pred_a") + F.lit(0.4) * F.col("pred_b"))
    out = tables.prediction_rows(rows, "both", "pred_b", {"rf": 0.6, "tabnet": 0.4})
    names = ("ensemble_prediction", "final_prediction", "competitive_adjustment", "ensemble_weight_rf", "ensemble_weight_tabnet")
    return rounded(out.select("race_id", "numero", *names))


@query(WITH_FIELD + " SELECT DISTINCT race_id AS comp, jour FROM field WHERE natpis = 'P'")
def races_to_predict(spark: SparkSession, sf: str) -> DataFrame:
    return scans.to_predict(daily(spark, sf)).select("comp", "jour")


@query(
    WITH_FIELD
    + """
SELECT DISTINCT race_id AS comp, jour FROM field WHERE natpis = 'F' AND jour BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
ORDER BY jour DESC, race_id LIMIT 200"""
)
def completed_races(spark: SparkSession, sf: str) -> DataFrame:
    return scans.completed(daily(spark, sf), "1996-01-01", "1998-12-31", predicted=True, limit=200).select("comp", "jour")


@query(
    WITH_FIELD
    + """
SELECT race_id AS comp, count(*) FILTER (WHERE discount > 0.05) AS n_predictions FROM field WHERE natpis = 'F' AND cheque > 50000
GROUP BY race_id HAVING count(*) FILTER (WHERE discount > 0.05) > 0"""
)
def completed_with_predictions(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "lineitem").where(F.col("l_discount") > 0.05).select(F.col("l_orderkey").alias("race_id"))
    return scans.completed_with_stored(daily(spark, sf), stored).select("comp", "n_predictions")


@query(
    WITH_FIELD
    + _RANKS
    + f"""
SELECT race_id AS comp, numero, rank AS predicted_rank, round(pred_b, 6) AS predicted_position,
  CASE WHEN natpis = 'F' THEN position ELSE 999 END AS actual_position FROM ranked {_STATUS}"""
)
def flatten_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = scans.nested_predictions(daily(spark, sf))
    return rounded(rows.select("comp", "numero", "predicted_rank", "predicted_position", "actual_position"))


@query(
    WITH_FIELD
    + _RANKS
    + f"""
SELECT race_id AS comp, array_to_string(list(numero ORDER BY rank) FILTER (WHERE rank <= 5), '-') AS top5,
  CAST(max(CASE WHEN numero = 1 THEN rank END) AS BIGINT) AS rank_of_first FROM ranked {_STATUS} GROUP BY race_id"""
)
def second_model_top5(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily(spark, sf)
    first = F.max(F.try_element_at("ranks", F.lit(1).cast("long"))).alias("rank_of_first")
    ranks = scans.rank_maps(rows).groupBy("comp").agg(first)
    top = F.array_join(F.transform("top", lambda n: n.cast("string")), "-").alias("top5")
    return scans.second_model(rows).select("comp", top).join(ranks, "comp")


@query(WITH_FIELD + f" SELECT race_id AS comp, position, numero FROM field {_DONE}")
def result_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Order texts of completed races to positions; pending and empty texts give no rows."""
    return scans.positions_of_orders(daily(spark, sf))


@query(
    WITH_FIELD
    + f"""
SELECT race_id AS comp, array_to_string(list(numero ORDER BY position) FILTER (WHERE position <= 3), '-') AS top3,
  array_to_string(list(numero ORDER BY position) FILTER (WHERE position <= 5), '-') AS top5 FROM field {_DONE} GROUP BY race_id HAVING count(*) >= 5"""
)
def complete_top5_sets(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), "-").alias(c)
    return scans.complete_orders(daily(spark, sf)).select("comp", text("top3"), text("top5"))


@query(
    WITH_RUNNERS
    + """
SELECT race_id AS comp, CAST(position AS BIGINT) AS position, numero FROM runners WHERE flag <> 'A'"""
)
def arrival_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Finish texts (numbers, and a code for flag A) to arrival arrays and back."""
    rows, _ = runners(spark, sf)
    finish = F.when(F.col("flag") == "A", "DAI").otherwise(F.col("position").cast("string"))
    rows = rows.select(F.col("race_id").alias("comp"), "numero", "horse_id", finish.alias("finish"))
    return scans.positions(tables.result_rows(rows, "comp", "finish", "numero", "horse_id"))


@query(
    WITH_FIELD
    + _RANKS
    + """
SELECT race_id AS comp, numero, typec, dist, round(pred_b, 6) AS predicted_position, CASE WHEN odds > 10 THEN odds ELSE 5.0 END AS cotedirect, position AS actual_position
FROM ranked WHERE natpis = 'F' AND typec IN ('1-URGENT', '2-HIGH') AND dist BETWEEN 1200 AND 2500 AND partant >= 3"""
)
def weight_analysis_rows(spark: SparkSession, sf: str) -> DataFrame:
    chosen = scans.filtered(daily(spark, sf), ["1-URGENT", "2-HIGH"], dist=(1200, 2500), field=(3, None))
    rows = scans.nested_predictions(chosen, missing=None).where(F.col("actual_position").isNotNull())
    listed = chosen.withColumn("participants", F.filter("participants", lambda p: p["cotedirect"] > 10))
    out = scans.with_odds(rows.select("comp", "numero", "predicted_position", "actual_position"), listed)
    kinds = chosen.select("comp", F.col("typec"), F.col("dist"))
    out = out.drop("typec", "dist", "partant", "hippo").join(kinds, "comp")
    return rounded(out.select("comp", "numero", "typec", "dist", "predicted_position", "cotedirect", "actual_position"))


@query("SELECT DISTINCT CAST(l_shipdate AS DATE) AS race_date FROM lineitem")
def prediction_dates(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("race_date"))
    return scans.prediction_days(stored)


@query(
    WITH_FIELD
    + """
SELECT race_id AS comp, numero, odds AS direct_odds, round(pred_b, 6) AS reference_odds FROM field"""
)
def odds_document(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    rapport = lambda c: F.struct(F.col(c).alias("rapport"))
    rows = rows.select(
        "race_id", "numero", F.col("numero").alias("numPmu"), rapport("odds").alias("dernierRapportDirect"),
        rapport("pred_b").alias("dernierRapportReference"),
    )
    documents = nest(rows, ["race_id"], "numero", ["numPmu", "dernierRapportDirect", "dernierRapportReference"], "participants")
    path = tables.stage_path(spark, "odds")
    tables.export_json(documents, path)
    back = spark.read.schema(documents.schema).json(path)
    out = scans.odds_document(back.drop("part"))
    return rounded(out.select(F.col("race_id").alias("comp"), "numero", "direct_odds", "reference_odds"))


@query(
    WITH_RUNNERS
    + """
SELECT race_id AS _race_id, numero, round(pred_a, 6) AS pred_a, round(pred_b, 6) AS pred_b FROM runners"""
)
def feature_export_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    rows = rows.withColumn("hippo", F.col("flag")).withColumn("date", F.col("ship_day").cast("string"))
    per_race = rows.groupBy("race_id").agg(F.first("hippo").alias("hippo"), F.first("date").alias("date"))
    nested = tables.feature_export(rows, "race_id", "numero", ["pred_a", "pred_b"]).join(per_race, "race_id")
    # A document holds a few races of at most one part each.
    bucket = F.floor(F.col("race_id") / 20)
    documents = nested.groupBy(bucket.alias("bucket"), "part").agg(
        F.collect_list(F.struct("race_id", "hippo", "date", "X_features")).alias("races")
    )
    path = tables.stage_path(spark, "features")
    tables.export_json(documents, path)
    back = spark.read.schema(documents.schema).json(path)
    return rounded(scans.exported_features(back).drop("_hippo", "_date"))


@query(
    WITH_RUNNERS + " SELECT race_id AS comp, numero, round(pred_b, 6) AS predicted_position FROM runners WHERE status = 'O'"
)
def newest_export(spark: SparkSession, sf: str) -> DataFrame:
    """Two exports side by side; only the one written last is read."""
    rows, _ = runners(spark, sf)
    rows = rows.select(F.col("race_id").alias("comp"), "numero", F.col("pred_b").alias("predicted_position"), "status")
    path = tables.stage_path(spark, "exports")
    for status in ("F", "O"):
        chosen = rows.where(F.col("status") == status).drop("status")
        tables.export_json(chosen, f"{path}/{status}")
    back = spark.read.schema("comp bigint, numero bigint, predicted_position double").json(f"{path}/*")
    return rounded(scans.newest_folder(back))


@query(WITH_RUNNERS + " SELECT race_id AS comp, numero, round(pred_b, 6) AS predicted_position FROM runners")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    rows = rounded(rows.select(F.col("race_id").alias("comp"), "numero", F.col("pred_b").alias("predicted_position")))
    path = tables.stage_path(spark, "csv")
    tables.export_csv(rows, path)
    return scans.read_predictions(spark, path, "comp bigint, numero bigint, predicted_position double")


@query(
    """
SELECT p_partkey, p_size, array_to_string(['a:' || p_size, 'b:' || (p_size * 2)], ',') AS extra FROM part"""
)
def checked_write(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.create_map(F.lit("a"), size, F.lit("b"), size * 2).alias("extra"))
    back = tables.write_checked(rows, tables.stage_path(spark, "checked"))
    read = F.from_json("extra", "map<string,int>")
    pairs = F.transform(F.array_sort(F.map_entries(read)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return back.withColumn("extra", F.array_join(pairs, ","))


@query("SELECT p_partkey, p_size FROM part")
def failed_write_keeps_the_table(spark: SparkSession, sf: str) -> DataFrame:
    """A second version that fails its check is never seen."""
    rows, path = table(spark, sf, "part").select("p_partkey", "p_size"), tables.stage_path(spark, "snapshots")
    tables.write_checked(rows, path)

    def complete(written: DataFrame) -> None:
        if written.where("p_size is null").limit(1).count():
            raise ValueError("sizes are missing")

    try:
        tables.write_checked(rows.withColumn("p_size", F.when(F.col("p_size") > 25, F.col("p_size"))), path, [complete])
    except ValueError:
        pass
    return Snapshots(spark, path).read()


# --- Feed -----------------------------------------------------------------------


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Feed rows as landed JSON text: one row per runner, each with its race record."""
    rows, _ = field(spark, sf)
    rows = rows.join(venues(spark, sf), "cust_id")
    text = lambda c: F.col(c).cast("string")
    race = F.struct(
        text("race_id").alias("comp"), text("jour").alias("jour"), F.col("hippo"), F.col("typec"),
        text("partant").alias("partant"), F.when(F.col("dist") > 1500, text("dist")).otherwise("?").alias("dist"),
        text("cheque").alias("cheque"), F.when(F.col("cheque") > 50_000, "1").otherwise("0").alias("quinte"),
        F.when(F.col("natpis") == "F", "1-2").otherwise("").alias("arriv"),
    )
    runner = F.struct(
        race.alias("numcourse"), F.col("numero").alias("num"), F.col("horse_id").alias("idChe"), text("odds").alias("cote"),
        F.when(F.col("flag") == "A", "DAI").otherwise(text("position")).alias("lastPlace"),
    )
    return rows.select(F.col("race_id"), F.col("numero"), F.to_json(runner).alias("document"))


FEED_RUNNER = (
    "numcourse:struct<comp:string,jour:string,hippo:string,reun:string,prix:string,prixnom:string,typec:string,partant:string,"
    "dist:string,handi:string,groupe:string,quinte:string,natpis:string,meteo:string,corde:string,cheque:string,arriv:string>,"
    "num:bigint,idChe:bigint,cote:string,lastPlace:string"
)


@query(
    WITH_FIELD
    + """
SELECT DISTINCT CAST(race_id AS VARCHAR) AS comp, jour, (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = cust_id) AS hippo,
  typec, CAST(partant AS INTEGER) AS partant, CASE WHEN dist > 1500 THEN CAST(CAST(dist AS DOUBLE) AS INTEGER) END AS dist,
  cheque, CAST(cheque > 50000 AS INTEGER) AS quinte, CASE WHEN natpis = 'F' THEN '1-2' ELSE 'pending' END AS actual_results FROM field"""
)
def feed_races(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse_nested(feed(spark, sf), "document", FEED_RUNNER)
    out = scans.feed_race(unnest(rows.select("document"), "document", computed=True))
    return out.select(
        "comp", "jour", "hippo", "typec", "partant", "dist", "cheque", F.col("quinte").cast("int").alias("quinte"), "actual_results"
    )


@query(
    WITH_FIELD
    + """
SELECT CAST(race_id AS VARCHAR) AS comp, numero, horse_id AS idche, odds AS cotedirect,
  CASE WHEN flag = 'A' THEN 15.0 ELSE position END::DOUBLE AS derniereplace, 5.0::DOUBLE AS age FROM field"""
)
def feed_runners(spark: SparkSession, sf: str) -> DataFrame:
    """Feed row conversion: normalise, rename, coerce, default."""
    rows = unnest(parse_nested(feed(spark, sf), "document", FEED_RUNNER).select("document"), "document", computed=True)
    rows = rows.withColumn("comp", F.col("numcourse.comp")).drop("numcourse")
    rows = cleaning.standard_names(rows, ["comp", "numero", "idche", "cotedirect", "derniereplace"])
    rows = cleaning.to_numeric(cleaning.mixed_to_numbers(rows), ["cotedirect", "derniereplace"])
    return cleaning.fill_defaults(cleaning.require_columns(rows, {"age": 5.0}))


@query(
    """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'P' WHEN '2-HIGH' THEN 'A' WHEN '3-MEDIUM' THEN 'M' ELSE NULL END AS code FROM orders"""
)
def discipline_codes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "PLAT").when(p == "2-HIGH", "Attelé").when(p == "3-MEDIUM", "m").otherwise("Galop")
    return table(spark, sf, "orders").select("o_orderkey", discipline_code(name).alias("code"))


# --- Joins ----------------------------------------------------------------------


@query("SELECT o_orderkey AS comp FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def anti_unarchived(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("race_id"))
    return scans.without_stored(table(spark, sf, "orders").select(F.col("o_orderkey").alias("comp")), stored)


@query("SELECT o_orderkey AS comp FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3)")
def semi_in_country(spark: SparkSession, sf: str) -> DataFrame:
    races_ = table(spark, sf, "orders").select(F.col("o_orderkey").alias("comp"), F.col("o_custkey").alias("hippo"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    country = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("k"))
    country = country.select(F.col("c_custkey").alias("hippo"), F.when(F.col("n_regionkey") == 3, "FRA").otherwise("").alias("Pays"))
    return scans.in_country(races_, country).select("comp")


@query(
    """
SELECT o_orderkey AS comp, CASE WHEN count(l_orderkey) > 0 THEN 1 ELSE 0 END AS has_prediction
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_discount > 0.08 GROUP BY o_orderkey"""
)
def flag_left_join(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "lineitem").where(F.col("l_discount") > 0.08).select(F.col("l_orderkey").alias("race_id"))
    return scans.stored_flag(table(spark, sf, "orders").select(F.col("o_orderkey").alias("comp")), stored)


@query("SELECT count(DISTINCT o_orderkey) AS races FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount > 0.08")
def predicted_race_count(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "lineitem").where(F.col("l_discount") > 0.08).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(stored, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("races"))


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_discount > 0.05 THEN l_quantity END, p_size::DOUBLE) AS size,
  coalesce(nullif(CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END, ''), p_brand) AS brand, p_type
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"""
)
def supplement_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("size"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("brand"),
    )
    documents = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand"), "p_type"
    )
    return scans.fill_from(rows, documents, ["l_partkey"])


@query(
    WITH_RUNNERS
    + """,
a AS (SELECT * FROM runners WHERE discount > 0.03), b AS (SELECT * FROM runners WHERE tax > 0.02)
SELECT a.race_id, a.numero, round(0.2 * a.pred_a + 0.8 * b.pred_b, 6) AS blended FROM a JOIN b ON a.race_id = b.race_id AND a.numero = b.numero"""
)
def two_models_joined(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = runners(spark, sf)
    a = rows.where(F.col("discount") > 0.03).select("race_id", "numero", "pred_a")
    b = rows.where(F.col("tax") > 0.02).select("race_id", "numero", "pred_b")
    both = a.join(b, ["race_id", "numero"])
    return rounded(both.select("race_id", "numero", (0.2 * F.col("pred_a") + 0.8 * F.col("pred_b")).alias("blended")))


@query(
    WITH_FIELD
    + """,
last AS (SELECT max(jour) AS d FROM races), today AS (SELECT * FROM field, last WHERE jour >= d - 30),
old AS (SELECT f.*, row_number() OVER (PARTITION BY horse_id ORDER BY jour DESC, race_id, numero) AS k FROM field f, last
        WHERE jour < d - 30 AND horse_id IN (SELECT horse_id FROM today))
SELECT race_id, numero, horse_id, 1 AS is_today FROM today UNION ALL SELECT race_id, numero, horse_id, 0 FROM old WHERE k <= 50"""
)
def history_of_today(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = field(spark, sf)
    rows = rows.select("race_id", "numero", "horse_id", "jour")
    cut = races(spark, sf).select(F.date_sub(F.max("jour"), 30)).scalar()
    today, history = rows.where(F.col("jour") >= cut), rows.where(F.col("jour") < cut)
    order = [F.desc("jour"), F.asc("race_id"), F.asc("numero")]
    return scans.history_of_today(today, history, "horse_id", order).drop("jour")


@query(
    WITH_RUNNERS
    + """,
x AS (SELECT race_id, max(CASE WHEN pred_a <= 10 AND position <= 3 THEN 1 ELSE 0 END) AS a FROM runners WHERE discount > 0.04 GROUP BY race_id),
y AS (SELECT race_id, max(CASE WHEN pred_b <= 20 AND position <= 3 THEN 1 ELSE 0 END) AS b FROM runners WHERE tax > 0.05 GROUP BY race_id)
SELECT o_orderkey AS comp, a AS first_hit, b AS second_hit, CASE WHEN a > b THEN 'first' WHEN b > a THEN 'second' WHEN a IS NULL OR b IS NULL THEN 'unknown' ELSE 'tie' END AS better_model
FROM orders LEFT JOIN x ON x.race_id = o_orderkey LEFT JOIN y ON y.race_id = o_orderkey"""
)
def two_sources_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluation import two_model_comparison

    rows, _ = runners(spark, sf)
    hit = lambda c, limit, name: F.max(F.when((F.col(c) <= limit) & (F.col("position") <= 3), 1).otherwise(0)).alias(name)
    x = rows.where(F.col("discount") > 0.04).groupBy(F.col("race_id").alias("comp")).agg(hit("pred_a", 10, "first_hit"))
    y = rows.where(F.col("tax") > 0.05).groupBy(F.col("race_id").alias("comp")).agg(hit("pred_b", 20, "second_hit"))
    all_races = table(spark, sf, "orders").select(F.col("o_orderkey").alias("comp"))
    return two_model_comparison(all_races.join(x, "comp", "left").join(y, "comp", "left"), "first_hit", "second_hit")


# --- Sinks ----------------------------------------------------------------------


@query(
    """
SELECT o_orderkey AS comp, round(CASE WHEN year(o_orderdate) >= 1998 THEN o_totalprice * 2 ELSE o_totalprice END, 4) AS cheque,
  CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"""
)
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Open races first; the second delivery inserts the others and updates the later years.

    Only the years of a delivery are rewritten.
    """
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    row = lambda factor, version: [
        F.col("o_orderkey").alias("comp"), (F.col("o_totalprice") * factor).alias("cheque"), F.lit(version).alias("version"), "year"
    ]
    pending = F.col("o_orderstatus") == "P"
    first = orders.where(~pending).select(*row(1, 1))
    recent = F.col("year") >= 1998
    second = orders.where(recent).select(*row(2, 2)).unionByName(orders.where(pending & ~recent).select(*row(1, 2)))
    path = tables.stage_path(spark, "races")
    tables.upsert(first, path, ["comp"], [F.desc("version")], "year")
    out = tables.upsert(second, path, ["comp"], [F.desc("version")], "year")
    return rounded(out.drop("version"), 4)


@query(
    """
SELECT o_orderkey AS comp, CASE WHEN o_orderpriority LIKE '1%' THEN 2001 WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
  CASE WHEN o_orderpriority LIKE '1%' THEN 5 WHEN o_orderpriority LIKE '2%' THEN 4 ELSE 3 END AS version FROM orders"""
)
def upsert_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """Moved, null and unchanged days through a key index; an older delivery of all races changes nothing."""
    day = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("comp"), day.alias("year"), "o_orderpriority")
    row = lambda rows, year, version: rows.select("comp", year.alias("year"), F.lit(version).alias("version"))
    path = tables.stage_path(spark, "races")
    index = KeyIndex(spark, tables.stage_path(spark, "races-index"), "comp bigint", "year int")
    batches = (
        row(orders, F.col("year"), 3),
        row(orders.where(F.col("o_orderpriority").startswith("2")), F.col("year"), 4),
        row(orders.where(F.col("o_orderpriority").startswith("1")), F.lit(2001), 5),
        row(orders, F.lit(1970), 2),
    )
    for batch in batches:
        out = tables.upsert(batch, path, ["comp"], [F.desc("version")], "year", index=index)
    return out


@query(
    """
SELECT o_orderkey AS comp, round(CASE WHEN o_orderpriority LIKE '1%' THEN 2 * o_totalprice ELSE o_totalprice END, 4) AS cheque,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders"""
)
def upsert_null_day(spark: SparkSession, sf: str) -> DataFrame:
    """Races without a day are kept and updated like others."""
    orders = table(spark, sf, "orders").withColumn("year", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")))
    row = lambda factor, version: [
        F.col("o_orderkey").alias("comp"), (F.col("o_totalprice") * factor).alias("cheque"), F.lit(version).alias("version"), "year"
    ]
    path = tables.stage_path(spark, "races")
    tables.upsert(orders.select(*row(1, 1)), path, ["comp"], [F.desc("version")], "year")
    second = orders.where(F.col("o_orderpriority").startswith("1")).select(*row(2, 2))
    return rounded(tables.upsert(second, path, ["comp"], [F.desc("version")], "year").drop("version"), 4)


@query(
    """
SELECT o_orderkey AS comp, CAST(CASE WHEN o_orderpriority LIKE '1%' OR year(o_orderdate) = 1998 THEN 2001 ELSE year(o_orderdate) END AS INTEGER) AS year,
  CAST(CASE WHEN o_orderpriority LIKE '1%' OR year(o_orderdate) = 1998 THEN 5 ELSE 3 END AS INTEGER) AS version FROM orders"""
)
def upsert_moved_day(spark: SparkSession, sf: str) -> DataFrame:
    """Races whose day is corrected leave the old day, a whole day too; an older version changes nothing."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("comp"), F.year("o_orderdate").alias("year"), "o_orderpriority")
    row = lambda rows, year, version: rows.select("comp", year.alias("year"), F.lit(version).alias("version"))
    path = tables.stage_path(spark, "races")
    tables.upsert(row(orders, F.col("year"), 3), path, ["comp"], [F.desc("version")], "year")
    moved = orders.where(F.col("o_orderpriority").startswith("1") | (F.col("year") == 1998))
    tables.upsert(row(moved, F.lit(2001), 5), path, ["comp"], [F.desc("version")], "year")
    return tables.upsert(row(orders, F.lit(1970), 2), path, ["comp"], [F.desc("version")], "year")


@query(
    WITH_FIELD
    + """
SELECT race_id, numero, CASE WHEN natpis = 'F' THEN position WHEN odds > 25 THEN 99 END AS actual_result,
  CASE WHEN natpis = 'F' THEN CAST(position <= 5 AS INTEGER) WHEN odds > 25 THEN 0 END AS was_in_quinte FROM field"""
)
def backfill_results(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = field(spark, sf)
    stored = rows.select("race_id", "numero", F.when(F.col("odds") > 25, 99).alias("actual_result"))
    results = rows.where(F.col("natpis") == "F").select("race_id", "numero", "position")
    out = tables.backfill(stored, results, ["race_id", "numero"])
    return out.withColumn("was_in_quinte", F.col("was_in_quinte").cast("int"))


@query(
    WITH_FIELD
    + _RANKS
    + """
SELECT race_id, count(*) AS total_horses, round(min(pred_b), 6) AS best_score, array_to_string(list(numero ORDER BY rank) FILTER (WHERE rank <= 5), '-') AS predicted_top5,
  max(CASE WHEN rank = 1 THEN numero END) AS predicted_winner FROM ranked GROUP BY race_id"""
)
def race_summaries(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_race = runners(spark, sf)
    rows = row_number_within(rows, by_race, [F.col("pred_b").asc(), F.col("numero").asc()], "rank")
    return rounded(tables.race_summaries(rows, ["race_id"], "rank", "numero", "pred_b"))


@query(
    WITH_FIELD
    + """
SELECT race_id AS comp, CAST(count(*) AS INTEGER) AS runners, CAST(sum(position) AS BIGINT) AS position_sum FROM field
WHERE natpis = 'F' AND typec <> '1-URGENT' GROUP BY race_id"""
)
def archive_races(spark: SparkSession, sf: str) -> DataFrame:
    """Archive of completed races not archived yet, written and read back with its results."""
    archived = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("comp"))
    rows, results, _ = tables.archive(daily(spark, sf), archived, {"natpis": "going"})
    races_path, results_path = tables.stage_path(spark, "history"), tables.stage_path(spark, "results")
    tables.write_partitions(rows.withColumn("year", F.year("jour")), races_path, "year")
    results.write.parquet(results_path)
    places = scans.positions(spark.read.parquet(results_path)).groupBy("comp").agg(F.sum("position").alias("position_sum"))
    stored = spark.read.parquet(races_path).select("comp", F.size("participants").alias("runners"))
    return stored.join(places, "comp")


@query(
    """
WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem), c AS (SELECT max(d) - 365 AS cut FROM d)
SELECT count(*) FILTER (WHERE d < cut) AS to_delete, count(*) FILTER (WHERE d >= cut) AS to_keep, min(d) FILTER (WHERE d < cut) AS oldest FROM d, c"""
)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return tables.retention_report(rows, "d", 365)


@query(
    """
WITH c AS (SELECT max(CAST(o_orderdate AS DATE)) - 365 AS cut FROM orders)
SELECT o_orderkey AS comp FROM orders, c WHERE NOT (CAST(o_orderdate AS DATE) < cut AND o_orderstatus = 'F')"""
)
def delete_archived_races(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("comp"), F.col("o_orderdate").cast("date").alias("jour"), "o_orderstatus"
    )
    return tables.delete_archived(rows, rows.where(F.col("o_orderstatus") == "F"), "jour", 365).select("comp")


@query(WITH_FIELD + f" SELECT race_id AS comp, numero, position AS final_position FROM field {_DONE}")
def participants_with_finish(spark: SparkSession, sf: str) -> DataFrame:
    done = tables.with_final_positions(scans.completed(daily(spark, sf)))
    return unnest(done.select("comp", "participants"), "participants").select(
        "comp", "numero", F.col("final_position").cast("long").alias("final_position")
    )


@query(
    WITH_FIELD
    + _RANKS
    + """
SELECT race_id AS comp, count(*) AS n, round(sum(pred_b), 6) AS score_sum, CAST(min(rank) AS BIGINT) AS best FROM ranked GROUP BY race_id"""
)
def predictions_into_races(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions nested into the race rows and read from there."""
    rows, by_race = runners(spark, sf)
    rows = row_number_within(rows, by_race, [F.col("pred_b").asc(), F.col("numero").asc()], "rank")
    rows = rows.withColumnRenamed("race_id", "comp")
    base = races(spark, sf).select(F.col("race_id").alias("comp"), "jour")
    stored = tables.nested_predictions(base, rows, "comp", "rank", ["numero", "pred_b"])
    flat = unnest(stored.select("comp", "predictions").where(F.col("predictions").isNotNull()), "predictions")
    return rounded(
        flat.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("pred_b").alias("score_sum"), F.min("rank").alias("best"))
    )


@query(
    WITH_RUNNERS
    + """
SELECT race_id AS id, count(*) AS runners, CAST(bool_or(p_size > 25) AS INTEGER) AS is_handicap
FROM runners JOIN part ON p_partkey = horse_id GROUP BY race_id"""
)
def race_rows_with_handicap(spark: SparkSession, sf: str) -> DataFrame:
    """Sync: race and runner rows joined, split, nested again, handicap text encoded."""
    rows, _ = runners(spark, sf)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("horse_id"), "p_size")
    rows = rows.join(parts, "horse_id")
    text = rows.groupBy("race_id").agg(F.max(F.when(F.col("p_size") > 25, "Handicap").otherwise("")).alias("handi"))
    joined = rows.select(F.col("race_id").alias("id"), "numero", "horse_id").join(text.withColumnRenamed("race_id", "id"), "id")
    race, runner = scans.split_race_runner(joined, ["id", "handi"])
    out = tables.race_rows(race, runner, "id", "numero", ["horse_id"], "handi")
    return out.groupBy("id").agg(
        F.sum(F.size("participants")).alias("runners"), F.max(F.col("is_handicap").cast("int")).alias("is_handicap")
    )
