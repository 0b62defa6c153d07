"""Scans of race, result and prediction tables.

Every scan is a filter on a frame: predicates and column lists reach the file
scan, and restrictions to other tables are semi or anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.orders import PENDING, explode_arrival, explode_order, order_array
from ..functions.text import clean_text
from ..operators.grouping import first_per_key
from ..operators.nesting import CHUNK, unnest


def known_result(column: str = "actual_results") -> Column:
    text = F.trim(F.col(column))
    return F.coalesce((text != "") & (F.lower(text) != PENDING), F.lit(False))


def has_predictions(column: str = "predictions") -> Column:
    return F.coalesce(F.size(column) > 0, F.lit(False))


def between_days(df: DataFrame, day: str, first=None, last=None) -> DataFrame:
    if first is not None:
        df = df.where(F.col(day) >= first)
    if last is not None:
        df = df.where(F.col(day) <= last)
    return df


def historical(
    races: DataFrame, results: DataFrame | None = None, kind: str | None = None, before=None, limit: int | None = None
) -> DataFrame:
    """Historical races of one type before a day, with their results if given."""
    out = races if kind is None else races.where(F.col("typec") == kind)
    out = between_days(out, "jour", last=before)
    if results is not None:
        out = out.join(results, "comp", "left")
    return out if limit is None else first_races(out, [F.desc("jour"), F.asc("comp")], limit)


def quinte(races: DataFrame, day=None, limit: int | None = None) -> DataFrame:
    """Quinté races: of one day in programme order, or the newest."""
    out = races.where(F.col("quinte"))
    if day is not None:
        return out.where(F.col("jour") == day).orderBy("reunion", "prix")
    order = [F.desc("jour"), F.asc("comp")]
    return out.orderBy(*order) if limit is None else first_races(out, order, limit)


def first_races(races: DataFrame, order: list, limit: int) -> DataFrame:
    """All parts of the first ``limit`` races in an order; a long race counts once."""
    if "part" not in races.columns:
        return races.orderBy(*order).limit(limit)
    return races.join(races.where(F.col("part") == 0).orderBy(*order).limit(limit).select("comp"), "comp", "left_semi")


def selected(races: DataFrame, ids: DataFrame | None = None, day=None, latest: int | None = None) -> DataFrame:
    """Races of an id frame, of a day, or the latest n."""
    if ids is not None:
        return races.join(ids.select("comp"), "comp", "left_semi")
    if day is not None:
        return races.where(F.col("jour") == day)
    return first_races(races, [F.desc("jour"), F.asc("comp")], latest or 1)


def runners_of(races: DataFrame, **chosen) -> DataFrame:
    return unnest(selected(races, **chosen), "participants")


def race_list(races: DataFrame, day=None) -> DataFrame:
    """Races with flags of what is stored for them."""
    out = races if day is None else races.where(F.col("jour") == day)
    out = out.where(F.col("part") == 0) if "part" in out.columns else out  # a long race is one race
    flag = lambda c: F.when(c, 1).otherwise(0)
    return out.select(
        "comp",
        "jour",
        "typec",
        flag(F.size("participants") > 0).alias("has_processed_data"),
        flag(has_predictions()).alias("has_predictions"),
        flag(known_result()).alias("has_results"),
    )


def one_race(races: DataFrame, comp) -> DataFrame:
    return races.where(F.col("comp") == comp)


def to_predict(races: DataFrame, day=None, force: bool = False, limit: int | None = None) -> DataFrame:
    """Races with participants and without predictions (or all of them when forced)."""
    out = races.where(F.size("participants") > 0)
    if day is not None:
        out = out.where(F.col("jour") == day)
    if not force:
        out = out.where(~has_predictions())
    return out if limit is None else first_races(out, [F.asc("jour"), F.asc("comp")], limit)


def completed(
    races: DataFrame, first=None, last=None, archived: DataFrame | None = None, predicted: bool = False, limit: int | None = None
) -> DataFrame:
    """Races with a result, newest first; optionally predicted ones, optionally not archived."""
    out = between_days(races.where(known_result()), "jour", first, last)
    if predicted:
        out = out.where(has_predictions())
    if archived is not None:
        out = out.join(archived.select("comp"), "comp", "left_anti")
    return out if limit is None else first_races(out, [F.desc("jour"), F.asc("comp")], limit)


def completed_with_stored(races: DataFrame, stored: DataFrame, at_least: int = 1, first=None, last=None) -> DataFrame:
    """Completed quinté races with at least n stored predictions, and their count."""
    counts = stored.groupBy(F.col("race_id").alias("comp")).agg(F.count(F.lit(1)).alias("n_predictions"))
    chosen = completed(races, first, last).where(F.col("quinte"))
    return chosen.join(counts.where(F.col("n_predictions") >= at_least), "comp")


def without_stored(races: DataFrame, stored: DataFrame) -> DataFrame:
    return races.join(stored.select(F.col("race_id").alias("comp")), "comp", "left_anti")


def stored_flag(races: DataFrame, stored: DataFrame, name: str = "has_prediction") -> DataFrame:
    """Races with a 0/1 flag of stored predictions."""
    keys = stored.select(F.col("race_id").alias("comp")).distinct().withColumn("__p", F.lit(1))
    return races.join(keys, "comp", "left").withColumn(name, F.coalesce("__p", F.lit(0))).drop("__p")


def predictions(stored: DataFrame, day=None, ids: DataFrame | None = None) -> DataFrame:
    """Stored predictions in comparison names, by race and rank."""
    out = stored if day is None else stored.where(F.col("race_date") == day)
    if ids is not None:
        out = out.join(ids.select(F.col("comp").alias("race_id")), "race_id", "left_semi")
    return out.select(
        F.col("race_id").alias("comp"),
        F.col("horse_number").alias("numero"),
        F.col("horse_id").alias("idche"),
        F.col("final_prediction").alias("predicted_position"),
        "predicted_rank",
        "race_date",
    ).orderBy("comp", "predicted_rank")


def nested_predictions(races: DataFrame, missing: int | None = 999) -> DataFrame:
    """Predictions of the nested column with the actual position; a missing one gets ``missing``."""
    rows = races.where(has_predictions()).select("comp", "jour", F.inline("predictions"))
    actual = positions_of_orders(races.where(known_result())).withColumnRenamed("position", "actual_position")
    out = rows.join(actual, ["comp", "numero"], "left")
    return out if missing is None else out.na.fill(missing, ["actual_position"])


def newest_folder(df: DataFrame) -> DataFrame:
    """Rows of the folder written last, where each export is a folder of any number of files."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]+$", 1)
    stamped = df.select("*", F.col("_metadata.file_modification_time").alias("__at"), folder.alias("__f"))
    last = stamped.select(F.max(F.struct("__at", "__f"))["__f"]).scalar()
    return stamped.where(F.col("__f") == last).drop("__at", "__f")


def second_model(races: DataFrame, top: int = 5) -> DataFrame:
    """(comp, top): the leading runners of each race's nested predictions, best first."""
    rows = races.where(has_predictions()).select("comp", F.inline("predictions")).where(F.col("predicted_rank") <= top)
    leading = F.array_sort(F.collect_list(F.struct(F.col("predicted_rank").alias("r"), F.col("numero").alias("n"))))
    return rows.groupBy("comp").agg(F.transform(leading, lambda e: e["n"]).alias("top"))


def rank_maps(races: DataFrame) -> DataFrame:
    """Race rows with a map from runner number to predicted rank."""
    entries = F.transform("predictions", lambda p: F.struct(p["numero"], p["predicted_rank"]))
    return races.where(has_predictions()).select("comp", F.map_from_entries(entries).alias("ranks"))


def positions(results: DataFrame) -> DataFrame:
    """(comp, position, numero) of arrival arrays."""
    return explode_arrival(results, "ordre_arrivee", "comp")


def positions_of_orders(races: DataFrame, order: str = "actual_results") -> DataFrame:
    """(comp, position, numero) of order strings; later parts of a long order count on."""
    if "part" not in races.columns:
        return explode_order(races, order, "comp")
    rows = explode_order(races, order, "comp", "part")
    return rows.select("comp", (F.col("position") + F.col("part") * CHUNK).alias("position"), "numero")


def complete_orders(races: DataFrame, order: str = "actual_results", size: int = 5) -> DataFrame:
    """Races with a complete top five: sets of the first three, four and five."""
    if "part" in races.columns:
        races = races.where(F.col("part") == 0)
    numbers = F.filter(F.transform(order_array(F.col(order)), lambda t: t.try_cast("long")), lambda n: n > 0)
    leading = races.select("comp", F.slice(numbers, 1, size).alias("__o")).where(F.size("__o") == size)
    return leading.select("comp", *[F.slice("__o", 1, k).alias(f"top{k}") for k in range(3, size + 1)])


def recent(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the table's newest day."""
    newest = df.select(F.max(day)).scalar()
    return df.where(F.col(day) >= F.date_sub(newest, days))


def with_odds(rows: DataFrame, races: DataFrame, default: float = 5.0) -> DataFrame:
    """Prediction rows with race attributes and the runner's odds."""
    runners = races.select("comp", "typec", "dist", "partant", "hippo", F.explode("participants").alias("p"))
    odds = runners.select(
        "comp", "typec", "dist", "partant", "hippo", F.col("p.numero").alias("numero"), F.col("p.cotedirect").alias("cotedirect")
    )
    out = rows.join(odds, ["comp", "numero"], "left")
    return out.withColumn("cotedirect", F.coalesce("cotedirect", F.lit(float(default))))


def filtered(races: DataFrame, kinds: Sequence[str] = (), venues: Sequence[str] = (), dist=(None, None), field=(None, None), first=None, last=None) -> DataFrame:
    """Race filter of the weight analysis: type, venue, distance, field size, days."""
    out = between_days(races, "jour", first, last)
    if kinds:
        out = out.where(F.col("typec").isin(*kinds))
    if venues:
        out = out.where(F.col("hippo").isin(*venues))
    for column, (low, high) in (("dist", dist), ("partant", field)):
        if low is not None:
            out = out.where(F.col(column) >= low)
        if high is not None:
            out = out.where(F.col(column) <= high)
    return out


def prediction_days(stored: DataFrame, day: str = "race_date") -> DataFrame:
    return stored.select(day).distinct().orderBy(F.desc(day))


def result_or_prediction(race_row: DataFrame, predictions_row: DataFrame, *fields: str) -> DataFrame:
    """Race attributes, filled from the prediction table where the race lacks them."""
    other = predictions_row.select("comp", *[F.col(f).alias(f"__{f}") for f in fields])
    joined = race_row.join(other, "comp", "full")
    return joined.select("comp", *[F.coalesce(f, f"__{f}").alias(f) for f in fields])


def odds_document(documents: DataFrame, column: str = "participants") -> DataFrame:
    """(numero, direct odds, reference odds) of a market document's participants."""
    entry = documents.select(*[c for c in documents.columns if c != column], F.explode(column).alias("p"))
    return entry.select(
        *[c for c in documents.columns if c != column],
        F.col("p.numPmu").alias("numero"),
        F.col("p.dernierRapportDirect.rapport").alias("direct_odds"),
        F.col("p.dernierRapportReference.rapport").alias("reference_odds"),
    )


def exported_features(documents: DataFrame) -> DataFrame:
    """Flat feature rows of an export {races: [{race_id, hippo, date, X_features: [...]}]}."""
    races = documents.select(F.explode("races").alias("r"))
    rows = races.select(
        F.col("r.race_id").alias("_race_id"), F.col("r.hippo").alias("_hippo"), F.col("r.date").alias("_date"),
        F.explode("r.X_features").alias("x"),
    )
    return rows.select("_race_id", "_hippo", "_date", "x.*")


# --- Daily feed ---------------------------------------------------------------


def feed_race(feed: DataFrame) -> DataFrame:
    """One race row per ``comp`` from feed rows that each carry ``numcourse``."""
    race = feed.select("numcourse.*", *[c for c in feed.columns if c == "received_at"])
    number = lambda c, kind: F.col(c).try_cast("double").try_cast(kind).alias(c)
    rows = race.select(
        "comp",
        F.col("jour").try_cast("date").alias("jour"),
        *[clean_text(F.col(c)).alias(c) for c in ("hippo", "reun", "prix", "prixnom", "typec", "handi", "groupe", "natpis", "meteo", "corde")],
        number("partant", "int"),
        number("dist", "int"),
        number("cheque", "double"),
        F.lower(F.trim("quinte")).isin("1", "true").alias("quinte"),
        F.coalesce(F.when(F.trim("arriv") != "", F.trim("arriv")), F.lit(PENDING)).alias("actual_results"),
        *[c for c in race.columns if c == "received_at"],
    )
    order = [F.desc("received_at")] if "received_at" in rows.columns else []
    return first_per_key(rows, ["comp"], [*order, F.desc(F.col("actual_results") != PENDING), F.asc("prixnom")])


def in_country(races: DataFrame, venues: DataFrame, country: str = "FRA") -> DataFrame:
    """Races at venues of one country; the optimizer sizes the venue side."""
    local = venues.where(F.col("Pays") == country).select("hippo")
    return races.join(local, "hippo", "left_semi")


def fill_from(rows: DataFrame, supplement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill missing or blank fields from a supplementary document."""
    fields = [c for c in supplement.columns if c not in keys]
    other = supplement.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    types = dict(rows.dtypes)
    own = lambda f: F.when(F.trim(F.col(f)) != "", F.col(f)) if types.get(f) == "string" else F.col(f)
    joined = rows.join(other, list(keys), "left")
    return joined.select(
        *[F.coalesce(own(c), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in rows.columns],
        *[F.col(f"__{f}").alias(f) for f in fields if f not in rows.columns],
    )


def history_of_today(today: DataFrame, history: DataFrame, horse: str, order: Sequence[Column], k: int = 50) -> DataFrame:
    """Today's rows and the latest k earlier rows of the same horses, in one frame."""
    from ..operators.grouping import top_k

    earlier = history.join(today.select(horse).distinct(), horse, "left_semi")
    return today.withColumn("is_today", F.lit(1)).unionByName(
        top_k(earlier, [horse], order, k).withColumn("is_today", F.lit(0)), allowMissingColumns=True
    )


# --- Operational database and files ---------------------------------------------


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """Parallel read of one database table, cut into ranges of its key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
        numPartitions=str(parts), **options,
    )
    return reader.load()


def jdbc_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def race_runner_rows(races: DataFrame, runners: DataFrame, quinte_only: bool = False) -> DataFrame:
    """Race × runner rows of the operational tables."""
    chosen = races.where(F.col("quinte") == 1) if quinte_only else races
    clash = [c for c in runners.columns if c in races.columns and c != "comp"]
    return chosen.join(runners.drop(*clash), chosen["id"] == runners["comp"], "inner").drop(runners["comp"])


def split_race_runner(rows: DataFrame, race_fields: Sequence[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(race rows, runner rows) of joined rows."""
    race = first_per_key(rows.select(*race_fields), [key], [F.asc(c) for c in race_fields if c != key])
    return race, rows.select(key, *[c for c in rows.columns if c not in race_fields])


def read_predictions(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)
