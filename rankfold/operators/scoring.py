"""The scoring job: models, blend, adjustment, calibration and ranking of all races at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibration, failures, models
from .blending import blend, first_rule
from .evaluation import regression_metrics
from .grouping import as_grouping, row_number_within
from .nesting import order_strings


def score_races(
    rows: DataFrame,
    group,
    scorers: Mapping[str, tuple[PipelineModel, Sequence[str]]],
    rules: Sequence[Mapping],
    default: Mapping[str, float],
    numero: str = "numero",
    adjustment: str | None = None,
    corrections: DataFrame | None = None,
) -> DataFrame:
    """Runner rows with model scores, blend, final score and rank in the race.

    ``scorers`` maps a score name to a model and its columns; rules and default
    give the weights by score name. All races are scored in one job; the only
    shuffle of its own is the rank by race.
    """
    g = as_grouping(rows, group)
    for name, (model, columns) in scorers.items():
        rows = models.predict(model, rows, columns, f"{name}_prediction")
    weighted = first_rule(rows, rules, default)
    rows = weighted.withColumn("ensemble_prediction", blend({f"{n}_prediction": F.col(n) for n in scorers}))
    shift = F.lit(0.0) if adjustment is None else F.col(adjustment)
    rows = rows.withColumn("final_prediction", F.col("ensemble_prediction") * (1 + shift))
    if corrections is not None:
        rows = calibration.apply_corrections(rows, corrections, "final_prediction", "final_prediction")
    order = [F.col("final_prediction").asc_nulls_last(), F.col(numero).asc()]
    return row_number_within(rows, g, order, "predicted_rank").drop(*default, "rule_no")


def predicted_orders(scored: DataFrame, race: Sequence[str], numero: str = "numero") -> DataFrame:
    return order_strings(scored, race, "predicted_rank", numero, "predicted_arriv")


def training_rows(predictions: DataFrame, results: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Stored predictions with their known results; runner attributes are kept."""
    return predictions.join(results.select(*keys, F.col(position).alias("actual_position")), list(keys))


def incremental_refit(
    rows: DataFrame, race: str, columns: Sequence[str], score: str, rank: str, actual: str, odds: str, numero: str = "numero",
    day: str | None = None, days: int | None = None, **settings
) -> DataFrame:
    """Refit on failures: weights by failure, a weighted forest, errors before and after on held-out races.

    Both sides of the comparison are measured on the same test races; the paired
    comparison is in the columns of ``models.paired_gain``. With ``days`` only races of the
    last days before the newest ``day`` are used.
    """
    if days is not None:
        newest = rows.select(F.max(day)).scalar()
        rows = rows.where(F.col(day) > F.date_sub(newest, days))
    card = failures.analyze(rows, [race], numero, score, rank, actual, odds)
    weighted = failures.weighted_rows(rows, card, [race])
    split = models.race_split(weighted, race)
    train = split.where(F.col("split") == "train").withColumn(actual, F.col(actual).cast("double"))
    model = models.fit_forest(train, columns, actual, weight="failure_weight", **settings)
    tested = models.predict(model, split.where(F.col("split") == "test"), columns, "refit_prediction")
    side = lambda name, column: tested.agg(*[c.alias(n) for n, c in regression_metrics(column, actual).items()]).withColumn(
        "model", F.lit(name)
    )
    gain = models.paired_gain(tested, race, score, "refit_prediction", actual).select("gain", "gain_low", "gain_high", "significant", "certain")
    both = side("baseline", score).unionByName(side("refit", "refit_prediction"))
    judged = gain.withColumn("model", F.lit("refit"))
    return both.join(judged, "model", "left")


