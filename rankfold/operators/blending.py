"""Blending of several predicted scores, weight rules and weight search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import Grouping, as_grouping, input_bytes, row_number_within

# Performance factors by recent mean absolute error.
GOOD_MAE, FAIR_MAE, POOR_MAE = 5.0, 6.0, 8.0
GOOD_FACTOR, FAIR_FACTOR, POOR_FACTOR = 1.3, 1.1, 0.7
WEIGHTED_BYTES = 16 << 20  # input times weights that one task of a weight search sorts


def check_weights(weights: Mapping[str, float], must_sum_to_one: bool = False) -> None:
    if not weights:
        raise ValueError("no weights given")
    for name, weight in weights.items():
        if weight < 0:
            raise ValueError(f"weight of {name} is negative: {weight}")
    if must_sum_to_one and abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"weights sum to {sum(weights.values())}, not 1")


def blend(scores: Mapping[str, Column | float]) -> Column:
    """Weighted mean of score columns; missing scores drop out, all-zero weights mean equal weights.

    ``scores`` maps a score column name to its weight (number or column).
    """
    numeric = [w for w in scores.values() if not isinstance(w, Column)]
    check_weights({str(i): w for i, w in enumerate(numeric)} or {"columns": 1.0})
    weight = {
        name: F.when(F.col(name).isNotNull(), w if isinstance(w, Column) else F.lit(float(w))).otherwise(0.0)
        for name, w in scores.items()
    }
    add = lambda items: reduce(lambda a, b: a + b, items)
    total = add(list(weight.values()))
    weighted = add([F.coalesce(F.col(name), F.lit(0.0)) * w for name, w in weight.items()])
    present = add([F.col(name).isNotNull().cast("double") for name in scores])
    equal = add([F.coalesce(F.col(name), F.lit(0.0)) for name in scores])
    return F.when(total > 0, weighted / total).when(present > 0, equal / present)


def blend_fixed(tree: str, neural: str, tree_weight: float = 0.6) -> Column:
    """Two-model blend with fixed weights; a missing side leaves the other alone."""
    both = F.col(tree) * tree_weight + F.col(neural) * (1 - tree_weight)
    return F.coalesce(both, F.col(tree), F.col(neural))


def condition_column(condition: Mapping[str, object], columns: Sequence[str]) -> Column:
    """Predicate of a rule condition: ``x_min``, ``x_max`` and equality; a missing field never matches."""
    out = F.lit(True)
    for key, value in condition.items():
        field, kind = (key[:-4], key[-3:]) if key.endswith(("_min", "_max")) else (key, "is")
        if field not in columns:
            return F.lit(False)
        if kind == "min":
            test = F.col(field) >= value
        elif kind == "max":
            test = F.col(field) <= value
        elif isinstance(value, (list, tuple)):
            test = F.col(field).isin(*value)
        else:
            test = F.col(field) == value
        out = out & F.coalesce(test, F.lit(False))
    return out


def first_rule(races: DataFrame, rules: Sequence[Mapping], default: Mapping[str, float]) -> DataFrame:
    """Add the weights of the first matching rule (``rule_no`` from 1; 0 = default)."""
    check_weights(default)
    number, out = F.lit(0), {name: F.lit(float(w)) for name, w in default.items()}
    for i, rule in reversed(list(enumerate(rules, 1))):
        check_weights(rule["weights"])
        match = condition_column(rule["condition"], races.columns)
        number = F.when(match, i).otherwise(number)
        out = {name: F.when(match, F.lit(float(rule["weights"].get(name, 0.0)))).otherwise(w) for name, w in out.items()}
    return races.select("*", number.alias("rule_no"), *[w.alias(name) for name, w in out.items()])


def all_rules(races: DataFrame, rules: Sequence[Mapping], include_all: bool = False) -> DataFrame:
    """One row per race and matching rule with its weights and accuracy.

    The rules are a short list known at plan time, so matching stays inside the
    scan stage: an array of matching rules is exploded.
    """
    names = sorted({n for rule in rules for n in rule["weights"]})
    entries = []
    for i, rule in enumerate(rules, 1):
        check_weights(rule["weights"])
        match = F.lit(True) if include_all else condition_column(rule["condition"], races.columns)
        accuracy = rule.get("accuracy")
        entry = F.struct(
            F.lit(i).alias("rule_no"),
            *[F.lit(float(rule["weights"].get(n, 0.0))).alias(n) for n in names],
            F.lit(None if accuracy is None else float(accuracy)).cast("double").alias("accuracy"),
        )
        entries.append(F.when(match, entry))
    matching = races.withColumn("__rule", F.explode(F.array_compact(F.array(*entries))))
    return matching.select("*", "__rule.*").drop("__rule")


def adaptive_weights(base: Mapping[str, float], distance: str, race_type: str, field_size: str) -> dict[str, Column]:
    """Weights scaled by the race: distance, type and field size."""
    one = F.lit(1.0)
    long_run, sprint = F.col(distance) > 2000, F.col(distance) < 1200
    crowd, trot = F.col(field_size) > 16, F.col(race_type) == "T"
    # The factors per model family.
    factors = {
        "lstm": F.when(long_run, 1.2).otherwise(1.0),
        "transformer": F.when(long_run, 1.3).otherwise(1.0) * F.when(crowd, 1.2).otherwise(1.0),
        "rf": F.when(sprint, 1.2).otherwise(1.0),
        "ensemble": F.when(trot, 1.2).otherwise(1.0) * F.when(crowd, 1.3).otherwise(1.0),
    }
    return {name: F.lit(float(w)) * factors.get(name, one) for name, w in base.items()}


def performance_factor(mae: Column) -> Column:
    return (
        F.when(mae < GOOD_MAE, GOOD_FACTOR)
        .when(mae < FAIR_MAE, FAIR_FACTOR)
        .when(mae > POOR_MAE, POOR_FACTOR)
        .otherwise(1.0)
    )


def shift_to_alternatives(
    base: Mapping[str, float], legacy: Sequence[str], enabled: Sequence[str], total: float = 0.3
) -> dict[str, float]:
    """Move ``total`` weight from the legacy models to the enabled ones."""
    if not enabled:
        return dict(base)
    held = sum(base[m] for m in legacy if m in base)
    kept = 1 - total / held
    out = {m: (w * kept if m in legacy else w) for m, w in base.items()}
    out.update({m: total / len(enabled) for m in enabled})
    return out


def weight_steps(step: float) -> list[float]:
    n = round(1 / step)
    return [round(i / n, 10) for i in range(n + 1)]


def under_weights(df: DataFrame, group, weights: Sequence[float], score: Column, order: Sequence[Column]):
    """Every row under every weight: (frame, grouping).

    Adds ``weight``, ``score`` (a column that may use ``weight``) and the rank
    ``predicted_rank`` by ``order`` inside (race, weight). The rows travel once, by race; the weights
    multiply them after the shuffle, so the parts are counted by the size after that.
    """
    g = as_grouping(df, group)
    grid = F.array(*[F.lit(float(w)) for w in weights])
    each = lambda rows: rows.withColumn("weight", F.explode(grid)).withColumn("score", score)
    plain, hot = (df, None) if g.hot is None else g.split(df)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) * len(weights) // WEIGHTED_BYTES))
    ranked = row_number_within(each(plain.repartition(parts, *g.keys)), Grouping(g.keys + ("weight",)), order, "predicted_rank")
    if hot is None:
        return ranked, Grouping(g.keys + ("weight",))
    finer = Grouping(g.keys + ("weight",), g.hot.withColumn("weight", F.explode(grid)))
    return ranked.unionByName(row_number_within(each(hot), finer, order, "predicted_rank")), finer


def over_weights(df: DataFrame, group, first: str, second: str, weights: Sequence[float], tie_break: Sequence[str]):
    """Every row under every weight of the first score, ranked as by :func:`under_weights`."""
    score = F.col(first) * F.col("weight") + F.col(second) * (1 - F.col("weight"))
    order = [F.col("score").asc_nulls_last(), *[F.col(c).asc() for c in tie_break]]
    return under_weights(df, group, weights, score, order)


def weight_results(
    ranked: DataFrame, race: Sequence[str], numero: str, position: str, by: Sequence[str] = (), min_podium: int = 3
) -> DataFrame:
    """Hit rates and rank errors per weight (and per ``by`` columns)."""
    rank, pos, error = F.col("predicted_rank"), F.col(position), F.abs(F.col("predicted_rank") - F.col(position))
    per_race = ranked.groupBy(*race, "weight", *by).agg(
        F.max(F.when((rank == 1) & (pos == 1), 1).otherwise(0)).alias("win"),
        F.count(F.when((rank <= 3) & (pos <= 3), 1)).alias("podium"),
        F.count(F.when(pos <= 3, 1)).alias("placed"),
        F.count(F.when((rank <= 5) & (pos <= 5), 1)).alias("in5"),
        F.count(F.when((rank <= 5) & (pos <= 4), 1)).alias("in4"),
        F.count(F.when((rank <= 5) & (pos <= 3), 1)).alias("in3"),
        F.sum(error).alias("err"),
        F.sum(error * error).alias("err2"),
        F.count(error).alias("n"),
    )
    enough = F.col("placed") >= 3 if min_podium == 3 else F.lit(True)
    return per_race.groupBy("weight", *by).agg(
        F.avg("win").alias("winner_accuracy"),
        F.avg(F.when((F.col("podium") >= min_podium) & enough, 1).otherwise(0)).alias("podium_accuracy"),
        F.try_divide(F.sum("err"), F.sum("n")).alias("mae"),
        F.sqrt(F.try_divide(F.sum("err2"), F.sum("n"))).alias("rmse"),
        F.count(F.when(F.col("in5") == 5, 1)).alias("quinte_desordre"),
        F.count(F.when(F.col("in4") == 4, 1)).alias("bonus4"),
        F.count(F.when(F.col("in3") == 3, 1)).alias("bonus3"),
        F.count(F.lit(1)).alias("total_races"),
    )


def best_weight(results: DataFrame, by: Sequence[str] = (), value: str = "winner_accuracy") -> DataFrame:
    """Row of the best weight per group; ties go to the smaller weight."""
    pick = F.max_by(F.struct("weight", value, "total_races"), F.struct(F.round(value, 9), -F.col("weight")))
    rows = results.groupBy(*by).agg(pick.alias("__best"))
    return rows.select(*by, "__best.*")


def weight_patterns(
    results: DataFrame, overall: DataFrame, by: Sequence[str], min_races: int = 10, min_shift: float = 0.2, min_gain: float = 0.05
) -> DataFrame:
    """Groups whose best weight differs from the overall best or clearly gains."""
    best = best_weight(overall).select(F.struct("weight", "winner_accuracy")).scalar()
    found = best_weight(results, by).withColumn("__all", best)
    shift = F.round(F.abs(F.col("weight") - F.col("__all.weight")), 9)
    gain = F.col("winner_accuracy") - F.col("__all.winner_accuracy")
    return found.where((F.col("total_races") >= min_races) & ((shift >= min_shift) | (gain > min_gain))).select(
        *by,
        F.col("weight").alias("optimal_weight"),
        "winner_accuracy",
        gain.alias("improvement_vs_overall"),
        "total_races",
        F.when(shift >= min_shift, "own_weight").otherwise("overall_weight").alias("recommendation"),
    )
