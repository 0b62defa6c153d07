"""Order strings such as '13-10-7' and bets settled on two orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING = "pending"


def order_array(column: Column) -> Column:
    """Array of runner numbers (text); empty for null, '' and 'pending'."""
    text = F.trim(column)
    known = text.isNotNull() & (text != "") & (F.lower(text) != PENDING)
    parts = F.transform(F.split(text, "-"), lambda p: F.trim(p))
    return F.when(known, parts).otherwise(F.array().cast("array<string>"))


def any_order(column: Column) -> Column:
    """Order array of a plain order string, a JSON list or a JSON arrival document.

    The document lists {narrivee, cheval}; only numeric arrivals count, by rank.
    """
    text = F.trim(column)
    arrivals = F.from_json(text, "array<struct<narrivee:string,cheval:string>>")
    ranked = F.array_sort(
        F.transform(
            F.filter(arrivals, lambda a: a["narrivee"].rlike("^[0-9]+$")),
            lambda a: F.struct(a["narrivee"].cast("int").alias("n"), a["cheval"].alias("c")),
        )
    )
    document = F.transform(ranked, lambda a: a["c"])
    listed = F.from_json(text, "array<string>")
    # Numeric places sort as numbers, so a document of any order reads the same.
    return (
        F.when(text.rlike(r"^\[\s*\{"), document)
        .when(text.startswith("["), listed)
        .otherwise(order_array(column))
    )


def explode_order(df: DataFrame, order: str, *keep: str) -> DataFrame:
    """(keep…, position, numero) rows; a bad entry is dropped but keeps its place."""
    entries = df.select(*keep, F.posexplode(order_array(F.col(order))).alias("__pos", "__entry"))
    number = F.col("__entry").try_cast("long")
    return entries.select(
        *keep, (F.col("__pos") + 1).cast("long").alias("position"), number.alias("numero")
    ).where(number > 0)


def explode_arrival(df: DataFrame, arrival: str, *keep: str) -> DataFrame:
    """(keep…, position, numero) rows of an arrival array; non-numeric finishes are dropped."""
    rows = df.select(*keep, F.explode(arrival).alias("__a"))
    return rows.where(F.col("__a.narrivee").rlike("^[0-9]+$")).select(
        *keep,
        F.col("__a.narrivee").cast("long").alias("position"),
        F.col("__a.cheval").cast("long").alias("numero"),
    )


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def bet_columns(pred: Column, actual: Column, definition: str = "first_correct") -> dict[str, Column]:
    """Win flags per bet for a predicted and an actual order array.

    ``first_correct``: the bonus bets need the winner plus the others in any order.
    ``overlap``: the bonus bets only need enough of the top five.
    """
    n_pred, n_actual = F.size(pred), F.size(actual)
    head = lambda a, n: F.slice(a, 1, n)
    part = lambda a, start, n: F.slice(a, start, n)
    both = lambda n: (n_pred >= n) & (n_actual >= n)
    exact = lambda n: both(n) & (head(pred, n) == head(actual, n))
    any_way = lambda n: both(n) & (F.sort_array(F.array_distinct(head(pred, n))) == F.sort_array(F.array_distinct(head(actual, n))))
    winner = F.get(pred, 0) == F.get(actual, 0)
    bets = {
        "tierce_exact": exact(3),
        "tierce_desordre": any_way(3),
        "quarte_exact": exact(4),
        "quarte_desordre": any_way(4),
        "quinte_exact": exact(5),
        "quinte_desordre": any_way(5),
        "deuxsur4": both(5) & (overlap(head(pred, 4), head(actual, 4)) >= 2),
    }
    if definition == "overlap":
        common = overlap(head(pred, 5), head(actual, 5))
        bets["bonus4"] = both(5) & (common >= 4)
        bets["bonus3"] = both(5) & (common >= 3)
        bets["multi4"] = both(5) & (overlap(head(pred, 4), head(actual, 5)) == 4)
    else:
        bets["bonus4"] = both(4) & winner & (overlap(part(pred, 2, 3), part(actual, 2, 3)) >= 3)
        bets["bonus3"] = both(5) & winner & (overlap(part(pred, 2, 2), part(actual, 2, 2)) >= 2)
        bets["multi4"] = both(5) & any_way(4)
    for picks in (6, 7):
        enough = (n_pred >= picks) & (n_actual >= 5)
        bets[f"quinte_{picks}horses"] = enough & (overlap(head(pred, picks), head(actual, 5)) == 5)
        rest = part(pred, 2, picks - 1)
        bets[f"bonus4_{picks}horses"] = enough & winner & (overlap(rest, part(actual, 2, 3)) >= 3)
        if picks == 7:
            bets["bonus3_7horses"] = enough & winner & (overlap(rest, part(actual, 2, 2)) >= 2)
    return {name: F.coalesce(won, F.lit(False)) for name, won in bets.items()}


def order_scores(pred: Column, actual: Column) -> dict[str, Column]:
    """Winner, podium share, exacta, trifecta and mean rank error of two orders."""
    n_pred, n_actual = F.size(pred), F.size(actual)
    podium = F.least(F.lit(3), n_pred, n_actual)
    enough = lambda n: (n_pred >= n) & (n_actual >= n)
    common = F.array_intersect(pred, actual)
    gaps = F.transform(
        common, lambda c: F.abs(F.array_position(pred, c) - F.array_position(actual, c)).cast("double")
    )
    return {
        "winner_correct": F.coalesce(F.get(pred, 0) == F.get(actual, 0), F.lit(False)),
        "podium_accuracy": F.when(podium > 0, overlap(F.slice(pred, 1, podium), F.slice(actual, 1, podium)) / podium)
        .otherwise(0.0),
        "exacta_correct": enough(2) & (F.slice(pred, 1, 2) == F.slice(actual, 1, 2)),
        "trifecta_correct": enough(3) & (F.slice(pred, 1, 3) == F.slice(actual, 1, 3)),
        "mean_rank_error": F.when(
            F.size(common) > 0, F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g) / F.size(common)
        ),
    }
