"""Hand-computed values of the worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from rankfold.functions.families import Fields, shoeing, with_families
from rankfold.functions.form import flatten_stats, form_runs, with_form_stats
from rankfold.functions.numbers import bucket, clamp, earnings_quality, money, number_or_code, rail_code, safe_divide
from rankfold.functions.orders import any_order, bet_columns, explode_arrival, explode_order, order_array, order_scores
from rankfold.functions.text import discipline_code, handicap_columns, handicap_label, race_time_millis, race_time_seconds
from rankfold.operators import cleaning, failures, performance


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def stats(spark, form, kind):
    df = spark.createDataFrame([(form, kind)], "form string, kind string")
    return flatten_stats(with_form_stats(df, "form", "kind", "che"), "che").first().asDict()


def test_form_statistics(spark):
    got = stats(spark, "1A 2A DA 3A 4A", "A")
    for prefix in ("che_global", "che_bytype"):
        assert got[f"{prefix}_avg_pos"] == 2.5
        assert got[f"{prefix}_recent_perf"] == 3.0
        assert math.isclose(got[f"{prefix}_consistency"], math.sqrt(1.25))
        assert got[f"{prefix}_trend"] == 2.0
        assert got[f"{prefix}_pct_top3"] == 0.75
        assert got[f"{prefix}_nb_courses"] == 4
        assert got[f"{prefix}_total_races"] == 5
        assert got[f"{prefix}_dnf_rate"] == 0.2
    assert got["che_weighted_avg_pos"] == 2.5 and math.isclose(got["che_weighted_pct_top3"], 0.75)


def test_form_year_mark_and_disciplines(spark):
    form = "(23) 3m 7m 3m 5m 3m Dm 5m 6m 4m 3m 5m Da Da"
    got = stats(spark, form, "M")
    assert got["che_global_total_races"] == 13 and got["che_global_nb_courses"] == 10
    assert got["che_bytype_nb_courses"] == 10 and got["che_bytype_total_races"] == 11
    other = stats(spark, form, "A")
    assert other["che_bytype_nb_courses"] == 0 and other["che_bytype_dnf_rate"] == 0.0


@pytest.mark.parametrize("form, rate, n", [("DA DP DI", 1.0, 0), ("DA NP 1A 2A", 0.5, 2), ("", 0.0, 0), (None, 0.0, 0)])
def test_form_unfinished(spark, form, rate, n):
    got = stats(spark, form, "A")
    assert got["che_global_dnf_rate"] == rate and got["che_global_nb_courses"] == n


def test_form_order_and_year_flag(spark):
    df = spark.createDataFrame([("(23) 1A 2A",)], "f string")
    places = lambda **k: [r["place"] for r in df.select(form_runs(F.col("f"), **k).alias("r")).first()["r"]]
    assert places() == [2, 1]
    assert places(newest_first=False, keep_year_marks=True) == [23, 1, 2]


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, (False, False, 0, 0)),
        ("Course normale", (False, False, 0, 0)),
        ("Handicap", (True, False, 0, 650)),
        ("Handicap divisé - première épreuve", (True, False, 1, 700)),
        ("Handicap divisé - deuxième épreuve", (True, False, 2, 600)),
        ("Handicap divisé - troisième épreuve", (True, False, 3, 550)),
        ("Handicap divisé - quatrième épreuve", (True, False, 4, 525)),
        ("Handicap de Catégorie", (True, True, 0, 1150)),
        ("Handicap de Catégorie divisé - première épreuve", (True, True, 1, 1200)),
        ("Handicap de Catégorie divisé - quatrième épreuve", (True, True, 4, 1025)),
    ],
)
def test_handicap_texts(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(*[c.alias(n) for n, c in handicap_columns(F.col("t")).items()]).first()
    assert tuple(row) == expected


def test_handicap_labels(spark):
    labels = [one(spark, handicap_label, s, "int") for s in (1200, 1050, 650, 0)]
    assert labels == [
        "Category Handicap - Premier Division", "Category Handicap - Undivided", "Standard Handicap - Undivided", "Non-Handicap Race",
    ]


@pytest.mark.parametrize(
    "text, seconds",
    [("2'42\"53", 162.53), ("3'19\"52", 199.52), ("2:42.53", 162.53), ("2.42.53", 162.53), ("x", None), ("", None), (None, None), ("N/A", None)],
)
def test_race_times(spark, text, seconds):
    got = one(spark, race_time_seconds, text)
    assert got == seconds if seconds is None else math.isclose(got, seconds)


def test_record_readings(spark):
    assert one(spark, race_time_millis, "1'29\"4") == 89_040
    assert one(spark, lambda c: race_time_millis(c, "tenths"), "1'29\"4") == 89_400


@pytest.mark.parametrize(
    "text, value", [("DAI", 15.0), (" arr", 16.0), ("tombe", 17.0), ("NP", 18.0), ("xx", 12.0), ("", 0.0), (None, 0.0), ("4", 4.0)]
)
def test_number_or_code(spark, text, value):
    assert one(spark, number_or_code, text) == value


def test_small_helpers(spark):
    assert one(spark, rail_code, "Gauche") == -1 and one(spark, rail_code, "7") == 7 and one(spark, rail_code, None) == 0
    assert one(spark, money, "12 500,5") == 125005.0
    assert one(spark, lambda c: safe_divide(c, F.lit(0.0), 9.0), 1.0, "double") == 9.0
    assert one(spark, lambda c: clamp(c, 0, 1), None, "double") is None
    assert one(spark, lambda c: bucket(c, [0, 3, 5], ["a", "b"]), 3.0, "double") == "a"
    assert one(spark, lambda c: bucket(c, [0, 3, 5], ["a", "b"]), 0.0, "double") is None
    assert one(spark, lambda c: bucket(c, [0, 3, 5], ["a", "b"], right_closed=False), 3.0, "double") == "b"
    quality = lambda g, n: spark.range(1).select(earnings_quality(F.lit(g), F.lit(n))).first()[0]
    assert quality(5.0, 0.0) == 0.0 and quality(5e9, 1.0) == 1.0 and quality(-5.0, 2.0) == 0.0


def test_discipline(spark):
    assert [one(spark, discipline_code, t) for t in ("Attelé", "haies", "c", "Galop")] == ["A", "H", "C", None]
    with pytest.raises(Exception, match="unknown race type"):
        one(spark, lambda c: discipline_code(c, strict=True), "Galop")


def test_order_strings(spark):
    df = spark.createDataFrame([(1, "7-3-x-1"), (2, "pending"), (3, ""), (4, None), (5, " 4 - 0 - 2 ")], "comp int, o string")
    got = sorted(tuple(r) for r in explode_order(df, "o", "comp").collect())
    # A bad entry is dropped but keeps its place.
    assert got == [(1, 1, 7), (1, 2, 3), (1, 4, 1), (5, 1, 4), (5, 3, 2)]


def test_result_formats(spark):
    document = '[{"narrivee":"2","cheval":"9"},{"narrivee":"1","cheval":"4"},{"narrivee":"DAI","cheval":"5"}]'
    texts = ["4-9", '["4","9"]', document]
    assert [one(spark, any_order, t) for t in texts] == [["4", "9"]] * 3


def test_arrival_arrays(spark):
    df = spark.createDataFrame(
        [("a", [("1", 4, 10), ("DAI", 5, 11), ("2", 9, 12)])], "comp string, o array<struct<narrivee:string,cheval:int,idche:bigint>>"
    )
    assert sorted(tuple(r) for r in explode_arrival(df, "o", "comp").collect()) == [("a", 1, 4), ("a", 2, 9)]


def bets(spark, pred, actual, definition="first_correct"):
    df = spark.createDataFrame([(pred, actual)], "p string, a string")
    df = df.select(order_array(F.col("p")).alias("p"), order_array(F.col("a")).alias("a"))
    columns = {**bet_columns(F.col("p"), F.col("a"), definition), **order_scores(F.col("p"), F.col("a"))}
    return df.select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_bets(spark):
    got = bets(spark, "1-2-3-4-5-6-7", "1-3-2-4-5")
    assert got["winner_correct"] and not got["tierce_exact"] and got["tierce_desordre"] and got["quinte_desordre"]
    assert got["bonus4"] and got["bonus3"] and got["multi4"] and got["deuxsur4"] and got["quinte_6horses"]
    assert got["podium_accuracy"] == 1.0 and math.isclose(got["mean_rank_error"], 2 / 5)
    short = bets(spark, "1-2", "1-2")
    assert short["exacta_correct"] and not short["trifecta_correct"] and not short["tierce_exact"]


def test_bet_definitions_differ(spark):
    first = bets(spark, "2-1-3-4-9", "1-2-3-4-5")
    over = bets(spark, "2-1-3-4-9", "1-2-3-4-5", "overlap")
    assert not first["bonus4"] and over["bonus4"] and over["bonus3"] and over["multi4"]


def test_failure_example(spark):
    odds = {13: 9.0, 10: 25.0, 7: 3.0, 1: 2.0, 8: 8.0, 3: 4.0, 4: 6.0, 2: 12.0, 5: 30.0}
    order = [13, 10, 7, 1, 8, 3, 4, 2]
    data = [
        ("r", n, float(i + 1), i + 1 if n in range(1, 6) else 10 + i, order.index(n) + 1 if n in order else None, odds[n])
        for i, n in enumerate([1, 2, 3, 4, 5, 7, 8, 10, 13])
    ]
    df = spark.createDataFrame(data, "race string, numero int, score double, rank int, actual int, odds double")
    row = failures.analyze(df, ["race"], "numero", "score", "rank", "actual", "odds").first()
    assert row["overlap"] == 1 and row["failure_type"] == "quinte_desordre_miss"
    assert row["missed_horses"] == [7, 8, 10, 13] and row["false_positives"] == [2, 3, 4, 5]
    assert row["missed_favorite"] and row["missed_longshot"] and row["over_weighted_favorite"]


def test_suggestions_example(spark):
    row = {
        "total_failures": 20, "missed_favorites_pct": 45.0, "missed_longshots_pct": 25.0, "over_weighted_favorites_pct": 35.0,
    }
    summary = spark.createDataFrame([tuple(row.values())], list(row))
    got = failures.weight_change(summary).first()
    assert math.isclose(got["adjustment"], -0.15) and math.isclose(got["suggested_weight"], 0.15)


def test_pair_example(spark):
    df = spark.createDataFrame(
        [(101, 201, 1), (102, 202, 3), (101, 201, 2), (103, 203, 5), (102, 202, 4), (101, 201, 1)], "h long, j long, p int"
    )
    got = {r["h"]: r for r in performance.pair_stats(df, "h", "j", "p").collect()}
    assert (got[101]["races_total"], got[101]["wins"], got[101]["places"]) == (3, 2, 3)


def test_shoeing_changes(spark):
    df = spark.createDataFrame([("FF", "DD", "0"), ("DD", "FF", None), ("", "", "1")], "defoeil string, defoeilPrec string, defFirstTime string")
    got = [r.asDict() for r in with_families(df, shoeing).collect()]
    assert [r["barefoot_to_shod"] for r in got] == [1.0, 0.0, 0.0]
    assert [r["major_shoeing_change"] for r in got] == [1.0, 1.0, 1.0]
    assert got[0]["shoeing_complexity"] == 3.0


def test_protected_fields_are_kept(spark):
    df = spark.createDataFrame([(3.0,), (None,)], "recence double")
    out = with_families(df, lambda r: {"recence": F.lit(9.0)})
    assert sorted(r[0] for r in out.collect()) == [3.0, 9.0]


def test_absent_fields_read_as_missing(spark):
    df = spark.range(1)
    assert df.select(Fields(df).num("age", 5.0), Fields(df).text("oeil")).first() == (5.0, "")


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame(
        [("DAI", "Dupont", " ", "1'29\"40", None), (None, "0", "O", None, 4.0)],
        "derniereplace string, dernierEnt string, oeil string, recordG string, age double",
    )
    once = cleaning.clean(df)
    assert once.collect() == cleaning.clean(once).collect()
    assert once.first().asDict() == {"derniereplace": "15.0", "dernierEnt": "0", "oeil": "", "recordG": 89400.0, "age": 0.0}


def test_align_columns(spark):
    df = spark.createDataFrame([("2", None)], "a string, b double")
    assert cleaning.align_columns(df, ["b", "a", "c"], 0.6).first().asDict() == {"b": 0.0, "a": 2.0, "c": 0.0}
    with pytest.raises(ValueError, match="33%"):
        cleaning.align_columns(df, ["a", "x", "y"])


def test_result_numbers(spark):
    df = spark.createDataFrame([("3",), ("DAI",), ("RET",), ("NP",), ("??",), ("",), (None,)], "r string")
    got = [r["n"] for r in cleaning.result_numbers(df, "r", "n").collect()]
    assert got == [3.0, 13.0, 23.0, 33.0, 43.0, 53.0, 53.0]
    assert cleaning.result_numbers(df, "r", "n", drop_empty=True).count() == 5


def test_model_ready(spark):
    data = [(float(i), "x" if i % 2 else None, str(i), "7" if i else None) for i in range(10)]
    df = spark.createDataFrame(data, "a double, corde string, n string, m string")
    out = cleaning.model_ready(df, drop=[], codes=["corde"])
    assert set(out.columns) == {"a", "n", "m", "corde_code"}
    assert out.where(F.col("m").isNull()).count() == 0
