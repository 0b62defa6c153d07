"""Registered queries against their SQL on the smallest data folder."""

import glob
import os
import sys

import duckdb
import pytest
from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import table_rows  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# RANKFOLD_ALL_QUERIES=1 runs all of them; tools/check_oracle.py does so on any folder.
SHORT = [
    "flagship_event_scorecard", "nested_explode_roundtrip", "asof_career_totals", "asof_hit_rates_and_recency",
    "previous_five_sequence", "form_string_stats", "career_ratios", "equipment_change_flags", "clean_and_default",
    "impute_by_hierarchy", "weight_grid_by_group", "best_weight_patterns", "bet_outcomes", "spearman_by_event",
    "bias_by_bucket", "apply_calibration", "failure_patterns", "column_audit", "composite_adjustment",
    "upsert_latest_wins", "stream_results_join", "stream_latest_wins", "feature_selector",
]
CHOSEN = sorted(SQL) if os.environ.get("RANKFOLD_ALL_QUERIES") else SHORT


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = table_rows([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(SQL[name])
    assert got == table_rows(result.fetchall(), [d[0] for d in result.description])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_ranks_are_complete(spark):
    from pyspark.sql import functions as F

    from rankfold.plans.scorecard import ranked_runners

    ranked, _ = ranked_runners(spark, SF)
    bad = ranked.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("m"), F.count_distinct("rank").alias("d"))
    assert bad.where("n <> m OR n <> d").count() == 0
