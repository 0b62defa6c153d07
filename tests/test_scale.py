"""Steps whose cost must not grow faster than the input."""

from conftest import SF, rows
from pyspark.sql import functions as F

from rankfold.functions import families
from rankfold.operators import grouping
from rankfold.operators.grouping import Grouping
from rankfold.operators.nesting import parse_nested, unnest
from rankfold.sources import key_index, tables


def test_fields_are_read_once(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    df = spark.createDataFrame([("gauche", "7", "DAI"), ("nowhere", "inf", "x"), (None, "", None)], "corde string, dernierecorde string, derniereplace string")
    out = families.with_families(df, families.last_race_comparison, families.last_race)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("TOMBE") == 2  # one reading per default, however many features use the place
    got = rows(out.select("corde_change", "last_race_position", "last_race_position_normalized", "last_race_won"))
    assert got == [(-8.0, 15.0, 1.4, 0.0), (float("-inf"), 12.0, 1.1, 0.0), (0.0, 0.0, 0.9, 0.0)]


def test_documents_are_made_once(spark, monkeypatch):
    from rankfold.plans import selections

    plans, upsert = [], tables.upsert

    def seen(new, *args, **kwargs):
        plans.append(new._jdf.queryExecution().optimizedPlan().toString())
        return upsert(new, *args, **kwargs)

    monkeypatch.setattr(tables, "upsert", seen)
    assert selections.stored_documents(spark, SF).where("version = 2").count() > 0
    assert len(plans) == 2 and not any("Window" in p or "Join" in p for p in plans)


def test_bulk_lookup_probes_no_filter(spark, folder, monkeypatch):
    monkeypatch.setattr(key_index, "MANY_KEYS", 50)
    index = key_index.KeyIndex(spark, f"{folder}/index", "k bigint", "v int", slice_rows=100)
    index.commit(index.add(spark.range(0, 400, 2).selectExpr("id AS k", "cast(id % 7 AS int) AS v")))
    kinds, read = [], index._read
    monkeypatch.setattr(index, "_read", lambda kind, *args: kinds.append(kind) or read(kind, *args))
    got = index.lookup(spark.range(400).selectExpr("id AS k"))
    assert rows(got.select("k", "v")) == sorted([(k, k % 7) for k in range(0, 400, 2)], key=lambda r: (str(r[0]), str(r[1])))
    assert "filters" not in kinds
    # The first slice is asked for many keys, the last for one.
    mixed = index.lookup(spark.range(60).union(spark.range(398, 400)).selectExpr("id AS k"))
    assert mixed.count() == 31 and "filters" in kinds


def test_feed_objects_are_parsed_once(spark):
    texts = [('{"n": 1, "t": "a"}',), ('{"participants": [{"n": 2}]}',), ('[{"n": 3}]',), ('{"participants": 5, "n": 4}',), ("x",), (None,)]
    out = parse_nested(spark.createDataFrame(texts, "d string"), "d", "n:bigint,t:string")
    assert [None if r.d is None else [e.n for e in r.d] for r in out.collect()] == [[1], [2], [3], [4], None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2  # a list, or an object of either shape


def test_parsed_arrays_are_not_parsed_in_a_join_below(spark):
    """A plain explode has the join ask for arrays with entries, which parses each text several times."""
    left = spark.createDataFrame([(1, '[{"a": 1}, null, {"a": 2}]'), (2, "[]"), (3, None), (4, '{"a": 4}')], "id int, text string")
    joined = left.join(spark.range(9).withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id", F.concat("text", F.repeat(F.lit(" "), F.col("other").cast("int"))).alias("text"))
    out = unnest(parse_nested(joined, "text", "a int"), "text", computed=True)
    assert sorted(tuple(r) for r in out.select("id", F.coalesce("a", F.lit(0))).collect()) == [(1, 0), (1, 1), (1, 2), (4, 4)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join" in line and "from_json" in line]


def test_keys_of_ordinary_groups_are_not_counted(spark, monkeypatch):
    """Only keys whose bucket is filled are counted; hot keys, a null one too, are found however keys share buckets."""
    df = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.col("id") % 100).alias("k"))  # 100 null keys, 75 keys of 4 rows
    counted = []
    monkeypatch.setattr(grouping, "reliable_checkpoint", lambda df: counted.append(df) or df.localCheckpoint())
    assert Grouping.measure(df.where("k is not null"), "k", max_rows=50).hot is None and not counted
    for buckets, listed in ((1, 1000), (1 << 16, 1000), (1 << 16, 0)):
        monkeypatch.setattr(grouping, "KEY_BUCKETS", buckets)
        monkeypatch.setattr(grouping, "LISTED_BUCKETS", listed)
        assert rows(Grouping.measure(df, "k", max_rows=50).hot) == [(None,)]
    assert Grouping.measure(df, "k", max_rows=3).hot.count() == 76
    assert counted


def test_the_shuffle_by_horse_carries_nothing_twice(spark):
    from rankfold.plans.models import all_features

    plan = all_features(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    by_horse = next(plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning(horse_id" in line)
    assert "price#" in by_horse and "pred_b#" not in by_horse and "coalesce(price" not in by_horse
