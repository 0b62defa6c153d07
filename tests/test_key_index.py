"""The key index and the upserts that use it, against plain dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from rankfold.sources import tables
from rankfold.sources.key_index import KeyIndex

SCHEMA = "comp long, numero int, year int, version int, price double"


def index_of(spark, folder, **options):
    return KeyIndex(spark, folder + "/index", "comp bigint, numero int", "year int", **{"slice_rows": 20, "fanout": 3, **options})


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_upserts_equal_a_dictionary(spark, folder):
    draw, want, index = random.Random(5), {}, index_of(spark, folder)
    for step in range(6):
        batch = {}
        for _ in range(25):
            key = (draw.choice([None, *range(step * 4, step * 4 + 30)]), draw.choice([1, 2, None]))
            batch[key] = (*key, draw.choice([None, 2001, 2002, 2003]), draw.randint(1, 12), draw.random())
        out = tables.upsert(frame(spark, list(batch.values())), folder + "/t", ["comp", "numero"], [F.desc("version")], "year", index=index)
        for key, row in batch.items():
            if key not in want or row[3] >= want[key][3]:
                want[key] = row
        got = [tuple(r) for r in out.select("comp", "numero", "year", "version", "price").collect()]
        assert sorted(got, key=repr) == sorted(want.values(), key=repr)
    assert len(index.runs()) <= 2 * 3 and max(index.committed().values()) >= 1


def test_every_key_is_found_and_few_slices_are_opened(spark, folder):
    index = index_of(spark, folder, slice_rows=100, fanout=99)
    rows = spark.range(2000).selectExpr("id * 2 as comp", "1 as numero", "cast(2000 + id % 5 as int) as year")
    index.commit(index.add(rows.where("comp < 2000")))
    index.commit(index.add(rows.where("comp >= 2000")))
    assert index.lookup(rows).count() == 2000
    few = rows.where("comp in (20, 22, 3000)")
    hits, touched = index.slices_of(few)
    assert hits.count() >= 3 and sum(map(len, touched.values())) <= 3
    assert sorted(tuple(r)[:3] for r in index.lookup(few).collect()) == [(20, 1, 2000), (22, 1, 2001), (3000, 1, 2000)]
    # Absent keys inside the zones are kept out by the filters, keys behind them by the zones.
    absent = spark.range(1000).selectExpr("id * 2 + 1 as comp", "1 as numero")
    assert index.slices_of(absent)[0].count() < 50
    assert index.slices_of(spark.range(9000, 9100).selectExpr("id as comp", "1 as numero"))[1] == {}


def test_a_failure_between_index_and_table(spark, folder, monkeypatch):
    index, path = index_of(spark, folder), folder + "/t"
    keys, version = ["comp", "numero"], [F.desc("version")]
    tables.upsert(frame(spark, [(i, 1, 2001, 1, 0.0) for i in range(10)]), path, keys, version, "year", index=index)
    second = frame(spark, [(3, 1, 2005, 2, 1.0), (50, 1, 2005, 2, 1.0)])

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "write_partitions", broken)
        with pytest.raises(OSError):
            tables.upsert(second, path, keys, version, "year", index=index)
    for i in range(4):  # merges must not forget where the row still lies
        tables.upsert(frame(spark, [(100 + i, 1, 2001, 1, 0.0)]), path, keys, version, "year", index=index)
    out = tables.upsert(second, path, keys, version, "year", index=index)
    assert [tuple(r) for r in out.where("comp = 3").collect()] == [(3, 1, 2, 1.0, 2005)]
    assert out.count() == 15


def test_an_index_of_a_stored_table(spark, folder):
    path, keys, version = folder + "/t", ["comp", "numero"], [F.desc("version")]
    tables.upsert(frame(spark, [(i, 1, 2001, 1, 0.0) for i in range(10)]), path, keys, version, "year")
    out = tables.upsert(frame(spark, [(4, 1, None, 2, 0.0)]), path, keys, version, "year", index=index_of(spark, folder))
    assert sorted((r.comp, r.year) for r in out.collect() if r.comp in (3, 4)) == [(3, 2001), (4, None)]


def test_empty_batches_and_history(spark, folder):
    index = index_of(spark, folder, history=True, fanout=2)
    assert index.lookup(frame(spark, [(1, 1, 1, 1, 1.0)])).count() == 0
    index.commit(index.add(frame(spark, [])))
    for year in (2001, 2002, 2001, 2003):
        index.commit(index.add(frame(spark, [(1, 1, year, 1, 1.0)])))
    assert {r.year for r in index.lookup(frame(spark, [(1, 1, None, 1, 1.0)])).collect()} == {2001, 2002, 2003}
    index.add(frame(spark, [(1, 1, 2009, 1, 1.0)]))
    some = frame(spark, [(1, 1, None, 1, 1.0)])
    assert {r.year for r in index.lookup(some, committed_only=True).collect()} == {2001, 2002, 2003}
    assert 2009 in {r.year for r in index.lookup(some).collect()}
