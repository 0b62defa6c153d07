"""Snapshots, the ledger of processed versions and running totals, with failures in between."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rankfold.sources import tables
from rankfold.sources.snapshots import Snapshots
from rankfold.streaming import totals as totals_module
from rankfold.streaming.ledger import Ledger
from rankfold.streaming.totals import RunningTotals

DAY = date(2024, 1, 1)


# --- Snapshots ----------------------------------------------------------------------


def test_readers_see_the_old_rows_until_the_switch(spark, folder):
    table = Snapshots(spark, folder)
    assert table.read() is None
    table.write(spark.range(5))

    def broken(written):
        assert written.count() == 7 and table.read().count() == 5
        raise ValueError("no")

    with pytest.raises(ValueError):
        table.write(spark.range(7), [broken])
    assert table.read().count() == 5 and table.versions() == [1]
    table.write(spark.range(9).withColumn("more", F.lit("x")))
    assert table.read().columns == ["id", "more"] and table.read(1).count() == 5


def test_a_wrong_count_leaves_the_table(spark, folder, monkeypatch):
    tables.write_checked(spark.range(4), folder)
    whole = Snapshots.new_folder

    def half(self):  # rows that get lost between the write and the count
        out = whole(self)
        spark.range(3).write.parquet(out)
        return out

    monkeypatch.setattr(Snapshots, "new_folder", half)
    with pytest.raises(Exception):
        tables.write_checked(spark.range(6), folder)
    monkeypatch.undo()
    assert Snapshots(spark, folder).read().count() == 4


def test_old_data_go_and_other_writers_are_noticed(spark, folder):
    table = Snapshots(spark, folder, keep=2)
    for n in range(5):
        table.write(spark.range(n))
    assert table.versions() == [4, 5] and [table.read(v).count() for v in (4, 5)] == [3, 4]
    files, data = tables.file_system(spark, folder + "/data")
    assert len(files.listStatus(data)) == 2
    with pytest.raises(RuntimeError, match="meanwhile"):
        table.publish({"folders": []}, after=3)


# --- Ledger -------------------------------------------------------------------------


def deliveries():
    first = [(i, DAY + timedelta(days=i % 9), float(i)) for i in range(30) if i % 4]
    second = [*first, (100, DAY - timedelta(days=300), 1.0), (None, None, None)]  # a day long past, and nulls
    third = [(k, d, v if k != 6 else -1.0) for k, d, v in second] + [(4, DAY, 4.0)]
    return first, second, third


def test_late_days_and_corrections_are_processed_once(spark, folder):
    ledger, seen = Ledger(spark, folder, "comp bigint", slice_rows=8, fanout=2), []
    first, second, third = deliveries()
    for part in (first, second, second, third, first):
        df = spark.createDataFrame(part, "comp long, day date, value double")
        out = ledger.run(df, lambda rows: rows, [F.asc("value")])
        seen.append(sorted((r.comp for r in out.collect()), key=str))
    assert seen[0] == sorted((k for k, _, _ in first), key=str)
    assert seen[1:] == [[100, None], [], [4, 6], []]


def test_a_run_that_fails_is_repeated_whole(spark, folder):
    ledger, order = Ledger(spark, folder, "comp bigint"), [F.asc("value")]
    df = spark.createDataFrame(deliveries()[0], "comp long, day date, value double")

    def broken(rows):
        rows.write.mode("overwrite").parquet(folder + "/out")
        raise OSError("lost")

    with pytest.raises(OSError):
        ledger.run(df, broken, order)
    again = ledger.run(df, lambda rows: rows, order)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert ledger.run(df, lambda rows: rows, order).count() == 0


def test_a_record_without_its_commit_does_not_count(spark, folder, monkeypatch):
    ledger, order = Ledger(spark, folder, "comp bigint"), [F.asc("value")]
    df = spark.createDataFrame(deliveries()[0], "comp long, day date, value double")
    with monkeypatch.context() as m:
        m.setattr(ledger.index, "commit", lambda run: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.run(df, lambda rows: rows, order)
    assert ledger.fresh(df, order).count() == df.count()


def test_of_several_versions_in_a_delivery_the_first_in_order_counts(spark, folder):
    ledger = Ledger(spark, folder, "comp bigint")
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)], "comp long, delivered int, value double")
    out = ledger.run(df, lambda rows: rows, [F.desc("delivered")], F.col("delivered"))
    assert sorted(map(tuple, out.collect())) == [(1, 2, 6.0), (2, 1, 7.0)]


# --- Running totals -----------------------------------------------------------------

SCHEMA = "key long, user string, day date, value double, version int"


def totals_of(spark, folder, **options):
    return RunningTotals(spark, folder, "user", "day", {"n": F.lit(1), "total": F.col("value")}, **options)


def plain(records):
    out = defaultdict(lambda: [0, 0.0])
    for _, user, _, value, _ in records:
        out[user][0] += 1
        out[user][1] += value or 0.0
    return {u: (n, round(t, 6)) for u, (n, t) in out.items()}


def found(totals):
    return {r.user: (int(r.n), round(r.total, 6)) for r in totals.read().collect() if r.n}


def test_folders_stay_few_over_fifty_batches(spark, folder):
    totals, draw, records = totals_of(spark, folder), random.Random(2), []
    for number in range(50):
        batch = [(number, draw.choice(["a", "b", None]), DAY + timedelta(days=number // 7), draw.random(), 1) for _ in range(3)]
        records += batch
        totals.add(spark.createDataFrame(batch, SCHEMA), number)
        if number == 20:
            totals.add(spark.createDataFrame(batch, SCHEMA), number)  # the same batch again
        assert len(totals.folders()) <= 3 * 3
    assert found(totals) == plain(records)
    files, data = tables.file_system(spark, folder + "/sums/data")
    assert len(files.listStatus(data)) <= 2 * 3 * 3 + 2
    assert totals.per_day().count() == len({(u, d) for _, u, d, _, _ in records})


def test_corrections_replace_what_counted_before(spark, folder, monkeypatch):
    totals = totals_of(spark, folder, keys="key bigint", version=[F.desc("version")], fanout=2)
    draw, records = random.Random(7), {}
    for number in range(6):
        batch = [
            (draw.choice([None, *range(12)]), draw.choice("ab"), draw.choice([None, DAY, DAY + timedelta(days=1)]), draw.random(), draw.randint(1, 9))
            for _ in range(8)
        ]
        batch = list({r[0]: r for r in batch}.values())  # a key once per batch
        df = spark.createDataFrame(batch, SCHEMA)
        if number == 3:  # the sums are switched, the records are not written
            with monkeypatch.context() as m:
                m.setattr(totals_module, "upsert", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    totals.add(df, number)
        if number == 4:  # neither
            with monkeypatch.context() as m:
                m.setattr(totals.sums, "publish", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    totals.add(df, number)
        totals.add(df, number)
        for row in batch:
            if row[0] not in records or row[4] >= records[row[0]][4]:
                records[row[0]] = row
        assert found(totals) == plain(records.values())


def test_several_versions_of_a_key_in_one_batch(spark, folder):
    totals = totals_of(spark, folder, keys="key bigint", version=[F.desc("version")])
    totals.add(spark.createDataFrame([(1, "a", DAY, 1.0, 1), (1, "b", DAY, 5.0, 2), (2, "a", DAY, None, 1)], SCHEMA), 0)
    assert found(totals) == {"b": (1, 5.0), "a": (1, 0.0)}
