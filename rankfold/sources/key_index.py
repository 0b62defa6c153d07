"""A stored index from keys to values, such as the partition that holds a key's row.

A write adds one run: entries sorted by key and cut into slices, a zone (least and greatest
key) and a Bloom filter per slice. A lookup opens the slices whose zone and filter admit one
of its keys, so a day's new races open none and a correction opens the slices that hold it.
Runs are merged level by level, so their number is logarithmic in the number of writes.

One writer at a time. A run counts once its success file is there; it is committed once the
data it describes are written, too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.grouping import join_on
from .tables import file_system, stage_path

SLICE_ROWS = 1_000_000
FANOUT = 4
HASHES = 4
BITS_PER_KEY = 10
MANY_KEYS = 10_000  # a filter admits one of so many keys almost surely, though it holds none


class KeyIndex:
    """``keys`` and ``value`` are column lists such as ``"comp bigint"`` and ``"year int"``.

    With ``history`` every value a key has had is kept; otherwise merging runs keeps the
    value of the last write. Nulls are keys and values like others.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: str, value: str, history: bool = False, slice_rows: int = SLICE_ROWS, fanout: int = FANOUT
    ):
        self.spark, self.path, self.history, self.slice_rows, self.fanout = spark, path.rstrip("/"), history, slice_rows, fanout
        self.key_fields, self.value_fields = StructType.fromDDL(keys), StructType.fromDDL(value)
        self.keys, self.value = self.key_fields.names, self.value_fields.names[0]
        key = f"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in self.key_fields)}>"
        self.zone_schema = f"slice int, low {key}, high {key}, width bigint"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*self.key_fields, *self.value_fields))
        self.entry_schema = f"{columns}, run bigint, slice int"

    # --- Files ----------------------------------------------------------------------

    def _folder(self, kind: str, run: int | None = None) -> str:
        return f"{self.path}/{kind}" + ("" if run is None else f"/run={run}")

    def _listed(self, kind: str) -> list[str]:
        files, folder = file_system(self.spark, self._folder(kind))
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def _begun(self) -> list[int]:
        return [int(n[4:]) for n in self._listed("entries") if n.startswith("run=")]

    def runs(self) -> list[int]:
        """Runs whose entries, filters and zones are written, in order; zones are written last."""
        done = []
        for name in self._listed("zones"):
            files, marker = file_system(self.spark, f"{self._folder('zones')}/{name}/_SUCCESS")
            if name.startswith("run=") and files.exists(marker):
                done.append(int(name[4:]))
        return sorted(done)

    def committed(self) -> dict[int, int]:
        """Level of each committed run."""
        pairs = [n.split("-") for n in self._listed("commits") if not n.startswith((".", "_"))]
        complete = set(self.runs())
        return {int(run): int(level) for run, level in pairs if int(run) in complete}

    # --- Writing --------------------------------------------------------------------

    def _typed(self, df: DataFrame, fields: Sequence) -> list[Column]:
        return [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]

    def _slots(self, width: Column) -> Column:
        """Places of a key in a filter of ``width`` bits, with the number of the hash."""
        place = lambda i: F.pmod(F.xxhash64(*self.keys, F.lit(i)), width)
        return F.array(*[F.struct(F.lit(i).alias("i"), place(i).alias("place")) for i in range(HASHES)])

    def add(self, rows: DataFrame) -> int:
        """Write the keys and values of ``rows`` as a new run, not yet committed, and return its number."""
        run = max([0, *self._begun()]) + 1
        rows = rows.select(*self._typed(rows, self.key_fields), *self._typed(rows, self.value_fields)).distinct()
        staged = stage_path(self.spark, "index-run")
        rows.write.parquet(staged)
        rows = self.spark.read.schema(rows.schema).parquet(staged)
        slices = max(1, -(-rows.count() // self.slice_rows))
        dealt = rows.repartitionByRange(slices, *self.keys).withColumn("slice", F.spark_partition_id())
        dealt.sortWithinPartitions("slice", *self.keys).write.partitionBy("slice").parquet(self._folder("entries", run))
        entries = self._entries([run]).select(*self.keys, "slice")
        zones = entries.groupBy("slice").agg(F.min(F.struct(*self.keys)).alias("low"), F.max(F.struct(*self.keys)).alias("high"), F.count(F.lit(1)).alias("n"))
        width = F.greatest(F.lit(64), F.pow(2, F.ceil(F.log2(F.col("n") * BITS_PER_KEY)))).cast("bigint")
        zones = zones.select("slice", "low", "high", width.alias("width"))
        staged = stage_path(self.spark, "index-zones")
        zones.write.parquet(staged)
        zones = self.spark.read.schema(self.zone_schema).parquet(staged)
        bit = entries.join(zones.select("slice", "width"), "slice").select("slice", F.explode(self._slots(F.col("width"))).alias("s"))
        words = bit.groupBy("slice", F.expr("s.place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s.place % 64 as int)))").alias("bits"))
        words.repartition("slice").sortWithinPartitions("slice", "word").write.partitionBy("slice").parquet(self._folder("filters", run))
        zones.coalesce(1).write.parquet(self._folder("zones", run))  # one short row per slice
        return run

    def commit(self, run: int, level: int = 0) -> None:
        """The data that ``run`` describes are written. Merges the runs of full levels."""
        files, marker = file_system(self.spark, f"{self._folder('commits')}/{run}-{level}")
        files.create(marker, True).close()
        while True:
            levels = self.committed()
            full = [n for n in sorted(set(levels.values())) if sum(v == n for v in levels.values()) >= self.fanout]
            if not full:
                return
            old = sorted(r for r, n in levels.items() if n == full[0])
            merged = self._entries(old)
            if not self.history:
                merged = merged.groupBy(*self.keys).agg(F.max(F.struct("run", self.value))[self.value].alias(self.value))
            new = self.add(merged)
            files, marker = file_system(self.spark, f"{self._folder('commits')}/{new}-{full[0] + 1}")
            files.create(marker, True).close()
            for run in old:  # a crash in between leaves entries that the merged run holds as well
                for path in (f"{self._folder('commits')}/{run}-{full[0]}", *[self._folder(k, run) for k in ("zones", "filters", "entries")]):
                    files, folder = file_system(self.spark, path)
                    files.delete(folder, True)

    # --- Reading --------------------------------------------------------------------

    def _read(self, kind: str, schema: str, runs: Sequence[int]) -> DataFrame:
        paths = [self._folder(kind, r) for r in runs]
        return self.spark.read.schema(schema).option("basePath", self._folder(kind)).parquet(*paths)

    def _entries(self, runs: Sequence[int]) -> DataFrame:
        return self._read("entries", self.entry_schema, runs)

    def _opened(self, df: DataFrame, touched: dict[int, list[int]]) -> DataFrame:
        """The slices of ``touched``; a filter on the folders, so others aren't listed or read."""
        chosen = F.lit(False)
        for run, slices in touched.items():
            chosen = chosen | ((F.col("run") == run) & F.col("slice").isin(*slices))
        return df.where(chosen)

    def _touched(self, df: DataFrame) -> dict[int, list[int]]:
        """Runs and slices named in ``df``; the driver receives one row per slice that is to be opened."""
        out: dict[int, list[int]] = {}
        for run, number in df.select("run", "slice").distinct().collect():
            out.setdefault(run, []).append(number)
        return out

    def slices_of(self, df: DataFrame, runs: Sequence[int] | None = None) -> tuple[DataFrame, dict[int, list[int]]]:
        """(key, run, slice) of the slices that may hold a key of ``df``, and these slices."""
        runs = self.runs() if runs is None else runs
        wanted = df.select(*self._typed(df, self.key_fields)).distinct()
        if not runs:
            return wanted.withColumns({"run": F.lit(0).cast("long"), "slice": F.lit(0)}).where("false"), {}
        zones = self._read("zones", f"{self.zone_schema}, run bigint", runs)
        zone = F.struct("low", "high", "slice", "width")
        of_run = zones.groupBy("run").agg(F.collect_list(zone).alias("zones"))
        each = wanted.withColumn("run", F.explode(F.array(*[F.lit(r).cast("long") for r in runs]))).join(of_run, "run")
        key = F.struct(*self.keys)
        within = F.filter("zones", lambda z: (z["low"] <= key) & (z["high"] >= key))
        near = each.withColumn("z", F.explode(within)).select(*self.keys, "run", "z.slice", "z.width")
        staged = stage_path(self.spark, "index-near")
        near.write.parquet(staged)
        near = self.spark.read.schema(near.schema).parquet(staged)
        touched = self._touched(near)
        if not touched:
            return near.drop("width"), {}
        # Slices asked for many keys are opened anyway: probing their filters would only cost a shuffle of every bit.
        counted = near.groupBy("run", "slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY_KEYS)
        crowded = self._touched(counted)
        sparse = {run: [n for n in slices if n not in crowded.get(run, ())] for run, slices in touched.items()}
        sparse = {run: slices for run, slices in sparse.items() if slices}
        if not sparse:
            return near.drop("width"), touched
        whole = self._opened(near, crowded).drop("width")
        near, touched = self._opened(near, sparse), sparse
        words = self._opened(self._read("filters", "word bigint, bits bigint, run bigint, slice int", list(touched)), touched)
        asked = near.withColumn("s", F.explode(self._slots(F.col("width"))))
        asked = asked.withColumn("word", F.expr("s.place div 64"))
        hit = asked.join(words, ["run", "slice", "word"]).where("shiftright(bits, cast(s.place % 64 as int)) & 1 = 1")
        hits = hit.groupBy(*self.keys, "run", "slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES).drop("n")
        if crowded:
            hits = hits.unionByName(whole)
        staged = stage_path(self.spark, "index-hits")
        hits.write.parquet(staged)
        hits = self.spark.read.schema(hits.schema).parquet(staged)
        return hits, self._touched(hits)

    def lookup(self, df: DataFrame, committed_only: bool = False) -> DataFrame:
        """(keys, value, run) entries of the keys of ``df``; a key may have several, the greatest run is the last."""
        runs = sorted(self.committed()) if committed_only else self.runs()
        hits, touched = self.slices_of(df, runs)
        if not touched:
            empty = self.spark.createDataFrame([], self.entry_schema)
            return empty.drop("slice")
        entries = self._opened(self._entries(list(touched)), touched)
        found = join_on(entries, hits.select(*self.keys, "run", "slice"), [*self.keys, "run", "slice"], "left_semi")
        return found.select(*self.keys, self.value, "run")
