"""Running totals of a stream, with corrections, in a bounded number of folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grouping import first_per_key, join_on
from ..sources.key_index import KeyIndex
from ..sources.snapshots import Snapshots
from ..sources.tables import existing, upsert

FANOUT = 4


class RunningTotals:
    """Sums of ``measures`` per entity and day, added up batch by batch.

    A batch leaves one folder of sums per entity and day; as soon as a level holds
    ``fanout`` folders they are added up into one of the next level, so their number is
    logarithmic in the batches. A manifest names the folders and the last batch, and is
    switched in one step: a batch that is run again counts once, and readers see whole
    batches.

    With ``keys`` (a column list such as ``"event_id bigint"``) and ``version`` a record
    may be delivered again with other values: what it counted for before is subtracted, on
    its old entity and day, and an older version changes nothing. The records' own values
    are kept in a table by day for that, found through a key index.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        entity: str,
        day: str,
        measures: Mapping[str, Column],
        keys: str | None = None,
        version: Sequence[Column] = (),
        fanout: int = FANOUT,
    ):
        self.spark, self.path, self.entity, self.day, self.measures = spark, path.rstrip("/"), entity, day, dict(measures)
        self.version, self.fanout = list(version), fanout
        self.sums = Snapshots(spark, f"{self.path}/sums")
        self.index = None if keys is None else KeyIndex(spark, f"{self.path}/index", keys, f"`{day}` date")

    # --- Batches --------------------------------------------------------------------

    def add(self, batch: DataFrame, number: int) -> None:
        """Count one batch; the same number again changes nothing."""
        names = list(self.measures)
        rows = batch.withColumns({name: F.coalesce(m.cast("double"), F.lit(0.0)) for name, m in self.measures.items()})
        if self.index is None:
            self._publish(rows.groupBy(self.entity, self.day).agg(*[F.sum(n).alias(n) for n in names]), number)
            return
        records = f"{self.path}/records"
        rows = first_per_key(rows, self.index.keys, self.version)
        rows = rows.withColumn(self.day, F.col(self.day).cast("date"))
        content = self.sums.manifest()
        if content is None or number > content["batch"]:
            old = existing(self.spark, records, rows.schema)
            new = rows.withColumn("__sign", F.lit(1.0))
            both = new
            if old is not None:
                days = [r[0] for r in self.index.lookup(rows).select(self.day).distinct().collect()]  # one value per day
                held = F.col(self.day).isin(*[d for d in days if d is not None]) if any(days) else F.lit(False)
                old = old.where(held | F.col(self.day).isNull() if None in days else held)
                old = join_on(old, rows.select(*self.index.keys), self.index.keys, "left_semi").withColumn("__sign", F.lit(-1.0))
                # Of both, the later version counts, of equal ones the new; a delivery older than the record changes nothing.
                both = new.unionByName(old)
                latest = first_per_key(both, self.index.keys, [*self.version, F.desc("__sign")])
                gone = latest.where("__sign < 0").select(*self.index.keys)
                both = join_on(both, gone, self.index.keys, "left_anti")
            signed = [F.sum(F.col(n) * F.col("__sign")).alias(n) for n in names]
            self._publish(both.groupBy(self.entity, self.day).agg(*signed), number)
        upsert(rows, records, self.index.keys, self.version, self.day, schema=rows.schema, index=self.index)

    def _publish(self, sums: DataFrame, number: int) -> None:
        content = self.sums.manifest() or {"folders": [], "levels": [], "batch": -1}
        if number <= content["batch"]:
            return
        version = (self.sums.versions() or [0])[-1]
        folder = self.sums.new_folder()
        sums.write.parquet(folder)
        folders, levels = [*content["folders"], folder], [*content["levels"], 0]
        while True:
            full = [n for n in sorted(set(levels)) if levels.count(n) >= self.fanout]
            if not full:
                break
            merged = [f for f, n in zip(folders, levels) if n == full[0]]
            folder = self.sums.new_folder()
            self._added(self.spark.read.schema(sums.schema).parquet(*merged), self.entity, self.day).write.parquet(folder)
            rest = [(f, n) for f, n in zip(folders, levels) if n != full[0]]
            folders, levels = [f for f, _ in rest] + [folder], [n for _, n in rest] + [full[0] + 1]
        self.sums.publish({"folders": folders, "levels": levels, "batch": number, "schema": sums.schema.jsonValue()}, version)

    def _added(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(n).alias(n) for n in self.measures])

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Count everything that has arrived, batch by batch, and stop."""
        from .feed import drain

        return drain(stream, self.add, checkpoint)

    # --- Reading --------------------------------------------------------------------

    def folders(self) -> list[str]:
        content = self.sums.manifest()
        return [] if content is None else content["folders"]

    def per_day(self) -> DataFrame:
        return self._added(self.sums.read(), self.entity, self.day)

    def read(self) -> DataFrame:
        """Current totals per entity; one whose records have all moved away stays with zeros."""
        return self._added(self.sums.read(), self.entity)
