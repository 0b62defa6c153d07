"""Tables whose readers see a whole old or a whole new version, never a mixture.

A version is a small manifest that names data folders. It is written under another name
and renamed once the data have been checked, so a write that fails leaves the version
before it in place. Data that no kept manifest names are removed after the switch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import file_system


class Snapshots:
    """The versions of the table at ``path``; ``keep`` versions stay readable for readers that have begun."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def versions(self) -> list[int]:
        files, folder = file_system(self.spark, f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """Contents of a version, by default the newest; None before the first."""
        known = self.versions()
        if version is None and not known:
            return None
        files, place = file_system(self.spark, self._manifest(known[-1] if version is None else version))
        stream = files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:09d}.json"

    def new_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def publish(self, content: dict, after: int | None = None) -> int:
        """Make ``content`` the newest version; ``after`` is the version it was made from.

        ``content["folders"]`` lists the data folders. A version that another writer has
        published meanwhile is an error.
        """
        known = self.versions()
        newest = known[-1] if known else 0
        if after is not None and after != newest:
            raise RuntimeError(f"{self.path}: version {newest} was written meanwhile")
        files, place = file_system(self.spark, self._manifest(newest + 1))
        _, draft = file_system(self.spark, f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if files.exists(place) or not files.rename(draft, place):
            raise RuntimeError(f"{self.path}: version {newest + 1} was written meanwhile")
        self._forget()
        return newest + 1

    def _forget(self) -> None:
        """Remove old manifests, and data folders that only they name."""
        known = self.versions()
        gone, kept = known[: -self.keep], known[-self.keep :]
        needed = {f for v in kept for f in self.manifest(v)["folders"]}
        for version in gone:
            for folder in set(self.manifest(version)["folders"]) - needed:
                files, place = file_system(self.spark, folder)
                files.delete(place, True)
            files, place = file_system(self.spark, self._manifest(version))
            files.delete(place, False)

    def write(self, df: DataFrame, checks: Iterable[Callable[[DataFrame], None]] = ()) -> DataFrame:
        """Write a version of one folder, count it, run ``checks`` on what was written, then switch.

        The expected count comes from the write itself, so the source is read once. A check
        that raises leaves the version before.
        """
        known = self.versions()
        folder, seen = self.new_folder(), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
        back, expected = self.spark.read.schema(df.schema).parquet(folder), seen.get["rows"]
        found = back.count()
        if found != expected:
            raise RuntimeError(f"{folder}: {found} rows instead of {expected}")
        for check in checks:
            check(back)
        self.publish({"folders": [folder], "rows": found, "schema": df.schema.jsonValue()}, known[-1] if known else 0)
        return back

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the newest; None before the first."""
        from pyspark.sql.types import StructType

        content = self.manifest(version)
        if content is None:
            return None
        return self.spark.read.schema(StructType.fromJson(content["schema"])).parquet(*content["folders"])
