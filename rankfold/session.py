"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Adaptive execution coalesces small shuffle blocks, turns joins into broadcast
# joins from measured sizes and splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app: str = "rankfold", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def short_methods(spark: SparkSession) -> None:
    """Have Spark split generated code that HotSpot would interpret instead of compile, as in :data:`SETTINGS`.

    Methods of more than 8,000 bytes are never compiled; a wide projection soon makes one.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > int(SETTINGS[key]):
        spark.conf.set(key, SETTINGS[key])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and stage tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local($|\[)", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="rankfold-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def reliable_checkpoint(df):
    """Materialise ``df`` in the shared folder, so a lost executor changes nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
