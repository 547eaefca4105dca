"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[DataFrame, str], DataFrame]


def build_session(
    app: str = "starweave", master: str | None = None, shuffle_tasks: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the plans are written for.

    ``shuffle_tasks`` is the number of tasks a shuffle starts with; adaptive
    execution merges small ones but never cuts more.  Rule: bytes of the
    largest shuffle divided by 128 MB, e.g. 800,000 for 100 TB.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shuffle_tasks:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_tasks))
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_tasks))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a fresh
    temporary folder.  On a cluster a folder of one machine would be lost
    together with that machine, so the missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="starweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def no_stage(frame: DataFrame, name: str) -> DataFrame:
    """Leave an intermediate result lazy."""
    return frame


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of staged tables that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def parquet_stage(spark: SparkSession, folder: str | None = None) -> Stage:
    """Write intermediate results once, as parquet in the shared folder (or in ``folder``).

    A written table survives the loss of executors, cuts the lineage, and
    keeps column pruning for its several readers.
    """
    run = folder or f"{shared_folder(spark).rstrip('/')}/starweave-{uuid.uuid4().hex}"

    def stage(frame: DataFrame, name: str) -> DataFrame:
        path = f"{run}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return stage
