"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: the one named by ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests) a folder of our own is set; on a cluster that is an error.
    """
    ctx = spark.sparkContext
    named = ctx.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or ctx.getCheckpointDir()
    if not named:
        if not ctx.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file:///tmp/checkpoints/pixelloom-{ctx.applicationId}"
        ctx.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A folder name of its own below the shared folder."""
    path = f"{shared_dir(spark)}/pixelloom-{label}-{uuid.uuid4().hex}"
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all folders that were handed out within it to this thread: what reads them must be done by then."""
    outer, _made.paths = getattr(_made, "paths", None), []
    try:
        yield
    finally:
        mine, _made.paths = _made.paths, outer
        for path in mine:
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this module handed out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """df as a compressed table in the shared folder, optionally in parts by columns. Job folders there can go with the job."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
