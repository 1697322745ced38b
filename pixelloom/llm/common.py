"""Shared plumbing of the corpus operators: the driver's tables, cuts of lineage, memory of Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import fresh_path, temporary, written  # noqa: F401
from ..functions.shipping import ship  # noqa: F401

#: What a row without a doc_id counts as: it sorts before every real id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder, which outlives executors: a cut of lineage.

    A written table has its true size. A checkpoint keeps the planner's estimate, and over the rounds of a loop of joins
    the product of estimates grows beyond use.
    """
    return written(df, "cut")


def tidied(batches):
    """What a Python worker yields; at the end it gives freed memory back, as workers live on from job to job."""
    import ctypes

    import pyarrow as pa

    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
