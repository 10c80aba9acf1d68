"""What the training-data operators share: tables, and tables written to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import ship

#: White space of the query contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer splits than there are cores, as from one small file, are dealt out to all of them."""
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only in local mode, where one machine is all, a temp folder does where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later jobs start from the files, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this worker has freed goes back to the system: workers stay for later stages, and their memory counts while they are idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, for mapInArrow, and then give_back."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def unit(*by: Column | str) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*by), 11).cast("double")) / F.lit(float(1 << 53))


def root_buckets(rows: int, least: int = 8) -> int:
    """About the square root of rows: as many buckets as rows in each, so that neither a bucket nor the list of buckets gets large."""
    return max(least, math.isqrt(max(rows, 0)) + 1)
