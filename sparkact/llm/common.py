"""Helpers shared by the training-data operators.

Nothing here is machine-local: intermediate tables go to the shared folder that the
session names in ``spark.checkpoint.dir`` (an own folder only on a local master without it).
"""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of its own on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage in a way
    that survives lost executors. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer referenced: they go once
    the driver has collected its garbage, and what only finalizers held goes a round later."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns; extra columns, whatever their names, never meet the operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def broadcast_if_small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcasting if its counted ``rows`` stay under a bound;
    beyond it Spark joins by a shuffle."""
    return F.broadcast(df) if rows <= most else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
