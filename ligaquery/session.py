"""Session helpers: reading tables, cutting lineage, and joins with a side whose size is measured first."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its bytes, measured first, are at most so many.
BROADCAST_BYTES = 32 << 20
#: Beyond that, each key is spread over so many tasks: the left rows take turns, the right ones are repeated.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local master without it (tests) gets an own one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, *gone: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again; the tables of ``gone``, from here too, are deleted.

    For loops: a checkpoint carries the estimated size of its plan on, which a join multiplies each
    round; a table has its real size, so small ones are broadcast and their files share tasks.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for g in gone:
        for f in g.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over; else they stay until the driver happens to collect its garbage."""
    gc.collect()  # what Python holds on to first
    spark.sparkContext._jvm.System.gc()


def byte_size(df: DataFrame) -> int:
    """The bytes of the values of ``df``, without any overhead but 8 a value."""

    def width(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        long = {"string": lambda: F.octet_length(c), "binary": lambda: F.octet_length(c)}.get(kind)
        if long is None and kind.startswith(("array", "map", "struct")):
            long = lambda: F.octet_length(F.to_json(F.struct(c)))
        return F.coalesce(long().cast("bigint"), F.lit(0)) + 8 if long else F.lit(8).cast("bigint")

    return df.agg(F.sum(reduce(Column.__add__, (width(n, k) for n, k in df.dtypes)))).first()[0] or 0


def lookup(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (``how``: inner, left, left_semi or left_anti), whatever the size of ``right`` and of one key.

    ``right`` is broadcast if its measured bytes are at most ``BROADCAST_BYTES``. Else the rows of each
    key of ``left`` are dealt over ``SALTS`` tasks and those of ``right`` repeated for each, so that a
    key with a third of all rows is no single task's work. The rows are the same either way. Column
    names must differ between the sides; ``on`` holds at least one equality.
    """
    if byte_size(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    every = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, on & (F.col("__salt") == F.col("__salt_r")), how).drop("__salt", "__salt_r")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes are at most ``BROADCAST_BYTES``, else as it is."""
    return F.broadcast(df) if byte_size(df) <= BROADCAST_BYTES else df


def keep(df: DataFrame) -> DataFrame:
    """Cache on the executors' disks and memory; lost blocks are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
