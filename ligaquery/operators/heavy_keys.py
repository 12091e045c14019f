"""A few keys holding most records: exact offset chunking.

Every row gets its number within its key: rows are counted per key and partition, the counts are
prefix-summed over the partitions, and the rows are numbered inside their partition. A key of any
size then falls into chunks of equal size, chunks are processed on their own, and their small
ordered states are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligaquery.session import cut

CHUNK_ROWS = 50_000


def number_rows(df: DataFrame, keys: list[str], order: list[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``row_no`` (from 1 per key) and ``chunk_no`` (from 0); null keys are a key of their own.

    With ``order`` the rows are range-partitioned by it first, so that numbers follow that order
    (ties in any order); without it they follow the partitions. No task holds more than one
    partition's rows of a key.
    """
    rows = df.repartitionByRange(*order) if order else df
    frozen = cut(rows.withColumn("__pid", F.spark_partition_id()))
    packed = F.struct(*keys)
    within = Window.partitionBy("__key", "__pid").orderBy(*(order or [F.lit(0)]))
    local = frozen.withColumn("__key", packed).withColumn("__at", F.row_number().over(within))
    counts = frozen.groupBy(packed.alias("__key"), "__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__key").alias("__okey"), F.col("__pid").alias("__opid"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    same = local["__key"].eqNullSafe(offsets["__okey"]) & (local["__pid"] == offsets["__opid"])
    numbered = local.join(offsets, same).withColumn("row_no", F.col("__off") + F.col("__at"))
    return numbered.withColumn("chunk_no", F.floor((F.col("row_no") - 1) / chunk_rows)).drop("__key", "__okey", "__pid", "__opid", "__off", "__at")


def chunk_counts(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows): the chunks' counts, merged."""
    states = numbered.groupBy(*keys, "chunk_no").agg(F.count(F.lit(1)).alias("n"))
    return states.groupBy(*keys).agg(F.sum("n").alias("n_rows"))


def chunk_stats(numbered: DataFrame, keys: list[str], scores: list[str], trace: str) -> DataFrame:
    """Per key: n_rows, for each score its count, mean, min and max, and ``n_switches``.

    ``n_switches`` counts the changes of ``trace`` (nulls as a value) between neighbouring rows; it
    is where the order matters: each chunk hands on its first and last value and the merge adds the
    change across the border. Null scores do not count; a key without scores has null statistics.
    """
    in_chunk = Window.partitionBy(*keys, "chunk_no").orderBy("row_no")
    switched = ~F.col(trace).eqNullSafe(F.lag(trace).over(in_chunk)) & (F.row_number().over(in_chunk) > 1)
    parts: list[Column] = [F.count(F.lit(1)).alias("n"), F.sum(F.col("__sw").cast("int")).alias("sw"), F.min_by(F.struct(trace), "row_no").alias("head"), F.max_by(F.struct(trace), "row_no").alias("tail")]
    for s in scores:
        parts += [F.count(s).alias(f"{s}_c"), F.sum(F.col(s).cast("double")).alias(f"{s}_s"), F.min(s).alias(f"{s}_lo"), F.max(s).alias(f"{s}_hi")]
    states = numbered.withColumn("__sw", switched).groupBy(*keys, "chunk_no").agg(*parts)
    across = Window.partitionBy(*keys).orderBy("chunk_no")
    joint = (F.col("chunk_no") > 0) & ~F.col("head").eqNullSafe(F.lag("tail").over(across))
    merged = [F.sum("n").alias("n_rows"), F.sum(F.col("sw") + F.col("__joint").cast("int")).alias("n_switches")]
    for s in scores:
        merged += [F.sum(f"{s}_c").alias(f"n_{s}"), F.try_divide(F.sum(f"{s}_s"), F.sum(f"{s}_c")).alias(f"mean_{s}"), F.min(f"{s}_lo").alias(f"min_{s}"), F.max(f"{s}_hi").alias(f"max_{s}")]
    return states.withColumn("__joint", joint).groupBy(*keys).agg(*merged)


def shares_at_least(counts: DataFrame, within: str, share_of: int) -> DataFrame:
    """The rows of ``counts`` whose ``n_rows`` is at least one in ``share_of`` of the total of their ``within``."""
    totals = counts.groupBy(F.col(within).alias("__w")).agg(F.sum("n_rows").alias("__total"))
    joined = counts.join(totals, F.col(within).eqNullSafe(F.col("__w")))
    return joined.where(F.col("n_rows") * share_of >= F.col("__total")).drop("__w", "__total")
