"""Partner rows that arrive in a landing folder: counts per partner, sample and day of annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of ``folder`` with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _usable(rows: DataFrame, stamp: str) -> DataFrame:
    return rows.where("partner IS NOT NULL AND partner NOT IN ('', '.')").withColumn("at", F.col(stamp).cast("timestamp")).where("at IS NOT NULL")


def daily_counts(rows: DataFrame, late: str = "30 days", stamp: str = "annotated_at") -> DataFrame:
    """(day, sample_idx, partner, n); rows later than ``late`` behind the newest are left out, state of closed days is dropped.

    Unusable partners (null, empty, ``.``) and rows without a time do not count. Appended, the days within ``late`` of the
    newest row are never written; ``start_all`` and ``totals`` count every row.
    """
    ok = _usable(rows, stamp)
    day = F.window("at", "1 day")
    counts = ok.withWatermark("at", late).groupBy(day.alias("w"), "sample_idx", "partner").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("w.start").alias("day"), "sample_idx", "partner", "n")


def start(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append closed days to ``folder`` until all files present are read."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)


def start_all(rows: DataFrame, folder: str, checkpoint: str, stamp: str = "annotated_at") -> StreamingQuery:
    """Write the counts of each batch, late rows and open days included, to a folder of its own until all files present are read.

    There is no watermark and no state; a batch that is run again replaces its folder. ``totals`` adds the batches up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = _usable(batch, stamp).groupBy(F.to_date("at").alias("day"), "sample_idx", "partner").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(day, sample_idx, partner, n) over all batches that ``start_all`` wrote to ``folder``."""
    return spark.read.parquet(folder).groupBy("day", "sample_idx", "partner").agg(F.sum("n").alias("n"))
