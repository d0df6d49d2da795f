"""Read counts and likelihoods kept up to date while reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.tally import count_reads, pileup_likelihoods


def read_counts(reads: DataFrame) -> DataFrame:
    """Streaming (sample_idx, site_idx, n, k): state is one row for each cell, however many reads come."""
    return count_reads(reads, "sample_idx", "site_idx")


def windowed_counts(reads: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """The same by event-time window; state older than the watermark is dropped, later reads with it."""
    timed = reads.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "sample_idx", "site_idx")
    return timed.agg(F.count("*").alias("n"), F.count_if("is_alt").alias("k")).select(F.col("w.start").alias("from_time"), "sample_idx", "site_idx", "n", "k")


def keep_likelihoods(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the likelihoods of the cells that changed in each batch to path/batch=i; the greatest batch of a cell counts.

    A batch that is repeated overwrites its own folder, so the result is exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        pileup_likelihoods(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return read_counts(reads).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark, path: str) -> DataFrame:
    """The newest row of each cell written by keep_likelihoods."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("sample_idx", "site_idx", "batch")]
    return rows.groupBy("sample_idx", "site_idx").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("sample_idx", "site_idx", "x.*")
