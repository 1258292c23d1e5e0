"""Access logs as a stream: an extension of the batch rollup with watermarks and bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborspark.functions import paths
from arborspark.sources.access import RAW, canonical_gcs


def read_raw(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New usage log files as they arrive."""
    return spark.readStream.schema(RAW).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def daily_ops(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """day, path, op: n_ops, bytes_out, bytes_in from a stream of canonical columns (ts, path, op, request_id, bytes_out, bytes_in): one row per
    request id within the watermark, every directory above included."""
    once = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])
    up = once.select("ts", "op", "bytes_out", "bytes_in", F.explode(paths.self_and_ancestors(paths.canonical(F.coalesce("path", F.lit(""))))).alias("path"))
    sums = up.groupBy(F.window("ts", "1 day").alias("w"), "path", "op").agg(
        F.count("*").alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in")
    )
    return sums.select(F.to_date("w.start").alias("day"), paths.published(F.col("path")).alias("path"), "op", "n_ops", "bytes_out", "bytes_in")


def to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Closed days appended as Parquet, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Raw rows to canonical Parquet, a folder per batch; a batch that is retried replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        canonical_gcs(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
