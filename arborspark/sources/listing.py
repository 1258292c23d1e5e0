"""Object listings of several dialects, normalized to (bucket, name, size_bytes, created, storage_class_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.functions.text import GCS_CLASSES, S3_CLASSES, lookup

SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("storage_class_id", T.IntegerType()),
    ]
)


def dialect(columns: Sequence[str]) -> str:
    """``raw``, ``gcs`` or ``s3`` by column names; anything else raises."""
    have = set(columns)
    for name, need in (("raw", {"bucket", "name", "size_bytes"}), ("gcs", {"bucket", "name", "size", "timeCreated"}), ("s3", {"Bucket", "Key", "Size"})):
        if need <= have:
            return name
    raise ValueError(f"unknown listing columns: {sorted(have)}")


def normalize(df: DataFrame) -> DataFrame:
    """One dialect to SCHEMA; deleted rows, delete markers and old versions go."""
    have, kind = set(df.columns), dialect(df.columns)
    when = lambda c: F.col(c).cast("timestamp") if c in have else F.lit(None).cast("timestamp")
    if kind == "raw":
        class_id = F.col("storage_class_id").cast("int") if "storage_class_id" in have else F.lit(0)
        return df.select("bucket", "name", F.col("size_bytes").cast("long"), when("created").alias("created"), F.coalesce(class_id, F.lit(0)).alias("storage_class_id"))
    if kind == "gcs":
        rows = df.filter(F.col("timeDeleted").isNull()) if "timeDeleted" in have else df
        class_id = F.coalesce(lookup(GCS_CLASSES, F.col("storageClass")), F.lit(0)) if "storageClass" in have else F.lit(0)
        return rows.select("bucket", "name", F.col("size").cast("long").alias("size_bytes"), when("timeCreated").alias("created"), class_id.alias("storage_class_id"))
    rows = df
    if "IsDeleteMarker" in have:
        rows = rows.filter(~F.coalesce(F.col("IsDeleteMarker").cast("boolean"), F.lit(False)))
    if "IsLatest" in have:
        rows = rows.filter(F.coalesce(F.col("IsLatest").cast("boolean"), F.lit(True)))
    class_id = F.coalesce(lookup(S3_CLASSES, F.col("StorageClass")), F.lit(0)) if "StorageClass" in have else F.lit(0)
    return rows.select(
        F.col("Bucket").alias("bucket"), F.col("Key").alias("name"), F.col("Size").cast("long").alias("size_bytes"),
        when("LastModifiedDate").alias("created"), class_id.alias("storage_class_id"),
    )


def merge(sources: Sequence[DataFrame]) -> DataFrame:
    """Union in which the first source that has a bucket provides all of it. Which source wins is a small aggregate per bucket;
    it meets the rows in a join that Spark sizes itself."""
    rows = None
    for i, df in enumerate(sources):
        own = normalize(df).withColumn("_src", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("no listing given")
    if len(sources) == 1:
        return rows.drop("_src")
    winner = rows.groupBy("bucket").agg(F.min("_src").alias("_win"))
    return rows.join(winner, "bucket").filter(F.col("_src") == F.col("_win")).select(*SCHEMA.names)


def buckets(listing: DataFrame) -> DataFrame:
    return listing.select("bucket").filter("bucket IS NOT NULL").distinct().orderBy("bucket")


def from_tuples(spark, bucket: str, rows: Sequence[tuple[str, int, str, str]]) -> DataFrame:
    """Listing rows of an API, (name, size, ISO time of mixed precision, class name)."""
    df = spark.createDataFrame(rows, "name string, size_bytes long, time string, class string")
    return df.select(
        F.lit(bucket).alias("bucket"), "name", "size_bytes", F.to_timestamp("time").alias("created"),
        F.coalesce(lookup({**S3_CLASSES, **GCS_CLASSES}, F.col("class")), F.lit(0)).alias("storage_class_id"),
    )
