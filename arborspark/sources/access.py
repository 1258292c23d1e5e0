"""Access logs to canonical rows, and the parser registry by store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.functions.text import normalize_op

RAW = (
    "time_micros long, c_ip string, c_ip_type string, c_ip_region string, cs_method string, cs_uri string, sc_status int, cs_bytes long, sc_bytes long,"
    " time_taken_micros long, cs_host string, cs_referer string, cs_user_agent string, s_request_id string, cs_operation string, cs_bucket string,"
    " cs_object string"
)
COLUMNS = ["ts", "store", "bucket", "path", "op", "op_raw", "status", "bytes_out", "bytes_in", "requester", "user_agent", "request_id"]
#: An object storage access line: owner, bucket, [time], ip, requester, request id, operation, key, "request", status, error, bytes sent, ...
S3_LINE = r'^\S+ (\S+) \[([^\]]+)\] (\S+) (\S+) (\S+) (\S+) (\S+) "([^"]*)" (\S+) \S+ (\S+) \S+ \S+ \S+ "[^"]*" "([^"]*)"'


def read_gcs(spark: SparkSession, glob: str) -> DataFrame:
    """Usage logs with a header; columns are matched by name through the fixed schema, without inference."""
    return spark.read.csv(glob, header=True, schema=RAW, enforceSchema=False)


def canonical_gcs(raw: DataFrame, store: str = "gcs") -> DataFrame:
    """Canonical rows, one per request id (null ids are one). Rows without a bucket go; lacking texts are empty."""
    rows = raw.filter("cs_bucket IS NOT NULL").select(
        F.timestamp_micros("time_micros").alias("ts"), F.lit(store).alias("store"), F.col("cs_bucket").alias("bucket"),
        F.coalesce("cs_object", F.lit("")).alias("path"), normalize_op(F.col("cs_method"), F.col("cs_operation")).alias("op"),
        F.coalesce("cs_operation", "cs_method", F.lit("")).alias("op_raw"), F.col("sc_status").alias("status"),
        F.coalesce("sc_bytes", F.lit(0)).cast("long").alias("bytes_out"), F.coalesce("cs_bytes", F.lit(0)).cast("long").alias("bytes_in"),
        F.coalesce("c_ip", F.lit("")).alias("requester"), F.coalesce("cs_user_agent", F.lit("")).alias("user_agent"), F.col("s_request_id").alias("request_id"),
    )
    return dedupe(rows)


def dedupe(rows: DataFrame) -> DataFrame:
    """One row per request id: an aggregation that combines before the shuffle, with the earliest row as the winner."""
    keys = [c for c in rows.columns if c != "request_id"]
    least = rows.groupBy("request_id").agg(F.min(F.struct(*keys)).alias("w"))
    return least.select(*[F.col(f"w.{c}").alias(c) for c in keys], "request_id").select(*rows.columns)


def read_storage_daily(spark: SparkSession, glob: str) -> DataFrame:
    """Daily storage: bucket and byte hours."""
    return spark.read.csv(glob, header=True, schema="bucket string, storage_byte_hours long")


def canonical_s3(lines: DataFrame) -> DataFrame:
    """Canonical rows from access lines (column ``value``). An extension: the other stores' logs."""
    part = lambda k: F.regexp_extract("value", S3_LINE, k)
    rows = lines.filter(F.col("value").rlike(S3_LINE))
    dash = lambda c: F.when(c != "-", c)
    return dedupe(
        rows.select(
            F.to_timestamp(part(2), "dd/MMM/yyyy:HH:mm:ss Z").alias("ts"), F.lit("s3").alias("store"), part(1).alias("bucket"),
            F.coalesce(F.url_decode(dash(part(7))), F.lit("")).alias("path"),
            F.when(part(6).startswith("REST.GET.BUCKET"), "LIST").when(part(6).startswith("REST.GET"), "GET").when(part(6).startswith("REST.PUT"), "PUT")
            .when(part(6).startswith("REST.POST"), "PUT").when(part(6).startswith("REST.HEAD"), "HEAD").when(part(6).contains("DELETE"), "DELETE")
            .otherwise("OTHER").alias("op"),
            part(6).alias("op_raw"), part(9).try_cast("int").alias("status"), F.coalesce(part(10).try_cast("long"), F.lit(0)).alias("bytes_out"),
            F.lit(0).cast("long").alias("bytes_in"), part(3).alias("requester"), part(11).alias("user_agent"), part(5).alias("request_id"),
        )
    )


def canonical_json(rows: DataFrame) -> DataFrame:
    """Canonical rows from JSON logs with the canonical names; missing ones are null. An extension."""
    have = {f.name: f.dataType for f in rows.schema.fields}
    kinds = {"ts": T.TimestampType(), "status": T.IntegerType(), "bytes_out": T.LongType(), "bytes_in": T.LongType()}
    out = [(F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, T.StringType())).alias(c) for c in COLUMNS]
    return dedupe(rows.select(*out))


PARSERS = {"gcs": canonical_gcs, "s3": canonical_s3, "r2": canonical_json}


def parser_for(store: str):
    """The parser of a store; an unknown one raises."""
    if store not in PARSERS:
        raise ValueError(f"no access log parser for {store!r}; known: {sorted(PARSERS)}")
    return PARSERS[store]
