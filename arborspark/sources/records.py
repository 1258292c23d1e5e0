"""Records beside data: artifact bodies, executor sidecars, run configurations, media files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A storage path in text (fixed value).
STORE_PATH = r"gs://[A-Za-z0-9._-]+(?:/[^\s\"',;)\]}]*)?"
PAIRS = "array<struct<key:string,path:string>>"


def read_bodies(spark: SparkSession, glob: str) -> DataFrame:
    """path, body of whole small files."""
    return spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def store_paths(text: Column) -> Column:
    """All storage paths in a text."""
    return F.regexp_extract_all(text, F.lit(f"({STORE_PATH})"), F.lit(1))


def walk_json(body: Column) -> Column:
    """Storage paths anywhere in a JSON document, each with the nearest key above it: the one recursive step without a built-in function,
    done for batches."""

    @F.pandas_udf(PAIRS)
    def walk(bodies):
        def visit(value, key):
            if isinstance(value, dict):
                for k, v in value.items():
                    yield from visit(v, k)
            elif isinstance(value, list):
                for v in value:
                    yield from visit(v, key)
            elif isinstance(value, str) and value.startswith("gs://"):
                yield {"key": key, "path": value}

        def one(text):
            try:
                return list(visit(json.loads(text), ""))
            except (TypeError, ValueError):
                return []

        return bodies.map(one)

    return walk(body)


def sidecars(rows: DataFrame) -> DataFrame:
    """path, name, output_path, error from executor sidecars (path, body)."""
    parsed = F.try_parse_json(F.coalesce("body", F.lit("")))
    get = lambda k: F.try_variant_get(parsed, f"$.{k}", "string")
    return rows.select("path", get("name").alias("name"), get("output_path").alias("output_path"), F.when(parsed.isNull(), "unreadable").alias("error"))


def dedupe_runs(runs: DataFrame) -> DataFrame:
    """One row per (project, run_id)."""
    return runs.dropDuplicates(["project", "run_id"])


def media_groups(files: DataFrame) -> DataFrame:
    """Media files (path, size) named ``<timestamp>_<index>.<ext>``: per timestamp and index the largest stays, the others are extras."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    parts = files.select("path", "size", F.regexp_extract(name, r"^(.+)_(\d+)\.[^.]+$", 1).alias("stamp"), F.regexp_extract(name, r"^(.+)_(\d+)\.[^.]+$", 2).alias("idx"))
    named = parts.filter("stamp <> ''")
    best = named.groupBy("stamp", "idx").agg(F.max(F.struct("size", "path")).alias("b"))
    return named.join(best, ["stamp", "idx"]).select("path", "stamp", F.col("idx").cast("int").alias("idx"), "size", (F.col("path") != F.col("b.path")).alias("extra"))
