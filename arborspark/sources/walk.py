"""Walks as text dumps: ``find -printf '%y %b %T@ %p\\0'`` and object ``ls --recursive`` output. Lines that do not parse are errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIND = r"(?s)^([a-zA-Z]) (\d+) (-?\d+)(?:\.\d+)? (?:\./?)?(.*)$"
LS = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) +(\d+) (.+)$"


@dataclass(frozen=True)
class Walk:
    """entries (path, size, mtime, kind) and errors (value)."""

    entries: DataFrame
    errors: DataFrame


def read_find_dump(spark: SparkSession, path: str) -> Walk:
    """Kinds d and f; sizes are blocks of 512 bytes."""
    lines = spark.read.text(path, lineSep="\0").filter("trim(value) <> ''")
    part = lambda k: F.regexp_extract("value", FIND, k)
    good = lines.filter(F.col("value").rlike(FIND))
    entries = good.filter(part(1).isin("d", "f")).select(
        part(4).alias("path"), (part(2).cast("long") * 512).alias("size"), part(3).cast("long").alias("mtime"), F.when(part(1) == "d", "dir").otherwise("file").alias("kind")
    )
    return Walk(entries, lines.filter(~F.col("value").rlike(FIND)))


def read_object_ls(spark: SparkSession, path: str) -> Walk:
    """Objects; directories follow from their keys in the rollup. Summary lines are no errors."""
    lines = spark.read.text(path).filter("trim(value) <> '' AND NOT value RLIKE '^ *Total (Objects|Size):'")
    part = lambda k: F.regexp_extract("value", LS, k)
    good = lines.filter(F.col("value").rlike(LS))
    entries = good.select(part(3).alias("path"), part(2).cast("long").alias("size"), F.unix_timestamp(part(1), "yyyy-MM-dd HH:mm:ss").alias("mtime"), F.lit("file").alias("kind"))
    return Walk(entries, lines.filter(~F.col("value").rlike(LS)))
