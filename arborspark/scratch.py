"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    Only a local master without that setting falls back to a folder of its own; on a cluster a missing
    setting is an error, since no other folder is known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), "arborspark-shared")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def home(spark: SparkSession) -> str:
    """This application's own folder under the shared one."""
    return f"{shared_dir(spark)}/arborspark/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder."""
    return f"{home(spark)}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove everything that this application wrote to the shared folder; frames that read it are void then."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there and lost
    executors lose nothing."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, columns: Iterable[str]) -> str:
    """``name`` with as many underscores as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranged(df: DataFrame, *order: Column, part: str, start: str) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt by range of the order and written once, with its range's number in ``part``; and one row per range with the number of
    rows before it in ``start``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranged")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)  # over as many rows as ranges
    counts = dealt.groupBy(part).agg(F.count("*").alias(start))
    return dealt, counts.select(part, F.col(start).alias("n"), (F.sum(start).over(before) - F.col(start)).alias(start))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with its place from 0 in that order. No task sees more than a range (and one row per range)."""
    part, start = (free_name(x, [*df.columns, name]) for x in ("_part", "_start"))
    dealt, starts = ranged(df, *order, part=part, start=start)
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, inside).join(F.broadcast(starts.drop("n")), part).select(*df.columns, (F.col(name) + F.col(start) - 1).alias(name))
