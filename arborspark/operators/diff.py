"""Differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(a: DataFrame, b: DataFrame, depth: int = 1, unchanged: bool = False, kinds: bool = False) -> DataFrame:
    """Rows at exactly ``depth`` of both views (path, kind, size, n_desc), by path: status, the sizes and the deltas, largest change first."""
    keys = ["path", "kind"] if kinds else ["path"]

    def side(tree: DataFrame, name: str) -> DataFrame:
        rows = tree.filter(F.col("depth") == depth)
        return rows.groupBy(*keys).agg(F.sum("size").alias(f"size_{name}"), F.sum("n_desc").alias(f"n_desc_{name}"))

    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (
        F.when(F.col("size_a").isNull(), "added")
        .when(F.col("size_b").isNull(), "removed")
        .when((F.col("size_a") != F.col("size_b")) | (F.col("n_desc_a") != F.col("n_desc_b")), "changed")
        .otherwise("unchanged")
    )
    rows = both.select(
        *keys, status.alias("status"), "size_a", "size_b", (zero("size_b") - zero("size_a")).alias("size_delta"),
        (zero("n_desc_b") - zero("n_desc_a")).alias("n_desc_delta"),
    )
    if not unchanged:
        rows = rows.filter("status <> 'unchanged'")
    return rows.orderBy(F.abs("size_delta").desc(), *keys)


def totals(diff: DataFrame) -> DataFrame:
    """status, n, size_delta."""
    return diff.groupBy("status").agg(F.count("*").alias("n"), F.sum("size_delta").alias("size_delta"))


def tree_compare(a: DataFrame, b: DataFrame, depth: int, top: int) -> DataFrame:
    """Leading paths by change of bytes between two flat trees (path, depth, objects, bytes), and TOTAL over all paths."""
    sides = [
        t.filter(F.col("depth") == depth).groupBy("path").agg(F.sum("objects").alias(f"objects_{n}"), F.sum("bytes").alias(f"bytes_{n}"))
        for t, n in ((a, "a"), (b, "b"))
    ]
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("objects_a", "objects_b", "bytes_a", "bytes_b")]
    both = sides[0].join(sides[1], "path", "full_outer").select("path", *zero)
    delta = both.select("*", (F.col("objects_b") - F.col("objects_a")).alias("objects_delta"), (F.col("bytes_b") - F.col("bytes_a")).alias("bytes_delta"))
    largest = delta.orderBy(F.abs("bytes_delta").desc(), "path").limit(top)
    total = delta.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in delta.columns[1:]]).select(F.lit("TOTAL").alias("path"), *delta.columns[1:])
    return largest.unionByName(total)
