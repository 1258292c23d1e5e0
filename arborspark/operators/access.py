"""Access rollup: canonical rows to daily sums per path, operation and every directory above."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions import paths


def leaf_rollup(rows: DataFrame, by_bucket: bool = False) -> DataFrame:
    """path, day, op: n_ops, bytes_out, bytes_in, n_requesters (distinct)."""
    keys = (["bucket"] if by_bucket else []) + ["path", "day", "op"]
    named = rows.withColumn("path", paths.canonical(F.coalesce("path", F.lit("")))).withColumn("day", F.to_date("ts"))
    per = named.groupBy(*keys, "requester").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("o"), F.sum("bytes_in").alias("i"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("n_ops"), F.sum("o").alias("bytes_out"), F.sum("i").alias("bytes_in"), F.count("requester").alias("n_requesters")
    )


def rollup(leaf: DataFrame) -> DataFrame:
    """path, parent, depth, kind, day, op and the sums, for paths and all directories above. A parent's n_requesters is the
    sum of its parts, an upper bound; a path with operations of its own is a file."""
    keys = (["bucket"] if "bucket" in leaf.columns else []) + ["path", "day", "op"]
    own = F.col("path") == F.col("leaf")
    spread = leaf.withColumnRenamed("path", "leaf").select("*", F.explode(paths.self_and_ancestors(F.col("leaf"))).alias("path"))
    sums = spread.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_ops", "bytes_out", "bytes_in", "n_requesters")], F.max(own.cast("int")).alias("own")
    )
    # kind belongs to the path, over all days and operations
    group = [k for k in keys if k not in ("day", "op")]
    kinds = sums.groupBy(*group).agg(F.max("own").alias("is_leaf"))
    p = F.col("path")
    rest = [F.col(k) for k in keys if k not in ("path", "day", "op")]
    return sums.join(kinds, group).select(
        *rest, paths.published(p).alias("path"), F.when((paths.parent(p) == "") & (p != ""), ".").otherwise(paths.parent(p)).alias("parent"),
        paths.depth(p).alias("depth"), F.when((F.col("is_leaf") == 1) & (p != ""), "file").otherwise("dir").alias("kind"), "day", "op",
        "n_ops", "bytes_out", "bytes_in", "n_requesters",
    )


def requester_sketches(rows: DataFrame) -> DataFrame:
    """path, approx_requesters: distinct requesters of every directory from mergeable sketches. An extension."""
    leaf = rows.groupBy(paths.canonical(F.col("path")).alias("leaf")).agg(F.hll_sketch_agg("requester").alias("s"))
    up = leaf.select(F.explode(paths.self_and_ancestors(F.col("leaf"))).alias("path"), "s")
    return up.groupBy("path").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("approx_requesters"))


def hot_prefixes(tree: DataFrame, depth: int | None = None, op: str | None = None, sort_by: str = "bytes_out", limit: int = 20) -> DataFrame:
    """The hottest (path, op): sums over days, the largest n_requesters of a day."""
    rows = tree
    if depth is not None:
        rows = rows.filter(F.col("depth") == depth)
    if op is not None:
        rows = rows.filter(F.col("op") == op)
    sums = rows.groupBy("path", "op").agg(
        F.sum("n_ops").alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in"), F.max("n_requesters").alias("n_requesters")
    )
    return sums.orderBy(F.col(sort_by).desc(), "path", "op").limit(limit)


def write_layer(tree: DataFrame, out: str) -> None:
    """The access tree as Parquet, dealt by range of and sorted by depth, path, day and operation."""
    keys = ["depth", "path", "day", "op"]
    tree.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(out)
