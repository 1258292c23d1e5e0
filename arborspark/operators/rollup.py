"""Listing to path tree: one row per file and directory, with measures of everything below.

Files are summed per parent directory first, which shrinks them to directories before anything is multiplied by depth; each
directory's sums then go to its ancestors by one explode and one aggregation. Counts of subdirectories come from the
directories themselves the same way, so the whole rollup is aggregations without a join, and hot directories (the root above
all) are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.functions.text import epoch_seconds

MAX_PIVOT_VALUES = 32


def pivot_name(column: str, value) -> str:
    return f"sum_{column}_{value}"


def pivot_values(listing: DataFrame, column: str) -> list:
    """The column's values in order; more than 32 raise. The limit is part of the query, so at most 33 values come back."""
    found = sorted(r[0] for r in listing.select(column).filter(F.col(column).isNotNull()).distinct().limit(MAX_PIVOT_VALUES + 1).collect())
    if len(found) > MAX_PIVOT_VALUES:
        raise ValueError(f"{column} has more than {MAX_PIVOT_VALUES} values")
    return found


def _exact(a: Column, b: Column) -> Column:
    """Exact integer product beyond 64 bits."""
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")


def files_of(listing: DataFrame) -> DataFrame:
    """bucket, path, size, mtime and the listing's other columns; rows without a bucket or with an empty canonical path go."""
    rest = [c for c in listing.columns if c not in {"bucket", "name", "size_bytes", "created"}]
    return listing.filter("bucket IS NOT NULL").select(
        "bucket",
        paths.canonical(F.col("name")).alias("path"),
        F.coalesce(F.col("size_bytes"), F.lit(0)).cast("long").alias("size"),
        F.coalesce(epoch_seconds(F.col("created")), F.lit(0)).alias("mtime"),
        *rest,
    ).filter("path <> ''")


def directories(files: DataFrame, pivots: dict[str, list] | None = None, mean_mtime: bool = False) -> DataFrame:
    """bucket, dir (root ``''``), size, mtime, n_files, n_desc, n_children, [pivot sums], [wsum]."""
    sums = {"size": F.sum("size"), "mtime": F.max("mtime"), "n_files": F.count("*")}
    again = {"size": F.sum("size"), "mtime": F.max("mtime"), "n_files": F.sum("n_files"), "direct": F.sum("direct")}
    for column, values in (pivots or {}).items():
        for v in values:
            name = pivot_name(column, v)
            sums[name] = F.sum(F.when(F.col(column) == v, F.col("size")).otherwise(0))
            again[name] = F.sum(name)
    if mean_mtime:
        sums["wsum"] = F.sum(_exact(F.col("mtime"), F.col("size")))
        again["wsum"] = F.sum("wsum").cast("decimal(38,0)")
    leaf = files.groupBy("bucket", paths.parent(F.col("path")).alias("at")).agg(*[c.alias(n) for n, c in sums.items()])
    up = leaf.select("*", F.explode(paths.self_and_ancestors(F.col("at"))).alias("dir"))
    up = up.withColumn("direct", F.when(F.col("dir") == F.col("at"), F.col("n_files")).otherwise(0))
    dirs = up.groupBy("bucket", "dir").agg(*[c.alias(n) for n, c in again.items()])
    # each directory's sums stay with it, and it counts once for every directory above, all from one read of ``dirs``
    names = [n for n in again if n not in ("direct", "mtime")]
    kinds = {f.name: f.dataType for f in dirs.schema.fields}
    sums_of = [*names, "direct", "mtime"]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    own = F.struct(F.col("dir").alias("dir"), *[F.col(n).alias(n) for n in sums_of], none.alias("n_sub"), none.alias("kids"))
    at = paths.parent(F.col("dir"))
    of_above = F.transform(
        paths.ancestors(F.col("dir")),
        lambda a: F.struct(a.alias("dir"), *[F.lit(None).cast(kinds[n]).alias(n) for n in sums_of], one.alias("n_sub"), F.when(a == at, one).otherwise(none).alias("kids")),
    )
    spread = dirs.select("bucket", F.inline(F.concat(F.array(own), of_above)))
    whole = spread.groupBy("bucket", "dir").agg(F.max("mtime").alias("mtime"), *[F.sum(n).alias(n) for n in [*names, "direct", "n_sub", "kids"]])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select(
        "bucket", "dir", "size", F.greatest("mtime", F.lit(0)).cast("long").alias("mtime"),
        (F.col("n_files") + zero("n_sub") + 1).alias("n_desc"), "n_files", (F.col("direct") + zero("kids")).alias("n_children"),
        *[n for n in names if n not in ("size", "n_files")],
    )


def rollup(
    listing: DataFrame,
    scheme: str = "gcs",
    pivots: Sequence[str] = (),
    mean_mtime: bool = False,
    bucket: str | None = None,
) -> DataFrame:
    """The published tree: bucket, path, size, mtime, n_desc, n_files, n_children, kind, parent, [sums], [mtime_mean], uri, depth.

    With ``bucket`` only that bucket is rolled up; an empty one raises when the tree is computed elsewhere (``require_rows``).
    """
    if bucket is not None:
        listing = listing.filter(F.col("bucket") == bucket)
    values = {c: pivot_values(listing, c) for c in pivots}
    files = files_of(listing)
    dirs = directories(files, values, mean_mtime)
    extras = [(pivot_name(c, v), c, v) for c, vs in values.items() for v in vs]
    root = F.concat(F.lit(scheme + "://"), F.col("bucket"))

    def publish(rows: DataFrame, path: str, is_dir: bool, own: list[Column]) -> DataFrame:
        p = F.col(path)
        return rows.select(
            "bucket", paths.published(p).alias("path"), "size", "mtime", "n_desc", "n_files", "n_children",
            F.lit("dir" if is_dir else "file").alias("kind"), paths.published_parent(p, F.lit(is_dir)).alias("parent"), *own,
            paths.uri(root, p).alias("uri"), paths.depth(p).alias("depth"),
        )

    of_dirs = [F.col(n) for n, _, _ in extras]
    of_files = [F.when(F.col(c) == v, F.col("size")).otherwise(0).cast("long").alias(n) for n, c, v in extras]
    if mean_mtime:
        mean = F.when(F.col("size") != 0, F.col("wsum").cast("double") / F.col("size").cast("double"))
        of_dirs.append(mean.alias("mtime_mean"))
        of_files.append(F.col("mtime").cast("double").alias("mtime_mean"))
    one = F.lit(1).cast("long")
    rows = files.select("*", one.alias("n_desc"), one.alias("n_files"), F.lit(0).cast("long").alias("n_children"))
    return publish(dirs, "dir", True, of_dirs).unionByName(publish(rows, "path", False, of_files))


def in_order(tree: DataFrame) -> DataFrame:
    """The written order: depth, path, directories before files."""
    keys = (["bucket"] if "bucket" in tree.columns else []) + ["depth", "path", "kind"]
    return tree.orderBy(*keys)


def walk_rollup(entries: DataFrame, root: str) -> DataFrame:
    """Tree of a walk (path, size, mtime, kind, with real directory rows whose own size counts); an empty walk gives the root."""
    files = entries.filter("kind = 'file'").select(F.lit("").alias("bucket"), "path", "size", "mtime")
    dirs = entries.filter("kind = 'dir'")
    own = dirs.select("path", F.col("size").alias("own"), F.col("mtime").alias("own_mtime"))
    sums = (
        files.select(paths.parent(F.col("path")).alias("at"), "size", "mtime", F.lit(1).alias("f"), F.lit(0).alias("d"))
        .unionByName(own.filter("path <> ''").select(paths.parent(F.col("path")).alias("at"), F.col("own").alias("size"), F.col("own_mtime").alias("mtime"), F.lit(0).alias("f"), F.lit(1).alias("d")))
        .select("*", F.explode(paths.self_and_ancestors(F.col("at"))).alias("path"))
        .groupBy("path")
        .agg(
            F.sum("size").alias("below"), F.max("mtime").alias("mtime_below"), F.sum("f").alias("n_files"), F.sum("d").alias("n_sub"),
            F.sum((F.col("at") == F.col("path")).cast("long")).alias("n_children"),
        )
    )
    known = own.select("path").unionByName(sums.select("path")).unionByName(entries.sparkSession.range(1).select(F.lit("").alias("path"))).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    tree = known.join(own, "path", "left").join(sums, "path", "left").select(
        "path", (zero("below") + zero("own")).alias("size"), F.greatest(zero("mtime_below"), zero("own_mtime")).alias("mtime"),
        (zero("n_files") + zero("n_sub") + 1).alias("n_desc"), zero("n_files").alias("n_files"), zero("n_children").alias("n_children"), F.lit("dir").alias("kind"),
    )
    one = F.lit(1).cast("long")
    rows = tree.unionByName(files.select("path", "size", "mtime", one.alias("n_desc"), one.alias("n_files"), F.lit(0).cast("long").alias("n_children"), F.lit("file").alias("kind")))
    p = F.col("path")
    return rows.select(
        paths.published(p).alias("path"), "size", "mtime", "n_desc", "n_files", "n_children", "kind",
        paths.published_parent(p, F.col("kind") == "dir").alias("parent"), paths.uri(F.lit(root), p).alias("uri"), paths.depth(p).alias("depth"),
    )


def require_rows(listing: DataFrame, bucket: str) -> DataFrame:
    """The bucket's rows; raises if there are none."""
    rows = listing.filter(F.col("bucket") == bucket)
    if not rows.limit(1).count():
        raise ValueError(f"no objects in bucket {bucket!r}")
    return rows


def prefix_weights(listing: DataFrame) -> DataFrame:
    """bucket, prefix, n: objects under each prefix of one and two components."""
    one = paths.component(F.col("name"), 1)
    two = paths.component(F.col("name"), 2)
    slashes = F.length("name") - F.length(F.replace(F.col("name"), F.lit("/")))
    found = F.array_compact(
        F.array(F.when(slashes >= 1, F.concat(one, F.lit("/"))), F.when(slashes >= 2, F.concat(one, F.lit("/"), two, F.lit("/"))))
    )
    return listing.select("bucket", F.explode(found).alias("prefix")).groupBy("bucket", "prefix").agg(F.count("*").alias("n"))


def duplicate_keys(listing: DataFrame) -> DataFrame:
    """bucket, name, n of keys listed more than once."""
    return listing.groupBy("bucket", "name").agg(F.count("*").alias("n")).filter("n > 1")


def key_audit(listing: DataFrame) -> DataFrame:
    """bucket, n_rows, n_keys, n_surplus: counted through the groups of keys, so that distinct keys of a hot bucket are spread."""
    per_key = listing.groupBy("bucket", "name").agg(F.count("*").alias("n"))
    return per_key.groupBy("bucket").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_surplus")
    )
