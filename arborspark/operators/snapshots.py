"""Snapshots of trees and their registry: (id, path, time, size, ...) rows, one per stored tree."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.operators import tree_query
from arborspark.scratch import materialize

REGISTRY = (
    "id int, path string, time timestamp, blob string, error_count int, error_paths string, size long, n_children long, n_desc long, mtime long"
)


def latest(registry: DataFrame) -> DataFrame:
    """Newest scans per path; ties stay."""
    w = Window.partitionBy("path").orderBy(F.col("time").desc())
    return registry.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def newest(registry: DataFrame, uri: str, n: int = 2) -> DataFrame:
    """The n newest scans of a URI, newest first."""
    return registry.filter(F.col("path") == uri).orderBy(F.col("time").desc(), F.col("id").desc()).limit(n)


def uri_ancestors(uri: Column) -> Column:
    """A URI and everything above it down to scheme://bucket."""
    scheme, rest = F.substring_index(uri, "://", 1), F.substring_index(uri, "://", -1)
    above = F.filter(paths.self_and_ancestors(rest), lambda p: p != "")
    return F.transform(above, lambda p: F.concat(scheme, F.lit("://"), p))


def covering(uris: DataFrame, registry: DataFrame) -> DataFrame:
    """For every row of ``uris`` (uri) the newest scan of it or of anything above: uri, id, scan_path, time, rel_path."""
    asked = uris.select("uri", F.explode(uri_ancestors(F.col("uri"))).alias("path"))
    found = asked.join(registry.select("id", "path", "time"), "path")
    best = found.groupBy("uri").agg(F.max(F.struct("time", F.length("path").alias("n"), "id", "path")).alias("b"))
    return best.select("uri", F.col("b.id").alias("id"), F.col("b.path").alias("scan_path"), F.col("b.time").alias("time"), relative(F.col("uri"), F.col("b.path")).alias("rel_path"))


def relative(uri: Column, scan_path: Column) -> Column:
    """A URI's path inside a scan, ``'.'`` for the scan's own root."""
    return F.when(uri == scan_path, ".").otherwise(F.substr(uri, F.length(scan_path) + 2))


def history(uris: DataFrame, registry: DataFrame, trees: DataFrame) -> DataFrame:
    """Every scan that covers a URI, with the URI's stats in it; ``trees`` has scan_id, path, size, n_desc, n_children, mtime."""
    asked = uris.select("uri", F.explode(uri_ancestors(F.col("uri"))).alias("path"))
    scans = asked.join(registry.select("id", "path", "time"), "path").select(
        "uri", F.col("id").alias("scan_id"), "time", F.col("path").alias("scan_path"), relative(F.col("uri"), F.col("path")).alias("rel_path")
    )
    stats = trees.select("scan_id", F.col("path").alias("rel_path"), "size", "n_desc", "n_children", "mtime", "kind")
    dirs_first = stats.groupBy("scan_id", "rel_path").agg(F.min(F.struct("kind", "size", "n_desc", "n_children", "mtime")).alias("s"))
    return scans.join(dirs_first, ["scan_id", "rel_path"]).select("uri", "scan_id", "time", "scan_path", "rel_path", "s.size", "s.n_desc", "s.n_children", "s.mtime")


def root_stats(tree: DataFrame) -> DataFrame:
    return tree.filter("path = '.'").select("uri", "size", "mtime", "n_desc", "n_files", "n_children")


def storage_stats(trees: DataFrame) -> DataFrame:
    """n_scans, n_rows, total_size over stored trees (scan_id, size)."""
    per = trees.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    return per.agg(F.count("*").alias("n_scans"), F.sum("n").alias("n_rows"), F.sum("s").alias("total_size"))


def chunk_stats(tree: DataFrame, threshold: int = 100_000, nested: bool = False) -> DataFrame:
    """Top-level directories of at least ``threshold`` descendants: the chunks a store keeps apart. With ``nested`` also the chunks inside chunks,
    each with the chunk that holds it (a directory above a chunk is one, since it has more descendants)."""
    rows = tree.filter((F.col("depth") >= 1) & (F.col("kind") == "dir") & (F.col("n_desc") >= threshold))
    if not nested:
        return rows.filter("depth = 1").select("path", "size", "n_desc", "n_children")
    return rows.select("path", F.when(F.col("depth") > 1, F.col("parent")).alias("chunk"), "size", "n_desc", "n_children")


def bucket_list(buckets: DataFrame, registry: DataFrame, scheme: str = "gcs") -> DataFrame:
    """name, created and of the newest scan of the bucket or of anything in it time, size, n_children, n_desc. Scanned buckets come first, the
    largest before, then the others by name."""
    inside = F.substring_index(F.substring_index("path", "://", -1), "/", 1)
    own = registry.filter(F.col("path").startswith(f"{scheme}://")).select(inside.alias("name"), F.struct("time", "id", "size", "n_children", "n_desc").alias("s"))
    last = own.groupBy("name").agg(F.max("s").alias("s"))
    rows = buckets.join(last, "name", "left").select("name", "created", F.col("s.time").alias("last_scanned"), "s.size", "s.n_children", "s.n_desc")
    return rows.orderBy(F.col("size").isNull(), F.col("size").desc(), "name")


def selection_totals(buckets: DataFrame) -> DataFrame:
    """n, n_scanned, size, n_desc over chosen rows of a bucket list."""
    return buckets.agg(F.count("*").alias("n"), F.count("size").alias("n_scanned"), F.sum("size").alias("size"), F.sum("n_desc").alias("n_desc"))


def expired(registry: DataFrame, cutoff) -> DataFrame:
    """Scans older than the cut-off."""
    return registry.filter(F.col("time") < cutoff)


class Store:
    """Trees as Parquet under ``path/scan_id=<id>``, ranges of (depth, path) sorted inside, and the registry beside them. A scan
    is immutable; a write is atomic by Spark's commit protocol."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, tree: DataFrame, scan_id: int, uri: str, time, partitions: int | None = None, if_exists: str = "errorifexists") -> None:
        keys = (["bucket"] if "bucket" in tree.columns else []) + ["depth", "path"]
        tree = materialize(tree, "tree")  # ranges are sampled before rows are dealt; the tree is made once for both
        ranged = tree.repartitionByRange(partitions, *keys) if partitions else tree.repartitionByRange(*keys)
        ranged.sortWithinPartitions(*keys, "kind").write.mode(if_exists).parquet(f"{self.path}/trees/scan_id={scan_id}")
        self._register(scan_id, uri, time, f"scan_id={scan_id}", if_exists)

    def adopt(self, location: str, scan_id: int, uri: str, time) -> None:
        """Register a finished tree in Parquet where it lies. Of its rows only the roots are read."""
        self._register(scan_id, uri, time, location, "errorifexists")

    def _register(self, scan_id: int, uri: str, time, blob: str, if_exists: str) -> None:
        roots = self._read(blob).filter("path = '.' AND depth = 0")  # one per bucket
        sums = roots.agg(F.sum("size").alias("size"), F.sum("n_children").alias("n_children"), F.sum("n_desc").alias("n_desc"), F.max("mtime").alias("mtime"))
        row = sums.select(
            F.lit(scan_id).cast("int").alias("id"), F.lit(uri).alias("path"), F.lit(time).cast("timestamp").alias("time"), F.lit(blob).alias("blob"),
            F.lit(0).cast("int").alias("error_count"), F.lit("[]").alias("error_paths"), "size", "n_children", "n_desc", "mtime",
        )
        row.coalesce(1).write.mode(if_exists).parquet(f"{self.path}/registry/scan={scan_id}")

    def _read(self, blob: str) -> DataFrame:
        return self.spark.read.parquet(blob if "/" in blob else f"{self.path}/trees/{blob}")

    def _at(self, part: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def scan_of(self, uri: str):
        """The registry row of the newest scan of a URI, None if there is none."""
        return newest(self.registry(), uri, 1).first()

    def load_or_create(self, uri: str, make: Callable[[], DataFrame], time=None) -> DataFrame:
        """The newest stored tree of a URI; without one it is made, stored and registered first."""
        found = self.scan_of(uri)
        if found is None:
            number = max(self.scans(), default=0) + 1
            self.save(make(), number, uri, time or datetime.datetime.now(datetime.timezone.utc))
            found = self.scan_of(uri)
        return self._read(found.blob)

    def delete(self, uri: str) -> int | None:
        """Take a URI out of the newest scan that covers it: the tree without it is stored as a scan of the same URI and time in its place, with the
        registry's sums; scans of the URI itself and of what lies below go. The new scan's id, None without a covering scan. The old scan
        goes last: until then the new one, with the larger id, is the newest of its time."""
        found = covering(self.spark.createDataFrame([(uri,)], "uri string"), self.registry()).first()
        below = [r.id for r in self.registry().filter((F.col("path") == uri) | F.col("path").startswith(uri + "/")).select("id").collect()]
        number = None
        if found is not None and found.rel_path != ".":
            number = max(self.scans()) + 1
            self.save(tree_query.delete(self.load(found.id), found.rel_path), number, found.scan_path, found.time)
            self.drop(found.id)
        for scan in below:
            self.drop(scan)
        return number

    def collect_garbage(self, cutoff) -> list[int]:
        """Drop the scans before the cut-off; their ids."""
        gone = sorted(r.id for r in expired(self.registry(), F.lit(cutoff).cast("timestamp")).select("id").collect())
        for scan in gone:
            self.drop(scan)
        return gone

    def registry(self) -> DataFrame:
        at, fs = self._at(f"{self.path}/registry")
        if not fs.exists(at):
            return self.spark.createDataFrame([], REGISTRY)
        return self.spark.read.schema(REGISTRY).option("basePath", f"{self.path}/registry").option("recursiveFileLookup", "true").parquet(f"{self.path}/registry")

    def load(self, scan_id: int, min_depth: int | None = None, max_depth: int | None = None) -> DataFrame:
        """A tree; the depth range reaches the files' statistics."""
        row = self.registry().filter(F.col("id") == scan_id).first()
        df = self._read(row.blob if row is not None else f"scan_id={scan_id}")
        if min_depth is not None:
            df = df.filter(F.col("depth") >= min_depth)
        if max_depth is not None:
            df = df.filter(F.col("depth") <= max_depth)
        return df

    def path_stats(self, scan_id: int, path: str) -> DataFrame:
        """One path's rows. Its depth follows from it, which prunes row groups that the path alone would not."""
        d = 0 if path == "." else path.count("/") + 1
        return self.load(scan_id, d, d).filter(F.col("path") == path)

    def scans(self) -> list[int]:
        """Stored scans, newest id first."""
        return [r.id for r in self.registry().select("id").orderBy(F.col("id").desc()).collect()]

    def drop(self, scan_id: int) -> None:
        """Forget a scan and remove its tree; an adopted tree stays where it is."""
        for part in (f"{self.path}/registry/scan={scan_id}", f"{self.path}/trees/scan_id={scan_id}"):
            at, fs = self._at(part)
            fs.delete(at, True)
