"""Queries on one tree: children, drill views with ancestor closure, expansion of single children, patching, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions import paths


def at_depth(tree: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    rows = tree if low is None else tree.filter(F.col("depth") >= low)
    return rows if high is None else rows.filter(F.col("depth") <= high)


def subtree(tree: DataFrame, top: str) -> DataFrame:
    """``top`` and all below. The depth that follows from the path prunes files sorted by depth."""
    rows = tree.filter(paths.in_subtree(F.col("path"), top))
    return rows if top in ("", ".") else rows.filter(F.col("depth") >= top.count("/") + 1)


def children(tree: DataFrame, top: str = ".") -> DataFrame:
    """Direct children of a directory, largest first."""
    if top == ".":
        rows = tree.filter("depth = 1 AND (parent = '.' OR (parent = '' AND path <> '.'))")
    else:
        rows = tree.filter((F.col("parent") == top) & (F.col("depth") == top.count("/") + 2))
    return rows.orderBy(F.col("size").desc(), "path", "kind")


def view(tree: DataFrame, top: str) -> DataFrame:
    """The subtree with paths, parents and depths relative to ``top``."""
    rows = subtree(tree, top)
    if top in ("", "."):
        return rows
    base = top.count("/") + 1
    rel = paths.rebase(F.col("path"), top)
    up = F.when(F.col("path") == top, "").when(F.col("parent") == top, ".").otherwise(paths.rebase(F.col("parent"), top))
    return rows.withColumns({"path": rel, "parent": up, "depth": F.col("depth") - base})


def key_range(listing: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows with low <= name < high; None is open."""
    rows = listing if low is None else listing.filter(F.col("name") >= low)
    return rows if high is None else rows.filter(F.col("name") < high)


def monotonic_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``rows`` with the number of their run, from 0: in ``order`` inside ``by`` a new run begins where ``value`` falls. A diagnosis of files that should
    be sorted: ``by`` is the file."""
    w = Window.partitionBy(by).orderBy(order)
    falls = (F.col(value) < F.lag(value).over(w)).cast("int")
    return rows.withColumn("_falls", F.coalesce(falls, F.lit(0))).withColumn("run", F.sum("_falls").over(w)).drop("_falls")


def maximal_matches(tree: DataFrame, pattern: str) -> DataFrame:
    """bucket, path, size of the directories whose name matches a regular expression and that lie in no other such directory."""
    hits = tree.filter((F.col("kind") == "dir") & (F.col("path") != ".") & paths.basename(F.col("path")).rlike(pattern)).select("bucket", "path", "size")
    above = hits.select("bucket", "path", F.explode(paths.ancestors(F.col("path"))).alias("up"))
    inside = above.join(hits.select("bucket", F.col("path").alias("up")), ["bucket", "up"]).select("bucket", "path").distinct()
    return hits.join(inside, ["bucket", "path"], "left_anti")


def drill(tree: DataFrame, top: str = ".", depth: int = 2, max_rows: int = 2000) -> DataFrame:
    """The view down to ``depth`` levels, cut to its ``max_rows`` largest rows plus everything above them. The limit is the view's page size."""
    base = 0 if top in ("", ".") else top.count("/") + 1
    rows = view(at_depth(tree, high=base + depth), top)
    largest = rows.orderBy(F.col("size").desc(), "path", "kind").limit(max_rows)
    kept = largest.select("path", "kind")
    above = largest.select(F.explode(paths.self_and_ancestors(F.col("path"))).alias("p")).select(F.when(F.col("p") == "", ".").otherwise(F.col("p")).alias("path"))
    closure = above.select("path", F.lit("dir").alias("kind")).unionByName(kept).distinct()
    return rows.join(closure, ["path", "kind"], "left_semi")


def single_chains(tree: DataFrame) -> DataFrame:
    """path, end, n_collapsed: for directories with one child, that is a directory, the last directory of the chain. Every directory
    finds the longest run of ancestors with a single child by one explode, not by walking the chain step by step."""
    dirs = tree.filter("kind = 'dir'").select("path", "n_children")
    single = dirs.filter("n_children = 1 AND path <> '.'").select(F.col("path").alias("up"))
    below = dirs.filter("path <> '.'").select(F.col("path").alias("end"), F.explode(paths.ancestors(F.col("path"))).alias("up")).filter("up <> ''")
    runs = below.join(single, "up").groupBy("end").agg(F.collect_set("up").alias("ups"))
    # an ancestor starts a chain to ``end`` if all directories from it down to the end's parent have a single child
    depths = runs.select("end", F.array_sort(F.transform("ups", lambda u: F.struct(paths.depth(u).alias("d"), u.alias("p")))).alias("ups"), paths.depth(F.col("end")).alias("d"))
    starts = depths.select("end", F.explode("ups").alias("s"), "d", "ups").filter(
        F.size(F.filter("ups", lambda u: u["d"] >= F.col("s.d"))) == F.col("d") - F.col("s.d")
    )
    best = starts.groupBy(F.col("s.p").alias("path")).agg(F.max(F.struct("d", "end")).alias("b"), F.first("s.d").alias("sd"))
    return best.select("path", F.col("b.end").alias("end"), (F.col("b.d") - F.col("sd")).cast("int").alias("n_collapsed"))


def patch_fresher(view_rows: DataFrame, view_time, registry: DataFrame) -> DataFrame:
    """Rows of a view whose URI has a scan of its own that is newer than the view take that scan's stats; ``patched`` tells."""
    newer = registry.filter(F.col("time") > F.lit(view_time).cast("timestamp"))
    best = newer.groupBy(F.col("path").alias("uri")).agg(F.max(F.struct("time", "id", "size", "n_children", "n_desc", "mtime")).alias("n"))
    own = [c for c in view_rows.columns if c not in ("size", "n_children", "n_desc", "mtime")]
    fresh = [F.coalesce(F.col(f"n.{c}"), F.col(c)).alias(c) for c in ("size", "n_children", "n_desc", "mtime")]
    return view_rows.join(best, "uri", "left").select(*own, *fresh, F.col("n").isNotNull().alias("patched"))


def scanned_state(listing: DataFrame, registry: DataFrame, base: str) -> DataFrame:
    """Live children (uri) with scanned = true (own scan), partial (a scan below) or false, newest stats beside, ordered for display."""
    exact = registry.groupBy(F.col("path").alias("uri")).agg(F.max(F.struct("time", "id", "size")).alias("e"))
    rest = F.substr(F.col("path"), F.lit(len(base) + 2))
    below = registry.filter(F.col("path").startswith(base + "/") & rest.contains("/")).select(
        F.concat(F.lit(base + "/"), F.substring_index(rest, "/", 1)).alias("uri")
    ).distinct().withColumn("some", F.lit(True))
    state = F.when(F.col("e").isNotNull(), "true").when(F.col("some"), "partial").otherwise("false")
    rows = listing.join(exact, "uri", "left").join(below, "uri", "left").select(*listing.columns, state.alias("scanned"), F.col("e.size").alias("scan_size"))
    return rows.orderBy(F.when(F.col("scanned") == "true", 0).when(F.col("scanned") == "partial", 1).otherwise(2), F.col("scan_size").desc_nulls_last(), "uri")


def delete(tree: DataFrame, top: str, self_counted: bool = True) -> DataFrame:
    """The tree without ``top`` and what is below, ancestors reduced. ``self_counted`` says whether n_desc counts the row itself."""
    lost = tree.filter(F.col("path") == top).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "n_desc", "n_files")], F.count("*").alias("n_rows")
    ).first()  # one row of four numbers
    parts = top.split("/")
    above = [".", *("/".join(parts[:k]) for k in range(1, len(parts)))]
    hit = F.col("path").isin(above) & (F.col("kind") == "dir")
    minus = lambda c, n: F.when(hit, F.col(c) - F.lit(n)).otherwise(F.col(c)).alias(c)
    n_desc = lost.n_desc if self_counted else lost.n_desc + lost.n_rows
    kids = F.when((F.col("path") == above[-1]) & (F.col("kind") == "dir"), F.col("n_children") - F.lit(lost.n_rows)).otherwise(F.col("n_children"))
    fresh = {"size": minus("size", lost['size']), "n_desc": minus("n_desc", n_desc), "n_files": minus("n_files", lost.n_files), "n_children": kids}
    return tree.filter(~paths.in_subtree(F.col("path"), top)).withColumns(fresh)


def virtual_root(rows: DataFrame) -> DataFrame:
    """One root over scanned children."""
    return rows.agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.sum("n_desc").alias("n_desc"), F.count("*").alias("n_children"))


def unaccounted(tree: DataFrame, floor: int = 1_000_000) -> DataFrame:
    """parent, size of what directories hold beyond their shown children, where that is more than ``floor``."""
    kids = tree.filter("path <> '.'").groupBy(F.when(F.col("parent") == "", ".").otherwise(F.col("parent")).alias("path")).agg(F.sum("size").alias("shown"))
    return tree.filter("kind = 'dir'").join(kids, "path").select(F.col("path").alias("parent"), (F.col("size") - F.col("shown")).alias("size")).filter(F.col("size") > floor)


def search(tree: DataFrame, text: str) -> DataFrame:
    """Rows whose path has ``text``, whatever the case."""
    return tree.filter(F.lower("path").contains(text.lower()))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    return rows.offset(number * size).limit(size)
