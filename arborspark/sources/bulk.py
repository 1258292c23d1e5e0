"""Bulk listing of object stores through a paging client, as Spark tasks over key ranges.

A pager is any picklable callable ``pager(start, end, prefix)`` that yields pages, lists of (name, size, iso time, class), of keys
``start <= name < end`` under ``prefix`` in key order (None is open). Tasks read at most ``max_pages`` of a range and report where they
stopped; what is left is cut at its middle key, or in a range without an end as far again as the reading came, and planned again. So a
hot range spreads over more tasks round by round. ``discover`` finds first boundaries from the directories at the top.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.text import GCS_CLASSES, S3_CLASSES, lookup
from arborspark.operators.planning import key_midpoint, next_prefix, open_split

Page = list[tuple[str, int, str, str]]
Pager = Callable[[str | None, str | None, str], Iterable[Page]]
FOUND = "name string, size_bytes long, time string, class string, seen_from string, left_from string, left_to string"
#: Rows of a shard, and bytes of its row groups.
SHARD_ROWS, ROW_GROUP_BYTES = 1 << 20, 8 << 20


class FakePager:
    """Pages over keys in memory: the paging contract as code, for tests."""

    def __init__(self, objects: Sequence[tuple[str, int, str, str]], page_size: int = 10):
        self.objects, self.page_size = sorted(objects), page_size

    def __call__(self, start: str | None, end: str | None, prefix: str) -> Iterator[Page]:
        own = [o for o in self.objects if o[0].startswith(prefix) and (start is None or o[0] >= start) and (end is None or o[0] < end)]
        for i in range(0, len(own), self.page_size):
            yield own[i : i + self.page_size]


def list_round(spark: SparkSession, ranges: Sequence[tuple[str | None, str | None]], pager: Pager, prefix: str, max_pages: int) -> DataFrame:
    """Objects of all ranges, and for unfinished ranges a row with a null name and what is left."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for frame in frames:
            for start, end in zip(frame["lo"], frame["hi"]):
                first = last = None
                for n, page in enumerate(pager(start, end, prefix)):
                    if n == max_pages:
                        yield pd.DataFrame([(None, None, None, None, first, last + "\0", end)], columns=names)
                        break
                    if page:
                        first, last = first or page[0][0], page[-1][0]
                        yield pd.DataFrame([(*o, None, None, None) for o in page], columns=names)

    plan = spark.createDataFrame(list(ranges), "lo string, hi string").repartition(len(ranges))
    return plan.mapInPandas(work, FOUND)


def list_bucket(
    spark: SparkSession, bucket: str, pager: Pager, out: str, prefix: str = "", cuts: Sequence[str] = (), max_pages: int = 1000, if_exists: str = "error"
) -> DataFrame:
    """List a bucket to Parquet under ``out`` and return it in the normalized schema. ``cuts`` are first boundaries, such as those of the
    run before. ``if_exists``: error, reuse or clear."""
    marker = f"{out}/_ranges"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(fs_path(marker)) or fs.exists(fs_path(out)):
        if if_exists == "reuse" and fs.exists(fs_path(f"{marker}/_SUCCESS")):
            return read_listing(spark, bucket, out)
        if if_exists != "clear":
            raise FileExistsError(out)
        fs.delete(fs_path(out), True)
    edges = [None, *sorted(cuts), None]
    ranges = list(zip(edges, edges[1:]))
    done: list[tuple[str | None, str | None]] = []
    number, origin = 0, None
    while ranges:
        part = f"{out}/round={number}"
        list_round(spark, ranges, pager, prefix, max_pages).write.parquet(part)
        done += ranges
        left = spark.read.parquet(part).filter("name IS NULL").select("seen_from", "left_from", "left_to").collect()  # ranges, not objects
        ranges = []
        for r in left:
            if r.left_to is None:  # the last range; how far it reached is measured from the first key of all
                origin = origin or r.seen_from
                middle = open_split(origin, r.left_from[:-1])
            else:
                middle = key_midpoint(r.left_from, r.left_to)
            ranges += [(r.left_from, middle), (middle, r.left_to)] if middle else [(r.left_from, r.left_to)]
        number += 1
    starts = sorted({lo for lo, _ in done if lo})
    spark.createDataFrame([(json.dumps(starts),)], "cuts string").coalesce(1).write.parquet(marker)
    return read_listing(spark, bucket, out)


def discover(pager: Pager, prefix: str = "", levels: int = 2, most: int = 1000) -> list[str]:
    """Boundaries from the first ``levels`` of directories under a prefix. Of each directory one page is read, then the search goes on behind it.
    Past ``most`` directories no deeper level is looked at; boundaries only plan the listing, which reads every key."""
    found = [prefix]
    for _ in range(levels):
        below: list[str] = []
        for top in found:
            at: str | None = top
            while at is not None and len(below) <= most:
                key = next((page[0][0] for page in pager(at, next_prefix(top) if top else None, top) if page), None)
                if key is None:
                    break
                rest = key[len(top) :]
                if "/" in rest[:-1] or rest.endswith("/") and rest != "/":
                    own = top + rest.split("/", 1)[0] + "/"
                    below.append(own)
                    at = next_prefix(own)
                else:
                    at = key + "\0"  # an object of the directory itself, or the marker of the directory
        if not below or len(below) > most:
            break
        found = below
    return [p for p in found if p]


def write_shards(listing: DataFrame, out: str, rows: int = SHARD_ROWS) -> None:
    """A listing as Parquet shards of at most ``rows`` rows, with small row groups that readers of key ranges can skip."""
    listing.write.option("maxRecordsPerFile", rows).option("parquet.block.size", ROW_GROUP_BYTES).parquet(out)


def warm_cuts(spark: SparkSession, out: str) -> list[str]:
    """Boundaries that a finished listing ended with."""
    return json.loads(spark.read.parquet(f"{out}/_ranges").first().cuts)


def read_listing(spark: SparkSession, bucket: str, out: str) -> DataFrame:
    rows = spark.read.schema(FOUND).parquet(f"{out}/round=*").filter("name IS NOT NULL")
    return rows.select(
        F.lit(bucket).alias("bucket"), "name", "size_bytes", F.to_timestamp("time").alias("created"),
        F.coalesce(lookup({**S3_CLASSES, **GCS_CLASSES}, F.col("class")), F.lit(0)).alias("storage_class_id"),
    )


def assert_no_duplicates(listing: DataFrame) -> None:
    """Raises with the leading offenders if a key was listed twice."""
    worst = listing.groupBy("bucket", "name").count().filter("count > 1").orderBy(F.col("count").desc(), "name").limit(5).collect()
    if worst:
        raise ValueError(f"keys listed more than once: {[(r.name, r['count']) for r in worst]}")


def window_edges(low: float, high: float, depth: int) -> list[float]:
    """The 2^depth + 1 edges of halved windows between two times."""
    n = 1 << depth
    return [low + (high - low) * i / n for i in range(n + 1)]
