"""Bulk listing with a paging client in memory, and records."""

import json

import pytest
from pyspark.sql import functions as F

from arborspark.operators.attribution import Identities
from arborspark.sources import bulk, records


def test_bulk_listing_splits_hot_ranges(spark, tmp_path):
    objects = [(f"{p}/k{i:04d}", i, "2026-01-02T03:04:05Z", "NEARLINE") for p, n in (("a", 5), ("hot", 230), ("z", 3)) for i in range(n)]
    out = f"file://{tmp_path}/list"
    got = bulk.list_bucket(spark, "b", bulk.FakePager(objects), out, cuts=["b"], max_pages=3)
    assert sorted((r.name, r.size_bytes, r.storage_class_id) for r in got.collect()) == sorted((n, s, 2) for n, s, _, _ in objects)
    bulk.assert_no_duplicates(got)
    assert len(bulk.warm_cuts(spark, out)) > 3
    with pytest.raises(FileExistsError):
        bulk.list_bucket(spark, "b", bulk.FakePager(objects), out)
    assert bulk.list_bucket(spark, "b", bulk.FakePager([]), out, if_exists="reuse").count() == len(objects)
    assert bulk.list_bucket(spark, "b", bulk.FakePager([]), out, if_exists="clear").count() == 0
    with pytest.raises(ValueError):
        bulk.assert_no_duplicates(got.limit(0).unionByName(spark.createDataFrame([("b", "x", 1, None, 0)] * 2, got.schema)))


def test_open_ranges_are_shared(spark, tmp_path):
    objects = [(f"data/abc/{i:05d}", i, "2026-01-02T03:04:05Z", "STANDARD") for i in range(3000)]
    out = f"file://{tmp_path}/open"
    got = bulk.list_bucket(spark, "b", bulk.FakePager(objects), out, max_pages=3)
    assert got.count() == 3000
    bulk.assert_no_duplicates(got)
    tasks = spark.read.parquet(f"{out}/round=*").filter("name IS NULL").count()
    rounds = len([p for p in (tmp_path / "open").iterdir() if p.name.startswith("round=")])
    assert tasks > 40 and rounds < 20, (tasks, rounds)  # one reader alone would take 100 rounds
    cuts = bulk.warm_cuts(spark, out)
    inside = [sum(a <= o[0] < b for o in objects) for a, b in zip(cuts, cuts[1:])]
    assert sum(n > 0 for n in inside) > len(inside) / 2


def test_discovery_and_shards(spark, tmp_path):
    keys = ["a/x/1", "a/x/2", "a/y/1", "a/top", "b/", "b/z/q/1", "c", "d//e", "d/f/g"]
    pager = bulk.FakePager([(k, 1, "2026-01-02T03:04:05Z", "STANDARD") for k in keys])
    assert bulk.discover(pager, levels=1) == ["a/", "b/", "d/"]
    assert bulk.discover(pager) == ["a/x/", "a/y/", "b/z/", "d//", "d/f/"] and bulk.discover(pager, most=3) == ["a/", "b/", "d/"]
    got = bulk.list_bucket(spark, "b", pager, f"file://{tmp_path}/found", cuts=bulk.discover(pager))
    assert sorted(r.name for r in got.collect()) == sorted(keys)
    bulk.write_shards(got.coalesce(1), f"file://{tmp_path}/shards", rows=4)
    assert len(list((tmp_path / "shards").glob("part-*.parquet"))) == 3 and spark.read.parquet(f"file://{tmp_path}/shards").count() == 9


def test_window_edges():
    assert bulk.window_edges(0, 8, 2) == [0, 2, 4, 6, 8]


def test_records(spark):
    body = json.dumps({"cfg": {"out": "gs://b/x", "l": ["gs://b/y", 3]}, "n": "no"})
    rows = spark.createDataFrame([("p", body), ("q", "{broken"), ("r", None), ("s", '{"name": "n", "output_path": "gs://o"}')], "path string, body string")
    found = {r.path: [tuple(x) for x in r.w] for r in rows.select("path", records.walk_json(F.col("body")).alias("w")).collect()}
    assert found == {"p": [("out", "gs://b/x"), ("l", "gs://b/y")], "q": [], "r": [], "s": [("output_path", "gs://o")]}
    side = {r.path: (r.name, r.output_path, r.error) for r in records.sidecars(rows).collect()}
    assert side["s"] == ("n", "gs://o", None) and side["q"][2] == "unreadable"
    assert rows.select(records.store_paths(F.lit('see gs://b/x, "gs://c"')).alias("x")).first().x == ["gs://b/x", "gs://c"]
    media = spark.createDataFrame([("d/t1_0.mp4", 5), ("e/t1_0.mp4", 9), ("d/t1_1.mp4", 1), ("readme", 1)], "path string, size long")
    assert {(r.path, r.extra) for r in records.media_groups(media).collect()} == {("d/t1_0.mp4", True), ("e/t1_0.mp4", False), ("d/t1_1.mp4", False)}


def test_identity_rules():
    with pytest.raises(ValueError):
        Identities({"a": {"aliases": ["x"]}, "b": {"aliases": ["x"]}})
    who = Identities(
        {"a": {"aliases": ["a"], "team": "t"}, "b": {"team": "ghost"}}, ["t"],
        [{"prefix": "gs://k/", "team": "t"}, {"prefix": "gs://k/d/", "team": "t"}, {"prefix": "bad", "user": "nobody"}, {"prefix": "gs://k/", "team": "t"}],
    )
    text = "\n".join(who.findings())
    for part in ("redundant alias", "unknown team 'ghost'", "already covers 'gs://k/d/'", "malformed prefix 'bad'", "unknown user 'nobody'", "repeated prefix"):
        assert part in text
