"""Hand-computed trees and edge cases."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from arborspark.functions import text
from arborspark.operators import diff, export, planning, rollup, snapshots, tree_query
from arborspark.sources import access, listing, urls, walk

KIND = "bucket string, name string, size_bytes long, created timestamp, storage_class_id int"


def rows_of(spark, names, bucket="b1", day=1):
    when = datetime.datetime(2026, 7, day)
    return spark.createDataFrame([(bucket, n, s, when, 1) for n, s in names], KIND)


def table_of(tree):
    return {(r.path, r.kind): (r.size, r.parent, r.n_desc, r.n_files, r.n_children, r.depth) for r in tree.collect()}


def test_small_tree(spark):
    t = table_of(rollup.rollup(rows_of(spark, [("a.txt", 100), ("sub/b.txt", 200), ("sub/c.txt", 300), ("sub/deep/d.txt", 400)])))
    assert t == {
        (".", "dir"): (1000, "", 7, 4, 2, 0),
        ("a.txt", "file"): (100, "", 1, 1, 0, 1),
        ("sub", "dir"): (900, ".", 5, 3, 3, 1),
        ("sub/b.txt", "file"): (200, "sub", 1, 1, 0, 2),
        ("sub/c.txt", "file"): (300, "sub", 1, 1, 0, 2),
        ("sub/deep", "dir"): (400, "sub", 2, 1, 1, 2),
        ("sub/deep/d.txt", "file"): (400, "sub/deep", 1, 1, 0, 3),
    }


def test_dirty_keys(spark):
    t = table_of(rollup.rollup(rows_of(spark, [("tokenized/a.txt", 100), ("tokenized/sub//x.txt", 4), ("other/b.txt", 50), ("/", 7), ("//", 8)])))
    assert t[(".", "dir")][0] == 154 and t[("tokenized", "dir")][0] == 104 and t[("tokenized/sub", "dir")][:2] == (4, "tokenized")
    assert not any("//" in p for p, _ in t)


def test_file_and_directory_on_one_path(spark):
    t = table_of(rollup.rollup(rows_of(spark, [("a", 7), ("a/b", 8), ("a/b/c", 9)])))
    assert t[("a", "file")][0] == 7 and t[("a", "dir")][0] == 17 and t[("a/b", "dir")][0] == 9 and t[(".", "dir")][0] == 24


def test_leading_slash_and_repeated_keys(spark):
    t = rollup.rollup(rows_of(spark, [("/a/b", 5), ("x/y", 1), ("x/y", 2)]))
    d = table_of(t)
    assert d[("/a", "dir")][0] == 5 and d[(".", "dir")][0] == 8 and d[("x", "dir")][3] == 2
    assert t.filter("path = 'x/y'").count() == 2


def test_empty_listing(spark):
    assert rollup.rollup(rows_of(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        rollup.require_rows(rows_of(spark, [("a", 1)]), "none")


def test_pivot_and_exact_mean(spark):
    data = [("data/hot.bin", 1000, 10, 1), ("data/warm.bin", 2000, 20, 2), ("data/cold/old.bin", 4000, 5, 4), ("empty/marker", 0, 15, 1), ("big", 20064072762, 25, 1)]
    df = spark.createDataFrame([("b", n, s, datetime.datetime(2026, 7, d), c) for n, s, d, c in data], KIND)
    t = {r.path: r for r in rollup.rollup(df, pivots=["storage_class_id"], mean_mtime=True).collect()}
    assert (t["data"].sum_storage_class_id_1, t["data"].sum_storage_class_id_2, t["data"].sum_storage_class_id_4) == (1000, 2000, 4000)
    assert t["empty"].mtime_mean is None and t["empty/marker"].mtime_mean is not None
    many = spark.range(33).select(F.lit("b").alias("bucket"), F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("created"), F.col("id").alias("k"))
    with pytest.raises(ValueError):
        rollup.rollup(many, pivots=["k"])


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([("b", "d/x", 5 * 10**18, datetime.datetime(2026, 7, 1), 1), ("b", "d/y", 1, datetime.datetime(2026, 7, 2), 1)], KIND)
    r = rollup.rollup(df, mean_mtime=True).filter("path = 'd'").first()
    a, b = 1782864000, 1782950400
    assert r.mtime_mean == float(5 * 10**18 * a + b) / float(5 * 10**18 + 1)


def test_walk_counts_directories_own_size(spark):
    kind = "path string, size long, mtime long, kind string"
    t = {r.path: r for r in rollup.walk_rollup(spark.createDataFrame([("", 10, 5, "dir"), ("d", 20, 9, "dir"), ("d/f", 3, 7, "file")], kind), "file:///x").collect()}
    assert (t["."].size, t["."].n_desc, t["."].mtime, t["d"].size, t["d"].n_children) == (33, 3, 9, 23, 1)
    alone = rollup.walk_rollup(spark.createDataFrame([], kind), "file:///x").collect()
    assert [(r.path, r.n_files, r.n_desc) for r in alone] == [(".", 0, 1)]


def test_dialects(spark):
    gcs = spark.createDataFrame([("b", "x", 1, None, None, "COLDLINE"), ("b", "gone", 1, None, "2026-01-01", "STANDARD")], "bucket string, name string, size long, timeCreated string, timeDeleted string, storageClass string")
    assert [(r.name, r.storage_class_id) for r in listing.normalize(gcs).collect()] == [("x", 3)]
    s3 = spark.createDataFrame([("b", "k", 1, False, True), ("b", "m", 1, True, True), ("b", "o", 1, False, False)], "Bucket string, Key string, Size long, IsDeleteMarker boolean, IsLatest boolean")
    assert [r.name for r in listing.normalize(s3).collect()] == ["k"]
    with pytest.raises(ValueError):
        listing.normalize(spark.range(1))


def test_delete_conventions(spark):
    t = rollup.rollup(rows_of(spark, [("foo/a.txt", 100), ("foo/b.txt", 300), ("bar/c.txt", 600)])).drop("bucket")
    left = {r.path: (r.size, r.n_desc, r.n_children) for r in tree_query.delete(t, "foo/a.txt").collect()}
    assert left["foo"] == (300, 2, 1) and left["."] == (900, 5, 2) and "foo/a.txt" not in left
    old = {r.path: r.n_desc for r in tree_query.delete(t, "foo/a.txt", self_counted=False).collect()}
    assert old["foo"] == 1


def test_subtree_does_not_match_wildcards(spark):
    t = rollup.rollup(rows_of(spark, [("a_b/x", 1), ("aXb/y", 2)])).drop("bucket")
    assert {r.path for r in tree_query.delete(t, "a_b").collect()} == {".", "aXb", "aXb/y"}


def test_diff_of_two_snapshots(spark):
    a = rollup.rollup(rows_of(spark, [("a.txt", 100), ("sub/b.txt", 200), ("sub/c.txt", 300)])).drop("bucket")
    b = rollup.rollup(rows_of(spark, [("a.txt", 500), ("sub/b.txt", 200), ("sub/d.txt", 700)])).drop("bucket")
    assert [(r.path, r.status, r.size_delta, r.n_desc_delta) for r in diff.snapshot_diff(a, b).collect()] == [("a.txt", "changed", 400, 0), ("sub", "changed", 400, 0)]
    inner = diff.snapshot_diff(tree_query.view(a, "sub"), tree_query.view(b, "sub")).collect()
    assert [(r.path, r.status, r.size_delta) for r in inner] == [("d.txt", "added", 700), ("c.txt", "removed", -300)]


def test_store_round_trip(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}")
    tree = rollup.rollup(rows_of(spark, [("a/b/c", 5), ("a/d", 6)])).drop("bucket")
    store.save(tree, 1, "gcs://b1", "2026-07-01")
    store.save(tree.filter("path <> 'a/d'"), 2, "gcs://b1", "2026-07-02")
    assert store.scans() == [2, 1]
    assert store.path_stats(1, "a").first().size == 11
    assert {r.path for r in store.load(1, max_depth=1).collect()} == {".", "a"}
    plan = store.load(1, 1, 1)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(depth,1)" in plan
    store.adopt(f"file://{tmp_path}/trees/scan_id=1", 7, "gcs://b7", "2026-07-03")
    assert store.load(7).count() == 5 and store.scan_of("gcs://b7").n_desc == 5
    store.drop(7)
    assert store.load(1).count() == 5 and store.load_or_create("gcs://b1", lambda: None).count() == 4
    assert store.load_or_create("gcs://b9", lambda: tree).count() == 5 and store.scan_of("gcs://b9").id == 3
    assert store.collect_garbage("2026-07-01 12:00:00") == [1] and store.scans() == [3, 2]
    store.save(tree, 1, "gcs://b1", "2026-07-01")
    store.drop(3)
    store.save(tree.filter("path LIKE 'a%'"), 5, "gcs://b1/a/b", "2020-01-01")
    assert store.delete("gcs://b1/a/b") == 6 and store.scans() == [6, 1] and {r.path for r in store.load(6).collect()} == {".", "a"}
    assert store.scan_of("gcs://b1").size == 6 and store.delete("gcs://none/x") is None
    store.drop(6)
    assert store.scans() == [1]
    with pytest.raises(Exception):
        store.save(tree, 1, "gcs://b1", "2026-07-01")


def test_access_dedupe_and_parsers(spark):
    raw = spark.createDataFrame([(1_000_000, "r1", "GET", None, 5), (1_000_000, "r1", "GET", None, 5), (2_000_000, None, "BREW", "storage.objects.get", 7), (3_000_000, None, "PUT", None, 1)],
                                "time_micros long, s_request_id string, cs_method string, cs_operation string, sc_bytes long")
    full = raw
    for f in ("c_ip", "cs_user_agent", "cs_bucket", "cs_object"):
        full = full.withColumn(f, F.lit("x"))
    assert access.canonical_gcs(full.withColumn("sc_status", F.lit(200)).withColumn("cs_bytes", F.lit(0).cast("long")).withColumn("cs_bucket", F.lit(None).cast("string"))).count() == 0
    ops = [("GET", "LIST_Bucket"), ("GET", "LIST_Buckets"), ("GET", "GET_Bucket"), ("PATCH", "PUT_Bucket"), ("POST", "POST_Object"), ("POST", None), (None, None), ("PUT", "GET_BUCKET"), (None, "HEAD_Object"), ("DELETE", "x")]
    got = spark.createDataFrame(ops, "m string, o string").select(text.normalize_op(F.col("m"), F.col("o")).alias("op")).collect()
    assert [r.op for r in got] == ["LIST", "LIST", "GET", "PUT", "PUT", "OTHER", "OTHER", "LIST", "HEAD", "DELETE"]
    names = spark.createDataFrame([("run-abcdef12_resume3",), ("run-resume2",), ("run_resume1-x-abcdef",), ("run-abcdef--",), ("a-123456",)], "n string")
    assert [r[0] for r in names.select(text.stem(F.col("n"))).collect()] == ["run-abcdef12", "run", "run", "run-abcdef", "a"]
    full = full.withColumn("sc_status", F.lit(200)).withColumn("cs_bytes", F.lit(0).cast("long"))
    out = access.canonical_gcs(full).collect()
    assert len(out) == 2 and {r.op for r in out} == {"GET", "OTHER"}
    line = 'own bkt [06/Feb/2026:00:00:38 +0000] 1.2.3.4 arn REQ1 REST.GET.OBJECT a%20b/c "GET /a HTTP/1.1" 200 - 113 113 7 - "-" "agent" -'
    got = access.canonical_s3(spark.createDataFrame([(line,), ("junk",)], "value string")).collect()
    assert [(r.path, r.op, r.bytes_out, r.requester) for r in got] == [("a b/c", "GET", 113, "1.2.3.4")]
    with pytest.raises(ValueError):
        access.parser_for("nope")


def test_planning():
    assert planning.pack([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == [["a", "d"], ["b", "c"]]
    for low, high in [("a", "b"), ("a", "c"), ("", "a"), ("abc", "abd"), ("a", None), ("zz", None), ("a", "a0"), ("\x00", "\x01")]:
        m = planning.key_midpoint(low, high)
        assert m is not None and low < m and (high is None or m < high), (low, high, m)
    assert planning.key_midpoint("a", "a\x00") is None
    assert planning.next_prefix("a/") == "a0"
    assert planning.next_prefix("a\U0010ffff") == "b" and planning.next_prefix("\ud7ff") == "\ue000" and planning.next_prefix("") is None
    assert planning.open_split("data/abc/00000", "data/abc/00012") == "data/abc/0002"
    for first, last in (("a", "a"), ("a/b", "zz"), ("x9", "x99"), ("k/Z", "k/Z"), ("\U0010ffff", "\U0010ffff")):
        assert planning.open_split(first, last) > last
    keys = ["".join(t) for n in range(4) for t in itertools.product("\x00\x01a9", repeat=n)]
    for low, high in itertools.combinations(sorted(keys), 2):
        m = planning.key_midpoint(low, high)
        assert (low < m < high) if m is not None else high.startswith(low) and set(high[len(low) :]) <= {"\x00", "\x01"}, (low, high, m)


def test_squarify_covers_the_area():
    boxes = export.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert abs(sum(w * h for _, _, w, h in boxes) - 24) < 1e-9
    assert all(0 <= x <= 6 and 0 <= y <= 4 for x, y, _, _ in boxes)


def test_urls_and_walks(spark, tmp_path):
    assert urls.parse("s3://b/k/").canonical == "s3://b/k" and urls.parse("host:/data").scheme == "ssh"
    assert urls.parent("gcs://b/x/y") == "gcs://b/x" and urls.parent("gcs://b") is None
    (tmp_path / "dump").write_bytes(b"d 8 1700000000.5 .\0f 16 1700000001.9 ./a b.txt\0bad\0")
    w = walk.read_find_dump(spark, f"file://{tmp_path}/dump")
    assert {(r.path, r.size, r.mtime, r.kind) for r in w.entries.collect()} == {("", 4096, 1700000000, "dir"), ("a b.txt", 8192, 1700000001, "file")}
    assert w.errors.count() == 1
    (tmp_path / "ls").write_text("2026-01-02 03:04:05        123 p/q r.txt\n\nTotal Objects: 1\n")
    s = walk.read_object_ls(spark, f"file://{tmp_path}/ls").entries.collect()
    assert [(r.path, r.size) for r in s] == [("p/q r.txt", 123)]
