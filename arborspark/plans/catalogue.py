"""Registered queries. Their SQL is in ``arborspark.plans.oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import paths, text
from arborspark.operators import access, attribution, diff, export, planning, rollup, snapshots, tree_query
from arborspark.plans import virtual as v
from arborspark.plans.oracles import ORACLES
from arborspark.scratch import scratch
from arborspark.sources import listing

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}
LISTING_TIME = ["bucket", "name", "size_bytes", "created_s", "storage_class_id"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("created_s", text.epoch_seconds(F.col("created"))).select(*LISTING_TIME)


@query
def listing_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _timed(listing.normalize(v.listing(spark, sf)))


@query
def listing_inventory_dialects(spark, sf):
    return _timed(listing.normalize(v.gcs_inventory(spark, sf)).unionByName(listing.normalize(v.s3_inventory(spark, sf))))


@query
def listing_priority_merge(spark, sf):
    first = v.listing(spark, sf).filter("bucket <> 'N'")
    return _timed(listing.merge([first, v.gcs_inventory(spark, sf), v.docs_listing(spark, sf)]))


@query
def bucket_list(spark, sf):
    return listing.buckets(listing.merge([v.listing(spark, sf), v.pages_listing(spark, sf)]))


@query
def path_canonical(spark, sf):
    name = F.col("name")
    both = v.listing(spark, sf).select("bucket", "name").unionByName(v.pages_listing(spark, sf).select("bucket", "name"))
    return both.select("bucket", "name", paths.canonical(name).alias("path"), paths.is_dirty(name).alias("dirty"))


@query
def path_parent_depth(spark, sf):
    p = paths.canonical(F.col("name"))
    return v.listing(spark, sf).select("bucket", p.alias("path")).select(
        "bucket", "path", paths.parent(F.col("path")).alias("parent"), paths.depth(F.col("path")).alias("depth"), paths.basename(F.col("path")).alias("base"),
        paths.component(F.col("path"), 2).alias("second"),
    )


@query
def path_ancestors(spark, sf):
    p = v.listing(spark, sf).select("bucket", paths.canonical(F.col("name")).alias("path")).distinct()
    return p.select("bucket", F.explode(paths.ancestors(F.col("path"))).alias("dir")).groupBy("bucket", "dir").agg(F.count("*").alias("n_paths"))


@query
def path_rebase(spark, sf):
    t = tree_query.subtree(v.stored(spark, sf, "A"), "F/y1997").select("path", "kind")
    rel = paths.rebase(F.col("path"), "F/y1997")
    return t.select("path", "kind", rel.alias("rel"), paths.unbase(rel, "F/y1997").alias("again"))


@query
def tree_rollup(spark, sf):
    return v.tree(spark, sf)


@query
def tree_rollup_pages(spark, sf):
    return rollup.rollup(listing.normalize(v.pages_listing(spark, sf)), scheme="http")


@query
def tree_rollup_pivot(spark, sf):
    return v.tree(spark, sf, pivots=["storage_class_id"]).filter("kind = 'dir'")


@query
def tree_rollup_mean_mtime(spark, sf):
    return v.tree(spark, sf, mean_mtime=True).filter("kind = 'dir'").select("bucket", "path", "size", "mtime", "mtime_mean")


@query
def tree_rollup_root(spark, sf):
    return snapshots.root_stats(v.stored(spark, sf))


@query
def children_at(spark, sf):
    return tree_query.children(v.stored(spark, sf, "A"), "F/y1997").select("path", "kind", "size", "n_desc", "n_children")


@query
def children_at_root(spark, sf):
    return tree_query.children(v.stored(spark, sf, "A")).select("path", "kind", "size", "n_desc", "n_children")


@query
def drill_topk_closure(spark, sf):
    return tree_query.drill(v.stored(spark, sf, "A"), "O", depth=3, max_rows=40).select("path", "parent", "depth", "kind", "size")


@query
def subtree_filter(spark, sf):
    return tree_query.subtree(v.stored(spark, sf, "N"), "O/y1998/m4").select("path", "kind", "size", "depth")


@query
def depth_filter(spark, sf):
    return tree_query.at_depth(v.stored(spark, sf), 1, 3).select("bucket", "path", "kind", "size", "depth")


@query
def path_search(spark, sf):
    return tree_query.search(v.stored(spark, sf), "Y1999/M7/O5").select("bucket", "path", "kind", "size")


@query
def expand_single(spark, sf):
    return tree_query.single_chains(rollup.rollup(v.order_listing(spark, sf)))


@query
def path_stats(spark, sf):
    t = tree_query.at_depth(v.stored(spark, sf), 3, 3)
    return t.filter("path = 'F/y1999/m12'").select("bucket", "path", "size", "mtime", "n_desc", "n_files", "n_children")


@query
def unaccounted(spark, sf):
    shown = v.stored(spark, sf, "A").filter("size >= 40000 AND depth <= 4")
    return tree_query.unaccounted(shown, 10_000)


@query
def virtual_root(spark, sf):
    return tree_query.virtual_root(tree_query.children(v.stored(spark, sf, "N")))


@query
def page_of_children(spark, sf):
    return tree_query.page(tree_query.children(v.stored(spark, sf, "A"), "F/y1997/m3"), 1, 10).select("path", "size")


def _reg(spark, sf):
    return v.registry(spark, sf).withColumn("time_s", text.epoch_seconds(F.col("time")))


@query
def snapshot_latest(spark, sf):
    return snapshots.latest(_reg(spark, sf)).select("id", "path", "time_s", "size")


@query
def scan_series(spark, sf):
    return snapshots.newest(_reg(spark, sf), "gcs://b1/d3", 5).select("id", "path", "time_s", "size")


@query
def covering_scan(spark, sf):
    return snapshots.covering(v.asked_uris(spark), v.registry(spark, sf)).select("uri", "id", "scan_path", text.epoch_seconds(F.col("time")).alias("time_s"), "rel_path")


@query
def scan_history(spark, sf):
    a = v.snapshot(spark, sf, "a").withColumn("scan_id", F.lit(1))
    both = a.unionByName(v.snapshot(spark, sf, "b").withColumn("scan_id", F.lit(2)))
    reg = spark.createDataFrame([(1, "gcs://A", "2024-01-01"), (2, "gcs://A", "2024-02-01")], "id int, path string, t string").select("id", "path", F.to_timestamp("t").alias("time"))
    asked = spark.createDataFrame([("gcs://A",), ("gcs://A/F/y1997",), ("gcs://A/O/y1999/m2",)], "uri string")
    return snapshots.history(asked, reg, both).select("uri", "scan_id", text.epoch_seconds(F.col("time")).alias("time_s"), "rel_path", "size", "n_desc", "n_children", "mtime")


@query
def snapshot_diff(spark, sf):
    return diff.snapshot_diff(v.snapshot(spark, sf, "a"), v.snapshot(spark, sf, "b"), 3)


@query
def snapshot_diff_subtree(spark, sf):
    sides = [tree_query.view(v.snapshot(spark, sf, s), "F/y1997/m3") for s in "ab"]
    return diff.snapshot_diff(*sides, depth=2, unchanged=True)


@query
def diff_totals(spark, sf):
    return diff.totals(diff.snapshot_diff(v.snapshot(spark, sf, "a"), v.snapshot(spark, sf, "b"), 5, unchanged=True))


def _flat(spark, sf, which):
    return v.snapshot(spark, sf, which).filter("kind = 'dir'").select("path", "depth", F.col("n_files").alias("objects"), F.col("size").alias("bytes"))


@query
def tree_compare(spark, sf):
    return diff.tree_compare(_flat(spark, sf, "a"), _flat(spark, sf, "b"), 2, 5)


@query
def delete_path(spark, sf):
    t = v.stored(spark, sf, "A")
    return tree_query.delete(t, "F/y1997").select("path", "kind", "size", "n_desc", "n_files", "n_children")


@query
def fresher_patch(spark, sf):
    seen = snapshots.newest(v.registry(spark, sf), "gcs://b1/d3", 1)
    shown = v.registry(spark, sf).groupBy(F.col("path").alias("uri")).agg(*[F.min(c).alias(c) for c in ("size", "n_children", "n_desc", "mtime")])
    at = seen.first()
    return tree_query.patch_fresher(shown, at.time if at else None, v.registry(spark, sf))


@query
def partial_children(spark, sf):
    base = "gcs://b2"
    live = spark.createDataFrame([(f"{base}/d{k}",) for k in range(9)], "uri string")
    return tree_query.scanned_state(live, v.registry(spark, sf).filter("length(path) <> 11 OR path < 'gcs://b2/d3'"), base)


@query
def access_parse(spark, sf):
    return v.access_rows(spark, sf).withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query
def access_dedupe(spark, sf):
    return v.access_rows(spark, sf).groupBy("op").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out"))


def _day(df):
    return df.withColumn("day", F.datediff("day", F.lit("1970-01-01").cast("date")))


@query
def access_leaf(spark, sf):
    return _day(access.leaf_rollup(v.access_rows(spark, sf)))


@query
def access_rollup(spark, sf):
    return _day(access.rollup(access.leaf_rollup(v.access_rows(spark, sf))))


@query
def access_rollup_by_bucket(spark, sf):
    return _day(access.rollup(access.leaf_rollup(v.access_rows(spark, sf), by_bucket=True)))


@query
def access_top(spark, sf):
    return access.hot_prefixes(access.rollup(access.leaf_rollup(v.access_rows(spark, sf))), depth=2, limit=25)


def _prefixes(spark, sf):
    rules = attribution.expand_wildcards(v.rules(spark), listing.buckets(v.listing(spark, sf)))
    return attribution.prefix_map(rules)


def _attributed(spark, sf):
    return attribution.deepest(attribution.dir_totals(v.listing(spark, sf)), _prefixes(spark, sf))


@query
def attr_prefix_map(spark, sf):
    return _prefixes(spark, sf)


@query
def attr_deepest(spark, sf):
    return _attributed(spark, sf)


@query
def attr_report(spark, sf):
    return attribution.report(_attributed(spark, sf))


@query
def attr_source_coverage(spark, sf):
    rules = v.rules(spark)
    keyed = attribution.expand_wildcards(rules, listing.buckets(v.listing(spark, sf))).join(rules.select("ord", "source"), "ord")
    return attribution.source_coverage(_attributed(spark, sf), keyed)


@query
def attr_gaps(spark, sf):
    return attribution.gaps(_attributed(spark, sf), 2)


@query
def attr_claims(spark, sf):
    return attribution.claims(_attributed(spark, sf), "cyd")


@query
def attr_user_prefix(spark, sf):
    return attribution.user_prefixes(_user_listing(spark, sf))


@query
def identity_resolve(spark, sf):
    who = attribution.Identities(
        {"ann-lee": {"aliases": ["al"], "team": "infra"}, "customer-000000003": {"aliases": ["c3", "customer-000000004"], "team": "data"}}, ["infra", "data"]
    )
    c = v.read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("@host ")).alias("raw"))
    return attribution.resolve(c, who).select("c_custkey", "user", "team")


@query
def run_name_match(spark, sf):
    return attribution.match_runs(v.run_leaves(spark, sf), v.runs(spark, sf))


@query
def writer_path_owner(spark, sf):
    return attribution.writer_paths(v.runs(spark, sf))


@query
def run_dirs(spark, sf):
    return attribution.run_dirs(v.listing(spark, sf))


@query
def record_owners(spark, sf):
    body = F.when(F.col("o_orderkey") % 5 == 0, "{broken").when(F.col("o_orderkey") % 5 == 1, "null").when(F.col("o_orderkey") % 5 == 2, '{"provenance": {}}').otherwise(
        F.concat(F.lit('{"provenance": {"built_by": "u'), F.col("o_custkey") % 10, F.lit('"}}'))
    )
    rows = v.read(spark, sf, "orders").select(F.concat(F.lit("r/"), "o_orderkey").alias("path"), body.alias("body"))
    return attribution.record_owners(rows)


@query
def census_buckets(spark, sf):
    return attribution.census(v.listing(spark, sf))["buckets"]


@query
def census_top_dirs(spark, sf):
    return attribution.census(v.listing(spark, sf), 15)["depth2"]


def _canonical(spark, sf):
    return v.listing(spark, sf).withColumn("name", paths.canonical(F.col("name")))


def _owned(spark, sf):
    """Listing rows with the owners of their directories."""
    rows = _canonical(spark, sf).withColumn("dir", attribution.dir_of(F.col("name")))
    return attribution.deepest(rows, _prefixes(spark, sf)).drop("key")


def _levels(spark, sf):
    return export.level_rows(export.dir_detail(_canonical(spark, sf)), 3)


@query
def tree_levels(spark, sf):
    return _levels(spark, sf).withColumn("second_bytes", F.col("second_bytes").cast("string"))


@query
def tree_nodes(spark, sf):
    return export.nodes(_levels(spark, sf), 3)


@query
def tree_fold(spark, sf):
    return export.fold(export.nodes(_levels(spark, sf), 3), 2_000_000)


@query
def tree_residual_fold(spark, sf):
    return export.residual_fold(export.nodes(_levels(spark, sf), 3), 0.005)


@query
def tree_json(spark, sf):
    return spark.createDataFrame([(export.nested(export.nodes(_levels(spark, sf), 3), 2_000_000),)], "json string")


@query
def age_strata(spark, sf):
    return export.age_strata(_canonical(spark, sf))


@query
def age_buckets(spark, sf):
    strata = export.age_strata(_canonical(spark, sf))
    rows = [export.age_buckets(strata, u).withColumn("unit", F.lit(u)) for u in ("week", "month")]
    return rows[0].unionByName(rows[1])


@query
def class_mix(spark, sf):
    return export.class_mix(_owned(spark, sf))


@query
def class_totals(spark, sf):
    return export.class_totals(v.listing(spark, sf))


def _owned_nodes(spark, sf):
    rows = _owned(spark, sf)
    return rows.select(F.concat_ws("/", "bucket", paths.component(F.col("dir"), 1), paths.component(F.col("dir"), 2)).alias("path"), "user", "team", F.col("size_bytes").alias("bytes"))


@query
def top_users_per_node(spark, sf):
    rows = v.listing(spark, sf).select("bucket", paths.component(paths.canonical(F.col("name")), 1).alias("d"), F.regexp_extract("name", "/l([0-9]+)-", 1).alias("k"), "size_bytes")
    return export.top_users(rows.select(F.concat_ws("/", "bucket", "d").alias("path"), F.concat(F.lit("u"), F.col("k").cast("long") % 40).alias("user"), F.col("size_bytes").alias("bytes")))


@query
def dominant_team(spark, sf):
    return export.dominant(_owned_nodes(spark, sf))


@query
def user_ranks(spark, sf):
    return export.user_ranks(_owned_nodes(spark, sf))


@query
def cost_estimate(spark, sf):
    return export.cost(export.class_mix(_owned(spark, sf)).select("team", "storage_class_id", "bytes"), ["team"])


@query
def cost_delta(spark, sf):
    rows = v.listing(spark, sf).groupBy(F.date_format("created", "yyyy").alias("date"), "storage_class_id").agg(F.sum("size_bytes").alias("bytes"))
    return export.cost_delta(export.cost(rows, ["date"]), 0.005, 5e8)


@query
def blended_rates(spark, sf):
    return export.blended_rates(_owned(spark, sf))


@query
def stale_score(spark, sf):
    t = v.tree(spark, sf, mean_mtime=True).filter("kind = 'dir' AND depth <= 3")
    return export.stale_score(t, 1_100_000_000)


@query
def prefix_weights(spark, sf):
    return rollup.prefix_weights(_canonical(spark, sf))


@query
def range_boundaries(spark, sf):
    return planning.boundaries(_canonical(spark, sf), 16)


@query
def dup_keys(spark, sf):
    return rollup.duplicate_keys(v.listing(spark, sf))


@query
def dup_keys_audit(spark, sf):
    return rollup.key_audit(v.listing(spark, sf))


@query
def bin_pack(spark, sf):
    weights = rollup.prefix_weights(_canonical(spark, sf)).filter("n > 0 AND prefix LIKE '%/%/'")
    rows = [(f"{r.bucket}/{r.prefix}", r.n) for r in weights.collect()]  # planning input: two levels of prefixes
    return spark.createDataFrame([(i, item) for i, items in enumerate(planning.pack(rows, 4)) for item in items], "bin int, prefix string")


@query
def nested_prefix_dedupe(spark, sf):
    t = v.stored(spark, sf, "A").filter("kind = 'dir' AND path <> '.' AND mtime >= 850000000")
    return planning.nested_prefixes(t.select(F.concat("path", F.lit("/")).alias("prefix")))


@query
def storage_stats(spark, sf):
    rows = [v.snapshot(spark, sf, s).select(F.lit(i).alias("scan_id"), "size") for i, s in enumerate("ab")]
    return snapshots.storage_stats(rows[0].unionByName(rows[1]))


@query
def chunk_stats(spark, sf):
    return snapshots.chunk_stats(v.snapshot(spark, sf, "a"), 100)


@query
def chunk_stats_nested(spark, sf):
    return snapshots.chunk_stats(v.snapshot(spark, sf, "a"), 100, nested=True)


@query
def index_load_or_create(spark, sf):
    v.stored(spark, sf)
    info = v.store(spark).scan_of(f"{sf}/lineitem")
    return spark.createDataFrame([(info.size, info.n_children, info.n_desc, info.mtime)], "size long, n_children long, n_desc long, mtime long")


@query
def delete_registry_sync(spark, sf):
    own = snapshots.Store(spark, scratch(spark, "store"))
    own.save(v.stored(spark, sf, "A").drop("bucket"), 1, "gcs://A", "2026-01-01")
    own.save(tree_query.view(v.stored(spark, sf, "A").drop("bucket"), "F/y1997"), 2, "gcs://A/F/y1997", "2025-01-01")
    own.delete("gcs://A/F/y1997")
    return own.registry().select("path", "size", "n_children", "n_desc", "mtime")


@query
def bucket_scans(spark, sf):
    rows = snapshots.bucket_list(v.bucket_names(spark, sf), v.registry(spark, sf))
    return rows.withColumn("last_scanned", text.epoch_seconds(F.col("last_scanned")))


@query
def bucket_selection(spark, sf):
    return snapshots.selection_totals(snapshots.bucket_list(v.bucket_names(spark, sf), v.registry(spark, sf)).filter("name < 'b2'"))


@query
def key_range(spark, sf):
    return tree_query.key_range(v.listing(spark, sf), "F/y1994/m2", "O").select("bucket", "name", "size_bytes")


@query
def monotonic_runs(spark, sf):
    rows = v.read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("shard"), "o_orderkey", F.floor("o_totalprice").cast("long").alias("price"))
    return tree_query.monotonic_runs(rows, "shard", "o_orderkey", "price").groupBy("shard").agg(F.max("run").alias("falls"), F.count("*").alias("n"))


@query
def maximal_matches(spark, sf):
    return tree_query.maximal_matches(v.stored(spark, sf), "^(m1[0-2]?|o1.*)$")


@query
def scan_codes(spark, sf):
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 3) * 43_200
    scan = F.when(F.col("o_orderkey") % 3 == 0, text.day_text(s)).otherwise(text.day_text(s, "yyyy-MM-dd'T'HHmm"))
    code = text.encode_scan(scan)
    return v.read(spark, sf, "orders").select("o_orderkey", text.round_day(s).alias("near_day"), scan.alias("scan"), code.alias("code"), text.decode_scan(code).alias("again"))


@query
def sidecar_owners(spark, sf):
    return attribution.sidecar_owners(v.sidecars(spark, sf), v.runs(spark, sf))


def _user_listing(spark, sf):
    return v.listing(spark, sf).withColumn("name", F.concat(F.lit("users/"), paths.component(paths.canonical(F.col("name")), 4), F.lit("/"), "name"))


@query
def census_users(spark, sf):
    return attribution.census(_user_listing(spark, sf))["users"]


@query
def census_records(spark, sf):
    rows = v.listing(spark, sf).withColumn("name", F.concat("name", F.when(F.col("size_bytes") < 5000, "/.artifact.json").when(F.col("size_bytes") < 9000, "/.executor_info").otherwise("/x")))
    return attribution.census(rows)["records"]


@query
def census_depth1(spark, sf):
    return attribution.census(v.listing(spark, sf))["depth1"]


def _owned_levels(spark, sf):
    detail = export.dir_detail(_owned(spark, sf), ["user", "team"])
    return export.level_rows(detail, 3, ["user", "team"])


@query
def tree_levels_owned(spark, sf):
    return _owned_levels(spark, sf).withColumn("second_bytes", F.col("second_bytes").cast("string"))


@query
def node_team_shares(spark, sf):
    return export.node_shares(_owned_levels(spark, sf), "team", 3)


@query
def rollup_bar(spark, sf):
    return export.rollup_bar(export.node_shares(_owned_levels(spark, sf), "user", 3), "user", 0.01)


@query
def category_order(spark, sf):
    return export.category_order(_levels(spark, sf))


@query
def child_ranks(spark, sf):
    return export.child_ranks(export.nodes(_levels(spark, sf), 3))


@query
def signed_tiles(spark, sf):
    return export.signed_tiles(diff.tree_compare(_flat(spark, sf, "a"), _flat(spark, sf, "b"), 2, 1000).filter("path <> 'TOTAL'"))


@query
def age_rows_in_order(spark, sf):
    return export.in_total_order(export.age_strata(_canonical(spark, sf)))


@query
def treemap_layout(spark, sf):
    return export.treemap(export.nodes(_levels(spark, sf), 3).filter("depth > 0"))
