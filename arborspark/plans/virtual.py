"""Inputs of the registered queries, as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.operators.rollup import rollup
from arborspark.operators.snapshots import Store
from arborspark.scratch import home
from arborspark.sources import access
from arborspark.sources.listing import normalize

#: Ownership rules: prefix, user, team, source, order. The second writes the key of the third first; the last is a team-only rule under a user.
RULES = [
    ("gcs://*/F/", None, "data", "rules", 0),
    ("gcs://A/O/y1996/", "ann", "infra", "rules", 1),
    ("gcs://A/O/y1996/", "bob", "data", "manual", 2),
    ("gcs://A/O/y1996/m3/", None, "data", "rules", 3),
    ("gcs://N/", "cyd", "web", "manual", 4),
    ("gcs://N/O/y1997/m5/o11/", "dee", "web", "records", 5),
    ("gcs://R/O/y1998/", None, "infra", "records", 6),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects from lineitem: some keys with ``//`` or a slash at their end, some listed twice."""
    t = read(spark, sf_dir, "lineitem")
    name = F.concat(
        "l_linestatus", F.when(F.col("l_orderkey") % 7 == 0, "//").otherwise("/"), F.lit("y"), F.year("l_shipdate"), F.lit("/m"), F.month("l_shipdate"), F.lit("/o"),
        F.col("l_orderkey") % 97, F.lit("/l"), "l_orderkey", F.lit("-"), "l_linenumber", F.when(F.col("l_orderkey") % 31 == 0, "/").otherwise(""),
    )
    return t.select(
        F.col("l_returnflag").alias("bucket"), name.alias("name"), (F.floor("l_quantity").cast("long") * 1024).alias("size_bytes"),
        F.col("l_shipdate").cast("timestamp").alias("created"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("storage_class_id"),
    )


def pages_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "pages")
    return t.select(
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("bucket"), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^?#]*)", 1).alias("name"),
        F.length("html").cast("long").alias("size_bytes"),
    )


def gcs_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' line items as one inventory dialect, some deleted."""
    t = read(spark, sf_dir, "lineitem")
    classes = F.element_at(F.array(*[F.lit(c) for c in ("STANDARD", "NEARLINE", "COLDLINE", "ARCHIVE", "OTHER")]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return t.select(
        F.col("l_returnflag").alias("bucket"), F.concat(F.lit("g/"), "l_orderkey", F.lit("-"), "l_linenumber").alias("name"), F.floor("l_quantity").cast("long").alias("size"),
        F.col("l_shipdate").cast("timestamp").alias("timeCreated"), F.when(F.col("l_linenumber") == 2, F.col("l_shipdate").cast("timestamp")).alias("timeDeleted"), classes.alias("storageClass"),
    )


def s3_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as another dialect with delete markers and old versions."""
    t = read(spark, sf_dir, "orders")
    return t.select(
        F.concat(F.lit("b"), F.col("o_custkey") % 3).alias("Bucket"), F.concat(F.lit("s/"), "o_orderkey").alias("Key"), F.floor("o_totalprice").cast("long").alias("Size"),
        F.col("o_orderdate").cast("timestamp").alias("LastModifiedDate"), F.when(F.col("o_orderkey") % 2 == 0, "GLACIER").otherwise("STANDARD_IA").alias("StorageClass"),
        (F.col("o_orderkey") % 9 == 0).alias("IsDeleteMarker"), (F.col("o_orderkey") % 8 != 0).alias("IsLatest"),
    )


def order_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, year, month and day: few at each place, so many directories hold one directory only."""
    t = read(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    name = F.concat(F.lit("c"), "o_custkey", F.lit("/y"), F.year(day), F.lit("/m"), F.month(day), F.lit("/d"), F.day(day), F.lit("/o"), "o_orderkey")
    return t.select(F.lit("orders").alias("bucket"), name.alias("name"), F.floor("o_totalprice").cast("long").alias("size_bytes"), day.cast("timestamp").alias("created"))


def docs_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents")
    return t.select(F.col("lang").alias("bucket"), F.concat("source", F.lit("/"), "doc_id").alias("name"), F.col("n_chars").cast("long").alias("size_bytes"))


def tree(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return rollup(listing(spark, sf_dir), **how)


def store(spark: SparkSession) -> Store:
    """The application's own store in the shared folder."""
    return Store(spark, f"{home(spark)}/store")


def stored(spark: SparkSession, sf_dir: str, bucket: str | None = None) -> DataFrame:
    """The tree of the listing, or of one of its buckets, from the store; the first reader of a table's listing indexes it."""
    t = store(spark).load_or_create(f"{sf_dir}/lineitem", lambda: tree(spark, sf_dir))
    return t if bucket is None else t.filter(F.col("bucket") == bucket)


def snapshot(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Two states of one bucket, from the store: what was there at two dates, where the earliest objects have gone by the second one."""
    first, last = {"a": ("1900-01-01", "1998-01-01"), "b": ("1992-07-01", "2100-01-01")}[which]
    rows = lambda: listing(spark, sf_dir).filter((F.col("bucket") == "A") & (F.col("created") >= first) & (F.col("created") < last))
    return store(spark).load_or_create(f"{sf_dir}/lineitem#{which}", lambda: rollup(rows()).drop("bucket"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans from orders: customers' URIs at three levels, one per order, with ties of time."""
    t = read(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    uri = F.concat(
        F.lit("gcs://b"), c % 4, F.when(c % 3 > 0, F.concat(F.lit("/d"), c % 7)).otherwise(""), F.when(c % 3 == 2, F.concat(F.lit("/e"), c % 5)).otherwise("")
    )
    return t.select(
        F.col("o_orderkey").cast("int").alias("id"), uri.alias("path"), F.col("o_orderdate").cast("timestamp").alias("time"),
        F.floor("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 50).cast("long").alias("n_children"), (F.col("o_orderkey") % 500).cast("long").alias("n_desc"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"),
    )


def asked_uris(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("gcs://b0",), ("gcs://b1/d3",), ("gcs://b2/d5/e1",), ("gcs://b3/d6/e4/deep/er",), ("gcs://none/x",)], "uri string")


def raw_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw usage rows from events, some without bucket, address, agent, method or operation; one request in 20 is logged twice."""
    t = read(spark, sf_dir, "events")
    kind, even = F.col("event_type"), F.col("user_id") % 2 == 0
    method = (
        F.when(kind == "signup", "POST").when(kind == "purchase", "DELETE").when((kind == "error") & even, "PATCH").when((kind == "error") & (F.col("user_id") % 4 == 1), "HEAD")
        .when(kind != "error", "GET")
    )
    operation = (
        F.when((kind == "click") & even, "LIST_Bucket").when(kind == "click", "GET_BUCKET").when(kind == "purchase", "DELETE_Object")
        .when((kind == "view") & even, "GET_Bucket").when((kind == "signup") & even, "POST_Object").when((kind == "error") & even, "PUT_Bucket")
    )
    rows = t.select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time_micros"), F.when(F.col("user_id") % 13 > 0, F.concat(F.lit("ip"), F.col("user_id") % 40)).alias("c_ip"),
        method.alias("cs_method"), F.when(kind == "error", 500).otherwise(200).alias("sc_status"),
        (F.col("user_id") % 1000).cast("long").alias("cs_bytes"), F.floor("value").cast("long").alias("sc_bytes"), F.when(even, "agent").alias("cs_user_agent"),
        F.concat(F.lit("r"), "event_id").alias("s_request_id"),
        operation.alias("cs_operation"), F.when(F.col("user_id") % 17 > 0, F.concat(F.lit("b"), F.col("user_id") % 3)).alias("cs_bucket"),
        F.when(kind != "click", F.concat(kind, F.lit("/u"), F.col("user_id") % 20, F.lit("/k"), F.get_json_object("props", "$.k"))).alias("cs_object"),
    )
    return rows.unionByName(rows.filter(F.substring("s_request_id", 2, 20).cast("long") % 20 == 0))


def access_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.canonical_gcs(raw_access(spark, sf_dir))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "prefix string, user string, team string, source string, ord long")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs from customers: names with hashes and resume marks; half of the names have one owner, the others one by nation."""
    t = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.concat(
        F.lit("llama-experiment-"), k % 200, F.when(k % 3 == 0, F.concat(F.lit("-"), F.lower(F.lpad(F.hex(k * 7919), 8, "0")))).otherwise(""),
        F.when(k % 4 == 1, F.concat(F.lit("_resume"), k % 3)).otherwise(""),
    )
    pairs = [("output_path", F.concat(F.lit("gs://b/runs/"), k % 200, F.lit("/"))), ("ckpt_dir", F.lit("gs://b/ckpt")), ("x_RUN_DIR", F.concat(F.lit("gs://b/own/"), k)), ("data", F.lit("gs://b/data"))]
    paths = F.to_json(F.array(*[F.array(F.lit(name), path) for name, path in pairs]))
    user = F.when(k % 200 < 100, k % 200).otherwise(F.col("c_nationkey") + k % 2 + 1000)
    return t.select(name.alias("name"), F.concat(F.lit("u"), user).alias("user"), paths.alias("gs_paths"))


def run_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run directories: exact names, names with another hash, bare stems and longer ones."""
    t = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, "").when(k % 4 == 3, "-0badcafe").when(k % 4 == 2, "_resume9").otherwise("-extra-long")
    return t.select(F.concat(F.lit("llama-experiment-"), k % 200, tail).alias("leaf"))


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step sidecars from parts: some with the name of a run, some in a run's directory, some with an output path, some with nothing."""
    t = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("steps/llama-experiment-"), k % 200)).when(k % 3 == 1, "steps/tokenize")
    folder = F.concat(F.lit("gs://b/steps/"), k % 7, F.lit("/llama-experiment-"), (k + 1) % 200, F.when(k % 2 == 0, "-0badcafe").otherwise("_resume9"))
    out = F.when(k % 5 == 0, F.concat(F.lit("gs://b/out/"), k % 50, F.lit("/"))).when(k % 5 == 1, "/tmp/out")
    return t.select(F.concat(folder, F.lit("/.executor_info")).alias("path"), name.alias("name"), out.alias("output_path"))


def bucket_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live buckets from nations; scans know a few of them."""
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("b"), "n_nationkey").alias("name"), F.col("n_name").alias("created"))


def normalized(df: DataFrame) -> DataFrame:
    return normalize(df)
