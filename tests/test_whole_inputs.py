"""Registered queries read whole tables."""

from pyspark.sql import functions as F

from arborspark.plans import virtual
from arborspark.plans.catalogue import QUERIES


def test_inventory_is_the_whole_table(spark, sf):
    items = virtual.read(spark, sf, "lineitem").filter("l_linenumber <> 2")
    key = F.concat(F.lit("g/"), "l_orderkey", F.lit("-"), "l_linenumber")
    want = sorted((r[0], r[1]) for r in items.select("l_returnflag", key).collect())
    got = QUERIES["listing_inventory_dialects"](spark, sf).filter("name LIKE 'g/%'").collect()
    assert sorted((r.bucket, r.name) for r in got) == want
    merged = QUERIES["listing_priority_merge"](spark, sf).filter("bucket = 'N'").collect()
    assert sorted((r.bucket, r.name) for r in merged) == [k for k in want if k[0] == "N"]
