"""Exports of a listing with owners: level rows, folding of small children, age strata, class mixes, cost, nested JSON, layout."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.functions.text import epoch_day, epoch_seconds
from arborspark.operators.attribution import dir_of
from arborspark.scratch import ranked

#: List price per GiB and month by storage class (fixed values).
PRICES = {0: 0.020, 1: 0.020, 2: 0.010, 3: 0.004, 4: 0.0012}
FOLD_BYTES = 20_000_000_000
GIB = 1 << 30


def dir_detail(listing: DataFrame, owners: Sequence[str] = ()) -> DataFrame:
    """bucket, dir: bytes, objects, the exact sum of size times epoch second, dated bytes, and bytes of classes 2, 3 and 4."""
    size, at = F.coalesce("size_bytes", F.lit(0)), epoch_seconds(F.col("created"))
    of = lambda k: F.sum(F.when(F.col("storage_class_id") == k, size).otherwise(0)).alias(f"class{k}_bytes")
    return listing.groupBy("bucket", dir_of(F.col("name")).alias("dir"), *owners).agg(
        F.sum(size).alias("bytes"), F.count("*").alias("objects"),
        F.sum(F.when(at.isNotNull(), size.cast("decimal(19,0)") * at.cast("decimal(12,0)")).otherwise(0).cast("decimal(38,0)")).alias("second_bytes"),
        F.sum(F.when(at.isNotNull(), size).otherwise(0)).alias("dated_bytes"), of(2), of(3), of(4),
    )


def level_rows(dirs: DataFrame, levels: int = 4, owners: Sequence[str] = ()) -> DataFrame:
    """Sums per bucket and d1..d<levels> (``''`` beyond a directory's depth) and owner columns."""
    named = dirs.select("*", *[paths.component(F.col("dir"), k).alias(f"d{k}") for k in range(1, levels + 1)])
    sums = [c for c in ("bytes", "objects", "second_bytes", "dated_bytes", "class2_bytes", "class3_bytes", "class4_bytes") if c in dirs.columns]
    return named.groupBy("bucket", *[f"d{k}" for k in range(1, levels + 1)], *owners).agg(*[F.sum(c).alias(c) for c in sums])


def nodes(levels: DataFrame, depth: int = 4) -> DataFrame:
    """Every node of the level tree with bytes and objects: path of the bucket and components, parent, depth."""
    rows = None
    for k in range(depth + 1):
        keys = ["bucket", *[f"d{j}" for j in range(1, k + 1)]]
        part = levels if k == 0 else levels.filter(F.col(f"d{k}") != "")
        sums = part.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))
        path = F.concat_ws("/", *keys)
        up = F.concat_ws("/", *keys[:-1]) if k else F.lit("")
        one = sums.select(path.alias("path"), up.alias("parent"), F.lit(k).alias("depth"), "bytes", "objects")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def fold(tree: DataFrame, floor: int = FOLD_BYTES) -> DataFrame:
    """Children under ``floor`` bytes become one ``(other xN)`` per parent; a single small child stays. Counts per parent come from an
    aggregation and a join, so a directory with very many children is no window's partition."""
    small = F.col("bytes") < floor
    n = tree.groupBy("parent").agg(F.count_if(small).alias("_n"))
    rows = tree.join(n, "parent")
    goes = small & (F.col("_n") >= 2)
    name = F.when(goes, F.concat(F.lit("(other ×"), F.col("_n"), F.lit(")"))).otherwise(paths.basename(F.col("path")))
    return rows.groupBy("parent", "depth", name.alias("name"), goes.alias("folded")).agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))


def residual_fold(tree: DataFrame, share: float = 0.001) -> DataFrame:
    """Children of at least ``share`` of the total, and per parent what they leave of it."""
    total = tree.filter("depth = 0").agg(F.sum("bytes")).first()[0] or 0
    kept = tree.filter((F.col("bytes") >= total * share) & (F.col("depth") > 0)).select("parent", F.col("path").alias("name"), "bytes", "objects")
    sums = kept.groupBy("parent").agg(F.sum("bytes").alias("b"), F.sum("objects").alias("o"))
    rest = tree.select(F.col("path").alias("parent"), F.col("bytes").alias("tb"), F.col("objects").alias("to")).join(sums, "parent")
    other = rest.select("parent", F.lit("(other)").alias("name"), (F.col("tb") - F.col("b")).alias("bytes"), (F.col("to") - F.col("o")).alias("objects"))
    return kept.unionByName(other.filter("bytes > 0 OR objects > 0"))


def class_mix(owned: DataFrame) -> DataFrame:
    """team, user, storage_class_id: bytes, objects from listing rows with owners."""
    return owned.groupBy("team", "user", "storage_class_id").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("objects"))


def class_totals(listing: DataFrame) -> DataFrame:
    return listing.groupBy("storage_class_id").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("objects"))


def age_strata(listing: DataFrame, owners: Sequence[str] = ()) -> DataFrame:
    """day (epoch day), d1, owners: bytes, objects."""
    d1 = F.when(F.col("name").contains("/"), paths.component(F.col("name"), 1)).otherwise("")
    return listing.groupBy(epoch_day(F.col("created")).alias("day"), d1.alias("d1"), *owners).agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("objects"))


def age_buckets(strata: DataFrame, unit: str) -> DataFrame:
    """Strata by day, week (from Monday) or month: bucket (epoch day of its first day), bytes, objects."""
    d = F.col("day")
    start = {"day": d, "week": d - F.pmod(d + 3, F.lit(7)), "month": F.datediff(F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), d), "month"), F.lit("1970-01-01").cast("date"))}[unit]
    return strata.filter("day IS NOT NULL").groupBy(start.cast("int").alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))


def best_unit(first_day: int, last_day: int, bars: int = 30) -> str:
    """The unit whose number of bars is nearest to ``bars``."""
    span = max(1, last_day - first_day + 1)
    return min(("day", "week", "month"), key=lambda u: abs(span / {"day": 1, "week": 7, "month": 30.44}[u] - bars))


def top_users(owned_nodes: DataFrame, k: int = 5) -> DataFrame:
    """path, user, bytes, rank: the leading users of a node. A node's users are ranked in as many places as the hash of their names says, and only
    ``k`` of each place meet in the last window."""
    sums = owned_nodes.filter("user IS NOT NULL").groupBy("path", "user").agg(F.sum("bytes").alias("bytes"))
    order = [F.col("bytes").desc(), F.col("user")]
    place = F.pmod(F.xxhash64("user"), F.lit(64))
    first = sums.withColumn("rank", F.row_number().over(Window.partitionBy("path", place).orderBy(*order))).filter(F.col("rank") <= k)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("path", "user", "bytes", "rank")


def dominant(owned_nodes: DataFrame) -> DataFrame:
    """path, team, share of the team that holds most of a node; the first name wins ties."""
    sums = owned_nodes.groupBy("path", "team").agg(F.sum("bytes").alias("bytes"))
    most = sums.groupBy("path").agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most"))
    tie = sums.join(most, "path").filter("bytes = most").groupBy("path").agg(F.min("team").alias("team"), F.max("most").alias("bytes"), F.max("total").alias("total"))
    return tie.select("path", "team", "bytes", F.when(F.col("total") != 0, F.col("bytes").cast("double") / F.col("total")).alias("share"))


def price(class_id: Column, prices: dict[int, float] = PRICES) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])[class_id], F.lit(prices[0]))


def cost(class_bytes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bytes, usd: class bytes at list price; each class is summed exactly before it is priced."""
    per = class_bytes.groupBy(*keys, "storage_class_id").agg(F.sum("bytes").alias("b"))
    usd = F.round(F.sum(F.col("b").cast("double") / GIB * price(F.col("storage_class_id"))), 6)
    return per.groupBy(*keys).agg(F.sum("b").alias("bytes"), usd.alias("usd"))


def cost_delta(per_snapshot: DataFrame, spike: float = 0.1, ceiling: float | None = None) -> DataFrame:
    """Snapshots (date, bytes, usd) with the change from the one before, and the flags of an alert. One row per snapshot."""
    w = Window.orderBy("date")
    before = F.lag("bytes").over(w)
    rows = per_snapshot.withColumn("bytes_delta", F.col("bytes") - before).withColumn("usd_delta", F.round(F.col("usd") - F.lag("usd").over(w), 6))
    over = F.col("bytes") > F.lit(ceiling) if ceiling is not None else F.lit(False)
    return rows.withColumns({"spike": F.coalesce(F.col("bytes_delta") > before * spike, F.lit(False)), "over_ceiling": over})


def blended_rates(owned: DataFrame) -> DataFrame:
    """team, bytes, usd, usd_per_byte."""
    rows = cost(class_mix(owned).select("team", "storage_class_id", "bytes"), ["team"])
    return rows.withColumn("usd_per_byte", F.when(F.col("bytes") != 0, F.col("usd") / F.col("bytes")))


def stale_score(tree: DataFrame, now: int) -> DataFrame:
    """path, stale: bytes times seconds since the size-weighted mean time, in TiB-years."""
    return tree.select("bucket", "path", F.round(F.col("size").cast("double") * (F.lit(now) - F.col("mtime_mean")) / (1 << 40) / 31_557_600, 9).alias("stale"))


def nested(tree: DataFrame, floor: int = FOLD_BYTES) -> str:
    """The folded tree as JSON ``{n, b, o, c: [...]}``. Folding bounds the rows: a parent's kept children share its bytes."""
    kids: dict[str, list[dict]] = {}
    for r in fold(tree, floor).orderBy("depth", "folded", F.col("bytes").desc(), "name").toLocalIterator():
        kids.setdefault(r.parent, []).append({"n": r.name, "b": r.bytes, "o": r.objects, "_p": None if r.folded else (f"{r.parent}/{r.name}" if r.parent else r.name)})

    def build(path: str) -> list[dict]:
        out = []
        for k in kids.get(path, []):
            node = {"n": k["n"], "b": k["b"], "o": k["o"]}
            below = build(k["_p"]) if k["_p"] else []
            out.append(node | ({"c": below} if below else {}))
        return out

    roots = build("")
    return json.dumps({"n": "", "b": sum(r["b"] for r in roots), "o": sum(r["o"] for r in roots), "c": roots}, ensure_ascii=False)


def meta(listing: DataFrame) -> DataFrame:
    """One row: total bytes, objects, newest time and bytes per class as a map."""
    per = class_totals(listing)
    newest = listing.agg(F.max(epoch_seconds(F.col("created"))).alias("newest")).first()[0]
    return per.agg(
        F.sum("bytes").alias("total_bytes"), F.sum("objects").alias("total_objects"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("storage_class_id", "bytes")))).alias("class_bytes"),
    ).withColumn("newest", F.lit(newest))


def user_ranks(owned: DataFrame) -> DataFrame:
    """user, team, bytes, rank overall, rank in the team, team_size. The overall rank is made by ranges of users."""
    sums = owned.filter("user IS NOT NULL").groupBy("user", "team").agg(F.sum("bytes").alias("bytes"))
    order = [F.col("bytes").desc(), F.col("user")]
    sums = ranked(sums, *order).withColumn("rank", (F.col("rank") + 1).cast("int"))
    return sums.withColumns(
        {
            "team_rank": F.row_number().over(Window.partitionBy("team").orderBy(*order)),
            "team_size": F.count("*").over(Window.partitionBy("team")),
        }
    )


def squarify(values: Sequence[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) of areas in proportion to ``values`` (largest first), as square as a row-by-row layout makes them."""
    total = float(sum(values))
    if total <= 0 or w <= 0 or h <= 0:
        return [(x, y, 0.0, 0.0) for _ in values]
    areas = [v * w * h / total for v in values]
    out: list[tuple[float, float, float, float]] = []
    at = 0
    while at < len(areas):
        side = min(w, h)
        n, row, worst = 0, 0.0, float("inf")
        while at + n < len(areas):
            grown, largest, least = row + areas[at + n], areas[at], areas[at + n]
            shape = max(side * side * largest / grown**2, grown**2 / (side * side * least)) if least > 0 else float("inf")
            if n and shape > worst:
                break
            n, row, worst = n + 1, grown, shape
        thick = row / side
        along = 0.0
        for a in areas[at : at + n]:
            length = a / thick if thick else 0.0
            out.append((x, y + along, thick, length) if w >= h else (x + along, y, length, thick))
            along += length
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        at += n
    return out


def treemap(tree: DataFrame) -> DataFrame:
    """parent, path, x, y, w, h in the parent's unit square, one group per parent of a folded tree."""

    def layout(group):
        group = group.sort_values(["bytes", "path"], ascending=[False, True])
        boxes = squarify(group["bytes"].tolist(), 0.0, 0.0, 1.0, 1.0)
        for name, column in zip("xywh", zip(*boxes)):
            group[name] = column
        return group[["parent", "path", "x", "y", "w", "h"]]

    return tree.select("parent", "path", "bytes").groupBy("parent").applyInPandas(layout, "parent string, path string, x double, y double, w double, h double")


def node_shares(levels: DataFrame, key: str, depth: int = 4) -> DataFrame:
    """path, ``key``, bytes, share: what each value of an owner column (or class, or date) holds of every node of level rows."""
    rows = None
    for k in range(depth + 1):
        part = levels if k == 0 else levels.filter(F.col(f"d{k}") != "")
        keys = ["bucket", *[f"d{j}" for j in range(1, k + 1)]]
        one = part.groupBy(F.concat_ws("/", *keys).alias("path"), key).agg(F.sum("bytes").alias("bytes"))
        rows = one if rows is None else rows.unionByName(one)
    total = rows.groupBy("path").agg(F.sum("bytes").alias("_total"))
    share = F.when(F.col("_total") != 0, F.col("bytes").cast("double") / F.col("_total").cast("double"))
    return rows.join(total, "path").select("path", key, "bytes", share.alias("share"))


def rollup_bar(shares: DataFrame, key: str, least: float = 0.001) -> DataFrame:
    """path, name, bytes: the values of ``key`` with at least that share of a node; the smaller ones and rows without a value are ``other``."""
    name = F.when((F.col("share") >= least) & F.col(key).isNotNull(), F.col(key)).otherwise("other")
    return shares.groupBy("path", name.alias("name")).agg(F.sum("bytes").alias("bytes"))


def category_order(levels: DataFrame) -> DataFrame:
    """d1, bytes of every top directory over all buckets, most bytes first."""
    return levels.filter("d1 <> ''").groupBy("d1").agg(F.sum("bytes").alias("bytes")).orderBy(F.col("bytes").desc(), "d1")


def child_ranks(tree: DataFrame) -> DataFrame:
    """path, parent, bytes, rank of a node among its parent's children, most bytes first."""
    w = Window.partitionBy("parent").orderBy(F.col("bytes").desc(), "path")
    return tree.filter("depth > 0").select("path", "parent", "bytes", F.row_number().over(w).alias("rank"))


def signed_tiles(compared: DataFrame) -> DataFrame:
    """path, delta, weight, sign of a comparison's rows, in order of weight: tiles are as large as the change, whatever its sign."""
    weight = F.abs("bytes_delta")
    rows = compared.select("path", F.col("bytes_delta").alias("delta"), weight.alias("weight"), F.signum("bytes_delta").cast("int").alias("sign"))
    return rows.filter("weight > 0").orderBy(F.col("weight").desc(), "path")


def in_total_order(rows: DataFrame) -> DataFrame:
    """Rows ordered by all their columns, nulls last, so that files of them can be compared."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in rows.columns])
