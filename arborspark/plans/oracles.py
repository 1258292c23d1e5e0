"""DuckDB SQL for the registered queries. It climbs paths row by row with recursive queries, a different way from the plans."""

from __future__ import annotations

L = """
l AS (
  SELECT l_returnflag AS bucket,
         l_linestatus || CASE WHEN l_orderkey % 7 = 0 THEN '//' ELSE '/' END || 'y' || year(l_shipdate) || '/m' || month(l_shipdate) || '/o' || (l_orderkey % 97)
           || '/l' || l_orderkey || '-' || l_linenumber || CASE WHEN l_orderkey % 31 = 0 THEN '/' ELSE '' END AS name,
         CAST(floor(l_quantity) AS BIGINT) * 1024 AS size_bytes, CAST(epoch(l_shipdate) AS BIGINT) AS created_s,
         CAST(l_suppkey % 4 + 1 AS INTEGER) AS storage_class_id
  FROM lineitem
), c AS (SELECT bucket, rtrim(regexp_replace(name, '/+', '/', 'g'), '/') AS name, size_bytes, created_s, storage_class_id FROM l)
"""
PAGES = """
l AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS bucket, regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS name,
         CAST(length(html) AS BIGINT) AS size_bytes, CAST(NULL AS BIGINT) AS created_s, 0 AS storage_class_id
  FROM pages
), c AS (SELECT bucket, rtrim(regexp_replace(name, '/+', '/', 'g'), '/') AS name, size_bytes, created_s, storage_class_id FROM l)
"""
GCS = """
g AS (
  SELECT l_returnflag AS bucket, 'g/' || l_orderkey || '-' || l_linenumber AS name, CAST(floor(l_quantity) AS BIGINT) AS size_bytes,
         CAST(epoch(l_shipdate) AS BIGINT) AS created_s, CAST([1, 2, 3, 4, 0][l_suppkey % 5 + 1] AS INTEGER) AS storage_class_id
  FROM lineitem WHERE l_linenumber <> 2
)
"""
S3 = """
s AS (
  SELECT 'b' || (o_custkey % 3) AS bucket, 's/' || o_orderkey AS name, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
         CAST(epoch(o_orderdate) AS BIGINT) AS created_s, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 2 END AS INTEGER) AS storage_class_id
  FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0
)
"""
ORDERS = """
c AS (
  SELECT 'orders' AS bucket, 'c' || o_custkey || '/y' || year(o_orderdate) || '/m' || month(o_orderdate) || '/d' || day(o_orderdate) || '/o' || o_orderkey AS name,
         CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CAST(epoch(o_orderdate) AS BIGINT) AS created_s, 0 AS storage_class_id
  FROM orders
)
"""


def tree(files: str = "SELECT * FROM c", scheme: str = "gcs", name: str = "tree", more: str = "", more_files: str = "", more_dirs: str = "") -> str:
    """CTEs that end in ``name``: the published tree of ``files`` (bucket, name, size_bytes, created_s, ...)."""
    n = name
    return f"""
{n}_f AS (SELECT *, coalesce(created_s, 0) AS mtime, regexp_extract(name, '^(.*)/[^/]+$', 1) AS up FROM ({files}) WHERE bucket IS NOT NULL AND name <> ''),
{n}_climb AS (
  SELECT bucket, up AS dir, up AS src, size_bytes, mtime, storage_class_id FROM {n}_f
  UNION ALL SELECT bucket, regexp_extract(dir, '^(.*)/[^/]+$', 1), src, size_bytes, mtime, storage_class_id FROM {n}_climb WHERE dir <> ''
),
{n}_d AS (
  SELECT bucket, dir, sum(size_bytes) AS size, greatest(max(mtime), 0) AS mtime, count(*) AS n_files, count(*) FILTER (src = dir) AS direct {more}
  FROM {n}_climb GROUP BY bucket, dir
),
{n}_sub AS (
  SELECT bucket, regexp_extract(dir, '^(.*)/[^/]+$', 1) AS dir, true AS kid FROM {n}_d WHERE dir <> ''
  UNION ALL SELECT bucket, regexp_extract(dir, '^(.*)/[^/]+$', 1), false FROM {n}_sub WHERE dir <> ''
),
{n}_n AS (SELECT bucket, dir, count(*) AS n_sub, count(*) FILTER (kid) AS kids FROM {n}_sub GROUP BY bucket, dir),
{n} AS (
  SELECT bucket, CASE WHEN dir = '' THEN '.' ELSE dir END AS path, CAST(size AS BIGINT) AS size, CAST(mtime AS BIGINT) AS mtime,
         CAST(n_files + coalesce(n_sub, 0) + 1 AS BIGINT) AS n_desc, CAST(n_files AS BIGINT) AS n_files, CAST(direct + coalesce(kids, 0) AS BIGINT) AS n_children,
         'dir' AS kind, CASE WHEN dir <> '' AND dir NOT LIKE '%/%' THEN '.' ELSE regexp_extract(dir, '^(.*)/[^/]+$', 1) END AS parent {more_dirs},
         '{scheme}://' || bucket || CASE WHEN dir = '' THEN '' ELSE '/' || dir END AS uri,
         CAST(CASE WHEN dir = '' THEN 0 ELSE length(dir) - length(replace(dir, '/', '')) + 1 END AS INTEGER) AS depth
  FROM {n}_d LEFT JOIN {n}_n USING (bucket, dir)
  UNION ALL
  SELECT bucket, name, size_bytes, mtime, 1, 1, 0, 'file', up {more_files}, '{scheme}://' || bucket || '/' || name,
         CAST(length(name) - length(replace(name, '/', '')) + 1 AS INTEGER) FROM {n}_f
)"""


def snap(which: str) -> str:
    at = {"a": "created_s < 883612800", "b": "created_s >= 709948800"}[which]  # 1998-01-01, 1992-07-01
    return tree(f"SELECT * FROM c WHERE bucket = 'A' AND {at}", name=which)


W = "WITH RECURSIVE "
T = W + L + "," + tree()
AB = W + L + "," + snap("a") + "," + snap("b")
REG = """
reg AS (
  SELECT CAST(o_orderkey AS INTEGER) AS id,
         'gcs://b' || (o_custkey % 4) || CASE WHEN o_custkey % 3 > 0 THEN '/d' || (o_custkey % 7) ELSE '' END || CASE WHEN o_custkey % 3 = 2 THEN '/e' || (o_custkey % 5) ELSE '' END AS path,
         CAST(epoch(o_orderdate) AS BIGINT) AS time_s, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(o_orderkey % 50 AS BIGINT) AS n_children,
         CAST(o_orderkey % 500 AS BIGINT) AS n_desc, CAST(epoch(o_orderdate) AS BIGINT) AS mtime
  FROM orders
)
"""
ACC = """
logged AS (
  SELECT *, user_id % 2 = 0 AS even,
         CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'DELETE' WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'PATCH' WHEN user_id % 4 = 1 THEN 'HEAD' END
              ELSE 'GET' END AS method,
         CASE WHEN event_type = 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'LIST_Bucket' ELSE 'GET_BUCKET' END WHEN event_type = 'purchase' THEN 'DELETE_Object'
              WHEN user_id % 2 = 0 THEN CASE event_type WHEN 'view' THEN 'GET_Bucket' WHEN 'signup' THEN 'POST_Object' WHEN 'error' THEN 'PUT_Bucket' END END AS operation
  FROM events
),
raw AS (
  SELECT epoch_us(ts) AS ts_us, 'gcs' AS store, 'b' || (user_id % 3) AS bucket,
         CASE WHEN event_type = 'click' THEN '' ELSE event_type || '/u' || (user_id % 20) || '/k' || json_extract_string(props, '$.k') END AS path,
         CASE WHEN regexp_matches(operation, '^LIST|.BUCKET$') THEN 'LIST' WHEN starts_with(operation, 'GET') OR method = 'GET' THEN 'GET'
              WHEN starts_with(operation, 'PUT') OR method = 'PUT' OR operation IN ('POST_Object', 'POST_Uploads') THEN 'PUT'
              WHEN starts_with(operation, 'HEAD') OR method = 'HEAD' THEN 'HEAD' WHEN starts_with(operation, 'DELETE') OR method = 'DELETE' THEN 'DELETE' ELSE 'OTHER' END AS op,
         coalesce(operation, method, '') AS op_raw,
         CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status, CAST(floor(value) AS BIGINT) AS bytes_out, CAST(user_id % 1000 AS BIGINT) AS bytes_in,
         CASE WHEN user_id % 13 = 0 THEN '' ELSE 'ip' || (user_id % 40) END AS requester, CASE WHEN even THEN 'agent' ELSE '' END AS user_agent, 'r' || event_id AS request_id
  FROM logged WHERE user_id % 17 > 0
),
leaf AS (
  SELECT path, CAST(floor(ts_us / 86400000000) AS INTEGER) AS day, op, count(*) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
         count(DISTINCT requester) AS n_requesters
  FROM raw GROUP BY 1, 2, 3
)
"""


def access_tree(leaf: str = "leaf", bucket: str = "") -> str:
    b, pb = (f"{bucket}, ", f"PARTITION BY {bucket}, p") if bucket else ("", "PARTITION BY p")
    return f"""
up AS (
  SELECT {b}path AS p, true AS own, day, op, n_ops, bytes_out, bytes_in, n_requesters FROM {leaf}
  UNION ALL SELECT {b}regexp_extract(p, '^(.*)/[^/]+$', 1), false, day, op, n_ops, bytes_out, bytes_in, n_requesters FROM up WHERE p <> ''
),
sums AS (
  SELECT {b}p, day, op, sum(n_ops) AS n_ops, sum(bytes_out) AS bytes_out, sum(bytes_in) AS bytes_in, sum(n_requesters) AS n_requesters, bool_or(own) AS own
  FROM up GROUP BY ALL
),
atree AS (
  SELECT {b}CASE WHEN p = '' THEN '.' ELSE p END AS path, CASE WHEN p <> '' AND p NOT LIKE '%/%' THEN '.' ELSE regexp_extract(p, '^(.*)/[^/]+$', 1) END AS parent,
         CAST(CASE WHEN p = '' THEN 0 ELSE length(p) - length(replace(p, '/', '')) + 1 END AS INTEGER) AS depth,
         CASE WHEN p <> '' AND bool_or(own) OVER ({pb}) THEN 'file' ELSE 'dir' END AS kind, day, op, CAST(n_ops AS BIGINT) AS n_ops, CAST(bytes_out AS BIGINT) AS bytes_out,
         CAST(bytes_in AS BIGINT) AS bytes_in, CAST(n_requesters AS BIGINT) AS n_requesters
  FROM sums
)"""


PFX = """
pfx AS (
  SELECT * FROM (
    SELECT b.bucket || '/F' AS key, CAST(NULL AS VARCHAR) AS "user", 'data' AS team, 1 AS depth, 'rules' AS source FROM (SELECT DISTINCT bucket FROM l) b
    UNION ALL VALUES ('A/O/y1996', 'ann', 'infra', 2, 'rules'), ('A/O/y1996/m3', NULL, 'data', 3, 'rules'), ('N', 'cyd', 'web', 0, 'manual'),
                     ('N/O/y1997/m5/o11', 'dee', 'web', 4, 'records'), ('R/O/y1998', NULL, 'infra', 2, 'records')
  )
)"""


def attributed(rows: str, keys: str) -> str:
    """CTE ``own``: ``rows`` with their directory's deepest prefix, by comparing each directory with every prefix."""
    return f"""
dirs AS (SELECT DISTINCT bucket, dir FROM {rows}),
hit AS (
  SELECT d.bucket, d.dir, p.*, row_number() OVER (PARTITION BY d.bucket, d.dir ORDER BY p.depth DESC) AS r
  FROM dirs d JOIN pfx p ON d.bucket || CASE WHEN d.dir = '' THEN '' ELSE '/' || d.dir END || '/' LIKE p.key || '/%'
),
own AS (SELECT {keys}, h."user", coalesce(h.team, 'unattributed') AS team, h.key, h.source FROM {rows} x LEFT JOIN (SELECT * FROM hit WHERE r = 1) h ON x.bucket = h.bucket AND x.dir = h.dir)"""


TOTALS = """
tot AS (SELECT bucket, CASE WHEN name LIKE '%/%' THEN regexp_replace(name, '/[^/]*$', '') ELSE '' END AS dir, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS objects FROM l GROUP BY 1, 2)"""
ATTR = "WITH " + L + "," + PFX + "," + TOTALS + "," + attributed("tot", "x.*")
OWNED = (
    "WITH " + L + "," + PFX + ", rows AS (SELECT *, CASE WHEN name LIKE '%/%' THEN regexp_replace(name, '/[^/]*$', '') ELSE '' END AS dir FROM c),"
    + attributed("rows", "x.*")
)
DETAIL = """
det AS (
  SELECT bucket, CASE WHEN name LIKE '%/%' THEN regexp_replace(name, '/[^/]*$', '') ELSE '' END AS dir, size_bytes AS b, created_s AS sec, storage_class_id AS k FROM c
),
lev AS (
  SELECT bucket, split_part(dir, '/', 1) AS d1, split_part(dir, '/', 2) AS d2, split_part(dir, '/', 3) AS d3, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS objects,
         CAST(sum(CAST(b AS HUGEINT) * sec) AS VARCHAR) AS second_bytes, CAST(sum(b) AS BIGINT) AS dated_bytes, CAST(coalesce(sum(b) FILTER (k = 2), 0) AS BIGINT) AS class2_bytes,
         CAST(coalesce(sum(b) FILTER (k = 3), 0) AS BIGINT) AS class3_bytes, CAST(coalesce(sum(b) FILTER (k = 4), 0) AS BIGINT) AS class4_bytes
  FROM det GROUP BY 1, 2, 3, 4
),
nod AS (
  SELECT bucket AS path, '' AS parent, 0 AS depth, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(objects) AS BIGINT) AS objects FROM lev GROUP BY bucket
  UNION ALL SELECT bucket || '/' || d1, bucket, 1, CAST(sum(bytes) AS BIGINT), CAST(sum(objects) AS BIGINT) FROM lev WHERE d1 <> '' GROUP BY bucket, d1
  UNION ALL SELECT bucket || '/' || d1 || '/' || d2, bucket || '/' || d1, 2, CAST(sum(bytes) AS BIGINT), CAST(sum(objects) AS BIGINT) FROM lev WHERE d2 <> '' GROUP BY bucket, d1, d2
  UNION ALL SELECT bucket || '/' || d1 || '/' || d2 || '/' || d3, bucket || '/' || d1 || '/' || d2, 3, CAST(sum(bytes) AS BIGINT), CAST(sum(objects) AS BIGINT)
            FROM lev WHERE d3 <> '' GROUP BY bucket, d1, d2, d3
)"""
OWN_LEVELS = """, olev AS (
  SELECT bucket, split_part(dir, '/', 1) AS d1, split_part(dir, '/', 2) AS d2, split_part(dir, '/', 3) AS d3, "user", team, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS objects,
         CAST(sum(CAST(size_bytes AS HUGEINT) * created_s) AS VARCHAR) AS second_bytes, CAST(sum(size_bytes) AS BIGINT) AS dated_bytes,
         CAST(coalesce(sum(size_bytes) FILTER (storage_class_id = 2), 0) AS BIGINT) AS class2_bytes, CAST(coalesce(sum(size_bytes) FILTER (storage_class_id = 3), 0) AS BIGINT) AS class3_bytes,
         CAST(coalesce(sum(size_bytes) FILTER (storage_class_id = 4), 0) AS BIGINT) AS class4_bytes
  FROM own GROUP BY 1, 2, 3, 4, 5, 6
)"""


def shares(key: str) -> str:
    """CTE ``shr``: path, key, its bytes b and the node's bytes t."""
    return f""", per AS (
  SELECT bucket AS path, {key}, bytes FROM olev UNION ALL SELECT bucket || '/' || d1, {key}, bytes FROM olev WHERE d1 <> ''
  UNION ALL SELECT bucket || '/' || d1 || '/' || d2, {key}, bytes FROM olev WHERE d2 <> '' UNION ALL SELECT bucket || '/' || d1 || '/' || d2 || '/' || d3, {key}, bytes FROM olev WHERE d3 <> ''
), shr AS (SELECT path, {key}, sum(bytes) AS b, sum(sum(bytes)) OVER (PARTITION BY path) AS t FROM per GROUP BY 1, 2)
"""


PRICE = "CASE {k} WHEN 1 THEN 0.020::DOUBLE WHEN 2 THEN 0.010::DOUBLE WHEN 3 THEN 0.004::DOUBLE WHEN 4 THEN 0.0012::DOUBLE ELSE 0.020::DOUBLE END"
RUNS = r"""
runs AS (
  SELECT 'llama-experiment-' || (c_custkey % 200) || CASE WHEN c_custkey % 3 = 0 THEN '-' || lpad(lower(printf('%x', c_custkey * 7919)), 8, '0') ELSE '' END
           || CASE WHEN c_custkey % 4 = 1 THEN '_resume' || (c_custkey % 3) ELSE '' END AS name,
         'u' || CASE WHEN c_custkey % 200 < 100 THEN c_custkey % 200 ELSE c_nationkey + c_custkey % 2 + 1000 END AS "user", c_custkey AS k
  FROM customer
),
leaves AS (
  SELECT DISTINCT 'llama-experiment-' || (p_partkey % 200) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 3 THEN '-0badcafe' WHEN 2 THEN '_resume9' ELSE '-extra-long' END AS leaf FROM part
)
"""


def no_hash(x: str) -> str:
    return f"regexp_replace({x}, '-[0-9a-f]{{6,8}}$', '')"


def stem(x: str) -> str:
    return f"regexp_replace(regexp_replace({no_hash(x)}, '[_-]resume[0-9]+.*$', ''), '[_-]+$', '')"


def matched(leaves: str) -> str:
    """CTE ``matched``: leaf, stage, n_users, user of the run name that each leaf finds first."""
    return f"""
ix AS (SELECT name, count(DISTINCT "user") AS n_users, min("user") AS "user" FROM runs GROUP BY name),
tried AS (
  SELECT leaf, 1 AS stage, 0 AS n, '' AS name, n_users, "user" FROM {leaves} JOIN ix ON name = leaf
  UNION ALL SELECT leaf, 2, 0, '', n_users, "user" FROM {leaves} JOIN ix ON name = {no_hash('leaf')}
  UNION ALL SELECT leaf, 3, 0, '', n_users, "user" FROM {leaves} JOIN ix ON name = {stem('leaf')}
  UNION ALL SELECT leaf, 4, -length(t), name, n_users, "user" FROM (SELECT leaf, {stem('leaf')} AS s FROM {leaves}) JOIN (SELECT *, {stem('name')} AS t FROM ix)
    ON length(s) >= 16 AND length(t) >= 16 AND left(s, 12) = left(t, 12) AND (starts_with(s, t) OR starts_with(t, s))
),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY stage, n, name) AS r FROM tried) WHERE r = 1)"""


def diff_sql(keys: str, depth: int, unchanged: bool, a: str = "a", b: str = "b") -> str:
    where = "" if unchanged else "WHERE status <> 'unchanged'"
    return f"""
da AS (SELECT {keys}, sum(size) AS size_a, sum(n_desc) AS na FROM {a} WHERE depth = {depth} GROUP BY {keys}),
db AS (SELECT {keys}, sum(size) AS size_b, sum(n_desc) AS nb FROM {b} WHERE depth = {depth} GROUP BY {keys}),
dd AS (
  SELECT * FROM (
    SELECT {keys}, CASE WHEN size_a IS NULL THEN 'added' WHEN size_b IS NULL THEN 'removed' WHEN size_a <> size_b OR na <> nb THEN 'changed' ELSE 'unchanged' END AS status,
           CAST(size_a AS BIGINT) AS size_a, CAST(size_b AS BIGINT) AS size_b, CAST(coalesce(size_b, 0) - coalesce(size_a, 0) AS BIGINT) AS size_delta,
           CAST(coalesce(nb, 0) - coalesce(na, 0) AS BIGINT) AS n_desc_delta
    FROM da FULL JOIN db USING ({keys})) {where}
)"""


COLS = "bucket, name, size_bytes, created_s, storage_class_id"
DUP = "SELECT bucket, name, count(*) AS n FROM l GROUP BY 1, 2"
ORACLES: dict[str, str] = {
    "listing_normalized": "WITH " + L + f"SELECT {COLS} FROM l",
    "listing_inventory_dialects": "WITH " + GCS + "," + S3 + f"SELECT {COLS} FROM g UNION ALL SELECT {COLS} FROM s",
    "listing_priority_merge": "WITH " + L + "," + GCS + f"""SELECT {COLS} FROM l WHERE bucket <> 'N' UNION ALL SELECT {COLS} FROM g WHERE bucket = 'N'
        UNION ALL SELECT lang, source || '/' || doc_id, CAST(n_chars AS BIGINT), CAST(NULL AS BIGINT), 0 FROM documents""",
    "bucket_list": "WITH " + L + "SELECT DISTINCT bucket FROM l UNION SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages",
    "path_canonical": "WITH " + L + """, b AS (SELECT bucket, name FROM l UNION ALL
        SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) FROM pages)
        SELECT bucket, name, rtrim(regexp_replace(name, '/+', '/', 'g'), '/') AS path, name LIKE '%//%' OR name LIKE '%/' AS dirty FROM b""",
    "path_parent_depth": "WITH " + L + """SELECT bucket, name AS path, regexp_extract(name, '^(.*)/[^/]+$', 1) AS parent,
        CAST(len(string_split(name, '/')) AS INTEGER) AS depth, string_split(name, '/')[-1] AS base, split_part(name, '/', 2) AS second FROM c""",
    "path_ancestors": W + L + """, p AS (SELECT DISTINCT bucket, name FROM c), up AS (SELECT bucket, regexp_extract(name, '^(.*)/[^/]+$', 1) AS dir FROM p
        UNION ALL SELECT bucket, regexp_extract(dir, '^(.*)/[^/]+$', 1) FROM up WHERE dir <> '') SELECT bucket, dir, count(*) AS n_paths FROM up GROUP BY 1, 2""",
    "path_rebase": T + """SELECT path, kind, CASE WHEN path = 'F/y1997' THEN '.' ELSE substr(path, 9) END AS rel, path AS again FROM tree
        WHERE bucket = 'A' AND (path = 'F/y1997' OR starts_with(path, 'F/y1997/'))""",
    "tree_rollup": T + "SELECT * FROM tree",
    "tree_rollup_pages": W + PAGES + "," + tree(scheme="http") + "SELECT * FROM tree",
    "tree_rollup_pivot": W + L + "," + tree(
        more="".join(f", coalesce(sum(size_bytes) FILTER (storage_class_id = {k}), 0) AS s{k}" for k in (1, 2, 3, 4)),
        more_files=", NULL, NULL, NULL, NULL", more_dirs="".join(f", CAST(s{k} AS BIGINT) AS sum_storage_class_id_{k}" for k in (1, 2, 3, 4)),
    ) + "SELECT * FROM tree WHERE kind = 'dir'",
    "tree_rollup_mean_mtime": W + L + "," + tree(
        more=", sum(CAST(mtime AS HUGEINT) * size_bytes) AS wsum", more_files=", NULL",
        more_dirs=", CASE WHEN size <> 0 THEN CAST(CAST(wsum AS VARCHAR) AS DOUBLE) / CAST(CAST(size AS VARCHAR) AS DOUBLE) END AS mtime_mean",
    ) + "SELECT bucket, path, size, mtime, mtime_mean FROM tree WHERE kind = 'dir'",
    "tree_rollup_root": T + "SELECT uri, size, mtime, n_desc, n_files, n_children FROM tree WHERE path = '.'",
    "children_at": T + "SELECT path, kind, size, n_desc, n_children FROM tree WHERE bucket = 'A' AND parent = 'F/y1997'",
    "children_at_root": T + "SELECT path, kind, size, n_desc, n_children FROM tree WHERE bucket = 'A' AND depth = 1",
    "drill_topk_closure": T + """, v AS (SELECT substr(path, 3) AS path, kind, size, depth - 1 AS depth, parent FROM tree WHERE bucket = 'A' AND starts_with(path, 'O/') AND depth <= 4
          UNION ALL SELECT '.', kind, size, 0, '' FROM tree WHERE bucket = 'A' AND path = 'O'),
        top AS (SELECT * FROM v ORDER BY size DESC, path, kind LIMIT 40)
        SELECT path, CASE WHEN depth = 0 THEN '' WHEN parent = 'O' THEN '.' ELSE substr(parent, 3) END AS parent, CAST(depth AS INTEGER) AS depth, kind, size FROM v
        WHERE (path, kind) IN (SELECT (path, kind) FROM top) OR (kind = 'dir' AND (path = '.' OR EXISTS (SELECT 1 FROM top WHERE starts_with(top.path, v.path || '/'))))""",
    "subtree_filter": T + "SELECT path, kind, size, depth FROM tree WHERE bucket = 'N' AND (path = 'O/y1998/m4' OR starts_with(path, 'O/y1998/m4/'))",
    "depth_filter": T + "SELECT bucket, path, kind, size, depth FROM tree WHERE depth BETWEEN 1 AND 3",
    "path_search": T + "SELECT bucket, path, kind, size FROM tree WHERE path ILIKE '%y1999/m7/o5%'",
    "expand_single": W + ORDERS + "," + tree() + """,
        d AS (SELECT path, n_children FROM tree WHERE kind = 'dir' AND path <> '.'),
        ch AS (SELECT s.path, k.path AS tip, k.n_children, 1 AS n FROM d s JOIN d k ON s.n_children = 1 AND regexp_extract(k.path, '^(.*)/[^/]+$', 1) = s.path
          UNION ALL SELECT ch.path, k.path, k.n_children, n + 1 FROM ch JOIN d k ON ch.n_children = 1 AND regexp_extract(k.path, '^(.*)/[^/]+$', 1) = ch.tip)
        SELECT path, arg_max(tip, n) AS "end", CAST(max(n) AS INTEGER) AS n_collapsed FROM ch GROUP BY path""",
    "path_stats": T + "SELECT bucket, path, size, mtime, n_desc, n_files, n_children FROM tree WHERE path = 'F/y1999/m12'",
    "unaccounted": T + """, s AS (SELECT * FROM tree WHERE bucket = 'A' AND size >= 40000 AND depth <= 4),
        k AS (SELECT CASE WHEN parent = '' THEN '.' ELSE parent END AS p, sum(size) AS shown FROM s WHERE path <> '.' GROUP BY 1)
        SELECT p AS parent, CAST(size - shown AS BIGINT) AS size FROM s JOIN k ON path = p WHERE kind = 'dir' AND size - shown > 10000""",
    "virtual_root": T + """SELECT CAST(sum(size) AS BIGINT) AS size, max(mtime) AS mtime, CAST(sum(n_desc) AS BIGINT) AS n_desc, count(*) AS n_children
        FROM tree WHERE bucket = 'N' AND depth = 1""",
    "page_of_children": T + "SELECT path, size FROM tree WHERE bucket = 'A' AND parent = 'F/y1997/m3' ORDER BY size DESC, path, kind LIMIT 10 OFFSET 10",
    "snapshot_latest": "WITH " + REG + "SELECT id, path, time_s, size FROM (SELECT *, max(time_s) OVER (PARTITION BY path) AS m FROM reg) WHERE time_s = m",
    "scan_series": "WITH " + REG + "SELECT id, path, time_s, size FROM reg WHERE path = 'gcs://b1/d3' ORDER BY time_s DESC, id DESC LIMIT 5",
    "covering_scan": "WITH " + REG + """, u(uri) AS (VALUES ('gcs://b0'), ('gcs://b1/d3'), ('gcs://b2/d5/e1'), ('gcs://b3/d6/e4/deep/er'), ('gcs://none/x')),
        h AS (SELECT uri, id, path AS scan_path, time_s, row_number() OVER (PARTITION BY uri ORDER BY time_s DESC, length(path) DESC, id DESC) AS r
              FROM u JOIN reg ON uri = path OR starts_with(uri, path || '/'))
        SELECT uri, id, scan_path, time_s, CASE WHEN uri = scan_path THEN '.' ELSE substr(uri, length(scan_path) + 2) END AS rel_path FROM h WHERE r = 1""",
    "scan_history": AB + """, u(uri, p) AS (VALUES ('gcs://A', '.'), ('gcs://A/F/y1997', 'F/y1997'), ('gcs://A/O/y1999/m2', 'O/y1999/m2')),
        s AS (SELECT 1 AS scan_id, 1704067200 AS time_s, * FROM a UNION ALL SELECT 2, 1706745600, * FROM b)
        SELECT u.uri, scan_id, CAST(time_s AS BIGINT) AS time_s, p AS rel_path, size, n_desc, n_children, mtime FROM u JOIN s ON s.path = p""",
    "snapshot_diff": AB + "," + diff_sql("path", 3, False) + "SELECT * FROM dd",
    "snapshot_diff_subtree": AB + """, va AS (SELECT substr(path, 12) AS path, size, n_desc, depth - 3 AS depth FROM a WHERE starts_with(path, 'F/y1997/m3/')),
        vb AS (SELECT substr(path, 12) AS path, size, n_desc, depth - 3 AS depth FROM b WHERE starts_with(path, 'F/y1997/m3/')),""" + diff_sql("path", 2, True, "va", "vb") + "SELECT * FROM dd",
    "diff_totals": AB + "," + diff_sql("path", 5, True) + "SELECT status, count(*) AS n, CAST(sum(size_delta) AS BIGINT) AS size_delta FROM dd GROUP BY status",
    "tree_compare": AB + """, x AS (SELECT path, n_files AS o, size AS y FROM a WHERE kind = 'dir' AND depth = 2), z AS (SELECT path, n_files AS o, size AS y FROM b WHERE kind = 'dir' AND depth = 2),
        j AS (SELECT path, coalesce(x.o, 0) AS objects_a, coalesce(z.o, 0) AS objects_b, coalesce(x.y, 0) AS bytes_a, coalesce(z.y, 0) AS bytes_b FROM x FULL JOIN z USING (path)),
        d AS (SELECT *, objects_b - objects_a AS objects_delta, bytes_b - bytes_a AS bytes_delta FROM j)
        (SELECT * FROM d ORDER BY abs(bytes_delta) DESC, path LIMIT 5)
        UNION ALL SELECT 'TOTAL', CAST(sum(objects_a) AS BIGINT), CAST(sum(objects_b) AS BIGINT), CAST(sum(bytes_a) AS BIGINT), CAST(sum(bytes_b) AS BIGINT),
                         CAST(sum(objects_delta) AS BIGINT), CAST(sum(bytes_delta) AS BIGINT) FROM d""",
    "delete_path": W + L + "," + tree() + "," + tree("SELECT * FROM c WHERE NOT starts_with(name, 'F/y1997/')", name="rest") + """
        SELECT path, kind, size, n_desc, n_files, n_children FROM rest WHERE bucket = 'A'""",
    "fresher_patch": "WITH " + REG + """, t AS (SELECT max(time_s) AS t FROM reg WHERE path = 'gcs://b1/d3'),
        s AS (SELECT path AS uri, min(size) AS size, min(n_children) AS n_children, min(n_desc) AS n_desc, min(mtime) AS mtime FROM reg GROUP BY 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY time_s DESC, id DESC) AS r FROM reg, t WHERE time_s > t.t)
        SELECT uri, coalesce(n.size, s.size) AS size, coalesce(n.n_children, s.n_children) AS n_children, coalesce(n.n_desc, s.n_desc) AS n_desc,
               coalesce(n.mtime, s.mtime) AS mtime, n.id IS NOT NULL AS patched FROM s LEFT JOIN n ON uri = path AND r = 1""",
    "partial_children": "WITH " + REG + """, g AS (SELECT * FROM reg WHERE length(path) <> 11 OR path < 'gcs://b2/d3'), live AS (SELECT 'gcs://b2/d' || k AS uri FROM range(9) t(k)),
        e AS (SELECT path, arg_max(size, (time_s, id)) AS size FROM g GROUP BY path)
        SELECT uri, CASE WHEN e.path IS NOT NULL THEN 'true' WHEN EXISTS (SELECT 1 FROM g WHERE starts_with(g.path, uri || '/')) THEN 'partial' ELSE 'false' END AS scanned,
               e.size AS scan_size FROM live LEFT JOIN e ON uri = e.path""",
    "access_parse": "WITH " + ACC + "SELECT * FROM raw",
    "access_dedupe": "WITH " + ACC + "SELECT op, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM raw GROUP BY op",
    "access_leaf": "WITH " + ACC + "SELECT * FROM leaf",
    "access_rollup": W + ACC + "," + access_tree() + "SELECT * FROM atree",
    "access_rollup_by_bucket": W + ACC + """, bleaf AS (SELECT bucket, path, CAST(floor(ts_us / 86400000000) AS INTEGER) AS day, op, count(*) AS n_ops, sum(bytes_out) AS bytes_out,
        sum(bytes_in) AS bytes_in, count(DISTINCT requester) AS n_requesters FROM raw GROUP BY 1, 2, 3, 4),""" + access_tree("bleaf", "bucket") + "SELECT * FROM atree",
    "access_top": W + ACC + "," + access_tree() + """SELECT path, op, CAST(sum(n_ops) AS BIGINT) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
        CAST(sum(bytes_in) AS BIGINT) AS bytes_in, max(n_requesters) AS n_requesters FROM atree WHERE depth = 2 GROUP BY 1, 2 ORDER BY bytes_out DESC, path, op LIMIT 25""",
    "attr_prefix_map": "WITH " + L + "," + PFX + 'SELECT key, "user", team, CAST(depth AS INTEGER) AS depth FROM pfx',
    "attr_deepest": ATTR + 'SELECT bucket, dir, bytes, objects, "user", team, key FROM own',
    "attr_report": ATTR + 'SELECT team, "user", CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(objects) AS BIGINT) AS objects, count(*) AS n_dirs FROM own GROUP BY 1, 2',
    "attr_source_coverage": ATTR + "SELECT source, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(objects) AS BIGINT) AS objects FROM own WHERE key IS NOT NULL GROUP BY 1",
    "attr_gaps": ATTR + """SELECT array_to_string((string_split(CASE WHEN dir = '' THEN bucket ELSE bucket || '/' || dir END, '/'))[1:3], '/') AS prefix,
        CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(objects) AS BIGINT) AS objects FROM own WHERE team = 'unattributed' GROUP BY 1""",
    "attr_claims": ATTR + "SELECT key, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(objects) AS BIGINT) AS objects FROM own WHERE \"user\" = 'cyd' GROUP BY 1",
    "attr_user_prefix": "WITH " + L + "SELECT DISTINCT bucket || '/users/' || split_part(name, '/', 4) AS prefix, split_part(name, '/', 4) AS raw FROM c",
    "identity_resolve": """SELECT c_custkey, CASE WHEN c_custkey IN (3, 4) THEN 'customer-000000003' ELSE replace(lower(c_name), '#', '-') END AS "user",
        CASE WHEN c_custkey IN (3, 4) THEN 'data' ELSE 'unknown' END AS team FROM customer""",
    "run_name_match": "WITH " + RUNS + "," + matched("leaves") + 'SELECT leaf, "user", CAST(stage AS INTEGER) AS stage FROM matched WHERE n_users = 1',
    "writer_path_owner": "WITH " + RUNS + """, p AS (SELECT 'gs://b/runs/' || (k % 200) AS prefix, "user" FROM runs UNION ALL SELECT 'gs://b/own/' || k, "user" FROM runs)
        SELECT prefix, min("user") AS "user" FROM p GROUP BY prefix HAVING count(DISTINCT "user") = 1""",
    "sidecar_owners": "WITH " + RUNS + """, side AS (SELECT 'gs://b/steps/' || (p_partkey % 7) || '/' AS top,
          'llama-experiment-' || ((p_partkey + 1) % 200) || CASE WHEN p_partkey % 2 = 0 THEN '-0badcafe' ELSE '_resume9' END AS dir,
          CASE p_partkey % 3 WHEN 0 THEN 'llama-experiment-' || (p_partkey % 200) WHEN 1 THEN 'tokenize' END AS tail,
          CASE WHEN p_partkey % 5 = 0 THEN 'gs://b/out/' || (p_partkey % 50) END AS out FROM part),
        own_leaves AS (SELECT dir AS leaf FROM side UNION SELECT tail FROM side WHERE tail IS NOT NULL),""" + matched("own_leaves") + """,
        j AS (SELECT coalesce(out, top || dir) || '/' AS prefix, top || dir || '/.executor_info' AS path, CASE WHEN t.leaf IS NOT NULL THEN t.n_users ELSE d.n_users END AS n_users,
          CASE WHEN t.leaf IS NOT NULL THEN t."user" ELSE d."user" END AS "user" FROM side LEFT JOIN matched t ON t.leaf = tail LEFT JOIN matched d ON d.leaf = dir)
        SELECT prefix, arg_min("user", (path, "user")) AS "user" FROM j WHERE n_users = 1 GROUP BY prefix""",
    "run_dirs": "WITH " + L + """, d AS (SELECT string_split(regexp_replace(name, '/[^/]*$', ''), '/') AS p FROM l)
        SELECT DISTINCT array_to_string(p[1:k-1], '/') AS parent, p[k] AS leaf FROM d, range(2, 5) t(k) WHERE len(p) >= k""",
    "record_owners": """SELECT 'r/' || o_orderkey AS path, CASE WHEN o_orderkey % 5 >= 3 THEN 'u' || (o_custkey % 10) END AS built_by, o_orderkey % 5 = 0 AS failed FROM orders""",
    "census_buckets": "WITH " + L + "SELECT bucket, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM l GROUP BY 1",
    "census_top_dirs": "WITH " + L + """SELECT bucket, split_part(name, '/', 1) AS d1, split_part(name, '/', 2) AS d2, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes
        FROM l GROUP BY 1, 2, 3 ORDER BY bytes DESC, bucket, d1, d2 LIMIT 15""",
    "tree_levels": "WITH " + L + "," + DETAIL + "SELECT * FROM lev",
    "tree_nodes": "WITH " + L + "," + DETAIL + "SELECT * FROM nod",
    "tree_fold": "WITH " + L + "," + DETAIL + """, m AS (SELECT *, count(*) FILTER (bytes < 2000000) OVER (PARTITION BY parent) AS n FROM nod)
        SELECT parent, depth, CASE WHEN bytes < 2000000 AND n >= 2 THEN '(other ×' || n || ')' ELSE string_split(path, '/')[-1] END AS name, bytes < 2000000 AND n >= 2 AS folded,
               CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(objects) AS BIGINT) AS objects FROM m GROUP BY 1, 2, 3, 4""",
    "tree_residual_fold": "WITH " + L + "," + DETAIL + """, t AS (SELECT sum(bytes) AS t FROM nod WHERE depth = 0), k AS (SELECT parent, path AS name, bytes, objects FROM nod, t WHERE depth > 0 AND bytes >= t * 0.005),
        r AS (SELECT n.path AS parent, '(other)' AS name, CAST(max(n.bytes) - sum(k.bytes) AS BIGINT) AS bytes, CAST(max(n.objects) - sum(k.objects) AS BIGINT) AS objects FROM nod n JOIN k ON n.path = k.parent GROUP BY 1)
        SELECT * FROM k UNION ALL SELECT * FROM r WHERE bytes > 0 OR objects > 0""",
    "age_strata": "WITH " + L + """SELECT CAST(created_s // 86400 AS INTEGER) AS day, split_part(name, '/', 1) AS d1, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS objects FROM c GROUP BY 1, 2""",
    "age_buckets": "WITH " + L + """, d AS (SELECT CAST(created_s // 86400 AS INTEGER) AS day, size_bytes FROM c)
        SELECT CAST(day - (day + 3) % 7 AS INTEGER) AS bucket, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS objects, 'week' AS unit FROM d GROUP BY 1
        UNION ALL SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(date_trunc('month', DATE '1970-01-01' + day) AS DATE)) AS INTEGER), CAST(sum(size_bytes) AS BIGINT), count(*), 'month' FROM d GROUP BY 1""",
    "class_mix": OWNED + 'SELECT team, "user", storage_class_id, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS objects FROM own GROUP BY 1, 2, 3',
    "class_totals": "WITH " + L + "SELECT storage_class_id, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS objects FROM l GROUP BY 1",
    "top_users_per_node": "WITH " + L + """, s AS (SELECT bucket || '/' || split_part(name, '/', 1) AS path, 'u' || (CAST(regexp_extract(name, '/l([0-9]+)-', 1) AS BIGINT) % 40) AS "user", CAST(sum(size_bytes) AS BIGINT) AS bytes FROM c GROUP BY 1, 2)
        SELECT * FROM (SELECT path, "user", bytes, CAST(row_number() OVER (PARTITION BY path ORDER BY bytes DESC, "user") AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "dominant_team": OWNED + """, s AS (SELECT bucket || '/' || split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) AS path, team, sum(size_bytes) AS b FROM own GROUP BY 1, 2),
        r AS (SELECT *, sum(b) OVER (PARTITION BY path) AS t, row_number() OVER (PARTITION BY path ORDER BY b DESC, team) AS r FROM s)
        SELECT path, team, CAST(b AS BIGINT) AS bytes, CASE WHEN t <> 0 THEN CAST(b AS DOUBLE) / CAST(t AS DOUBLE) END AS share FROM r WHERE r = 1""",
    "user_ranks": OWNED + """, s AS (SELECT "user", team, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM own WHERE "user" IS NOT NULL GROUP BY 1, 2)
        SELECT *, CAST(row_number() OVER (ORDER BY bytes DESC, "user") AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY team ORDER BY bytes DESC, "user") AS INTEGER) AS team_rank,
               count(*) OVER (PARTITION BY team) AS team_size FROM s""",
    "cost_estimate": OWNED + f""", p AS (SELECT team, storage_class_id AS k, sum(size_bytes) AS b FROM own GROUP BY 1, 2)
        SELECT team, CAST(sum(b) AS BIGINT) AS bytes, round(sum(CAST(b AS DOUBLE) / 1073741824 * {PRICE.format(k='k')}), 6) AS usd FROM p GROUP BY team""",
    "cost_delta": "WITH " + L + f""", p AS (SELECT CAST(year(to_timestamp(created_s) AT TIME ZONE 'UTC') AS VARCHAR) AS date, storage_class_id AS k, sum(size_bytes) AS b FROM l GROUP BY 1, 2),
        s AS (SELECT date, CAST(sum(b) AS BIGINT) AS bytes, round(sum(CAST(b AS DOUBLE) / 1073741824 * {PRICE.format(k='k')}), 6) AS usd FROM p GROUP BY date),
        d AS (SELECT *, lag(bytes) OVER (ORDER BY date) AS b0, lag(usd) OVER (ORDER BY date) AS u0 FROM s)
        SELECT date, bytes, usd, bytes - b0 AS bytes_delta, round(usd - u0, 6) AS usd_delta, coalesce(bytes - b0 > b0 * 0.005, false) AS spike, bytes > 5e8 AS over_ceiling FROM d""",
    "blended_rates": OWNED + f""", p AS (SELECT team, storage_class_id AS k, sum(size_bytes) AS b FROM own GROUP BY 1, 2),
        s AS (SELECT team, CAST(sum(b) AS BIGINT) AS bytes, round(sum(CAST(b AS DOUBLE) / 1073741824 * {PRICE.format(k='k')}), 6) AS usd FROM p GROUP BY team)
        SELECT *, CASE WHEN bytes <> 0 THEN usd / CAST(bytes AS DOUBLE) END AS usd_per_byte FROM s""",
    "stale_score": W + L + "," + tree(
        more=", sum(CAST(mtime AS HUGEINT) * size_bytes) AS wsum", more_files=", NULL",
        more_dirs=", CASE WHEN size <> 0 THEN CAST(CAST(wsum AS VARCHAR) AS DOUBLE) / CAST(CAST(size AS VARCHAR) AS DOUBLE) END AS mtime_mean",
    ) + """SELECT bucket, path, round(CAST(size AS DOUBLE) * (1100000000 - mtime_mean) / 1099511627776::DOUBLE / 31557600, 9) AS stale FROM tree WHERE kind = 'dir' AND depth <= 3""",
    "prefix_weights": "WITH " + L + """SELECT bucket, split_part(name, '/', 1) || '/' AS prefix, count(*) AS n FROM c GROUP BY 1, 2
        UNION ALL SELECT bucket, split_part(name, '/', 1) || '/' || split_part(name, '/', 2) || '/', count(*) FROM c GROUP BY 1, 2""",
    "range_boundaries": "WITH " + L + """, r AS (SELECT name, row_number() OVER (ORDER BY name) AS r, count(*) OVER () AS t FROM c)
        SELECT CAST(k AS INTEGER) AS cut, name FROM r, range(1, 16) x(k) WHERE r = CAST(ceil(k * t / 16.0::DOUBLE) AS BIGINT)""",
    "dup_keys": "WITH " + L + f"SELECT * FROM ({DUP}) WHERE n > 1",
    "dup_keys_audit": "WITH " + L + f"SELECT bucket, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n) - count(*) AS BIGINT) AS n_surplus FROM ({DUP}) GROUP BY 1",
    "nested_prefix_dedupe": T + """, p AS (SELECT path || '/' AS prefix FROM tree WHERE bucket = 'A' AND kind = 'dir' AND path <> '.' AND mtime >= 850000000)
        SELECT prefix, (SELECT min(q.prefix) FROM p q WHERE starts_with(p.prefix, q.prefix) AND q.prefix <> p.prefix) AS covered_by FROM p""",
    "storage_stats": AB + "SELECT CAST(2 AS BIGINT) AS n_scans, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS total_size FROM (SELECT size FROM a UNION ALL SELECT size FROM b)",
    "chunk_stats_nested": AB + """SELECT path, CASE WHEN depth > 1 THEN parent END AS chunk, size, n_desc, n_children FROM a WHERE depth >= 1 AND kind = 'dir' AND n_desc >= 100""",
    "index_load_or_create": T + """SELECT CAST(sum(size) AS BIGINT) AS size, CAST(sum(n_children) AS BIGINT) AS n_children, CAST(sum(n_desc) AS BIGINT) AS n_desc, max(mtime) AS mtime
        FROM tree WHERE path = '.'""",
    "delete_registry_sync": W + L + "," + tree("SELECT * FROM c WHERE bucket = 'A' AND NOT starts_with(name, 'F/y1997/')", name="rest") + """,
        whole AS (SELECT max(created_s) AS mtime FROM c WHERE bucket = 'A') SELECT 'gcs://A' AS path, size, n_children, n_desc, whole.mtime FROM rest, whole WHERE path = '.'""",
    "bucket_scans": "WITH " + REG + """, b AS (SELECT 'b' || n_nationkey AS name, n_name AS created FROM nation), s AS (SELECT name, reg.*, row_number() OVER (PARTITION BY name ORDER BY time_s DESC, id DESC) AS r
          FROM b JOIN reg ON reg.path = 'gcs://' || name OR starts_with(reg.path, 'gcs://' || name || '/'))
        SELECT b.name, b.created, time_s AS last_scanned, size, n_children, n_desc FROM b LEFT JOIN s ON s.name = b.name AND r = 1""",
    "bucket_selection": "WITH " + REG + """, s AS (SELECT arg_max(size, (time_s, id)) AS size, arg_max(n_desc, (time_s, id)) AS n_desc FROM reg WHERE path LIKE 'gcs://b0%' OR path LIKE 'gcs://b1%'
          GROUP BY left(path, 8))
        SELECT (SELECT count(*) FROM nation WHERE 'b' || n_nationkey < 'b2') AS n, count(*) AS n_scanned, CAST(sum(size) AS BIGINT) AS size, CAST(sum(n_desc) AS BIGINT) AS n_desc FROM s""",
    "key_range": "WITH " + L + "SELECT bucket, name, size_bytes FROM l WHERE name >= 'F/y1994/m2' AND name < 'O'",
    "monotonic_runs": """WITH r AS (SELECT o_custkey % 50 AS shard, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
        f AS (SELECT shard, price < lag(price) OVER (PARTITION BY shard ORDER BY o_orderkey) AS fell FROM r)
        SELECT shard, count(*) FILTER (fell) AS falls, count(*) AS n FROM f GROUP BY shard""",
    "maximal_matches": T + """SELECT bucket, path, size FROM tree WHERE kind = 'dir' AND path <> '.' AND regexp_matches(path, '(^|/)(m1[0-2]?|o1[^/]*)$')
        AND NOT regexp_matches(path, '(^|/)(m1[0-2]?|o1[^/]*)/')""",
    "scan_codes": """WITH s AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 3) * 43200 AS s FROM orders),
        t AS (SELECT o_orderkey, CAST(s / 86400.0::DOUBLE AS INTEGER) AS near_day, make_timestamp(s * 1000000) AS t, o_orderkey % 3 = 0 AS whole FROM s)
        SELECT o_orderkey, near_day, strftime(t, '%Y-%m-%d') || CASE WHEN whole THEN '' ELSE strftime(t, 'T%H%M') END AS scan,
          strftime(t, '%y%m%d') || CASE WHEN whole THEN '' ELSE strftime(t, '-%H%M') END AS code,
          '20' || strftime(t, '%y-%m-%d') || CASE WHEN whole THEN '' ELSE strftime(t, 'T%H%M') END AS again FROM t""",
    "census_users": "WITH " + L + """SELECT bucket, split_part(rtrim(regexp_replace(name, '/+', '/', 'g'), '/'), '/', 4) AS segment, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes
        FROM l GROUP BY 1, 2""",
    "census_records": "WITH " + L + "SELECT bucket, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM l WHERE size_bytes < 9000 GROUP BY 1",
    "census_depth1": "WITH " + L + """SELECT bucket, split_part(name, '/', 1) AS d1, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM l GROUP BY 1, 2
        ORDER BY bytes DESC, bucket, d1 LIMIT 20""",
    "tree_levels_owned": OWNED + OWN_LEVELS + "SELECT * FROM olev",
    "node_team_shares": OWNED + OWN_LEVELS + shares("team") + 'SELECT path, team, CAST(b AS BIGINT) AS bytes, CAST(b AS DOUBLE) / CAST(t AS DOUBLE) AS share FROM shr',
    "rollup_bar": OWNED + OWN_LEVELS + shares('"user"') + """SELECT path, CASE WHEN CAST(b AS DOUBLE) / CAST(t AS DOUBLE) >= 0.01 AND "user" IS NOT NULL THEN "user" ELSE 'other' END AS name,
        CAST(sum(b) AS BIGINT) AS bytes FROM shr GROUP BY 1, 2""",
    "category_order": "WITH " + L + "SELECT split_part(name, '/', 1) AS d1, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM c GROUP BY 1",
    "child_ranks": "WITH " + L + "," + DETAIL + "SELECT path, parent, bytes, CAST(row_number() OVER (PARTITION BY parent ORDER BY bytes DESC, path) AS INTEGER) AS rank FROM nod WHERE depth > 0",
    "signed_tiles": AB + """, x AS (SELECT path, size AS y FROM a WHERE kind = 'dir' AND depth = 2), z AS (SELECT path, size AS y FROM b WHERE kind = 'dir' AND depth = 2),
        d AS (SELECT path, coalesce(z.y, 0) - coalesce(x.y, 0) AS delta FROM x FULL JOIN z USING (path))
        SELECT path, CAST(delta AS BIGINT) AS delta, CAST(abs(delta) AS BIGINT) AS weight, CAST(sign(delta) AS INTEGER) AS sign FROM d WHERE delta <> 0""",
    "age_rows_in_order": "WITH " + L + """SELECT CAST(created_s // 86400 AS INTEGER) AS day, split_part(name, '/', 1) AS d1, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS objects FROM c GROUP BY 1, 2""",
    "chunk_stats": AB + "SELECT path, size, n_desc, n_children FROM a WHERE depth = 1 AND kind = 'dir' AND n_desc >= 100",
}
