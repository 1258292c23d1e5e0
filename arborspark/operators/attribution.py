"""Ownership: identities, prefix maps, the deepest matching prefix of every directory, reports, run-name matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.functions.text import glob_regex, sanitize_username, stem, without_hash

#: Prefix maps up to this many rows are broadcast; larger ones join by shuffle.
MOST_BROADCAST = 200_000


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Identities:
    """Users with aliases and teams. Aliases must name one user only."""

    def __init__(self, users: dict[str, dict], teams: Sequence[str] = (), prefix_owners: Sequence[dict] = ()):
        self.users, self.teams, self.prefix_owners = users, list(teams), list(prefix_owners)
        self.aliases: dict[str, str] = {}
        for user, about in users.items():
            for alias in [user, *about.get("aliases", [])]:
                if self.aliases.setdefault(alias, user) != user:
                    raise ValueError(f"alias {alias!r} names both {self.aliases[alias]!r} and {user!r}")

    def alias_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(a, u, self.users[u].get("team", "unknown")) for a, u in self.aliases.items()]
        return spark.createDataFrame(rows, "alias string, user string, team string")

    def findings(self) -> list[str]:
        """What is wrong with the rules: aliases that say nothing, unknown teams and users, malformed, repeated or shadowed prefixes."""
        out = [f"redundant alias {a!r} of {u!r}" for u, about in self.users.items() for a in about.get("aliases", []) if a == u]
        known = set(self.teams) or {about.get("team") for about in self.users.values()}
        out += [f"unknown team {about['team']!r} of {u!r}" for u, about in self.users.items() if about.get("team") and about["team"] not in known]
        seen: dict[str, dict] = {}
        for rule in self.prefix_owners:
            prefix = rule["prefix"]
            if "://" not in prefix or not prefix.endswith("/"):
                out.append(f"malformed prefix {prefix!r}")
            if prefix in seen:
                out.append(f"repeated prefix {prefix!r}")
            for other, about in seen.items():
                if prefix != other and prefix.startswith(other) and (about.get("team"), about.get("user")) == (rule.get("team"), rule.get("user")):
                    out.append(f"{other!r} already covers {prefix!r}")
            seen.setdefault(prefix, rule)
            if rule.get("team") and rule["team"] not in known:
                out.append(f"unknown team {rule['team']!r} of {prefix!r}")
            if rule.get("user") and rule["user"] not in self.users:
                out.append(f"unknown user {rule['user']!r} of {prefix!r}")
        return out


def resolve(rows: DataFrame, identities: Identities, column: str = "raw") -> DataFrame:
    """``rows`` with user (canonical, or the sanitized name) and team (``unknown`` for others)."""
    named = rows.withColumn("_name", sanitize_username(F.col(column)))
    alias = identities.alias_rows(rows.sparkSession).select(F.col("alias").alias("_name"), F.col("user").alias("_u"), F.col("team").alias("_t"))
    joined = named.join(sized(alias), "_name", "left")
    return joined.select(*rows.columns, F.coalesce("_u", "_name").alias("user"), F.coalesce("_t", F.lit("unknown")).alias("team"))


def expand_wildcards(owners: DataFrame, buckets: DataFrame) -> DataFrame:
    """Owner rules (prefix ``scheme://bucket/path/``, user, team, ord) to keys ``bucket/path``; a ``*`` in the bucket matches by glob. Rules and
    buckets are tables of configuration: the pairs are made on the side of the rules, by a regular expression per rule."""
    bare = F.rtrim(F.substring_index("prefix", "://", -1), F.lit("/"))
    rules = owners.select(F.substring_index(bare, "/", 1).alias("_b"), bare.alias("key"), "user", "team", "ord")
    plain = rules.filter(~F.col("_b").rlike(r"[*?\[]")).select("key", "user", "team", "ord")
    wild = rules.filter(F.col("_b").rlike(r"[*?\[]")).collect()  # rules of the configuration, not data
    for r in wild:
        rest = r.key[len(r._b) :]
        found = buckets.filter(F.col("bucket").rlike(glob_regex(r._b)))
        plain = plain.unionByName(
            found.select(F.concat("bucket", F.lit(rest)).alias("key"), F.lit(r.user).cast("string").alias("user"), F.lit(r.team).cast("string").alias("team"), F.lit(r.ord).cast("long").alias("ord"))
        )
    return plain


def prefix_map(rules: DataFrame) -> DataFrame:
    """key, user, team, depth: the first writer (smallest ord) of each key wins."""
    best = rules.groupBy("key").agg(F.min_by(F.struct("user", "team"), "ord").alias("w"))
    return best.select("key", "w.user", "w.team", (F.length("key") - F.length(F.replace(F.col("key"), F.lit("/")))).alias("depth"))


def dir_of(name: Column) -> Column:
    """The directory of a key, ``''`` at the top."""
    return F.when(name.contains("/"), F.regexp_replace(name, "/[^/]*$", "")).otherwise("")


def dir_totals(listing: DataFrame) -> DataFrame:
    """bucket, dir, bytes, objects."""
    return listing.groupBy("bucket", dir_of(F.col("name")).alias("dir")).agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("objects"))


def deepest(dirs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``dirs`` (bucket, dir) with user, team and key of the deepest prefix at or above. User and team travel as one value, so a deeper
    team-only rule beats a shallower user. Only as many ancestors are made as the deepest prefix needs, for distinct directories."""
    most = prefixes.agg(F.max("depth")).first()[0] or 0
    full = F.when(F.col("dir") == "", F.col("bucket")).otherwise(F.concat("bucket", F.lit("/"), "dir"))
    parts = F.split(full, "/")
    up = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most + 1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = dirs.select("bucket", "dir").distinct()
    hits = own.select("bucket", "dir", F.explode(up).alias("key")).join(sized(prefixes), "key")
    best = hits.groupBy("bucket", "dir").agg(F.max_by(F.struct("user", "team", "key"), "depth").alias("w"))
    return dirs.join(best, ["bucket", "dir"], "left").select(*dirs.columns, "w.user", F.coalesce("w.team", F.lit("unattributed")).alias("team"), "w.key")


def report(attributed: DataFrame) -> DataFrame:
    """team, user, bytes, objects, n_dirs."""
    return attributed.groupBy("team", "user").agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"), F.count("*").alias("n_dirs"))


def claims(attributed: DataFrame, user: str) -> DataFrame:
    """key, bytes, objects of every prefix that a user owns."""
    return attributed.filter(F.col("user") == user).groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))


def gaps(attributed: DataFrame, depth: int) -> DataFrame:
    """Unattributed bytes by the first ``depth`` components under the bucket."""
    full = F.when(F.col("dir") == "", F.col("bucket")).otherwise(F.concat("bucket", F.lit("/"), "dir"))
    at = F.array_join(F.slice(F.split(full, "/"), 1, depth + 1), "/")
    rows = attributed.filter("team = 'unattributed'").groupBy(at.alias("prefix"))
    return rows.agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))


def source_coverage(attributed: DataFrame, rules: DataFrame) -> DataFrame:
    """source, bytes, objects of the rule that each directory follows."""
    source = rules.groupBy("key").agg(F.min_by("source", "ord").alias("source"))
    return attributed.filter("key IS NOT NULL").join(source, "key").groupBy("source").agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))


def user_prefixes(listing: DataFrame, top: str = "users") -> DataFrame:
    """Signals from ``users/<name>/``: prefix, raw."""
    rows = listing.filter(F.col("name").startswith(top + "/")).select("bucket", paths.component(F.col("name"), 2).alias("raw"), F.col("name"))
    rows = rows.filter((F.col("raw") != "") & F.col("name").contains("/")).select("bucket", "raw").distinct()
    return rows.select(F.concat("bucket", F.lit(f"/{top}/"), "raw").alias("prefix"), "raw")


def record_owners(records: DataFrame) -> DataFrame:
    """path, built_by, failed from artifact records (path, body): tolerant of broken, null and unrelated bodies."""
    parsed = F.try_parse_json(F.coalesce("body", F.lit("")))
    who = F.try_variant_get(parsed, "$.provenance.built_by", "string")
    return records.select("path", F.nullif(who, F.lit("")).alias("built_by"), parsed.isNull().alias("failed"))


def run_names(runs: DataFrame) -> DataFrame:
    """name, n_users, user (the smallest) of every run name; nameless runs and runs without a user go."""
    rows = runs.filter("name <> '' AND user <> ''")
    return rows.groupBy("name").agg(F.count_distinct("user").alias("n_users"), F.min("user").alias("user"))


def match_runs(leaves: DataFrame, runs: DataFrame, least: int = 16, block: int = 12, ambiguous: bool = False) -> DataFrame:
    """leaf, user, stage: run directories to run owners. The directory's name, then the name without its hash, then its stem is looked up among
    run names; at last run names are taken whose stem starts the directory's or is started by it, with at least ``least`` characters in
    common, compared within blocks of equal first characters, the longest stem first and the smallest name among equals. The first hit
    decides; if it has several users the directory has no owner (with ``ambiguous`` such rows stay, their user null)."""
    index = run_names(runs)
    own = leaves.select("leaf").distinct()
    tries = [F.col("leaf"), without_hash(F.col("leaf")), stem(F.col("leaf"))]
    asked = own.select("leaf", F.posexplode(F.array(*tries)).alias("stage", "name"))
    none, zero = F.lit(""), F.lit(0)
    exact = asked.join(index, "name").select("leaf", (F.col("stage") + 1).alias("stage"), zero.alias("n"), none.alias("name"), "n_users", "user")
    stems = index.select("name", "n_users", "user", stem(F.col("name")).alias("other"), F.substring("name", 1, block).alias("b")).filter(F.length("other") >= least)
    mine = own.select("leaf", stem(F.col("leaf")).alias("s")).filter(F.length("s") >= least).withColumn("b", F.substring("s", 1, block))
    near = mine.join(stems, "b").filter(F.col("s").startswith(F.col("other")) | F.col("other").startswith(F.col("s")))
    overlap = near.select("leaf", F.lit(4).alias("stage"), (-F.length("other")).alias("n"), "name", "n_users", "user")
    best = exact.unionByName(overlap).groupBy("leaf").agg(F.min(F.struct("stage", "n", "name", "n_users", "user")).alias("w"))
    found = best.select("leaf", F.when(F.col("w.n_users") == 1, F.col("w.user")).alias("user"), "w.stage")
    return found if ambiguous else found.filter("user IS NOT NULL")


def sidecar_owners(sidecars: DataFrame, runs: DataFrame) -> DataFrame:
    """prefix, user from step sidecars (path, name, output_path) and runs: the last component of the step's name is matched first, then the
    name of the sidecar's own directory; the first that matches decides. The prefix is the output path if that is in a store, else
    the directory; of several sidecars of one prefix the smallest path wins, and of one path the smallest user."""
    base = paths.parent(F.col("path"))
    tail = F.when(F.col("name") != "", paths.basename(F.col("name")))
    rows = sidecars.select("path", tail.alias("tail"), paths.basename(base).alias("dir"), base.alias("base"), "output_path")
    asked = rows.select(F.explode(F.array_compact(F.array("tail", "dir"))).alias("leaf"))
    found = match_runs(asked, runs, ambiguous=True)
    by = lambda c: found.select(F.col("leaf").alias(c), F.col("user").alias(f"user_{c}"), F.lit(True).alias(f"hit_{c}"))
    joined = rows.join(by("tail"), "tail", "left").join(by("dir"), "dir", "left")
    user = F.when(F.col("hit_tail"), F.col("user_tail")).otherwise(F.col("user_dir"))
    out = F.when(F.col("output_path").startswith("gs://"), F.rtrim("output_path", F.lit("/"))).otherwise(F.col("base"))
    hits = joined.select(F.concat(out, F.lit("/")).alias("prefix"), user.alias("user"), "path").filter("user IS NOT NULL")
    return hits.groupBy("prefix").agg(F.min(F.struct("path", "user")).alias("w")).select("prefix", "w.user")


def writer_paths(runs: DataFrame, pattern: str = r"(?i)(^|_)(output|save|run_dir|artifact_dir|out_dir|store|base_path)") -> DataFrame:
    """prefix, user from run configurations (user, gs_paths as JSON pairs of key and path): writing keys only, prefixes of one user only."""
    pairs = runs.select("user", F.explode(F.from_json("gs_paths", "array<array<string>>")).alias("p"))
    rows = pairs.select("user", F.element_at("p", 1).alias("key"), F.rtrim(F.element_at("p", 2), F.lit("/")).alias("prefix")).filter(F.col("key").rlike(pattern))
    return rows.groupBy("prefix").agg(F.count_distinct("user").alias("n"), F.min("user").alias("user")).filter("n = 1").drop("n")


def run_dirs(listing: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """parent, leaf of directories at levels low to high."""
    parts = F.split(dir_of(F.col("name")), "/")
    levels = F.sequence(F.lit(low), F.least(F.size(parts), F.lit(high)))
    rows = listing.filter(F.size(parts) >= low).select(F.explode(levels).alias("k"), parts.alias("p"))
    return rows.select(F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/").alias("parent"), F.element_at("p", F.col("k")).alias("leaf")).distinct()


def census(listing: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """Five overviews: per bucket, per user segment, record files, leading directories of depth 1 and 2."""
    n, b = F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes")
    one, two = paths.component(F.col("name"), 1), paths.component(F.col("name"), 2)
    in_dir = listing.filter(F.col("name").contains("/"))
    per = lambda rows, *keys: rows.groupBy("bucket", *keys).agg(n, b)
    return {
        "buckets": per(listing),
        "users": per(listing.filter(F.col("name").startswith("users/")), two.alias("segment")),
        "records": per(listing.filter(paths.basename(F.col("name")).isin(".artifact.json", ".executor_info"))),
        "depth1": per(in_dir, one.alias("d1")).orderBy(F.col("bytes").desc(), "bucket", "d1").limit(top),
        "depth2": per(in_dir.filter(F.size(F.split("name", "/")) > 2), one.alias("d1"), two.alias("d2")).orderBy(F.col("bytes").desc(), "bucket", "d1", "d2").limit(top),
    }
