"""Substring dedup with prefix-partitioned suffix trees.

A window is 50 consecutive words. A word of a document goes if a window covers it whose words also start in a document with a
smaller doc_id. Generalized suffix trees over all different texts find those windows:

1. Sampling. Only suffixes that can repeat become leaves: of the 43 runs of 8 words in a window the one with the smallest hash is the
   window's seed, so equal windows have equal seeds. Seeds that occur in one document only are dropped, with all their windows.
   Texts with equal words are one string of the trees; its leaves stand for all of them under their smallest doc_id.
2. Groups. The suffixes around one seed are a group, known by that 8-word prefix. Windows that follow one another with the same
   seed travel as one stretch of text, whose suffixes the group's task makes itself; equal stretches are merged before that.
   A prefix with over ``GROUP`` stretches is lengthened: each of its suffixes travels alone, cut to ``REACH`` words, and belongs to the
   group of its first 16 words, or of its first 32 where those are in over ``GROUP`` different suffixes, or of its first 50. So no group outgrows
   a task, whatever prefix is frequent.
3. Trees. A task sorts a group's suffixes and takes the longest common prefixes of neighbours, in words. Intervals of that array
   are the tree's internal nodes; a node's depth is the length of the repeat that its path spells. Suffixes under one node of 50 words or more
   share a window, and the smallest doc_id below the topmost such node decides for all of them. Where the first 50 words are crowded
   too, the node is known without its tree, and a sum over its leaves gives the smallest doc_id.
4. Removal. Flagged windows return to their documents by a join, and the words that they cover are removed.

``dedup`` gives what is left of each document; ``maximal_repeats`` gives the deep nodes themselves.

Defined results: null, empty and short texts (under 50 words) lose nothing; of documents with equal words the smallest doc_id keeps
them; rows that repeat a doc_id are no smaller document to each other; a null doc_id neither loses words nor takes any; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.llm.common import arrow_rows, materialize, utf8
from arborspark.llm.repetition import grow

WINDOW, SEED_WORDS = 50, 8
#: Stretches, or suffixes, that a group may hold, and the lengths to which a prefix is lengthened where it has more.
GROUP, LENGTHS = 2_000, (16, 32, WINDOW)
#: Words of a suffix that travels alone.
REACH = 60
#: Names of stretches that a task remembers as sent, and places among which a crowded prefix is dealt.
REMEMBERED, SALTS = 100_000, 16

STATS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("short", T.LongType()),
        T.StructField("seeds", T.ArrayType(T.LongType(), False)),
        T.StructField("times", T.ArrayType(T.IntegerType(), False)),
    ]
)
SUFFIXES = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("prefixes", T.ArrayType(T.LongType(), False)),
        T.StructField("stretch", T.BinaryType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("short", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("words", T.BinaryType()),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("short", T.LongType()),
        T.StructField("removed", T.LongType()),
        T.StructField("kept", T.StringType()),
    ]
)
EMPTY = hashlib.sha256(b"").hexdigest()


def digest_of(words: list[bytes]) -> str:
    """sha256 of words joined by one space."""
    return hashlib.sha256(b" ".join(words)).hexdigest()


def short_of(digest: str) -> int:
    return int.from_bytes(bytes.fromhex(digest[:16]), "big", signed=True)


def window_seeds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every window the place of its seed (the leftmost smallest hash), and the hashes of all runs of 8 words."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    runs, starts = hashes, np.arange(n)
    for size in range(2, SEED_WORDS + 1):
        starts, runs = starts[:-1], runs[:-1]
        runs = grow(runs, hashes, starts, size)
    # the smallest of 2^k neighbours from those of 2^(k-1); two spans of 32 then cover 43
    span, best, at = 1, runs, np.arange(len(runs))
    reach = WINDOW - SEED_WORDS + 1
    while span * 2 <= reach:
        later = best[span:] < best[:-span]
        at = np.where(later, at[span:], at[:-span])
        best = np.where(later, best[span:], best[:-span])
        span *= 2
    gap = reach - span
    if gap:
        later = best[gap:] < best[:-gap]
        at = np.where(later, at[gap:], at[:-gap])
    return at, runs


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last windows of the runs of windows with one seed."""
    if not len(at):
        return at, at
    cuts = np.flatnonzero(np.diff(at)) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(at)]))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, digest, short (64 bits of it), the different seeds of every row and the stretches that each has."""

    def make():
        def each(row: dict) -> Iterator[tuple]:
            words = utf8(row["text"]).split()
            at, runs = window_seeds(words)
            digest = digest_of(words)
            seeds, times = np.unique(runs[at[_stretches(at)[0]]], return_counts=True)
            yield row["doc_id"], len(words), digest, short_of(digest), seeds.view(np.int64), times.astype(np.int32)

        return each

    return arrow_rows(docs.select("doc_id", "text"), STATS, make, out_rows=2_000)


def suffixes(candidates: DataFrame) -> DataFrame:
    """Stretches with shared seeds, rows of SUFFIXES, from (doc_id, short, text, seeds, crowded). Those of a crowded seed are one suffix
    each, with the hashes of their first words and no key yet. Words are null where the task has sent the same before."""

    def make():
        sent: set[bytes] = set()

        def once(name: bytes, part: bytes) -> bytes | None:
            if name in sent:
                return None
            if len(sent) >= REMEMBERED:
                sent.clear()
            sent.add(name)
            return part

        def each(row: dict) -> Iterator[tuple]:
            words = utf8(row["text"]).split()
            if short_of(digest_of(words)) != row["short"]:
                return  # another row with this doc_id
            at, runs = window_seeds(words)
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            begins = np.concatenate(([0], ends[:-1])).tolist()
            ends = (ends - 1).tolist()
            shared = dict(zip(row["seeds"], row["crowded"]))
            firsts, lasts = _stretches(at)
            keys = runs[at[firsts]].view(np.int64).tolist()
            for key, a, b in zip(keys, firsts.tolist(), lasts.tolist()):
                crowded = shared.get(key)
                if crowded is None:
                    continue
                if not crowded:
                    part = joined[begins[a] : ends[b + WINDOW - 2]]
                    name = xxhash.xxh3_128_digest(part)
                    yield key, None, name, row["doc_id"], row["short"], a, b - a, once(name, part)
                    continue
                for c in range(a, b):
                    part = joined[begins[c] : ends[min(c + REACH, len(words)) - 1]]
                    name = xxhash.xxh3_128_digest(part)
                    if (new := once(name, part)) is None:
                        yield None, None, name, row["doc_id"], row["short"], c, 1, None
                    else:
                        heads = [xxhash.xxh64_intdigest(joined[begins[c] : ends[c + k - 1]]) for k in LENGTHS]
                        yield None, np.array(heads, np.uint64).view(np.int64), name, row["doc_id"], row["short"], c, 1, new

        return each

    return arrow_rows(candidates.select("doc_id", "short", "text", "seeds", "crowded"), SUFFIXES, make, out_rows=4_000)


def _salted(rows: DataFrame, crowded: DataFrame, on: str) -> DataFrame:
    """``rows`` left-joined with ``crowded``, a crowded value being dealt among SALTS places."""
    salt = F.pmod(F.xxhash64("stretch"), F.lit(SALTS))
    places = crowded.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(places, [on, "_salt"], "left").drop("_salt")


def lengthened(alone: DataFrame, group: int = GROUP) -> DataFrame:
    """Suffixes that travel alone (stretch, prefixes, ...) with the key of their group: the hash of the shortest prefix that is in up to
    ``group`` different suffixes. ``deep`` marks those whose first 50 words are the key: one deep node."""
    rows = alone.select("*", *[F.element_at("prefixes", i + 1).alias(f"_p{i}") for i in range(len(LENGTHS))])
    for i in range(len(LENGTHS) - 1):
        full = rows.groupBy(f"_p{i}").agg(F.count("*").alias("_n")).filter(F.col("_n") > group)
        rows = _salted(rows, full.select(f"_p{i}", F.lit(True).alias(f"_full{i}")), f"_p{i}")
    key, deep = F.col(f"_p{len(LENGTHS) - 1}"), F.lit(True)
    for i in reversed(range(len(LENGTHS) - 1)):
        fits = F.col(f"_full{i}").isNull()
        key, deep = F.when(fits, F.col(f"_p{i}")).otherwise(key), F.when(fits, False).otherwise(deep)
    return rows.withColumns({"key": key, "deep": deep}).drop(*[c for c in rows.columns if c.startswith(("_p", "_full"))])


def common_words(a: bytes, b: bytes) -> int:
    """Words that two suffixes have in common at their start; every word ends with a space."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a != b:
        n -= -(-(int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() // 8)
    return a.count(b" ", 0, n)


class Tree:
    """The suffix tree of one group, as sorted suffixes and the common words of neighbours."""

    def __init__(self, group: list[tuple]):
        """``group`` has stretches (name, smallest doc_id, largest doc_id, n windows, words)."""
        self.group = group
        leaves = []
        for g, (_, _, _, n, words) in enumerate(group):
            text = words + b" "
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            starts = [0, *(spaces[: n - 1] + 1).tolist()]
            leaves += [(text[a:], g, j) for j, a in enumerate(starts)]
        leaves.sort()
        self.leaves = leaves
        self.common = [common_words(a[0], b[0]) for a, b in zip(leaves, leaves[1:])]

    def flags(self) -> Iterator[tuple[bytes, list[int]]]:
        """For each stretch that has a suffix of a document larger than the smallest under its topmost deep node: the name, and those
        smallest doc_ids by suffix."""
        mins = [[0] * s[3] for s in self.group]
        under: list[tuple[int, int]] = []

        def close() -> None:
            least = min(self.group[g][1] for g, _ in under)
            for g, j in under:
                mins[g][j] = least
            under.clear()

        for i, (_, g, j) in enumerate(self.leaves):
            if i and self.common[i - 1] < WINDOW:
                close()
            under.append((g, j))
        close()
        for s, found in zip(self.group, mins):
            if min(found) < s[2]:
                yield s[0], found

    def deep_nodes(self) -> Iterator[tuple[int, int, int]]:
        """(depth, first leaf, last leaf) of every internal node of WINDOW words or more: the intervals of the common words."""
        open_nodes: list[tuple[int, int]] = []
        for i, depth in enumerate([*self.common, 0]):
            first = i
            while open_nodes and open_nodes[-1][0] > depth:
                d, first = open_nodes.pop()
                yield d, first, i
            if depth >= WINDOW and (not open_nodes or open_nodes[-1][0] < depth):
                open_nodes.append((depth, first))

    def repeats(self) -> Iterator[tuple[int, int, int, str]]:
        """(words, suffixes, smallest doc_id, text) of deep nodes that cannot be grown to the left: not all suffixes under them have the same
        word before them in their stretch."""
        for depth, a, b in self.deep_nodes():
            before = set()
            for _, g, j in self.leaves[a : b + 1]:
                before.add(self.group[g][4].split(b" ", j)[j - 1] if j else None)
            if len(before) > 1 or None in before:
                text = b" ".join(self.leaves[a][0].split(b" ", depth)[:depth])
                yield depth, b - a + 1, min(self.group[g][1] for _, g, _ in self.leaves[a : b + 1]), text.decode("utf-8", "surrogatepass")


FLAGS = T.StructType([T.StructField("stretch", T.BinaryType()), T.StructField("mins", T.ArrayType(T.LongType()))])
REPEATS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_suffixes", T.LongType()),
        T.StructField("first_doc", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def trees(stretches: DataFrame, schema: T.StructType, read: Callable[[Tree], Iterator[tuple]]) -> DataFrame:
    """What ``read`` finds in the tree of each group of merged stretches (key, stretch, least, most, n, words)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = stretches.repartition("key").sortWithinPartitions("key")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at: int | None = None
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1 or held[0][1] < held[0][2] or held[0][3] > 1:
                out.extend(read(Tree(held)))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, *rest in zip(*columns):
                if key != at and held:
                    close()
                    held.clear()
                at = key
                held.append(tuple(rest))
            if len(out) >= 4_000:
                yield flush()
        if held:
            close()
        if out:
            yield flush()

    return rows.select("key", "stretch", "least", "most", "n", "words").mapInArrow(run, schema)


def remove(flagged: DataFrame) -> DataFrame:
    """RESULT from (doc_id, short, text, starts): words that no flagged window covers stay."""

    def make():
        def each(row: dict) -> Iterator[tuple]:
            words = utf8(row["text"]).split()
            if short_of(digest_of(words)) != row["short"]:
                return
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.array(row["starts"], np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge)[: len(words)] > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
            yield row["doc_id"], row["short"], int(gone.sum()), digest_of(kept)

        return each

    return arrow_rows(flagged.select("doc_id", "short", "text", "starts"), RESULT, make)


class Forest:
    """The stretches of a table and their groups, written to the shared folder."""

    def __init__(self, docs: DataFrame, group: int = GROUP):
        stats = materialize(statistics(docs), "substring-stats")
        copies = materialize(
            stats.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "copies"
        )
        self.known = stats.join(copies, "digest", "left")
        firsts = self.known.filter((F.col("n_words") >= WINDOW) & (F.col("doc_id") == F.coalesce("first", "doc_id"))).dropDuplicates(["doc_id", "short"])
        own = F.explode(F.arrays_zip("seeds", "times")).alias("own")
        seeds = materialize(firsts.select("doc_id", "short", own).select("doc_id", "short", F.col("own.seeds").alias("seed"), "own.times"), "seeds")
        shared = (
            seeds.groupBy("seed")
            .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("times").alias("c"))
            .filter("a < b")
            .select("seed", (F.col("c") > group).alias("crowded"))
        )
        wanted = (
            seeds.join(shared, "seed")
            .groupBy("doc_id", "short")
            .agg(F.collect_list(F.struct("seed", "crowded")).alias("own"))
            .select("doc_id", "short", F.col("own.seed").alias("seeds"), F.col("own.crowded").alias("crowded"))
        )
        self.candidates = materialize(docs.select("doc_id", "text").join(wanted, "doc_id"), "candidates")
        self.found = materialize(suffixes(self.candidates), "suffixes")
        merged = self.found.groupBy("key", "stretch").agg(
            F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("n").alias("n"),
            F.first("words", ignorenulls=True).alias("words"), F.first("prefixes", ignorenulls=True).alias("prefixes"),
        )
        self.merged = materialize(merged, "stretches")
        alone = materialize(lengthened(self.merged.filter("key IS NULL").drop("key"), group), "alone")
        self.groups = self.merged.filter("key IS NOT NULL").drop("prefixes").unionByName(alone.filter("NOT deep").drop("deep", "prefixes"))
        self.crowded = alone.filter("deep")

    def flags(self) -> DataFrame:
        """stretch, mins: for stretches that start in smaller documents too, the smallest one by suffix."""
        least = self.crowded.groupBy("key").agg(F.min("least").alias("m"))
        alone = _salted(self.crowded, least, "key").filter("m < most").select("stretch", F.array("m").alias("mins"))
        return trees(self.groups, FLAGS, Tree.flags).unionByName(alone)


def maximal_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """n_words, n_suffixes (merged ones), first_doc and text of the deep nodes: passages of 50 words or more that repeat and grow to
    neither side within their stretches (a stretch has up to 92 words). Where the first 50 words are crowded, the node is
    reported with those 50."""
    forest = Forest(docs, group)
    crowded = forest.crowded.groupBy("key").agg(F.count("*").alias("n"), F.min("least").alias("first"), F.max("most").alias("last"), F.first("words").alias("words"))
    crowded = crowded.filter("n > 1 OR first < last")
    words = F.array_join(F.slice(F.split(F.decode("words", "UTF-8"), " "), 1, WINDOW), " ")
    known = crowded.select(F.lit(WINDOW).cast("long").alias("n_words"), F.col("n").alias("n_suffixes"), F.col("first").alias("first_doc"), words.alias("text"))
    return trees(forest.groups, REPEATS, Tree.repeats).unionByName(known)


def dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    forest = Forest(docs, group)
    hits = forest.found.select("stretch", "doc_id", "short", "start").join(forest.flags(), "stretch")
    starts = F.filter(F.transform("mins", lambda m, i: F.when(m < F.col("doc_id"), F.col("start") + i)), lambda s: s.isNotNull())
    per_doc = (
        hits.select("doc_id", "short", starts.alias("starts"))
        .filter(F.size("starts") > 0)
        .groupBy("doc_id", "short")
        .agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )
    # a row that repeats a candidate's doc_id with other words was joined too; its own digest tells it apart
    texts = forest.candidates.select("doc_id", "short", "text")
    lost = remove(texts.join(per_doc, ["doc_id", "short"])).dropDuplicates(["doc_id", "short"])
    rows = forest.known.select("doc_id", "n_words", "digest", "short", "first").join(lost, ["doc_id", "short"], "left")
    copy = F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= WINDOW), F.lit(False))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )
