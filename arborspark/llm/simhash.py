"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 hashes (seed 42) of the text's
4-word shingles. Fingerprints at Hamming distance 4 or less are linked.

The bits are cut into segments of 23, 23 and 18. If two fingerprints differ in at most 4 bits, they differ in at most
one bit of the first segment, or at most one of the second, or in none of the third (else there would be 2 + 2 + 1). For the
first two the anchors are the 4096 words of the perfect binary Golay code, whose covering radius is 3: every value lies
within 3 of exactly one anchor, its home, and a value within 1 of it lies within 3 + 1 of that anchor. So each fingerprint is
replicated to every anchor within covering radius plus threshold (5.3 on average) and compared, per anchor, with the
fingerprints at home there. In the third segment every value is its own anchor (radius 0, threshold 0). Links are exact.

Only different fingerprints are compared; copies share one. An anchor gives a spanning forest of the links it sees, not
the links, so a dense group costs rows in proportion to its size. Anchors with more than ``hot`` fingerprints are cut
exactly: their members are dealt again by five blocks of their bits, of which a linked pair has one in common. The number
of anchors is fixed by the code, so the table of hot anchors has a proven bound and is broadcast.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and link like any other; texts of
fewer than 4 words have one shingle; repeated rows link to each other; a null doc_id is never a component's id, and a component of
such rows alone has a null id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.llm.common import arrow_rows, free_name, materialize, utf8
from arborspark.llm.components import components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: (lowest bit, bits, radius of the anchors, threshold) of the segments; thresholds plus one sum to over THRESHOLD.
SEGMENTS = ((0, 23, 3, 1), (23, 23, 3, 1), (46, 18, 0, 0))
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0xC75
#: Members from which an anchor is cut into sub-blocks, and the blocks: five that cover 64 bits.
HOT = 20_000
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Places among which a component's fingerprints are dealt.
SALTS = 64
#: Comparisons held at once.
CELLS = 1 << 20

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
PLACES = "seg int, anchor int, home boolean, fp long"


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[SHINGLE - 1 :].tolist() if len(words) >= SHINGLE else [len(joined)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(last))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte, which adds faster
        counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (signed) and the columns ``more`` of every row."""

    def make():
        def each(row: dict) -> Iterator[tuple]:
            fp = fingerprint(row["text"])
            yield row["doc_id"], fp - (1 << 64) if fp >> 63 else fp, *(row[c] for c in more)

        return each

    schema = T.StructType([*FINGERPRINTS.fields, *(docs.schema[c] for c in more)])
    return arrow_rows(docs.select("doc_id", "text", *more), schema, make)


def syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit values by the generator polynomial: zero for anchors."""
    left = values.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where((left >> bit) & 1, left ^ (GOLAY << (bit - 11)), left)
    return left


def patterns(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All error patterns of weight up to ``reach``, sorted by syndrome: where each syndrome's begin, the patterns, their weights."""
    found = [sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(23), k)]
    errors = np.array(found, np.int64)
    which = syndromes(errors)
    order = np.argsort(which, kind="stable")
    errors, which = errors[order], which[order]
    return np.searchsorted(which, np.arange(2049)), errors, np.bitwise_count(errors)


def places(fps: DataFrame) -> DataFrame:
    """seg, anchor, home, fp: where each fingerprint is compared."""
    arrow = pa.schema([("seg", pa.int32()), ("anchor", pa.int32()), ("home", pa.bool_()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {radius + t: patterns(radius + t) for _, _, radius, t in SEGMENTS if radius}
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            bits = whole.view(np.uint64)
            for seg, (low, width, radius, t) in enumerate(SEGMENTS):
                value = ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
                if radius:
                    begins, errors, weights = tables[radius + t]
                    which = syndromes(value)
                    n = begins[which + 1] - begins[which]
                    row = np.repeat(np.arange(len(value)), n)
                    pick = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begins[which][row]
                    anchor, home = value[row] ^ errors[pick], weights[pick] <= radius
                else:
                    row, anchor, home = np.arange(len(value)), value, np.ones(len(value), bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), seg, np.int32)), pa.array(anchor.astype(np.int32)), pa.array(home), pa.array(whole[row])],
                    schema=arrow,
                )

    return fps.select("fp").mapInArrow(run, PLACES)


def forest(fps: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Spanning edges (member, smallest member) of the links between different fingerprints of one anchor."""
    own = np.flatnonzero(home)
    n = len(fps)
    if n < 2 or not len(own):
        return []
    hit = np.zeros(n, bool)
    step = max(1, CELLS // n)
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        near = np.bitwise_count(fps[rows, None] ^ fps[None, :]) <= threshold
        near[np.arange(len(rows)), rows] = False
        hit[rows[near.any(axis=1)]] = True
        hit |= near.any(axis=0)
    left = fps[hit]
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        # everything linked to a visited member leaves the pool, so a dense group is searched once
        todo, members = [left[0]], [left[0]]
        left = left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= threshold
            if near.any():
                found = left[near]
                todo.extend(found)
                members.extend(found)
                left = left[~near]
        signed = np.array(members, np.uint64).view(np.int64)
        root = int(signed.min())
        out.extend((int(x), root) for x in signed if x != root)
    return out


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the fingerprints in ``fps`` (one column fp)."""
    spread = materialize(places(fps), "places")
    crowded = spread.groupBy("seg", "anchor").count().filter(F.col("count") > hot).select("seg", "anchor", F.lit(True).alias("_hot"))
    block = F.explode(
        F.when(
            F.col("_hot"),
            F.array(*[F.lit(i << 13) + F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1) + 1 for i, (low, width) in enumerate(BLOCKS)]),
        ).otherwise(F.array(F.lit(0).cast("long")))
    )
    rows = spread.join(F.broadcast(crowded), ["seg", "anchor"], "left").select("seg", "anchor", block.alias("block"), "home", "fp")
    keys = ["seg", "anchor", "block"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def groups(columns: list[np.ndarray], final: bool):
            key = np.stack(columns[:3])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = np.concatenate(([0], cuts, [key.shape[1]]))
            edges: list[tuple[int, int]] = []
            whole = len(bounds) - (1 if final else 2)
            for i in range(whole):
                a, b = bounds[i], bounds[i + 1]
                if b - a > 1:
                    edges.extend(forest(columns[4][a:b].view(np.uint64), columns[3][a:b]))
            return edges, (None if final else [c[bounds[-2] :] for c in columns])

        def out(edges):
            a, b = zip(*set(edges))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                columns = [np.concatenate(p) for p in zip(held, columns)]
            edges, held = groups(columns, False)
            if edges:
                yield out(edges)
        if held is not None:
            edges, _ = groups(held, True)
            if edges:
                yield out(edges)

    return rows.mapInArrow(run, "a long, b long")


def _classes(fps: DataFrame, hot: int) -> DataFrame:
    """_fp, root, component_id of every fingerprint; components of rows without a doc_id differ in their root alone."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = materialize(distinct, "distinct")
    roots = components(links(distinct.select("fp"), hot))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named = materialize(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", "root"), "named")
    alone = named.filter("root IS NULL").select(F.col("fp").alias("_fp"), F.col("fp").alias("root"), F.col("first").alias("component_id"))
    members = named.filter("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    # a component may hold a third of all fingerprints: its id meets them in as many places, but only where it has members
    dealt = members.groupBy("root", "salt").agg(F.min("first").alias("least"))
    whole = dealt.groupBy("root").agg(F.min("least").alias("component_id"), F.collect_list("salt").alias("salts"))
    ids = whole.select("root", "component_id", F.explode("salts").alias("salt"))
    return alone.unionByName(members.join(ids, ["root", "salt"]).select(F.col("fp").alias("_fp"), "root", "component_id"))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = _classes(fps, hot).drop("root")
    return fps.join(classes, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row of ``docs`` of each component, with its columns: the one with the smallest doc_id, rows without one last, and among
    equal ids the one with the smallest digest of all its columns. Equal rows are one; a doc_id that stands in several components
    stays once in each that it is the first of."""
    name = free_name("_row", docs.columns)
    keyed = docs.withColumn(name, F.unhex(F.sha2(F.to_json(F.struct("*")), 256)))
    fps = materialize(fingerprints(keyed, name), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", F.col(name).alias("_digest"))
    of_text = fps.groupBy("fp").agg(F.min(order).alias("_first"))
    first = of_text.join(_classes(fps, hot), F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("_first").alias("_first"))
    return keyed.join(first.select(F.col("_first._digest").alias(name)), name, "left_semi").dropDuplicates([name]).drop(name)


def hex_fingerprint(fp="fp"):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
