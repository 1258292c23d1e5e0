"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.llm.common import materialize

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Large: every node hangs its larger neighbours on its smallest one. Small: its smaller ones and itself.
    The smallest neighbour comes from an aggregation and a join back, so a node with very many neighbours is summed
    before the shuffle and its edges can be split over tasks."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = pairs.join(least, F.col("a") == F.col("n"))
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, root (the smallest node of its component) for every node with an edge except the roots themselves.
    ``edges`` has two long columns a and b. Each round is written to the shared folder, so lineage stays short."""
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        edges = materialize(_stars(_stars(edges, True), False), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
