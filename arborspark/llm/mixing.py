"""Mixing sources to target weights with a time-varying curriculum.

Every source is an endless stream of its documents: pass 0 in a keyed order, then pass 1 over the same order,
and so on. The source has a target of T words and a weight schedule w(t) over training time t in [0, 1] that is
linear from ``start`` to ``end`` times its base weight. The schedule's integral, scaled to T at t = 1, is the
cumulative token demand D(t); the copy whose first word is word c of the stream is trained at t = D^-1(c), which
is a quadratic root. Rows are then range-sorted by that position; what the mix took of a document is read back from that order.

The stream is cut at word T, so each source takes its target to the word: of the copy in which the cut falls
only the words before it count.

Word offsets come from a prefix sum over a tree: the key of a row is a hash in hex digits, its first digits are its bucket,
and buckets are summed ``LEVEL_DIGITS`` digits at a time, so a window holds 16^LEVEL_DIGITS sums at most, or the few rows of one bucket.
A source with a third of all rows has more levels, not larger windows. Sources are ranked by range, and targets come from
repeated sums over the table of sources, so sources may be as many as documents.

The key hashes doc_id and text together, so rows without an id are spread like others, and the order does not depend on
how the table is dealt to tasks.

Defined results: null texts and texts without words have size 0 and take 0; null sources are one source that
sorts last; repeated rows are separate documents; rows of equal source, doc_id and text are interchangeable and lie next to one
another in the order; an empty table gives an empty result; other columns of the input are kept by ``mix`` and ``curriculum``
under any name, and are replaced only where they are named like a column that the operator returns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.llm.common import free_name, materialize, n_words, quoted, ranked

#: Base weights, dealt to the sources in code-point order, null last.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all words.
BUDGET = 1.5
#: No source, and no document, is taken more often than this.
MAX_EPOCHS = 2
#: Schedules by rank of the source, dealt in turn: weight at t = 0 and at t = 1 as multiples of the base weight.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
#: Rows that one bucket of the keyed order should hold, and hex digits of the key by which sums go one level up.
BUCKET_ROWS, LEVEL_DIGITS = 64, 3
#: A table of sources up to this many rows is broadcast.
MOST_BROADCAST = 50_000


def order_key() -> Column:
    """The keyed order of documents: 32 hex digits from doc_id and text, the same in any engine."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce("text", F.lit("")))))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and order_key of every row."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key().alias("order_key"))


def targets(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """source, rank, weight, n_docs, source_size, target: water-filling.

    A level is the words that a weight of one gets. Sources whose share reaches their cap are capped and the level of the others
    is taken anew from what is left, until no further source reaches its cap. Each turn is one sum over the table of
    sources; the sums are integers, so the level is the one that a closed form over sorted caps gives.
    """
    return _filled(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), weights, budget, max_epochs)


def _filled(per: DataFrame, weights: Sequence[int], budget: float, max_epochs: int) -> DataFrame:
    """``targets`` from source, n_docs, source_size."""
    per = ranked(per, F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(turns, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("long"))
    per = materialize(per, "sources")
    cap = F.col("source_size") * max_epochs
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    capped, used, level = 0, 0, None
    while whole.words is not None and used < whole.weights:
        level = (whole.words * budget - capped) / (whole.weights - used)
        full = F.lit(level) * F.col("weight") >= cap
        now = per.agg(F.sum(F.when(full, cap)).alias("words"), F.sum(F.when(full, F.col("weight"))).alias("weights")).first()
        if (now.weights or 0) == used:
            break
        capped, used = now.words, now.weights
    share = cap.cast("double") if level is None or used == whole.weights else F.least(F.lit(level) * F.col("weight"), cap.cast("double"))
    return per.select("source", "rank", "weight", "n_docs", "source_size", share.alias("target"))


def _starts(sums: DataFrame, digits: int, step: int) -> DataFrame:
    """_g, _bucket, _start from (_g, _bucket, _in): the words of the source before each bucket, one level of digits at a time."""
    levels = [*range(step, digits, step), digits]
    known = None
    for up, at in zip([0, *levels], levels):
        level = sums if at == digits else sums.groupBy("_g", F.substring("_bucket", 1, at).alias("_bucket")).agg(F.sum("_in").alias("_in"))
        above = F.substring("_bucket", 1, up) if up else F.lit("")
        level = level.withColumn("_up", above)
        running = Window.partitionBy("_g", "_up").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        level = level.withColumn("_start", F.sum("_in").over(running) - F.col("_in"))
        if known is not None:
            higher = known.select("_g", F.col("_bucket").alias("_up"), F.col("_start").alias("_base"))
            level = level.join(higher, ["_g", "_up"]).withColumn("_start", F.col("_start") + F.col("_base"))
        known = level.select("_g", "_bucket", "_start")
    return known


def mix(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    bucket_rows: int = BUCKET_ROWS,
    level_digits: int = LEVEL_DIGITS,
) -> DataFrame:
    """One row per row of ``sized`` (doc_id, source, size, order_key and any other columns), adding source_size, target and
    ``passes``: for every copy that the mix takes its pass, words and position."""
    own = {"source_size", "target", "passes"}
    kept = [c for c in sized.columns if c.lower() not in own]
    digits = min(32, max(1, math.ceil(math.log(sized.count() / bucket_rows + 1, 16))))
    # one key without nulls for the window and the joins, so that rows are shuffled once for all of them; the caller's columns
    # travel as one struct, where no name of theirs can meet one of ours
    group = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    row = F.struct(*[F.col(quoted(c)) for c in kept])
    keyed = sized.select(group.alias("_g"), F.col("order_key").alias("_key"), F.col("size").alias("_size"), F.substring("order_key", 1, digits).alias("_bucket"), F.col("source").alias("_source"), row.alias("_row"))
    # sources and buckets are summed in one reading, since sizes may be counted in texts
    sums = keyed.groupBy("_g", "_bucket", "_source").agg(F.sum("_size").alias("_in"), F.count("*").alias("_n"))
    sums = materialize(sums, "buckets")
    starts = _starts(sums, digits, level_digits)
    per = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_n").alias("n_docs"), F.sum("_in").alias("source_size"))
    shares = _filled(per, weights, budget, max_epochs)
    n_sources = shares.count()
    inside = Window.partitionBy("_g", "_bucket").orderBy("_key", "_size")
    before = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    rows = keyed.drop("_source").withColumn("_before", before).join(starts, ["_g", "_bucket"], "left")
    shares = shares.select(group.alias("_g"), F.col("rank").alias("_rank"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    # sources are broadcast only up to a counted size; beyond it the join shuffles
    rows = rows.join(F.broadcast(shares) if n_sources <= MOST_BROADCAST else shares, "_g", "left")
    want = F.round(F.col("_target")).cast("long")

    def one(k: int) -> Column:
        # of pass k the words [k * source_size + offset, ... + size) belong to this document
        offset = F.col("_source_size") * k + F.col("_start") + F.col("_before")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), want - offset))
        return F.struct(
            F.lit(k).alias("pass"), words.alias("words"), _position(offset, F.col("_target"), F.col("_rank"), schedules).alias("position")
        )

    passes = F.filter(F.array(*[one(k) for k in range(max_epochs)]), lambda p: p["words"] > 0)
    return rows.select(
        *[F.col("_row").getField(c).alias(c) for c in kept], F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), passes.alias("passes")
    )


def _position(offset: Column, target: Column, rank: Column, schedules: Sequence[tuple[float, float]]) -> Column:
    """t with D(t) = offset, where D(t) = target * (a t + (b - a) t^2 / 2) / ((a + b) / 2)."""
    turn = (F.pmod(rank, F.lit(len(schedules))) + 1).cast("int")
    a = F.element_at(F.array(*[F.lit(float(s[0])) for s in schedules]), turn)
    b = F.element_at(F.array(*[F.lit(float(s[1])) for s in schedules]), turn)
    share = F.try_divide(offset.cast("double"), target) * (a + b) / 2  # null for a source without words
    # the stable root of (b - a) / 2 t^2 + a t - share = 0
    return share * 2 / (a + F.sqrt(a * a + (b - a) * share * 2))


def training_order(mixed: DataFrame, untaken: bool = False) -> DataFrame:
    """The copies that the mix takes, one row each, sorted by range of position: the rows of ``mix`` with epoch, taken_words
    and position in place of ``passes``. ``untaken`` adds the rows that it does not take, with nulls, after all others.
    Columns of the input with these three names are replaced."""
    own = {"passes", "epoch", "taken_words", "position"}
    kept = [c for c in mixed.columns if c.lower() not in own]
    copy = free_name("copy", kept)
    copies = mixed.select(*[F.col(quoted(c)) for c in kept], (F.explode_outer if untaken else F.explode)("passes").alias(copy))
    in_order = copies.orderBy(F.col(copy)["position"].asc_nulls_last(), "doc_id", "order_key")
    return in_order.select(
        *[F.col(quoted(c)) for c in kept],
        F.col(copy)["pass"].alias("epoch"),
        F.col(copy)["words"].alias("taken_words"),
        F.col(copy)["position"].alias("position"),
    )


def digest(order: DataFrame) -> DataFrame:
    """One row per row of the mix, from its training order with the untaken: ``taken`` (words of all its copies, 0 if none) and
    ``position`` (of its first pass, null if none) beside its other columns, which together must tell rows apart."""
    own = {"epoch", "taken_words", "position"}
    kept = [F.col(quoted(c)) for c in order.columns if c.lower() not in own]
    first = F.min(F.when(F.col("epoch") == 0, F.col("position")))
    return order.groupBy(*kept).agg(F.coalesce(F.sum("taken_words"), F.lit(0).cast("long")).alias("taken"), first.alias("position"))


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, one per copy, with epoch, taken_words and position, sorted by range of
    position: the training order. ``how`` goes to ``mix``. Columns of the input with these three names are replaced."""
    own = {"epoch", "taken_words", "position"}
    kept = [c for c in docs.columns if c.lower() not in own]
    row = F.struct(*[F.col(quoted(c)) for c in kept])
    mixed = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key().alias("order_key"), row.alias("row")), **how)
    copies = training_order(mixed.select("row", "doc_id", "order_key", "passes"))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in kept], "epoch", "taken_words", "position")
