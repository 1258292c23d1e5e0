"""Quality classifier: Bradley-Terry pairwise ranking.

A text gets a vector of surface features. From labelled rows pairs (better, worse) are drawn, and weights w are learned
by the logistic loss of w . (x_better - x_worse), with Newton steps and a small ridge; a pair's labels are all that it says, so
there is no intercept. The text's worth is w . x. The cut is a quantile of the worths of the labelled rows: the one that
separates the labels best. The score is the logistic of worth against the cut, placed so that the cut scores 0.7.

Labels come from at most ``MAX_LABELS`` rows, those with the smallest keyed hash, which is a documented bound; features and
scores cover every row. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have the features of an empty text and are scored; without labels of both kinds nothing
is known and every text scores 0.7 (kept); a doc_id labelled twice counts as good only if all its labels are; a null doc_id
is never labelled; repeated rows score alike; extra columns are ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.llm.common import arrow_rows, free_name, materialize, utf8
from arborspark.llm.repetition import grow

#: Labelled rows used at most; pairs drawn for each row of the commoner label, and pairs at most. Pairs are drawn in turns over both labels, so
#: with up to MAX_LABELS rows every labelled row is in pairs, whatever these two say.
MAX_LABELS, PAIRS_EACH, MAX_PAIRS = 20_000, 20, 200_000
RIDGE, STEPS, SEED = 1e-3, 30, 7
#: The score at the cut.
CUT_SCORE = 0.7
#: Standardised features are bounded to this many deviations.
BOUND = 6.0

FEATURES = (
    "log_words", "log_lines", "mean_word", "long_words", "upper", "digits", "period_comma", "exclaim", "marks", "bars", "other_ascii", "non_ascii",
    "sqrt_marks", "sqrt_bars", "sqrt_exclaim", "stutter", "new_words", "new_windows", "repeated_lines", "short_words",
)

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.FloatType(), False))])

#: Classes of bytes: 1 upper, 2 digit, 3 . or , 4 ! or ?, 5 marks, 6 bars, 7 other punctuation, 8 not ASCII, 0 the rest.
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 7
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b".,")] = 3
_CLASS[list(b"!?")] = 4
_CLASS[list(b"#*$%&<>~^_=+")] = 5
_CLASS[list(b"|\\")] = 6
_CLASS[128:] = 8


def features(text: str | None) -> list[float]:
    """The feature vector of one text, in the order of FEATURES."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * 16 + [1.0, 1.0, 0.0, 0.0]
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper, digits, stops, exclaim, marks, bars, other, high = (kinds[1:] / chars).tolist()
    stutter = sum(map(operator.eq, words, words[1:])) / n
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    new_windows = 1.0
    if n >= 4:
        windows, starts = hashes, np.arange(n)
        for size in range(2, 5):
            starts, windows = starts[:-1], windows[:-1]
            windows = grow(windows, hashes, starts, size)
        new_windows = len(np.unique(windows)) / len(windows)
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), chars / n, float((lengths > 20).mean()), upper, digits, stops, exclaim, marks, bars, other,
        high, marks**0.5, bars**0.5, exclaim**0.5, stutter, len(set(words)) / n, new_windows, 1 - len(set(lines)) / len(lines),
        float((lengths <= 3).mean()),
    ]


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and x of every row."""

    def make():
        def each(row: dict) -> Iterator[tuple]:
            yield row["doc_id"], features(row["text"])

        return each

    return arrow_rows(docs.select("doc_id", "text"), SCHEMA, make)


@dataclass(frozen=True)
class Ranker:
    """Learned weights on standardised features, the cut and the scale of worths."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -BOUND, BOUND) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.worth(x) - self.cut) / self.spread + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray) -> Ranker | None:
    """Learn from feature rows and their labels; None unless both labels occur."""
    if not good.any() or good.all():
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = np.clip((x - mean) / scale, -BOUND, BOUND)
    rng = np.random.default_rng(SEED)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    n = min(MAX_PAIRS, PAIRS_EACH * max(len(better), len(worse)))
    # every labelled row appears: each side is dealt in turns of a shuffled order
    deal = lambda side: np.concatenate([rng.permutation(side) for _ in range(-(-n // len(side)))])[:n]
    d = z[deal(better)] - z[deal(worse)]
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the model has of preferring the worse
        gradient = -(d * p[:, None]).mean(axis=0) + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    worth = z @ w
    order = np.argsort(worth, kind="stable")
    ranked, labels = worth[order], good[order]
    # at quantile k / n the k lowest are rejected; both labels weigh the same
    caught = np.concatenate(([0], np.cumsum(~labels))) / max(1, (~labels).sum())
    lost = np.concatenate(([0], np.cumsum(labels))) / max(1, labels.sum())
    gain = caught - lost
    gain[1:-1][ranked[1:] == ranked[:-1]] = -1.0  # no cut between equal worths
    k = int(gain.argmax())
    low, high = ranked[max(0, k - 1)], ranked[min(k, len(ranked) - 1)]
    return Ranker(mean, scale, w, float((low + high) / 2), float(max(worth.std(), 1e-6) / 2))


def _marked(labels: DataFrame) -> DataFrame:
    """One known label for each doc_id."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality IS NOT NULL")


def _lowest(marked: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of ``marked`` with the smallest hash of doc_id. A bar set from the rows' number lets about 1.2 times as many leave their tasks,
    however many tasks there are."""
    n = marked.count()
    if n > most:
        share = min(1.0, 1.2 * most / n + 1000 / n)
        marked = marked.filter(F.xxhash64("doc_id") <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))))
    return marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn(rows: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> Ranker | None:
    """Fit on the labelled rows of ``rows`` (doc_id, x); ``labels`` has doc_id and quality."""
    sample = rows.join(_marked(labels), "doc_id").select("x", "quality", F.xxhash64("doc_id").alias("_k"), "doc_id").orderBy("_k", "doc_id").limit(most)
    held = sample.select("x", "quality").collect()
    if not held:
        return None
    return fit(np.array([r.x for r in held], np.float64), np.array([r.quality >= 1 for r in held]))


def scores(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """doc_id and score of every row of ``docs``, learned from ``labels``."""
    rows = materialize(featurize(docs), "features")
    known = _marked(labels).join(rows.select("doc_id"), "doc_id", "left_semi")
    ranker = learn(rows, _lowest(known, most), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
            score = ranker.score(x) if ranker is not None else np.full(len(x), CUT_SCORE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def score_texts(docs: DataFrame, ranker: Ranker | None, name: str = "score") -> DataFrame:
    """``docs`` with its score as one more column, in one pass over the texts."""

    @F.pandas_udf("double")
    def score(texts):
        if ranker is None:
            return texts.map(lambda _: CUT_SCORE).astype("float64")
        x = np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return texts.__class__(ranker.score(x))

    return docs.withColumn(name, score(F.col("text")))


def train_on(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> Ranker | None:
    """Learn from ``docs`` itself, reading only texts of the labelled rows within the bound."""
    chosen = _lowest(_marked(labels), most)
    return learn(featurize(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")), chosen, most)


def keep_good(docs: DataFrame, ranker: Ranker | None, cut: float = CUT_SCORE) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, with their columns."""
    name = free_name("_score", docs.columns)
    return score_texts(docs, ranker, name).filter(F.col(name) >= cut).drop(name)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of doc_ids whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
