"""Benchmark decontamination by latent semantic retrieval.

1. A word's number is a hash of 16 bits, so numbers need no vocabulary. One pass writes the numbers of every document beside it in the
   shared folder: texts are cut into words once, for all of the benchmark; all further passes read numbers. The terms are the numbers that
   occur in the benchmark. Words that share a number make a document look more like a passage, never less; the last step reads words.
2. The next pass counts in how many passages of all documents each term occurs (idf). Another one multiplies the TF-IDF matrix A of all
   passages with a random matrix: Z = A^T (A R). Tasks send Z in ranges of terms, which are summed in as many tasks, and a
   single-pass Nystrom step turns Z and R into the leading ``RANK`` right singular vectors. They come from the documents
   alone, have a fixed number, and serve the whole benchmark.
3. The benchmark is a stated query set, read in blocks. The space of a block is those singular vectors, which count ``LATENT`` times, and beside
   them what the block's own passages add (SVD updating): an orthonormal basis of their residuals. On prose without topics
   the leading directions alone would lose the rare words, on which a leak shows. Every window of every document is compared with every
   passage of the block in that space. A window's product with a passage is a sum over its terms, so it comes from one table of terms
   by passages; windows that hold ``MASS`` of a passage's own product get their cosine, and those above ``COSINE`` are
   candidates. So are those that hold ``SURE_MASS``, whatever their cosine: a window is longer than a short passage, and words of
   other items around a copy turn its direction.
4. Candidates are checked on the words themselves: longest common subsequence against stretches of 1.5 times the item's length,
   and whether the item's answer (its last words) stands there. A leak has an LCS share of ``LCS_SURE``, or of ``LCS_ANSWER``
   with the answer. Of an item of several passages, one passage with a share of ``LCS_SURE`` is a leak too; ``lcs`` is the larger
   share.

What it finds: copies in whole, and paraphrases that keep 55 words in 100 in their order (unrelated text stays below 45). Words that co-occur add to a product through
the singular vectors, but a passage retold in other words has no common subsequence and is not reported.

``BLOCKS`` blocks of ``BLOCK_PASSAGES`` passages are searched in one pass, whose terms and vectors have a bounded size, so what is sent to
executors does not grow with the data; a larger benchmark costs one more pass over the numbers for as many.

Defined results: null and empty texts leak nothing; items without words are in no document; rows that repeat a doc_id or an item_id
are compared each for itself; a null doc_id is reported as null; without documents or items there are no leaks;
extra columns are ignored by ``leaks`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.llm.common import materialize, quoted

#: Words in a block of a document, and blocks in a passage of the matrix and in the two window sizes.
UNIT, PASSAGE_UNITS, SHORT_UNITS = 24, 3, 2
#: Benchmark items are cut into passages of up to this many words, so that each fits a window at some step.
CHUNK, SHORT_CHUNK = PASSAGE_UNITS * UNIT - UNIT + 1, SHORT_UNITS * UNIT - UNIT + 1
#: Benchmark passages in a block, and blocks searched in one pass.
BLOCK_PASSAGES, BLOCKS = 256, 8
#: Singular vectors kept, oversampling, and how much the vectors count beside the benchmark's residuals.
RANK, OVERSAMPLE, SEED, LATENT = 64, 16, 11, 1.2
#: Terms of a range in which tasks send their part of Z.
RANGE_TERMS = 512
#: Terms in more than this share of the passages are left out, unless an item would keep fewer than MIN_TERMS.
MAX_DF, MIN_TERMS = 0.03, 5
#: Share of a passage's own product that a window must hold before its cosine is taken.
MASS = 0.35
#: Share from which a window is a candidate without the cosine; the smallest share of a leak.
SURE_MASS = 0.5
COSINE, LCS_SURE, LCS_ANSWER, ANSWER_WORDS = 0.45, 0.55, 0.5, 5
#: Words that one batch of documents gathers before the matrix product.
BATCH_WORDS = 60_000
#: How numbers are packed, how many there are, and how many words' numbers a task remembers.
NUMBER, NUMBERS, REMEMBERED = np.dtype("<u2"), 1 << 16, 1 << 20

LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean"
_BARE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def bare_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BARE).split() if text else []


class Numbers(dict):
    """The number of each word, worked out once per task for up to REMEMBERED words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = xxhash.xxh32_intdigest(word) & (NUMBERS - 1)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), NUMBER, len(words))


class Block:
    """A block of benchmark items: their words and their passages as numbers."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, w) for i, w in ((i, bare_words(t)) for i, t in items) if w]
        self.passages: list[tuple[int, int, np.ndarray]] = []  # item's place, first word, numbers
        numbers = Numbers()
        for k, (_, words) in enumerate(self.items):
            ids = numbers.of(words)
            parts = -(-len(ids) // CHUNK)
            cuts = [len(ids) * p // parts for p in range(parts + 1)]
            self.passages += [(k, a, ids[a:b]) for a, b in zip(cuts, cuts[1:])]


def blocks_of(benchmark: DataFrame, most: int = BLOCK_PASSAGES) -> Iterator[Block]:
    """Blocks of the benchmark; one partition at a time reaches the driver."""
    held: list[tuple[int, str | None]] = []
    n = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        k = -(-len(bare_words(row.text)) // CHUNK)
        if not k:
            continue
        if held and n + k > most:
            yield Block(held)
            held, n = [], 0
        held.append((row.item_id, row.text))
        n += k
    if held:
        yield Block(held)


def numbered(docs: DataFrame, *more: str) -> DataFrame:
    """The columns ``more`` of ``docs``, then text, then the packed numbers of its words, written once. Columns are called by their
    places (c0, c1, ...)."""
    columns = [*more, "text"]
    rows = docs.select(*[F.col(quoted(c)) for c in columns]).toDF(*[f"c{i}" for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            packed = [numbers.of(bare_words(texts[r].as_py())).tobytes() for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names=[*batch.schema.names, "numbers"])

    return materialize(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("numbers", T.BinaryType())])), "numbers")


def _terms_of(batches: Iterator[pa.RecordBatch], places: np.ndarray) -> Iterator[np.ndarray]:
    """The terms of each document, -1 for other words."""
    for batch in batches:
        values = batch.column(0)
        for r in range(batch.num_rows):
            yield places[np.frombuffer(values[r].as_py(), NUMBER)]


def document_frequencies(rows: DataFrame, places: np.ndarray, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each term occurs, and how many passages there are."""
    width = PASSAGE_UNITS * UNIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(n_terms, np.int64), 0
        for ids in _terms_of(batches, places):
            n += -(-len(ids) // width)
            at = np.flatnonzero(ids >= 0)
            if len(at):
                own = np.unique((at // width) * n_terms + ids[at]) % n_terms
                df += np.bincount(own, minlength=n_terms)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([-1], own))), pa.array(np.concatenate(([n], df[own])))], names=["term", "n"]
        )

    found = rows.select("numbers").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(n_terms, np.int64), 0
    for r in found:
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return out, total


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each range that a task was dealt."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            key, part = batch.column(0)[r].as_py(), np.frombuffer(batch.column(1)[r].as_py(), np.float32)
            if key in totals:
                totals[key] += part
            else:
                totals[key] = part.astype(np.float64)
    if totals:
        data = [t.astype(np.float32).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def sample_range(rows: DataFrame, places: np.ndarray, idf: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Z = A^T (A R) over the passages of all documents, A with rows of length one. Tasks send their sums in ranges of terms; each range is
    summed by itself, and the ranges together are the size of R."""
    shared = rows.sparkSession.sparkContext.broadcast((places, idf.astype(np.float32), random.astype(np.float32)))
    width = PASSAGE_UNITS * UNIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, idf, random = shared.value
        weighted = random * idf[:, None]
        z = np.zeros_like(random)
        held: list[np.ndarray] = []
        n = 0

        def flush() -> None:
            offset, all_ids, all_rows = 0, [], []
            for ids in held:
                at = np.flatnonzero(ids >= 0)
                at = at[idf[ids[at]] > 0]
                all_ids.append(ids[at])
                all_rows.append(at // width + offset)
                offset += -(-len(ids) // width)
            ids, of = np.concatenate(all_ids), np.concatenate(all_rows)
            if not len(ids):
                return
            begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            y = np.add.reduceat(weighted[ids], begins, axis=0)
            y /= np.add.reduceat(idf[ids] ** 2, begins)[:, None]
            place = np.repeat(np.arange(len(begins)), np.diff(np.concatenate((begins, [len(ids)]))))
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
            own = ids[order[first]]
            z[own] += idf[own, None] * np.add.reduceat(y[place[order]], first, axis=0)

        for ids in _terms_of(batches, places):
            held.append(ids)
            n += len(ids)
            if n >= BATCH_WORDS:
                flush()
                held, n = [], 0
        if held:
            flush()
        cuts = range(0, len(z), RANGE_TERMS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c // RANGE_TERMS for c in cuts], pa.int32()), pa.array([z[c : c + RANGE_TERMS].tobytes() for c in cuts], pa.binary())],
            names=["part", "data"],
        )

    schema = "part int, data binary"
    parts = rows.select("numbers").mapInArrow(run, schema).repartition("part").mapInArrow(_sum_parts, schema).collect()
    z = np.zeros_like(random)
    for r in parts:
        part = np.frombuffer(r.data, np.float32).reshape(-1, random.shape[1])
        z[r.part * RANGE_TERMS : r.part * RANGE_TERMS + len(part)] = part
    return z


def singular_vectors(z: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from Z = A^T A R (single-pass Nystrom with a stabilising shift)."""
    shift = max(1e-12, np.finfo(np.float32).eps * float(np.linalg.norm(z)))
    y = z + shift * random
    c = random.T @ y
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    values = np.maximum(values, 1e-12 * max(values.max(), 1e-30))
    u, _, _ = np.linalg.svd(y @ (vectors / np.sqrt(values)), full_matrices=False)
    return u[:, :rank]


class Latent:
    """Terms, idf and singular vectors, fitted on the passages of all documents for the whole benchmark."""

    def __init__(self, rows: DataFrame, benchmark: DataFrame, block_passages: int, rank: int = RANK):
        used = np.zeros(NUMBERS, bool)
        for block in blocks_of(benchmark, block_passages):
            for _, _, ids in block.passages:
                used[ids] = True
        n_terms = int(used.sum())
        self.places = np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)
        df, n = document_frequencies(rows, self.places, n_terms)
        idf = np.log((n + 1) / (df + 1)) + 0.1
        common = df > MAX_DF * max(n, 1)
        for block in blocks_of(benchmark, block_passages):
            for _, _, ids in block.passages:
                own = np.unique(self.places[ids])
                if (~common[own]).sum() < MIN_TERMS:
                    common[own] = False
        self.idf = np.where(common, 0.0, idf)
        rank = min(rank, n_terms)
        random = np.random.default_rng(SEED).standard_normal((n_terms, min(n_terms, rank + OVERSAMPLE)))
        self.vectors = singular_vectors(sample_range(rows, self.places, self.idf, random), random, rank) if n_terms else random


def lcs(item: list[bytes], region: list[bytes]) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time (bit-parallel)."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in region:
        hit = masks.get(w)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def verify(item: list[bytes], words: list[bytes], first: int, last: int) -> tuple[float, bool]:
    """Best LCS share of the item over stretches of 1.5 times its length around words first..last, and whether its answer, the last
    words of the item, stands in that stretch."""
    n = len(item)
    stretch, step = n + (n + 1) // 2, max(1, n // 4)
    answer = item[-ANSWER_WORDS:]
    best = (0.0, False)
    begin, end = max(0, first - n), min(len(words), last + n)
    for a in range(begin, max(begin + 1, end - stretch + step), step):
        part = words[a : a + stretch]
        share = lcs(item, part) / n
        found = any(part[j : j + len(answer)] == answer for j in range(len(part) - len(answer) + 1))
        best = max(best, (share, found))
    return best


class Searcher:
    """Finds the leaks of one block in documents as numbers."""

    def __init__(self, block: Block, latent: Latent, cosine: float, latent_weight: float = LATENT, update: bool = True):
        self.block, self.cosine = block, cosine
        # short passages first, so that the passages of a window size are one slice of the products
        self.passages = sorted(block.passages, key=lambda p: len(p[2]) > SHORT_CHUNK)
        used = np.unique(np.concatenate([ids for _, _, ids in self.passages]))
        self.places = np.full(NUMBERS, -1, np.int32)
        self.places[used] = np.arange(len(used), dtype=np.int32)
        idf, basis = latent.idf[latent.places[used]], latent.vectors[latent.places[used]]
        rows = np.zeros((len(self.passages), len(used)))
        for row, (_, _, ids) in zip(rows, self.passages):
            np.add.at(row, self.places[ids], 1.0)
        rows *= idf
        # the vectors' coordinates outside the block's terms cannot meet a passage, so residuals are taken inside them
        inside, _ = np.linalg.qr(basis) if basis.shape[1] <= len(used) else (np.eye(len(used)), None)
        residual = rows - (rows @ inside) @ inside.T
        _, values, added = np.linalg.svd(residual, full_matrices=False)
        added = added[values > 1e-6 * max(float(np.linalg.norm(rows)), 1e-30)] if update else added[:0]
        self.space = np.hstack([latent_weight * inside, added.T]).astype(np.float32) * idf[:, None].astype(np.float32)
        self.telling = idf > 0
        embedded = np.stack([self.space[self.places[ids]].sum(axis=0) for _, _, ids in self.passages])
        self.own = np.maximum(np.linalg.norm(embedded, axis=1), 1e-9).astype(np.float32)
        self.products = self.space @ (embedded / self.own[:, None]).T
        n_short = sum(len(ids) <= SHORT_CHUNK for _, _, ids in self.passages)
        sizes = (SHORT_UNITS, slice(0, n_short)), (PASSAGE_UNITS, slice(n_short, len(self.passages)))
        self.sizes = [(units, own) for units, own in sizes if own.stop > own.start]

    def leaks(self, texts: pa.Array, numbers: pa.Array) -> Iterator[tuple[int, int, float, float, bool]]:
        """(row, item_id, cosine, lcs, answer_found) for every leak, a bounded number of words at a time."""
        rows: list[int] = []
        held: list[np.ndarray] = []
        n = 0
        for r in range(len(texts)):
            ids = self.places[np.frombuffer(numbers[r].as_py(), NUMBER)]
            if len(ids):
                rows.append(r)
                held.append(ids)
                n += len(ids)
            if held and (n >= BATCH_WORDS or r == len(texts) - 1):
                for d, spots in sorted(self._candidates(held).items()):
                    words = bare_words(texts[rows[d]].as_py())
                    for k, places in sorted(spots.items()):
                        item_id, item = self.block.items[k]
                        best = max(verify(item, words, a, b) for a, b in _places(places))
                        for first, end in sorted({p[3:] for p in places if p[4] - p[3] < len(item)}):
                            if best[0] < LCS_SURE:
                                own = _places([p for p in places if p[3] == first])
                                share = max(verify(item[first:end], words, a, b)[0] for a, b in own)
                                best = (share, best[1]) if share >= LCS_SURE else best
                        if best[0] >= LCS_SURE or (best[0] >= LCS_ANSWER and best[1]):
                            yield rows[d], item_id, max(p[0] for p in places), *best
                rows, held, n = [], [], 0

    def _candidates(self, held: list[np.ndarray]) -> dict[int, dict[int, list[tuple[float, int, int, int, int]]]]:
        """For each document, for each item, the windows (cosine, first word, end) above the limits and the passage's words (first, end)."""
        # documents lie one after another in units of words, with empty units between them that no window crosses
        n_units = np.array([-(-len(ids) // UNIT) + PASSAGE_UNITS - 1 for ids in held])
        firsts = np.concatenate(([0], np.cumsum(n_units)))
        every = np.concatenate(held)
        begins = np.concatenate(([0], np.cumsum([len(ids) for ids in held])))
        at = np.flatnonzero(every >= 0)
        at = at[self.telling[every[at]]]
        ids = every[at]
        found: dict[int, dict[int, list[tuple[float, int, int, int, int]]]] = {}
        if not len(ids):
            return found
        of = np.searchsorted(begins, at, side="right") - 1
        units = (at - begins[of]) // UNIT + firsts[of]
        edge = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1])))
        sums = np.zeros((firsts[-1] + PASSAGE_UNITS, self.products.shape[1]), np.float32)
        sums[units[edge]] = np.add.reduceat(self.products[ids], edge, axis=0)
        for wide, own in self.sizes:
            part = sums[:, own]
            window = part[: firsts[-1]] + part[1 : firsts[-1] + 1]
            for k in range(2, wide):
                window += part[k : firsts[-1] + k]
            for i, j in zip(*np.nonzero(window >= MASS * self.own[own])):
                a, b = np.searchsorted(units, (i, i + wide))
                norm = float(np.linalg.norm(self.space[ids[a:b]].sum(axis=0)))
                cosine = float(window[i, j]) / max(norm, 1e-9)
                if cosine >= self.cosine or window[i, j] >= SURE_MASS * self.own[own.start + j]:
                    d = int(np.searchsorted(firsts, i, side="right")) - 1
                    word = int(i - firsts[d]) * UNIT
                    item, first, terms = self.passages[own.start + j]
                    found.setdefault(d, {}).setdefault(item, []).append((cosine, word, word + wide * UNIT, first, first + len(terms)))
        return found


def _places(windows: list[tuple[float, int, int, int, int]]) -> list[tuple[int, int]]:
    """Overlapping windows are one place."""
    out: list[tuple[int, int]] = []
    for _, a, b, *_ in sorted(windows, key=lambda w: w[1]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _passes(rows: DataFrame, benchmark: DataFrame, cosine: float, block_passages: int, blocks: int):
    """Broadcast lists of Searchers, ``blocks`` at a time, fitted on all documents. Their size depends on the bounds of a block."""
    latent = Latent(rows, benchmark, block_passages)
    held: list[Searcher] = []
    for block in blocks_of(benchmark, block_passages):
        held.append(Searcher(block, latent, cosine))
        if len(held) == blocks:
            yield rows.sparkSession.sparkContext.broadcast(held)
            held = []
    if held:
        yield rows.sparkSession.sparkContext.broadcast(held)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block_passages: int = BLOCK_PASSAGES, blocks: int = BLOCKS) -> DataFrame:
    """One row per document and benchmark item that the document leaks: doc_id, item_id, cosine, lcs, answer_found."""
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
    names = ["doc_id", "item_id", "cosine", "lcs", "answer_found"]
    rows = numbered(docs, "doc_id")
    out = None
    for shared in _passes(rows, benchmark, cosine, block_passages, blocks):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if found := [leak for searcher in shared.value for leak in searcher.leaks(batch.column(1), batch.column(2))]:
                    row, *rest = (list(c) for c in zip(*found))
                    columns = [batch.column(0).take(pa.array(row)), *rest]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        found = rows.mapInArrow(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block_passages: int = BLOCK_PASSAGES, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns; texts are not shuffled."""
    at = docs.columns.index("text")
    order = [*docs.columns[:at], *docs.columns[at + 1 :]]
    rows = numbered(docs, *order)
    kept, n = rows, 0
    for shared in _passes(rows, benchmark, cosine, block_passages, blocks):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for searcher in shared.value:
                    stays[[leak[0] for leak in searcher.leaks(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))]] = False
                yield batch.filter(pa.array(stays))

        # what a pass keeps is written before the next one, so that a task holds the blocks of one pass
        kept = (materialize(kept, "clean") if n else kept).mapInArrow(run, rows.schema)
        n += 1
    return kept.drop("numbers").toDF(*order, "text").select(*[F.col(quoted(c)) for c in docs.columns])
