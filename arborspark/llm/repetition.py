"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

Every text is one numpy job: its words get 64-bit hashes, windows of n words get a rolling sum of the word hashes
times odd powers (all windows of a length at once), and a sort finds windows that occur twice. The measure of a
length is the share of word characters that lie inside a window which occurred before in the text; lines are
measured the same way. A text is kept if no measure passes its limit.

Defined results: null and empty texts have no words, measure 0 and fail the base rule; a text shorter than n words
has no window of that length; very long texts are one job each of memory in proportion to the text; repeated rows
give repeated rows; null doc_ids are kept as they are; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arborspark.llm.common import arrow_rows, utf8

#: Largest share of word characters inside repeated windows, by window length in words (fixed values). A short text
#: with one boilerplate line at both ends stays below all of them; a text of stuttered words passes those of 2 to 4.
LIMITS = {2: 0.60, 3: 0.30, 4: 0.25, 5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Largest share of lines, and of characters, in repeated lines (fixed values).
LINE_LIMIT, LINE_CHAR_LIMIT = 0.50, 0.30
#: The base rule.
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("dup_line_share", T.DoubleType()),
        T.StructField("dup_line_char_share", T.DoubleType()),
        *[T.StructField(f"dup_{n}gram_share", T.DoubleType()) for n in LIMITS],
    ]
)

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grow(hashes: np.ndarray, words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Rolls the hashes of the windows of n - 1 words at ``starts`` on by one word."""
    return (hashes * _MIX + words[starts + n - 1]) * _ODD


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in text order: which occur twice or more, and which of them not for the first time."""
    order = np.argsort(hashes, kind="stable")
    in_order = hashes[order]
    same = in_order[1:] == in_order[:-1]
    later = np.zeros(len(hashes), bool)
    later[order[1:][same]] = True
    both = later.copy()
    both[order[:-1][same]] = True
    return both, later


def covered(at: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """True for words inside a window of n words that starts at one of ``at``."""
    edge = np.zeros(n_words + 1, np.int32)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge)[:n_words] > 0


def measure(text: str | None) -> tuple:
    """All measures of one text, in the order of SCHEMA after doc_id."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    body = np.frombuffer(raw, np.uint8)
    n_symbols = int(_SYMBOLS[body].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    if len(raw) != (len(text) if text else 0):  # code points: bytes that do not continue one
        goes_on = np.concatenate(([0], np.cumsum((body & 0xC0) == 0x80)))
        blank = (body == 32) | ((body >= 9) & (body <= 13))
        begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        lengths = lengths - (goes_on[begins + lengths] - goes_on[begins])
    chars = int(lengths.sum())
    seen: set[bytes] = set()
    lines = dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line)
            seen.add(line)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    repeat_words, shares = 0, dict.fromkeys(LIMITS, 0.0)
    starts, windows = np.arange(n), hashes
    for size in range(2, max(LIMITS) + 1):
        # a window can repeat only if both windows of one word less inside it do, so each length looks at those alone
        if size > 2:
            follows = np.flatnonzero(np.diff(starts) == 1)
            starts, windows = starts[follows], windows[follows]
        else:
            starts, windows = starts[: max(0, n - 1)], windows[: max(0, n - 1)]
        if not len(starts):
            break
        windows = grow(windows, hashes, starts, size)
        both, later = repeated(windows)
        if size in LIMITS and later.any():
            shares[size] = float(lengths[covered(starts[later], size, n)].sum()) / chars
        if size == BASE_WINDOW:
            repeat_words = int(covered(starts[both], size, n).sum())
        starts, windows = starts[both], windows[both]
    failed = n < MIN_WORDS or 100 * repeat_words > BASE_PERCENT * n
    line_share = dup_lines / lines if lines else 0.0
    line_char_share = dup_line_chars / len(raw) if raw else 0.0
    kept = (
        not failed
        and line_share <= LINE_LIMIT
        and line_char_share <= LINE_CHAR_LIMIT
        and all(shares[size] <= limit for size, limit in LIMITS.items())
    )
    return n, chars, n_symbols, dup_lines, repeat_words, failed, kept, line_share, line_char_share, *shares.values()


def repetition(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept and the shares."""

    def make():
        def each(row: dict) -> Iterator[tuple]:
            yield (row["doc_id"], *measure(row["text"]))

        return each

    return arrow_rows(docs.select("doc_id", "text"), SCHEMA, make)
