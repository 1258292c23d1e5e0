"""Token counts as delta-maintained rollups.

Each text column of a row is tokenized once, in ``count_tokens``, and a column that equals the first one not again. A change is an insert (n_tokens), a delete (old_tokens, the count before) or a
revision (both), for one tokenizer version. It contributes signed counts, + for the state after and - for the state before, per
source, language and tokenizer version, so batches carry counts and no texts. A batch of changes is summed to one
small delta per key and written once under its batch id; totals are the sum of all committed deltas.
Committing a batch id again changes nothing, so a batch may be retried at will: the delta is written to a folder of the
attempt first and becomes visible by one rename that fails where the batch is there already, so of two committers one wins. (The rename
is atomic where the file system's is, as on HDFS.) ``compact`` folds committed batches into one base, which remembers their ids.

Defined results: null texts and null counts are no tokens but a document; null source or lang is a key of its own; repeated rows
count each; empty batches commit an empty delta; unknown operations raise; extra columns are ignored. A revision that moves
a document to another source or language passes old_source and old_lang (default: unchanged).
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.llm.common import arrow_rows, utf8

VOCAB_DIR = "/opt/tokenizers"
#: How the rank files' tokenizers cut text before merging (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEYS = ["source", "lang", "tokenizer"]
DELTA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("tokenizer", T.StringType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
_loaded: dict[tuple[str, str], Callable[[str], int]] = {}


def counter(version: str, vocab_dir: str = VOCAB_DIR) -> Callable[[str], int]:
    """The counting function of a tokenizer version: ``words-1`` (runs between ASCII white space), ``bytes-1`` (UTF-8 bytes)
    or the name of a rank file. Loaded once per Python worker."""
    if version == "words-1":
        return lambda text: len(utf8(text).split())
    if version == "bytes-1":
        return lambda text: len(utf8(text))
    key = (version, vocab_dir)
    if key not in _loaded:
        import tiktoken

        with open(f"{vocab_dir}/{version}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(version, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        _loaded[key] = lambda text: len(encoding.encode_ordinary(text))
    return _loaded[key]


def count_tokens(docs: DataFrame, tokenizers: Sequence[str], columns: Sequence[str] = ("text",), vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """doc_id, source, lang, tokenizer and for each text column its tokens (``text_tokens``), for every row and tokenizer."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *DELTA.fields[:3], *(T.StructField(f"{c}_tokens", T.LongType()) for c in columns)]
    )

    def make():
        count = {v: counter(v, vocab_dir) for v in tokenizers}

        def each(row: dict) -> Iterator[tuple]:
            texts = [row[c] or "" for c in columns]
            for version, n in count.items():
                first = n(texts[0])
                yield row["doc_id"], row["source"], row["lang"], version, first, *(first if t == texts[0] else n(t) for t in texts[1:])

        return each

    return arrow_rows(docs.select("doc_id", "source", "lang", *columns), schema, make)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals per key from op, source, lang, tokenizer, n_tokens, old_tokens and, if they are there, old_source and old_lang.
    Tasks sum what they read before the shuffle, so a hot key sends one row per task."""
    have = {c.lower() for c in changes.columns}
    known = F.col("op").isin("insert", "delete", "revise")
    op = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(F.col("op"), F.lit("null")))))

    def side(sign: int, prefix: str) -> Column:
        keys = [F.col(f"{prefix}{k}" if f"{prefix}{k}" in have else k).alias(k) for k in ("source", "lang")]
        n = F.coalesce(F.col(f"{prefix}tokens" if prefix else "n_tokens"), F.lit(0)) if (prefix or "n_") + "tokens" in have else F.lit(0)
        return F.struct(*keys, F.col("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (n * sign).cast("long").alias("n_tokens"))

    after, before = side(1, ""), side(-1, "old_")
    sides = F.when(op == "insert", F.array(after)).when(op == "delete", F.array(before)).otherwise(F.array(after, before))
    return (
        changes.select(F.inline(sides))
        .groupBy(*KEYS)
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    )


class Rollup:
    """Totals in a folder of a shared file system: ``base-<n>`` (compacted) and ``batch=<id>`` (committed deltas)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._Path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _base(self) -> str | None:
        found = [n for n in self._names() if re.fullmatch(r"base-\d{6}", n)]
        return found[-1] if found else None

    def _publish(self, attempt: str, name: str) -> bool:
        """Move an attempt to its final name; False if that is taken."""
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(self._Path(attempt), self._Path(f"{self.path}/{name}"), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            if not self._fs.exists(self._Path(f"{self.path}/{name}")):
                raise
            self._fs.delete(self._Path(attempt), True)
            return False
        return True

    def has(self, batch: str) -> bool:
        """Whether a batch is committed; of the folded ids only this one is looked up."""
        if self._fs.exists(self._Path(f"{self.path}/batch={batch}")):
            return True
        base = self._base()
        return bool(base) and bool(self.spark.read.parquet(f"{self.path}/{base}/batches").filter(F.col("batch") == batch).limit(1).count())

    def committed(self) -> set[str]:
        """Ids of all committed batches, compacted ones included."""
        own = {n.removeprefix("batch=") for n in self._names() if n.startswith("batch=")}
        base = self._base()
        if base:
            own |= {r.batch for r in self.spark.read.parquet(f"{self.path}/{base}/batches").collect()}
        return own

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if its id was committed before, then nothing is read or changed."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.has(batch):
            return False
        attempt = f"{self.path}/.attempt-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(attempt)
        return self._publish(attempt, f"batch={batch}")

    def _parts(self) -> list[str]:
        base = self._base()
        folded = {r.batch for r in self.spark.read.parquet(f"{self.path}/{base}/batches").collect()} if base else set()
        live = [f"{self.path}/{n}" for n in self._names() if n.startswith("batch=") and n.removeprefix("batch=") not in folded]
        return ([f"{self.path}/{base}/totals"] if base else []) + live

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; keys without documents are left out."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*parts)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Fold all committed batches into the next base; a crash between the steps leaves the old state valid."""
        base, ids = self._base(), sorted(self.committed())
        number = int(base.removeprefix("base-")) + 1 if base else 0
        attempt = f"{self.path}/.attempt-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{attempt}/totals")
        self.spark.createDataFrame([(i,) for i in ids], "batch string").write.parquet(f"{attempt}/batches")
        if self._publish(attempt, f"base-{number:06d}"):
            for i in ids:
                self._fs.delete(self._Path(f"{self.path}/batch={i}"), True)
