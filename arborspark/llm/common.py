"""Shared helpers: table access, the shared scratch folder, Arrow batches, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.scratch import free_name, materialize, ranked, scratch, shared_dir

__all__ = ["arrow_rows", "free_name", "materialize", "n_words", "quoted", "ranked", "scratch", "shared_dir", "table", "utf8"]

#: A word is a run of characters other than ASCII white space; ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow output is cut into batches of about this many rows.
OUT_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name as Spark reads it back, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def arrow_rows(
    df: DataFrame,
    schema: T.StructType,
    make: Callable[[], Callable[[dict], Iterator[tuple]]],
    out_rows: int = OUT_ROWS,
) -> DataFrame:
    """Apply a row function over Arrow batches. ``make`` runs once per task and returns a function from a
    row (column name to Python value) to output tuples. One row's intermediates are alive at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            for r in range(batch.num_rows):
                held.extend(each({n: c[r].as_py() for n, c in zip(names, columns)}))
                if len(held) >= out_rows:
                    yield _batch(held, arrow)
                    held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), type=field.type) for column, field in zip(zip(*rows), arrow)], schema=arrow
    )


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def n_words(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
