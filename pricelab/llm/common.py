"""Helpers shared by the training-data operators: keys, words, Arrow batches, tables.

Row keys.  A document is named by ``doc_id``.  Where rows must be joined back
or ordered, the internal key is ``did`` (doc_id, a null one counts as the
largest id) and ``th`` (XXH64 of the text), so rows that repeat a doc_id with
another text stay apart and fully repeated rows count as one document that is
returned as often as it was given.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_ID = 2**63 - 1
#: Rows of an Arrow batch handed to Python; a batch of average documents is a few MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in Arrow batches: keep the batches small (session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def did(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(MAX_ID))


def crc_mod(col: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at just these six bytes."""
    return text.split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def portions(b: pa.RecordBatch, text: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, some ``most`` bytes of its column ``text`` at a time."""
    ends, i = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, most + (ends[i - 1] if i else 0), side="right")))
        yield b.slice(i, j - i)
        i = j


def map_docs(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType, rows: int = 0) -> DataFrame:
    """mapInArrow with ``fn`` giving a batch's output columns by the names of ``schema``.

    Batches that give no rows are skipped.  Batches of short rows are put
    together until they have ``rows`` rows.
    """
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _joined(batches, rows) if rows else batches:
            if b.num_rows:
                cols = fn(b)
                out = pa.RecordBatch.from_arrays(
                    [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and (whole := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield whole[0]


def filter_docs(df: DataFrame, keep: Callable[[list], list[bool]], text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text ``keep`` accepts, batch by batch, with all their columns."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, df.schema)
