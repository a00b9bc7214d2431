"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Arrow batches of text are bounded by bytes, as rows may be long: workers and executors hold a few at a time.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder_is(key: Column, modulus: int, wanted: int) -> Column:
    """crc32 of the key as text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == wanted, F.lit(False))


def slices(batch: pa.RecordBatch, text: str, most_chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut an Arrow batch into runs of rows with about most_chars of text; null texts become ''.

    A single longer text still comes whole.
    """
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64) + 1)
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most_chars, side="right")))
        part = batch.slice(at, to - at)
        yield part, [x or "" for x in col.slice(at, to - at).to_pylist()]
        at = to


def per_slice(f: Callable[[pa.RecordBatch, list[str]], dict | None], schema: pa.Schema, text: str = "text", most_chars: int = 1_000_000):
    """A mapInArrow function from f(rows, texts) -> columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, text, most_chars):
                if (out := f(rows, texts)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) if not isinstance(out[x.name], pa.Array) else out[x.name] for x in schema], schema=schema)

    return run


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, the same ones each time: those with the smallest hash of the key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(7)), F.col(key)).limit(most)


def kept_rows(rows: DataFrame, keeps: Callable[[list[str]], np.ndarray], text: str = "text", most_chars: int = 1_000_000) -> DataFrame:
    """The rows, all columns, whose text `keeps` says yes to; nothing is shuffled."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text, most_chars):
                yield part.filter(pa.array(keeps(texts), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
