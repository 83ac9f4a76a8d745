"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # text handled at a time inside a Python task
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH, SMALL_BATCH = "67108864b", "4194304b"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def session_for_texts(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches of 4 MiB unless it sets a size itself: with
    Spark's default, long texts fill some hundred MB a task on both sides."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_BYTES, SMALL_BATCH)
    return spark


def broadcast(spark: SparkSession, value):
    """A broadcast variable for models and vocabularies of a bounded size."""
    return spark.sparkContext.broadcast(value)


def texts_of(array: pa.Array) -> list[str]:
    """Texts with null as the empty text."""
    return [t or "" for t in array.to_pylist()]


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a string array with about ``limit`` bytes each; a
    longer text is a part of its own, so memory is bounded by the longest text."""
    if len(array) == 0:
        yield array
        return
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(array):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield array.slice(start, stop - start)
        start = stop


def by_slices(array: pa.Array, fn, limit: int = SLICE_BYTES) -> pa.Array:
    """``fn`` of each slice, concatenated."""
    return pa.concat_arrays([fn(part) for part in slices(array, limit)])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them as long as a column of ``df`` has that name."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
        taken.add(name.lower())
    return found


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
