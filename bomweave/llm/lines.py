"""Line dedup with two Bloom filters, of keys seen once and of keys seen twice.

Every task fills a pair of filters from its documents. Pairs merge bit by bit: what
is in both *once* filters may have been seen twice. Keys outside the merged *twice*
filter are certainly unique and never leave their task; the rest, suspected repeats,
is shuffled as 128-bit hashes, confirmed by grouping, and kept in the smallest
document only. A filter that is too small for the corpus suspects more keys and
shuffles more, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import broadcast, by_slices, session_for_texts, slices, unused
from .filters import FILTER_BITS, maybe, seen_twice

WHITE_SPACE = b" \t\n\x0b\x0c\r"


def lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the line's key, or None for a key that is too short."""
    key = line.strip(WHITE_SPACE).lower()  # of bytes: A-Z only
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document ids and distinct keys per document, a slice of text at a time.
    Rows without a document id hold nothing."""
    texts, start = batch.column(1).cast(pa.binary()), 0
    for part in slices(texts):
        ids = batch.column(0).slice(start, len(part)).to_pylist()
        start += len(part)
        docs, keys = [], []
        for doc, text in zip(ids, part.to_pylist()):
            if doc is not None:
                found = {k for line in lines_of(text) if (k := key_of(line, min_chars)) is not None}
                keys.extend(found)
                docs.extend([doc] * len(found))
        yield np.array(docs, np.int64), np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def line_dedup(docs: DataFrame, min_chars: int = 10, id: str = "doc_id", text: str = "text",
               filter_bits: int = FILTER_BITS) -> DataFrame:
    """Add ``kept_text``, ``n_lines`` and ``n_dropped`` (long).

    A line's key is the line without ASCII white space at its ends and with A-Z in
    lower case. A key of at least ``min_chars`` code points in two or more documents
    keeps its lines in the smallest ``id`` only. Rows with the same id count as one
    document; rows without an id lose nothing and hold nothing. A null or empty text
    is one empty line. ``filter_bits`` is a power of two, at least 4096; 12 bits a
    distinct key keep false suspicions rare. All other columns and all rows stay;
    columns with the names of the new ones are replaced.
    """
    spark = session_for_texts(docs)
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    twice = broadcast(spark, seen_twice(
        rows, lambda batch: (keys for _, keys in _keys(batch, min_chars)), filter_bits))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys in _keys(batch, min_chars):
                at = np.flatnonzero(maybe(twice.value, keys))
                hashes = np.ascontiguousarray(keys[at]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at], pa.int64()),
                     pa.FixedSizeBinaryArray.from_buffers(
                         pa.binary(16), len(at), [None, pa.py_buffer(hashes)]).cast(pa.binary())],
                    names=["doc", "key"])

    suspects = materialise(rows.mapInArrow(suspect, "doc long, key binary"), "line-suspects")
    confirmed = suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter(
        "first < last").select("key", "first")
    confirmed = materialise(confirmed, "line-repeats")
    d, g, kept = unused(docs, "_doc", "_dropped", "_left")
    dropped = suspects.join(confirmed, "key").filter("doc > first").groupBy(F.col("doc").alias(d)).agg(
        F.collect_set("key").alias(g))  # bounded by the document's own lines

    @F.arrow_udf("struct<n_lines:bigint,n_dropped:bigint,kept:string>")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        start = 0

        def part(values: pa.Array) -> pa.Array:
            nonlocal start
            rows = []
            for content, keys in zip(values.to_pylist(), gone.slice(start, len(values)).to_pylist()):
                found = lines_of(content)
                left = found
                if keys:
                    keys = set(keys)
                    left = [line for line in found if key_of(line, min_chars) not in keys]
                rows.append((len(found), len(found) - len(left), b"\n".join(left)))
            start += len(values)
            return pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], names=["n_lines", "n_dropped", "kept"])

        return by_slices(texts.cast(pa.binary()), part)

    joined = docs.join(dropped, F.col(id).cast("long") == F.col(d), "left").drop(d)
    result = joined.withColumn(kept, without(F.col(text), F.col(g))).drop(g)
    return result.withColumns({
        "kept_text": F.col(kept)["kept"], "n_lines": F.col(kept)["n_lines"], "n_dropped": F.col(kept)["n_dropped"],
    }).drop(kept)
