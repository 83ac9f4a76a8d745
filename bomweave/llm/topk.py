"""Exact top-k by inner product over a bit-sliced index.

Every attribute (vector component) is quantised to an integer and stored as bit
slices: bitmap *i* of an attribute has bit *i* of its value for all rows of a block.
The scores of a query are added up from slices by carry-save bitmap arithmetic, which
gives the score itself as slices. The top rows are then selected from the most
significant slice downward; rows that tie at the boundary are resolved by row id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise

BLOCK_ROWS = 16_384
CHUNK_QUERIES = 128
LARGEST_SCORE = 1 << 61


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (uint64 words) of 0/1 rows along the last axis."""
    padded = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 64), np.uint8)
    padded[..., : bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class SlicedBlock:
    """Bit slices of a block of integer vectors, ordered by row id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low = self.values.min(0)
        above = self.values - self.low  # slices hold what lies above the least value
        self.bits = max(1, int(above.max()).bit_length())
        self.slices = np.stack([_packed(((above >> i) & 1).T.astype(np.uint8)) for i in range(self.bits)])
        self.all = _packed(np.ones(len(ids), np.uint8))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of all inner products with ``query``, least significant first, and
        the constant that is missing from them. A negative factor multiplies the
        complement of its attribute, so that only sums of slices are needed."""
        full = (1 << self.bits) - 1
        size = np.abs(query)
        constant = int(query @ self.low) - full * int(size[query < 0].sum())
        flip = np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
        attributes = [s ^ flip for s in self.slices]
        levels: list[list[np.ndarray]] = [[] for _ in range(self.bits + int(size.max(initial=0)).bit_length() + 1)]
        for j in range(int(size.max(initial=0)).bit_length()):
            used = np.flatnonzero((size >> j) & 1)
            for i in range(self.bits):
                levels[i + j].append(attributes[i][used])
        result, level = [], 0
        while level < len(levels):
            terms = np.concatenate(levels[level]) if levels[level] else self.all[None][:0]
            while len(terms) > 1:
                n = len(terms) // 3
                if n:
                    a, b, c = terms[:n], terms[n:2 * n], terms[2 * n:3 * n]
                    odd = a ^ b
                    total, carry, rest = odd ^ c, (a & b) | (odd & c), terms[3 * n:]
                else:
                    total, carry, rest = terms[:1] ^ terms[1:], terms[:1] & terms[1:], terms[:0]
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(carry)
                terms = np.concatenate([total, rest])
            result.append(terms[0] if len(terms) else np.zeros_like(self.all))
            level += 1
        return result, constant

    def top(self, slices: list[np.ndarray], k: int, without: int | None) -> np.ndarray:
        """Positions of the ``k`` best rows: first all rows above the boundary, then
        the rows on it in order of id."""
        sure, open_ = np.zeros_like(self.all), self.all.copy()
        if without is not None:
            open_[without >> 6] &= ~(np.uint64(1) << np.uint64(without & 63))
        for bits in reversed(slices):
            high = open_ & bits
            count = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(high).sum())
            if count >= k:
                open_ = high
            else:
                sure |= high
                open_ &= ~bits
        above, ties = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, open_))
        return np.concatenate([above, ties[: max(0, k - len(above))]])

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best rows other than the query's own: one row of its
        id and values, all of which are in one block."""
        slices, constant = self.scores(query)
        named = np.arange(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        same = named[(self.values[named] == query).all(1)]  # equal rows of an id are interchangeable
        best = self.top(slices, k, int(same[0]) if len(same) else None)
        score = np.full(len(best), constant, np.int64)
        for i, bits in enumerate(slices):
            score += ((bits[best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
        return self.ids[best], score


def quantised(vectors: DataFrame, scale: float, id: str, vector: str) -> DataFrame:
    """``id`` and ``value`` (array of long): floor(scale * x) of vectors whose components
    are all finite. Rows without an id, or with a null or empty vector, are left out."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col(id).isNotNull() & (F.size(vector) > 0) & usable).select(
        F.col(id).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("value"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id: str = "vec_id",
          vector: str = "embedding", block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """The ``k`` largest inner products of each query with all other rows, as
    (query_id, rank from 1, vec_id, score); ties go to the smaller id, and there are
    fewer rows where there are fewer candidates. Only the query's own row is left out.

    Components x become floor(scale * x). Vectors that are null, empty, or hold a null
    or non-finite component take no part, nor do rows without an id. Shorter vectors
    count as filled up with zeros. Rows with the same id are rows of their own, as queries
    (with ranks of their own) and as candidates. Scores must stay below 2^61; larger
    vectors raise a ``ValueError``, as they would have no exact score.

    Rows are dealt into blocks and queries into chunks by hash; a pair of block and
    chunk is one task's work, so neither side is ever held whole.
    """
    index = materialise(quantised(vectors, scale, id, vector), "top-k-rows")
    asked = materialise(quantised(queries, scale, id, vector).withColumn("ask", F.monotonically_increasing_id()), "top-k-queries")
    size = F.max(F.size("value")), F.max(F.greatest(F.abs(F.array_max("value")), F.abs(F.array_min("value"))))
    rows, width, most = index.agg(F.count("id"), *size).first()
    n_queries, query_width, query_most = asked.agg(F.count("id"), *size).first()
    width = max(width or 0, query_width or 0)
    if width * (most or 0) * (query_most or 0) * 4 >= LARGEST_SCORE:
        raise ValueError("components are too large for exact 64-bit scores")
    blocks, chunks = -(-(rows or 1) // block_rows), -(-(n_queries or 1) // chunk_queries)

    def dealt(rows: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return rows.select(
            F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other), *rows.columns)

    def search(table: pa.Table, chunk: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and chunk.num_rows:
            block = SlicedBlock(table.column("id").to_numpy(), _matrix(table.column("value"), width))
            ask = zip(chunk.column("ask").to_pylist(), chunk.column("id").to_pylist(), _matrix(chunk.column("value"), width))
            found = [(n, q, *block.search(q, x, k)) for n, q, x in ask]
        counts = [len(ids) for _, _, ids, _ in found]
        none = np.zeros(0, np.int64)
        return pa.table({
            "ask": pa.array(np.repeat(np.array([n for n, _, _, _ in found], np.int64), counts)),
            "query_id": pa.array(np.repeat(np.array([q for _, q, _, _ in found], np.int64), counts)),
            "vec_id": pa.array(np.concatenate([none, *(ids for _, _, ids, _ in found)])),
            "score": pa.array(np.concatenate([none, *(scores for _, _, _, scores in found)]))})

    pairs = dealt(index, "block", blocks, "chunk", chunks).groupBy("block", "chunk").cogroup(
        dealt(asked, "chunk", chunks, "block", blocks).groupBy("block", "chunk"))
    partial = pairs.applyInArrow(search, "ask long, query_id long, vec_id long, score long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
