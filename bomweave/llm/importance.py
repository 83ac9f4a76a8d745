"""Importance resampling towards a target distribution, with a position-table CRC.

Features are hashed into buckets by their CRC-32. The checksum is linear over XOR: a byte
contributes a word that depends on its value and its distance from the feature's end
only, and the length adds a constant. ``PositionCrc`` looks the contributions of all bytes of
a slice of text up at once and folds them per feature with ``bitwise_xor.reduceat``; features
longer than the table are folded block by block.

Documents are weighted by how much more frequent their buckets are in the target than in
the corpus, and drawn without replacement by weight plus Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators.skew import numbered
from .common import broadcast, by_slices, session_for_texts, slices

DEPTH = 64  # distances from the end that the table holds
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True  # digits, a-z, all bytes of other characters


class PositionCrc:
    """CRC-32 of many spans of a byte buffer at once."""

    def __init__(self, depth: int = DEPTH):
        first = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1).astype(np.uint32)
        self.depth = depth
        self.first = first
        rows = [first]
        for _ in range(depth - 1):
            rows.append(self._zero(rows[-1]))
        self.table = np.stack(rows).ravel()  # [distance from the end * 256 + byte]
        start = [np.uint32(0xFFFFFFFF)]
        for _ in range(depth):
            start.append(self._zero(start[-1]))
        self.start = np.array(start, np.uint32)  # what the initial register adds, by length
        block = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(depth):
            block = self._zero(block)
        self.block = block  # a register, byte by byte, after ``depth`` more zero bytes

    def _zero(self, register):
        """The register after one more zero byte."""
        return (register >> np.uint32(8)) ^ self.first[register & np.uint32(255)]

    def _skip(self, register: np.ndarray) -> np.ndarray:
        found = self.block[0][register & np.uint32(255)]
        for k in range(1, 4):
            found = found ^ self.block[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
        return found

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Checksums of ``data[start:end]``; spans may overlap but not be empty."""
        if len(starts) == 0:
            return np.zeros(0, np.uint32)
        lengths = ends - starts
        blocks = -(-lengths // self.depth)
        owner = np.repeat(np.arange(len(starts)), blocks)
        at = np.cumsum(blocks) - blocks  # first block of each span, the only one that may be short
        nth = np.arange(len(owner)) - at[owner]
        block_end = ends[owner] - (blocks[owner] - 1 - nth) * self.depth
        block_start = np.maximum(starts[owner], block_end - self.depth)
        size = block_end - block_start
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(block_start - begin, size)
        distance = np.repeat(block_end, size) - 1 - place
        folded = np.bitwise_xor.reduceat(self.table[distance * 256 + data[place]], begin)
        register = self.start[size[at]] ^ folded[at]
        long = np.flatnonzero(blocks > 1)
        k = 1
        while len(long):
            register[long] = self._skip(register[long]) ^ folded[at[long] + k]
            k += 1
            long = long[blocks[long] > k]
        return ~register


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a binary array: their bytes in lower case, one space behind each word,
    with the start, end and row of every word."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = LOWER[np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = IN_WORD[raw]
    here = inside[1:-1]
    before, behind = inside[:-2].copy(), inside[2:].copy()
    edges = bounds[(bounds > 0) & (bounds < len(raw))]
    before[edges], behind[edges - 1] = False, False  # words end where their text does
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~behind) + 1
    row = np.searchsorted(bounds, starts, side="right") - 1
    lengths = ends - starts
    new_end = np.cumsum(lengths + 1) - 1
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    kept = np.ones(len(out), bool)
    kept[new_end] = False
    out[kept] = raw[here]
    return out, new_end - lengths, new_end, row


def features_of(texts: pa.Array, longest: int, buckets: int, crc: PositionCrc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature: runs of 1 to ``longest`` words; and words per row."""
    data, starts, ends, row = words_of(texts)
    rows, found = [], []
    for n in range(1, longest + 1):
        first = np.flatnonzero(row[:max(0, len(row) - n + 1)] == row[n - 1:])
        found.append(crc.of(data, starts[first], ends[first + n - 1]).astype(np.int64) % buckets)
        rows.append(row[first])
    return np.concatenate(rows), np.concatenate(found), np.bincount(row, minlength=len(texts))


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``bucket, n``: features of all rows of a one-column frame of texts. Counted in the
    tasks; at most ``buckets`` rows of each are shuffled."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = PositionCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0).cast(pa.binary())):
                total += np.bincount(features_of(part, longest, buckets, crc)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    session_for_texts(texts)
    return texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Gain of each bucket in thousandths: how much likelier it is in the target texts
    than in the corpus, both with one more feature in every bucket. The driver holds
    one number per bucket."""
    def dense(frame: DataFrame) -> np.ndarray:
        counts, found = np.zeros(buckets), bucket_counts(frame, longest, buckets).toArrow()
        counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        return counts

    s, t = dense(docs), dense(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = LEAST_WORDS, longest: int = 1,
           buckets: int = BUCKETS, seed: int = SEED, id: str = "doc_id", text: str = "text",
           target_text: str = "text") -> DataFrame:
    """One row per document: ``id, n_features, weight, score, rank`` (all long).

    Words are runs of digits, letters a-z (A-Z count as these) and all characters beyond
    ASCII; features are runs of 1 to ``longest`` words of a text, repeats counted. ``weight`` is
    the floored mean of the features' gains, 0 without features; ``score`` adds the noise.
    Of the N documents of at least ``least_words`` words, ``percent * N // 100`` are drawn, those of
    the highest scores, ties to the smaller id; ``rank`` is their place from 1, null for the rest.

    Null and empty texts have no features; a null id has a null score and isn't drawn, nor
    does it count in N. Rows with the same id have the same noise and are rows of their own. Other
    columns are not read. Without target texts all features of the corpus are equally unlikely there.
    """
    spark = session_for_texts(docs)
    shared = broadcast(spark, gains(docs.select(text), target.select(target_text), longest, buckets))

    @F.arrow_udf("struct<n_features:bigint,n_words:bigint,weight:bigint>")
    def weighed(texts: pa.Array) -> pa.Array:
        crc = PositionCrc()

        def part(values: pa.Array) -> pa.Array:
            rows, found, words = features_of(values, longest, buckets, crc)
            n = np.bincount(rows, minlength=len(values))
            total = np.zeros(len(values), np.int64)
            np.add.at(total, rows, shared.value[found])
            return pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())],
                names=["n_features", "n_words", "weight"])

        return by_slices(texts.cast(pa.binary()), part)

    rows = docs.select(F.col(id).alias("id"), weighed(F.col(text)).alias("f")).select(
        "id", "f.*", (F.col("f.weight") + noise(F.col("id"), seed)).alias("score"))
    rows = materialise(rows.withColumn("able", (F.col("n_words") >= least_words) & F.col("id").isNotNull()), "importance-weights")
    able = rows.filter("able")
    drawn = percent * able.count() // 100
    placed = numbered(able.withColumn("behind", -F.col("score")), [], ["behind", "id", "weight", "n_features"], "rank")
    result = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")).drop("behind").unionByName(
        rows.filter("not able").withColumn("rank", F.lit(None).cast("long")))
    return result.select(F.col("id").alias(id), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; options as for ``ranked``."""
    drawn = ranked(docs, target, id=id, **options).filter(F.col("rank").isNotNull()).select(id).distinct()
    return docs.join(drawn, id, "left_semi")
