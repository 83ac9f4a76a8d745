"""Event intake that never forgets an id.

Ids lie in hash buckets; each bucket has a Bloom filter. A batch tests its ids against the
filters and reads only the buckets in which a test hits. What a filter suspects
is settled by the ids themselves, so the result is exact whatever the filters say: a replay
is dropped after any time, and a new event is kept however late it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import accounts
from .store import BatchStore, bucket_of, buckets_in

HASHES = 8
BITS_PER_ID = 16  # one in some 2,000 new ids is suspected
FIRST_BITS = 1 << 16
FILTER = "bucket int, bits binary, n long"


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (h1 + steps * (h2 | np.uint64(1))) & np.uint64(bits - 1)


def _hashes(table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))


class SeenIds:
    """Ids delivered so far, below a folder. ``key`` is the id's column."""

    def __init__(self, spark: SparkSession, target: str, key: str = "event_id", buckets: int = 64):
        self.key, self.buckets = key, buckets
        self.store = BatchStore(spark, target, {"filters": "bits binary, n long"}, {"ids": "id string"}, buckets)

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.select("bucket", F.xxhash64(F.lit(1), "id").alias("h1"), F.xxhash64(F.lit(2), "id").alias("h2"), "id")

    def _suspects(self, ids: DataFrame, filters: DataFrame) -> DataFrame:
        """Ids that a filter may hold. A task takes the batch's ids of one bucket and its filter."""
        def test(left: pa.Table, right: pa.Table) -> pa.Table:
            if right.num_rows == 0 or left.num_rows == 0:
                return left.slice(0, 0).select(["bucket", "id"])
            left = left.combine_chunks()
            bits = np.unpackbits(np.frombuffer(right.column("bits")[0].as_py(), np.uint8))
            hit = bits[_places(*_hashes(left), len(bits))].all(0)
            return left.select(["bucket", "id"]).filter(pa.array(hit))

        return self._hashed(ids).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, "bucket int, id string")

    def _filled(self, ids: DataFrame, filters: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
        """Filters of the touched buckets. ``sizes`` has their bits and ids; an old filter of that
        size is kept and added to, any other is built again from all ids of the bucket."""
        def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket = key[0].as_py()
            bits, n = sizes[bucket]
            here = np.zeros(bits, bool)
            for batch in batches:
                for old in batch.column("bits").to_pylist():
                    if old is not None and len(old) * 8 == bits:
                        here |= np.unpackbits(np.frombuffer(old, np.uint8)).view(bool)
                plain = batch.filter(batch.column("bits").is_null())
                here[_places(*_hashes(plain), bits)] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([np.packbits(here).tobytes()], pa.binary()), pa.array([n], pa.int64())],
                names=["bucket", "bits", "n"])

        rows = self._hashed(ids).select("bucket", "h1", "h2", F.lit(None).cast("binary").alias("bits"))
        old = filters.select("bucket", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "bits")
        return rows.unionByName(old).groupBy("bucket").applyInArrow(fill, FILTER)

    def first_deliveries(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Events of the batch that no earlier batch has delivered, one per id (the earliest).
        Their ids are remembered as of ``batch_id``; run again, a batch gives the same events.
        Events without an id are one event of their batch."""
        store, id = self.store, F.col(self.key).cast("string")
        once = accounts.intake(batch.withColumnRenamed(self.key, "event_id")).withColumnRenamed("event_id", self.key)
        once = materialise(once.select(batch.columns), "batch-events")
        ids = once.select(id.alias("id")).withColumn("bucket", bucket_of("id", buckets=self.buckets))
        touched = buckets_in(ids)
        filters = store.read("filters", batch_id, touched)
        suspects = materialise(self._suspects(ids, filters), "suspected-ids")
        known = store.read("ids", batch_id, buckets_in(suspects)).join(suspects, ["bucket", "id"], "left_semi")
        known = known.select(F.col("id").alias("_known"))
        fresh = materialise(once.join(known, id == F.col("_known"), "left_anti"), "first-deliveries")

        new = fresh.select(id.alias("id")).withColumn("bucket", bucket_of("id", buckets=self.buckets))
        store.stage("ids", new.select("id", "bucket"), batch_id)
        had = {r["bucket"]: (r["bits"] * 8, r["n"]) for r in filters.select("bucket", F.octet_length("bits").alias("bits"), "n").collect()}
        sizes, grown = {}, []
        for r in new.groupBy("bucket").count().collect():
            bits, n = had.get(r["bucket"], (FIRST_BITS, 0))
            n += r["count"]
            if n * BITS_PER_ID > bits:
                grown.append(r["bucket"])
                while n * BITS_PER_ID > bits:
                    bits *= 2
            sizes[r["bucket"]] = bits, n
        source = new.unionByName(store.read("ids", batch_id, grown)) if grown else new
        store.stage("filters", self._filled(source, filters.filter(F.col("bucket").isin(list(sizes))), sizes), batch_id)
        store.commit(batch_id, {"filters": list(sizes)})
        return fresh
