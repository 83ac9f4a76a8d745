"""Bloom filters of keys seen once and of keys seen twice, filled in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FILTER_BITS = 1 << 27  # 16 MiB each, whatever the data
FILTER_HASHES = 4
FILTER_SLICES = 64


class SeenFilters:
    """Bloom filters of keys seen at least once and at least twice."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.once, self.twice = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and bit of each hash of each key (two 64-bit columns)."""
        steps = np.arange(FILTER_HASHES, dtype=np.uint64)[:, None]
        at = (keys[:, 0] + steps * (keys[:, 1] | np.uint64(1))) & self.mask
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def add(self, keys: np.ndarray) -> None:
        order = np.argsort(keys[:, 0], kind="stable")
        first = keys[order, 0]
        again = np.zeros(len(keys), bool)
        again[order[1:]] = first[1:] == first[:-1]
        words, bits = self.places(keys)
        again |= ((self.once[words] & bits) != 0).all(0)
        np.bitwise_or.at(self.twice, words[:, again], bits[:, again])
        np.bitwise_or.at(self.once, words, bits)

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice
        self.twice |= self.once & once
        self.once |= once


def maybe(twice: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key."""
    probe = SeenFilters.__new__(SeenFilters)
    probe.mask = np.uint64(len(twice) * 64 - 1)
    words, bits = probe.places(keys)
    return ((twice[words] & bits) != 0).all(0)


def seen_twice(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """The merged filter of keys that may occur twice. ``keys_of`` gives arrays of keys,
    two 64-bit hashes each. The filter has ``bits`` bits (a power of two, at least
    4096) at any size of the corpus."""
    slice_words = bits // 64 // FILTER_SLICES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = SeenFilters(bits)
        for batch in batches:
            for keys in keys_of(batch):
                filters.add(keys)
        for k in range(FILTER_SLICES):
            part = slice(k * slice_words, (k + 1) * slice_words)
            if filters.once[part].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([filters.once[part].tobytes()], pa.binary()),
                     pa.array([filters.twice[part].tobytes()], pa.binary())], names=["part", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = SeenFilters(slice_words * 64)
        for batch in batches:
            for once, twice in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                filters.merge(np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([filters.twice.tobytes()], pa.binary())],
            names=["part", "twice"])

    # one pair of filters per core at most: they are larger than a task's keys
    source = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    merged = source.mapInArrow(fill, "part int, once binary, twice binary").groupBy("part").applyInArrow(
        merge, "part int, twice binary")
    twice = np.zeros(bits // 64, np.uint64)
    for row in merged.collect():
        twice[row["part"] * slice_words:(row["part"] + 1) * slice_words] = np.frombuffer(row["twice"], np.uint64)
    return twice
