"""Removal of byte strings that occur more than once in the collection.

*Anchors.* In every window of ``window`` bytes the short string with the least hash is
its anchor, so equal windows have equal anchors at equal offsets. A *segment* is the
text of consecutive windows with the same anchor. Two Bloom filters drop anchors seen
once; only segments of suspected repeats are shuffled.

*Construction.* Segments of one anchor are aligned on it and form a small document
collection. Its Burrows-Wheeler order is built column-wise: each round inserts one
symbol per segment in front, re-sorts the segments by that symbol, stably, and updates
the common prefixes of neighbours. As copies are aligned, suffixes from different
columns need no comparison, so a round touches its own column only. A window repeats
where a neighbour's common prefix reaches its length. The segments come as files
sorted by anchor, read once from front to back, a bounded number at a time.

*Crowded anchors.* Segments that agree are counted, not collected. If more than
``group_rows`` different ones share an anchor, their windows are cut into narrower
pieces, keyed by the bytes that all windows of a piece share, down to single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import broadcast, by_slices, session_for_texts, unused
from .filters import FILTER_BITS, maybe, seen_twice

WINDOW = 400
ANCHOR = 32  # bytes of an anchor; a power of two
GROUP_ROWS = 512
PIECES = (16, 1)  # widths in windows of the pieces of crowded segments
BUFFER_BYTES = 1 << 20
POSITION_BITS = np.uint64(22)
ROWS_AT_ONCE = 4_096
ABSENT = 256
_tables: list[np.ndarray] = []


def _byte_hashes() -> np.ndarray:
    if not _tables:
        _tables.append(np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return _tables[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _anchored(data: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the short string at each position, and each window's anchor position."""
    h, width, factor = _byte_hashes()[data], 1, 0x9E3779B97F4A7C15
    while width < anchor:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = (factor * factor + 2) & ((1 << 64) - 1), width * 2
    h = _mixed(h)
    # the least hash, ties to the left: positions fill the low bits
    low = ((h >> POSITION_BITS) << POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
    span, width = window - anchor + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width:])
    return h, (low & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)


def segments(texts: list[bytes], window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, last window, anchor position, anchor hash) of the
    segments, for a buffer of texts at a time. Long texts are cut with an overlap."""
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces])
        starts = np.cumsum(sizes) - sizes
        h, at = _anchored(data, window, anchor)
        # a window must lie in one piece, and pieces delimit runs
        piece = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
        inside = np.arange(len(at)) + window <= (starts + sizes)[piece]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new & inside)
        edge = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
        owner = piece[first]
        offset = np.array([o for _, o, _ in pieces])[owner] - starts[owner]
        return (np.array([n for n, _, _ in pieces])[owner], first + offset, edge + offset, at[first] + offset, h[at[first]])

    for n, text in enumerate(texts):
        for start in range(0, max(1, len(text) - window + 1), BUFFER_BYTES):
            piece = text[start:start + BUFFER_BYTES + window - 1]
            if len(piece) >= window:
                pieces.append((n, start, piece))
                held += len(piece)
            if held >= BUFFER_BYTES:
                yield flush()
                pieces, held = [], 0
    if pieces:
        yield flush()


def _filter_keys(hashes: np.ndarray) -> np.ndarray:
    return np.stack([hashes, _mixed(hashes + np.uint64(1))], 1)


def repeated_windows(group: np.ndarray, low: np.ndarray, text: list[bytes], window: int, anchor: int) -> np.ndarray:
    """For segments sorted by group, aligned so that ``low`` (<= 0) is the first byte's
    column: whether the window that starts in each column (from ``anchor - window``
    on) occurs in another segment of its group.

    Rounds go from the last column to the first; each inserts one symbol per segment.
    """
    n, left = len(text), window - anchor
    columns = np.full((n, left + window), ABSENT, np.uint16)
    for i, t in enumerate(text):
        columns[i, low[i] + left: low[i] + left + len(t)] = np.frombuffer(t, np.uint8)
    columns = np.ascontiguousarray(columns.T)
    repeated = np.zeros((left + 1, n), bool)
    order, prefix = np.arange(n), np.zeros(n + 1, np.int32)  # prefix[k]: of order[k - 1] and order[k]
    base = group.astype(np.int64) * (ABSENT + 1)
    for c in range(left + window - 1, -1, -1):
        key = base[order] + columns[c][order]
        move = np.argsort(key, kind="stable")
        key, order = key[move], order[move]
        same = np.zeros(n + 1, bool)
        same[1:n] = (key[1:] == key[:-1]) & (columns[c][order[1:]] != ABSENT)
        shared = np.zeros(n + 1, np.int32)
        near = same.copy()
        near[1:n] &= move[1:] == move[:-1] + 1
        shared[near] = prefix[move[np.flatnonzero(near)]] + 1
        far = np.flatnonzero(same & ~near)
        if len(far):  # neighbours that others stood between: the least prefix on the way
            bounds = np.stack([move[far - 1] + 1, move[far] + 1], 1).ravel()
            shared[far] = np.minimum.reduceat(prefix, bounds)[::2] + 1
        prefix = shared
        if c <= left:
            reach = prefix >= window
            repeated[c, order[reach[:-1] | reach[1:]]] = True
    return repeated.T


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - 1


def _keys_of(id: str, text: str) -> list[Column]:
    """Two hashes of id and text that stand for a row; equal rows have equal results."""
    return [F.xxhash64(F.col(id), F.col(text)).alias("k1"), F.xxhash64(F.lit("row"), F.col(text), F.col(id)).alias("k2")]


ROW = "anchor long, digest long, k1 long, k2 long, first long, last long, at long"


def _rows(anchor, digest, k1, k2, first, last, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x).view(np.int64) if getattr(x, "dtype", None) == np.uint64 else x, pa.int64())
         for x in (anchor, digest, k1, k2, first, last, at)],
        names=["anchor", "digest", "k1", "k2", "first", "last", "at"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", anchor: int = ANCHOR,
                   group_rows: int = GROUP_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans`` (long), ``spans`` (array of removed
    (start, stop) byte ranges) and ``kept_bytes`` (binary).

    Every byte is removed that a string of ``window`` bytes covers which also starts
    anywhere else in the collection, in the same text or another. Texts are taken as
    UTF-8; null counts as empty. Matches never cross rows; rows with equal id and text
    are separate places. Overlapping occurrences count, and all strings are judged on
    the input. All rows and other columns stay; columns named like the new ones are
    replaced. Segments are told apart by anchor and digest, 128 bits together.
    """
    spark = session_for_texts(docs)
    keyed = docs.select(*_keys_of(id, text), F.col(text).alias("text")).filter(F.octet_length("text") >= window)

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for *_, h in segments(batch.column(0).cast(pa.binary()).to_pylist(), window, anchor):
            yield _filter_keys(h)

    twice = broadcast(spark, seen_twice(keyed.select("text"), anchors, filter_bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for n, first, last, at, h in segments(texts, window, anchor):
                use = maybe(twice.value, _filter_keys(h))
                n, first, last, at, h = (x[use] for x in (n, first, last, at, h))
                digest = np.fromiter(
                    (xxhash.xxh3_64_intdigest(texts[i][a:b + window], p - a) for i, a, b, p in zip(
                        n.tolist(), first.tolist(), last.tolist(), at.tolist())), np.uint64, len(n))
                yield _rows(h, digest, k1[n], k2[n], first, last, at)

    places = materialise(keyed.mapInArrow(suspected, ROW), "repeat-segments")
    intervals = []
    for width in (None, *PIECES):
        found, crowded = _level(places, keyed, window, anchor, group_rows, width)
        intervals += found
        if crowded is None:
            break
        places = crowded
    every = intervals[0]
    for more in intervals[1:]:
        every = every.unionByName(more)
    # bounded by the row's own windows
    removed = materialise(every.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("_parts")), "repeat-removals")

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<start:bigint,stop:bigint>>,kept:binary>")
    def without(texts: pa.Array, parts: pa.Array) -> pa.Array:
        at = 0
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def part(values: pa.Array) -> pa.Array:
            nonlocal at
            rows = []
            for value, gone in zip(values.to_pylist(), parts.slice(at, len(values)).to_pylist()):
                value, spans = value or b"", merged(gone or [])
                edges = [0, *(e for s in spans for e in s), len(value)]
                kept = b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(value), len(value) - len(kept), [{"start": a, "stop": b} for a, b in spans], kept))
            at += len(values)
            return pa.StructArray.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), kind, pa.binary()))],
                names=["n_bytes", "n_removed", "spans", "kept"])

        return by_slices(texts.cast(pa.binary()), part)

    k1, k2, r1, r2, parts, cut = unused(docs, "_k1", "_k2", "_r1", "_r2", "_parts", "_cut")
    removed = removed.select(F.col("k1").alias(r1), F.col("k2").alias(r2), F.col("_parts").alias(parts))
    joined = docs.withColumns(dict(zip((k1, k2), _keys_of(id, text)))).join(
        removed, (F.col(k1) == F.col(r1)) & (F.col(k2) == F.col(r2)), "left")
    result = joined.withColumn(cut, without(F.col(text), F.col(parts))).drop(k1, k2, r1, r2, parts)
    return result.withColumns({
        "n_bytes": F.col(cut)["n_bytes"], "n_removed": F.col(cut)["n_removed"],
        "n_spans": F.size(F.col(cut)["spans"]).cast("long"), "spans": F.col(cut)["spans"], "kept_bytes": F.col(cut)["kept"],
    }).drop(cut)


def merged(parts: list[dict]) -> list[tuple[int, int]]:
    """Maximal spans of ranges that overlap or touch."""
    spans: list[tuple[int, int]] = []
    for p in sorted(parts, key=lambda p: p["start"]):
        if spans and p["start"] <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], p["stop"])
        else:
            spans.append((p["start"], p["stop"]))
    return spans


def _level(places: DataFrame, keyed: DataFrame, window: int, anchor: int, group_rows: int,
           width: int | None) -> tuple[list[DataFrame], DataFrame | None]:
    """Intervals of repeated windows among ``places``, and the pieces of crowded anchors
    for the next level (None without any)."""
    kinds = places.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first", "last", "at")).alias("one"))
    kinds = materialise(kinds, "repeat-kinds")
    equal = materialise(kinds.filter("n > 1").select("anchor", "digest"), "repeat-equal")
    result = [places.join(equal, ["anchor", "digest"]).select(
        "k1", "k2", F.col("first").alias("start"), (F.col("last") + window).alias("stop"))]
    if width == 1:
        return result, None
    groups = materialise(kinds.groupBy("anchor").agg(F.count("digest").alias("kinds")).filter("kinds > 1"), "repeat-groups")
    most = groups.agg(F.max("kinds")).first()[0] or 0
    if most == 0:
        return result, None
    per_row = kinds.join(groups, "anchor").select("anchor", "digest", "kinds", "one.*").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("anchor", "digest", "kinds", "first", "last", "at")).alias("parts"))
    # the row's own segments beside its text
    wanted = keyed.join(materialise(per_row, "repeat-wanted"), ["k1", "k2"]).select("k1", "k2", "text", "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "k1", "k2", "low", "first", "bytes"]
        kinds_ = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            for row in range(batch.num_rows):
                k1, k2, text, parts = (batch.column(c)[row].as_py() for c in range(4))
                text = text.encode()
                rows = [(p["anchor"], p["digest"], k1, k2, p["first"] - p["at"], p["first"],
                         text[p["first"]:p["last"] + window]) for p in parts if p["kinds"] <= group_rows]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds_)], names=names)

    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows):
            group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
            low = np.array([r[4] for r in rows])
            row, start, stop = _runs(repeated_windows(group, low, [r[6] for r in rows], window, anchor))
            shift = np.array([r[5] - r[4] for r in rows])[row] - (window - anchor)
            k1, k2 = (np.array([r[c] for r in rows], np.int64)[row] for c in (2, 3))
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (k1, k2, start + shift, stop + shift + window)], names=["k1", "k2", "start", "stop"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] == held[-1][:2]:
                    continue  # the same segment of a row that occurs more than once
                if len(held) >= ROWS_AT_ONCE and row[0] != held[-1][0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    ordered = wanted.mapInArrow(
        cut, "anchor long, digest long, k1 long, k2 long, low long, first long, bytes binary").repartition(
        "anchor").sortWithinPartitions("anchor", "digest")
    result.append(materialise(ordered.mapInArrow(construct, "k1 long, k2 long, start long, stop long"), "repeat-windows"))
    if most <= group_rows:
        return result, None
    narrow = next((w for w in PIECES if width is None or w < width))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k1, k2, text, parts = (batch.column(c)[row].as_py() for c in range(4))
                text = text.encode()
                rows = []
                for p in parts:
                    if p["kinds"] <= group_rows:
                        continue
                    start = p["first"]
                    while start <= p["last"]:
                        piece = (start - p["at"]) // narrow  # windows of a piece begin in the same columns
                        stop = min(p["last"], p["at"] + (piece + 1) * narrow - 1)
                        core = text[p["at"] + (piece + 1) * narrow - 1: p["at"] + piece * narrow + window]
                        key = xxhash.xxh3_64_intdigest(core, (p["anchor"] ^ piece) & ((1 << 64) - 1))
                        digest = xxhash.xxh3_64_intdigest(text[start:stop + window], start - p["at"] & ((1 << 64) - 1))
                        rows.append((key, digest, start, stop, p["at"]))
                        start = stop + 1
                if rows:
                    key, digest, first, last, at = (np.array(c, np.uint64 if i < 2 else np.int64) for i, c in enumerate(zip(*rows)))
                    yield _rows(key, digest, np.full(len(rows), k1), np.full(len(rows), k2), first, last, at)

    return result, materialise(wanted.mapInArrow(split, ROW), "repeat-pieces")
