"""Near-duplicate documents with SetSketch registers.

*Sketch.* A document is its set of word shingles. Register i holds the truncated
exponent of the least of the set's exponentially distributed hashes, so registers of
a union are the larger of the registers of its parts, and equal registers are likely
between similar sets.

*Candidates.* Bands of register values are keys. Two Bloom filters drop keys seen once;
what remains is grouped by key. Equal sets are one node from the start. Instead of all
pairs under a key, only its least node is tested against the others. Keys whose nodes
are then still in different components are settled exactly: their nodes are compared
block by block inside tasks, which return one link per pair of components. No link
that could join components stays untested, and no table of pairs arises.

*Test.* The likelihood of the register comparisons gives an estimate of the
similarity; pairs that are far below the threshold go. The rest is confirmed on the
full sets, taken from the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import broadcast, session_for_texts, slices, unused
from .components import components
from .filters import FILTER_BITS, maybe, seen_twice

BAND_ROWS = 6
BANDS = 40
REGISTERS = BAND_ROWS * BANDS
BASE = 1.001  # ratio of neighbouring register values
RATE = 20.0  # of the exponential distribution
LARGEST = (1 << 16) - 1
ESTIMATE_SLACK = 0.15  # over five and a half standard deviations of the estimate
MOST_BROADCAST_ROWS = 1_000_000
PROBE_BLOCK, TARGET_BLOCK = 128, 1_024
AT_ONCE = 1 << 11

_seeds: list[np.ndarray] = []


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _seeds:
        rng = np.random.default_rng(11)
        _seeds.append(rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32))
        _seeds.append(rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
        _seeds.append(rng.integers(0, 1 << 63, 256, dtype=np.uint64))
    return _seeds[0], _seeds[1], _seeds[2]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles of so many words. A-Z count
    as a-z; words are runs without ASCII white space. A text with fewer words has the
    whole sequence as its one shingle, a text without words has none."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    inside = inside[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    size = stops - starts
    # polynomial hash of each word
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    letters = np.flatnonzero(inside)
    values = _constants()[2][data[letters]] * power[letters - np.repeat(starts, size)]
    word = _mixed(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1]])
    chained = word.copy()
    for k in range(1, words):
        chained = _mixed(chained[: len(word) - k] * np.uint64(0xD6E8FEB86659FD93) + word[k:]) if len(word) > k else chained[:0]
    result = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= words:
            result.append(np.unique(chained[a:b - words + 1]))
        elif b > a:
            whole = word[a:a + 1]
            for k in range(a + 1, b):
                whole = _mixed(whole * np.uint64(0xD6E8FEB86659FD93) + word[k:k + 1])
            result.append(whole ^ np.uint64(b - a))
        else:
            result.append(word[:0])
    return result


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a set of hashes."""
    add, factor, _ = _constants()
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(REGISTERS, LARGEST << 16 | LARGEST, np.uint32)
    for start in range(0, len(low), AT_ONCE):
        h = (low[start:start + AT_ONCE, None] + add) * factor
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(14)
        np.minimum(least, h.min(0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarities of pairs of sketches (rows) that are most likely, given the set
    sizes: bisection on the derivative of the concave log-likelihood."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    scale = (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-x * scale) / np.log(BASE)

    def slope(x):
        return 1 / (1 - x * scale) * scale / np.log(BASE)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        up, down = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        same = np.maximum(1 - chance(up) - chance(down), 1e-12)
        rise = -above * v * slope(up) / chance(up) - below * u * slope(down) / chance(down)
        rise += equal * (v * slope(up) + u * slope(down)) / same
        low, high = np.where(rise > 0, j, low), np.where(rise > 0, high, j)
    return (low + high) / 2


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(sketch, band) keys of 64 bits."""
    bands = sketches.reshape(len(sketches), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None] + np.uint64(1)
    for k in range(BAND_ROWS):
        key = _mixed(key * np.uint64(0xD6E8FEB86659FD93) + bands[:, :, k])
    return key


def _filter_keys(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys, _mixed(keys + np.uint64(1))], 1)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _node(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text",
                    filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    Documents whose sets of ``words``-word shingles have 100 * intersection >= percent *
    union are linked; ``component_id`` is the smallest id that is reached, itself
    included, and ``kept`` marks rows whose own id that is. A null text, or one without
    words, has an empty set and is linked with nothing. Rows with equal sets always
    share a component, also rows with the same id; rows without an id are linked with
    nothing, have a null component, and are kept. Links at the threshold are missed
    with a probability of (1 - 0.8^6)^40, 5 in a million; closer ones hardly ever.
    """
    return _labelled(docs, words, percent, id, text, filter_bits).select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text",
                         filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns. Rows with
    equal id and text are one document and stay or go together."""
    kept = _labelled(docs, words, percent, id, text, filter_bits).filter("kept").select("k1", "k2")
    k1, k2, n1, n2 = unused(docs, "_k1", "_k2", "_n1", "_n2")
    keyed = docs.withColumns(dict(zip((k1, k2), _row_keys(id, text))))
    kept = kept.select(F.col("k1").alias(n1), F.col("k2").alias(n2))
    return keyed.join(kept, (F.col(k1) == F.col(n1)) & (F.col(k2) == F.col(n2)), "left_semi").drop(k1, k2)


def _row_keys(id: str, text: str) -> list[Column]:
    """Two hashes that stand for a row's id and text."""
    return [F.xxhash64(F.col(id), F.col(text)), F.xxhash64(F.lit("row"), F.col(text), F.col(id))]


def _labelled(docs: DataFrame, words: int, percent: int, id: str, text: str, filter_bits: int) -> DataFrame:
    """(id, k1, k2, n, component_id, kept) of every row."""
    session_for_texts(docs)
    k1, k2 = _row_keys(id, text)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).cast(pa.binary()), 0
            for part in slices(texts):
                sets = shingle_sets([t or b"" for t in part.to_pylist()], words)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(at, len(part)) for c in (0, 2, 3)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["id", "k1", "k2", "n", "node", "sketch"])
                at += len(part)

    sketched = materialise(rows.mapInArrow(
        sketch, "id long, k1 long, k2 long, n long, node binary, sketch binary"), "near-sketches")
    nodes = materialise(sketched.filter("id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("low"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "near-nodes")
    shared = _shared_keys(nodes, filter_bits)
    involved = materialise(nodes.join(shared.select("node").distinct(), "node"), "near-involved")
    links = _links(shared, involved, _texts(rows.select("id", "text"), involved, words), words, percent)
    reached = components(links, "a", "b").withColumnRenamed("id", "node").withColumnRenamed("component_id", "label")
    reached = nodes.select("node", "low").join(reached, "node")
    lowest = reached.groupBy("label").agg(F.min("low").alias("component_id"))
    joined = materialise(reached.join(materialise(lowest, "near-lowest"), "label").select("node", "component_id"), "near-components")
    alone = materialise(nodes.select("node", "low"), "near-lows")
    result = sketched.drop("sketch").join(alone, "node", "left").join(joined, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "low", "id"))
    return result.select("id", "k1", "k2", "n", component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _shared_keys(nodes: DataFrame, filter_bits: int) -> DataFrame:
    """(key, node) of band keys that at least two nodes have."""
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        if batch.num_rows:
            yield _filter_keys(band_keys(_sketches(batch.column(0))).ravel())

    twice = broadcast(nodes.sparkSession, seen_twice(nodes.select("sketch"), keys_of, filter_bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_sketches(batch.column(1)))
                row, band = np.nonzero(maybe(twice.value, _filter_keys(keys.ravel())).reshape(keys.shape))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row, band].view(np.int64)), batch.column(0).take(pa.array(row))], names=["key", "node"])

    found = materialise(nodes.select("node", "sketch").mapInArrow(suspected, "key long, node binary"), "near-suspects")
    common = materialise(found.groupBy("key").agg(F.count("node").alias("n")).filter("n > 1").select("key"), "near-common")
    return materialise(found.join(common, "key"), "near-keys")


def _texts(rows: DataFrame, involved: DataFrame, words: int) -> DataFrame:
    """(node, text) of the nodes that share a key."""
    wanted = involved.select(F.col("low").alias("id"), "node")
    if wanted.count() <= MOST_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an id may come with several texts
        for batch in batches:
            texts, at = batch.column(1).cast(pa.binary()), 0
            for part in slices(texts):
                sets = shingle_sets([t or b"" for t in part.to_pylist()], words)
                names = batch.column(0).slice(at, len(part)).to_pylist()
                good = pa.array([_node(s) == name for s, name in zip(sets, names)], pa.bool_())
                yield batch.slice(at, len(part)).filter(good)
                at += len(part)

    return materialise(rows.join(wanted, "id").select("node", "text").mapInArrow(own, "node binary, text string"), "near-texts")


def _labelled_keys(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """(key, node, label, lowest) of keys whose nodes are in different components."""
    rows = shared.withColumn("label", F.col("node")) if label is None else shared.join(label, "node", "left").select(
        "key", "node", F.coalesce("_label", "node").alias("label"))
    rows = materialise(rows, "near-labelled") if label is not None else rows
    keys = rows.groupBy("key").agg(F.min("label").alias("lowest"), F.max("label").alias("highest")).filter(
        "lowest <> highest").select("key", "lowest")
    return materialise(rows.join(materialise(keys, "near-open"), "key"), "near-left")


def _links(shared: DataFrame, involved: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the same components as all links would."""
    open_keys = _labelled_keys(shared, None)
    hub = materialise(open_keys.groupBy("key").agg(F.min("node").alias("hub")), "near-hubs")
    pairs = open_keys.join(hub, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    found = _confirmed(materialise(pairs, "near-pairs"), involved, texts, words, percent)
    label = materialise(components(found, "a", "b").select(
        F.col("id").alias("node"), F.col("component_id").alias("_label")), "near-labels")
    return found.unionByName(_between(_labelled_keys(shared, label), involved, texts, words, percent))


def _between(left: DataFrame, involved: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components that share a key, at least one per pair of components
    that has any. The nodes of all keys with the same lowest label form a group; nodes
    of other labels are probes in it. Groups are cut into blocks of probes and targets."""
    group = materialise(left.select(F.col("lowest").alias("owner"), "node", "label").distinct(), "near-groups")
    probe = F.col("label") != F.col("owner")
    sizes = materialise(group.groupBy("owner").agg(
        F.ceil(F.sum(probe.cast("int")) / PROBE_BLOCK).cast("int").alias("probes"),
        F.ceil(F.count("node") / TARGET_BLOCK).cast("int").alias("targets")), "near-group-sizes")
    if sizes.count() <= MOST_BROADCAST_ROWS:
        sizes = F.broadcast(sizes)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        placed = rows.join(sizes, "owner").withColumn(f"_{own}", F.pmod(F.xxhash64("node"), F.col(own)).cast("int")).withColumn(
            f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        full = placed.join(involved.select("node", "n", "sketch"), "node").join(texts, "node")
        return full.select(*[F.col(c).alias(c) for c in ("owner", "_probes", "_targets", "node", "label", "n", "sketch", "text")])

    def test(probes: pa.Table, targets: pa.Table) -> pa.Table:
        links: dict[tuple, tuple] = {}
        if probes.num_rows and targets.num_rows:
            sides = [(t.column("node").to_pylist(), t.column("label").to_pylist(), t.column("n").to_numpy().astype(float),
                      _sketches(t.column("sketch"))) for t in (probes, targets)]
            sets = [shingle_sets([x.encode() for x in t.column("text").to_pylist()], words) for t in (probes, targets)]
            (node, label, size, sketch), (nodes, labels, sizes_, sketches) = sides
            labels = np.array(labels, object)
            for i in range(len(node)):
                at = np.flatnonzero((labels != label[i]) & (100 * np.minimum(size[i], sizes_) >= percent * np.maximum(size[i], sizes_)))
                equal = (sketches[at] == sketch[i]).mean(1) if len(at) else np.zeros(0)
                at = at[equal >= percent / 100 - ESTIMATE_SLACK - 0.05]
                guess = estimate(np.broadcast_to(sketch[i], (len(at), REGISTERS)), sketches[at], np.full(len(at), size[i]), sizes_[at])
                for j in at[guess >= percent / 100 - ESTIMATE_SLACK]:
                    pair = (label[i], labels[j])
                    if pair not in links and _linked(sets[0][i], sets[1][j], percent):
                        links[pair] = (node[i], nodes[j])
        rows = list(links.values())
        return pa.table({"a": pa.array([min(r) for r in rows], pa.binary()), "b": pa.array([max(r) for r in rows], pa.binary())})

    keys = ["owner", "_probes", "_targets"]
    found = dealt(group.filter(probe), "probes", "targets").groupBy(*keys).cogroup(
        dealt(group, "targets", "probes").groupBy(*keys)).applyInArrow(test, "a binary, b binary")
    return materialise(found, "near-between")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, involved: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are links: by estimate first, then on the full sets."""
    def side(name: str) -> DataFrame:
        return involved.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(c).to_numpy().astype(float) for c in (2, 3)]
                guess = estimate(_sketches(batch.column(4)), _sketches(batch.column(5)), *sizes)
                good = (guess >= percent / 100 - ESTIMATE_SLACK) & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(
        likely, "a binary, b binary")
    close = materialise(close, "near-likely")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                first, second = (shingle_sets([t.encode() for t in part.column(c).to_pylist()], words) for c in (2, 3))
                good = [_linked(x, y, percent) for x, y in zip(first, second)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = close.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")
    return materialise(joined.select("a", "b", "t_a", "t_b").mapInArrow(exact, "a binary, b binary"), "near-found")
