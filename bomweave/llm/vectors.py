"""Near-duplicate vectors by product quantisation with an exact cosine rerank.

Vectors are dealt to coarse lists by nearest centroid and stored as codes of their
residual, one byte per subspace, in blocks of consecutive lists. Any two blocks meet in
one task, straight from the written table: blocks are never copied, so disk and shuffle
follow the input whatever the number of pairs. Between two lists, the components of two
linked vectors along the line of the centroids differ by at most the length of the
longest link, which leaves out most pairs and no link. The others are compared by
approximate products with the looked-up codewords. The known reconstruction error of a
code bounds the true product from above, so no link is missed there either; what passes
is reranked with the exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise, scratch
from ..operators.skew import salted_join
from .common import broadcast, session_for_texts
from .components import components

LIST_ROWS = 512  # mean vectors in a list
MAX_LISTS = 8_192
FIT_ROWS = 16_384  # sample for centroids and codewords
SUBSPACE = 8  # components coded by one byte
CODEWORDS = 256
SLACK = 1e-4  # for rounding in single precision
BLOCK_ROWS = 8_192
BLOCK_BYTES = 1 << 22  # components in a block
KEPT_BLOCKS = 8  # unpacked blocks that a task holds
ROWS_AT_ONCE = 1_024
STRIP = 128  # rows of a list compared at once
DENSE = 16  # from one candidate in so many pairs on, all cosines of a strip are taken
PAIRS_AT_ONCE = 1 << 16
HELD_PAIRS = 1 << 20
INDEX = "id long, home int, x binary, codes binary, own float, error float"
BLOCK = "block long, id binary, home binary, x binary, codes binary, own binary, error binary"


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (centres * centres).sum(1)
    parts = [(squares - 2 * x[k:k + ROWS_AT_ONCE] @ centres.T).argmin(1) for k in range(0, len(x), ROWS_AT_ONCE)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres of Lloyd's iterations from evenly spaced rows; empty ones stay put."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[filled])[:-1]]))
        centres[filled] = sums / count[filled, None]
    return centres


@dataclass(frozen=True)
class Codebooks:
    """Coarse centroids and the codewords of each subspace."""

    centroids: np.ndarray
    words: np.ndarray  # subspace, codeword, component

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> "Codebooks":
        centroids = _k_means(sample, lists, 10)
        rest = sample - centroids[_nearest(sample, centroids)]
        parts = rest[: FIT_ROWS // 2].reshape(-1, rest.shape[1] // SUBSPACE, SUBSPACE)
        words = [_k_means(np.ascontiguousarray(parts[:, m]), CODEWORDS, 6) for m in range(parts.shape[1])]
        return Codebooks(centroids, np.stack(words))

    def encode(self, x: np.ndarray):
        """List, codes, own product with the error, and length of the error."""
        x = x.astype(np.float32)
        own = _nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = np.stack([_nearest(rest[:, m * SUBSPACE:(m + 1) * SUBSPACE], w) for m, w in enumerate(self.words)], 1)
        error = rest - self.decoded(codes)
        return own, codes.astype(np.uint8), (x * error).sum(1), np.sqrt((error ** 2).sum(1))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[m][codes[:, m]] for m in range(len(self.words))], 1)


@dataclass(frozen=True)
class Block:
    """Vectors in the order of their lists, ready to be compared."""

    id: np.ndarray
    x: np.ndarray  # unit vectors in double precision
    lists: np.ndarray
    starts: np.ndarray  # of the lists, and the end
    probing: np.ndarray  # unit vectors, and 1
    stored: np.ndarray  # decoded vectors, and by how much the product of a link may exceed theirs
    level: np.ndarray  # product with the centroid of the own list

    @staticmethod
    def of(books: Codebooks, reach: float, id, home, x, codes, own, error) -> "Block":
        lists, starts = np.unique(home, return_index=True)
        centres, single = books.centroids[home], x.astype(np.float32)
        return Block(
            id, x, lists, np.append(starts, len(id)), np.column_stack([single, np.ones(len(id), np.float32)]),
            np.column_stack([centres + books.decoded(codes), own + np.float32(reach) * error]), (single * centres).sum(1))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither vanish nor overflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _reach(least: float) -> float:
    """Length of the longest link between unit vectors."""
    return float(np.sqrt(max(0.0, 2 - 2 * least)))


def _candidates(books: Codebooks, a: Block, b: Block, least: float):
    """Rows of ``a``, rows of ``b`` and the places in their table that hold the candidates.
    Of the pairs inside one block, one order is enough."""
    here, there = books.centroids[a.lists].astype(np.float64), books.centroids[b.lists].astype(np.float64)
    squares = (here * here).sum(1)[:, None] + (there * there).sum(1) - 2 * here @ there.T
    limits = _reach(least) * np.sqrt(np.maximum(squares, 0)) + SLACK
    # x (c - d) and y (d - c) for a list's own centroid c and the other's d; of a link they add up to the limit at most
    lean_a = a.level[:, None] - a.probing[:, :-1] @ books.centroids[b.lists].T
    lean_b = b.level[:, None] - b.probing[:, :-1] @ books.centroids[a.lists].T
    lowest = np.minimum.reduceat(lean_a, a.starts[:-1]) + np.minimum.reduceat(lean_b, b.starts[:-1]).T
    for i, j in zip(*np.nonzero(lowest <= limits)):
        if a is b and i > j:
            continue
        (left, first), (right, second) = (_ascending(lean_a[:, j], a.starts[i:]), _ascending(lean_b[:, i], b.starts[j:]))
        most = np.searchsorted(second, limits[i, j] - first, "right")
        stored = b.stored[right[: most[0]]]
        for k in range(0, len(left), STRIP):
            if most[k] == 0:
                break
            rows = left[k:k + STRIP]
            bound = a.probing[rows] @ stored[: most[k]].T
            at = np.flatnonzero(bound >= least - SLACK)
            if len(at):
                yield rows, right[: most[k]], at


def _ascending(lean: np.ndarray, starts: np.ndarray):
    """The rows of a list by ``lean``, and their values."""
    lean = lean[starts[0]:starts[1]]
    order = np.argsort(lean)
    return starts[0] + order, lean[order]


def _linked(books: Codebooks, a: Block, b: Block, least: float):
    """Pairs of rows of two blocks with a cosine of at least ``least``."""
    for rows, columns, at in _candidates(books, a, b, least):
        i, j = np.divmod(at, len(columns))
        if a is b:
            # pairs of different lists come once, those of one list in either order
            once = (rows[i] < columns[j]) | (np.searchsorted(a.starts, rows[0], "right") != np.searchsorted(a.starts, columns[0], "right"))
            i, j = i[once], j[once]
        p, q = rows[i], columns[j]
        if len(p) * DENSE > len(rows) * len(columns):
            cosine = (a.x[rows] @ b.x[columns].T)[i, j]
            close = np.flatnonzero(np.abs(cosine - least) < 1e-9)
        else:
            cosine, close = np.zeros(len(p)), np.arange(len(p))
        for k in range(0, len(close), PAIRS_AT_ONCE):
            part = close[k:k + PAIRS_AT_ONCE]
            cosine[part] = np.einsum("ij,ij->i", a.x[p[part]], b.x[q[part]])
        good = cosine >= least
        yield p[good], q[good]


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Links:
    """Links of each vector and components of all blocks that a task meets."""

    def __init__(self) -> None:
        self.first: dict[int, int] = {}  # node of each block's first row
        self.ids, self.count, self.label = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def nodes(self, block: int, ids: np.ndarray) -> int:
        if block not in self.first:
            self.first[block] = n = len(self.ids)
            self.ids, self.count = np.append(self.ids, ids), np.append(self.count, np.zeros(len(ids), np.int64))
            self.label = np.append(self.label, np.arange(n, n + len(ids)))
        return self.first[block]

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.held.append((p, q))
        self.waiting += len(p)
        if self.waiting >= HELD_PAIRS:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            p, q = (np.concatenate([pair[k] for pair in self.held]) for k in (0, 1))
            self.count += np.bincount(p, minlength=len(self.ids)) + np.bincount(q, minlength=len(self.ids))
            u, v = self.label[p], self.label[q]
            new = u != v
            if new.any():
                self.label = _lowest(len(self.ids), u[new], v[new])[self.label]
        self.held, self.waiting = [], 0

    def rows(self) -> pa.RecordBatch:
        """(id, n, low) of the vectors with links, ``low`` being the smallest id they reach."""
        self.settle()
        low = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(low, self.label, self.ids)
        some = np.flatnonzero(self.count)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[some], self.count[some], low[self.label[some]])],
                                          names=["id", "n", "low"])


def near_vectors(vectors: DataFrame, least: float = 0.9, id: str = "vec_id", vector: str = "embedding",
                 list_rows: int = LIST_ROWS, fit_rows: int = FIT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    Links are pairs of vectors with a cosine of at least ``least`` (over 0); ``n_links`` counts a
    vector's links, ``component_id`` is the smallest id it reaches, ``kept`` marks vectors with
    that id. Vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing. Shorter vectors count as filled up with zeros. Vectors with the same id
    are told apart by their row; rows without an id are left out.

    Centroids and codewords are fitted on about ``fit_rows`` rows; every row is
    indexed. Any two blocks of at most ``block_rows`` rows meet once, so no link is missed; how many
    of their pairs are compared follows from ``least`` and from how the vectors cluster.
    The blocks are read anew for each meeting, so that only work grows with the pairs, not
    disk. A task returns counts and local components, not pairs.
    """
    spark = session_for_texts(vectors)
    # components travel as wide as they came
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    with scratch(spark):
        with scratch(spark):
            with scratch(spark):
                # rows are numbered once, in a written table; from here on ``id`` is a row's number
                named = materialise(vectors.filter(F.col(id).isNotNull()).select(
                    F.monotonically_increasing_id().alias("id"), F.col(id).cast("long").alias("name"),
                    (F.col(vector) if single else F.transform(F.col(vector), lambda v: v.cast("double"))).alias("v")), "named-vectors")
                names = materialise(named.select("id", "name"), "vector-names", keep=3)
                usable = named.select("id", "v").filter((F.size("v") > 0) & F.forall(
                    "v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("v", lambda v: v != 0))
                n, width = usable.agg(F.count("id"), F.max(F.size("v"))).first()
                if not n:
                    return names.select(F.col("name").alias(id), F.lit(0).cast("long").alias("n_links"),
                                        F.col("name").alias("component_id"), F.lit(True).alias("kept"))
                shape = Shape(-(-width // SUBSPACE) * SUBSPACE, np.float32 if single else np.float64)
                books = _fitted(usable, n, shape, list_rows, fit_rows)
                index = _index(usable, books, shape)
            blocks = _blocks(index, shape, block_rows)
        found = _found(blocks, books, shape, least)
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    reached = components(found.select("id", "low"), "id", "low").withColumnRenamed("component_id", "group")
    rows = names.join(counts, "id", "left").join(reached, "id", "left")
    rows = materialise(rows.withColumn("group", F.coalesce("group", "id")), "vector-groups")
    lowest = rows.groupBy("group").agg(F.min("name").alias("component_id"))
    return salted_join(rows, lowest, ["group"], ["id"], how="inner").select(
        F.col("name").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id",
        (F.col("component_id") == F.col("name")).alias("kept"))


@dataclass(frozen=True)
class Shape:
    """Width that all vectors are filled up to, and the type they are stored as."""

    width: int
    kind: type

    def matrix(self, column: pa.Array) -> np.ndarray:
        x = np.zeros((len(column), self.width), self.kind)
        x[np.arange(self.width) < pc.list_value_length(column).to_numpy()[:, None]] = column.flatten().to_numpy()
        return x

    def units(self, x: np.ndarray) -> np.ndarray:
        return _unit(x.astype(np.float64)) if len(x) else x.astype(np.float64)


def _fitted(usable: DataFrame, n: int, shape: Shape, list_rows: int, fit_rows: int):
    """Centroids and codewords for all tasks."""
    sample = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, fit_rows / n) * (1 << 30)))
    x = shape.units(shape.matrix(sample.orderBy("id").toArrow().column("v").combine_chunks()))
    lists = min(MAX_LISTS, max(1, len(x) // 8), -(-n // list_rows))
    return broadcast(usable.sparkSession, Codebooks.fit((x if len(x) else np.eye(1, shape.width)).astype(np.float32), lists))


def _index(usable: DataFrame, books, shape: Shape) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                x = shape.matrix(part.column("v"))
                home, codes, own, error = books.value.encode(shape.units(x))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(home, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own, pa.float32()), pa.array(error, pa.float32()),
                ], names=["id", "home", "x", "codes", "own", "error"])

    return materialise(usable.mapInArrow(encode, INDEX), "vector-index", keep=1)


def _blocks(index: DataFrame, shape: Shape, block_rows: int) -> DataFrame:
    """The index, in rows of up to ``block_rows`` vectors of consecutive lists."""
    size = max(1, min(block_rows, BLOCK_BYTES // (shape.width * np.dtype(shape.kind).itemsize)))

    def packed(rows: pa.Table) -> pa.RecordBatch:
        parts = [b"".join(c.to_pylist()) if pa.types.is_binary(c.type) else c.to_numpy().tobytes() for c in rows.columns]
        return pa.RecordBatch.from_arrays([rows.column("id").slice(0, 1).combine_chunks(), *(pa.array([p], pa.binary()) for p in parts)],
                                          names=["block", *rows.column_names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rows = new if rows is None else pa.concat_tables([rows, new])
            while rows.num_rows >= size:
                yield packed(rows.slice(0, size))
                rows = rows.slice(size)
        if rows is not None and rows.num_rows:
            yield packed(rows)

    # ranges by list and row, so that a crowded list is cut as well
    dealt = index.repartitionByRange("home", "id").sortWithinPartitions("home", "id")
    return materialise(dealt.mapInArrow(pack, BLOCK), "vector-blocks", keep=1)


def _found(blocks: DataFrame, books, shape: Shape, least: float) -> DataFrame:
    """(id, n, low) of the linked vectors of each two blocks, in a written table."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Block] = {}

        def block(batch: pa.RecordBatch, row: int, side: str) -> Block:
            key = batch.column(f"{side}_block")[row].as_py()
            if key not in kept:
                if len(kept) == KEPT_BLOCKS:
                    kept.pop(next(iter(kept)))
                read = lambda name, kind: np.frombuffer(batch.column(f"{side}_{name}")[row].as_buffer(), kind)
                x = shape.units(read("x", shape.kind).reshape(-1, shape.width))
                kept[key] = Block.of(books.value, _reach(least), read("id", np.int64).copy(), read("home", np.int32), x,
                                     read("codes", np.uint8).reshape(len(x), -1), read("own", np.float32), read("error", np.float32))
            return kept[key]

        links = Links()
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = block(batch, row, "a"), block(batch, row, "b")
                at, beside = (links.nodes(batch.column(f"{side}_block")[row].as_py(), x.id) for side, x in (("a", a), ("b", b)))
                for p, q in _linked(books.value, a, b, least):
                    links.add(at + p, beside + q)
        yield links.rows()

    a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    # each two blocks in one order, which is either one for half of them: tasks get about the same
    even = (F.col("a_block") + F.col("b_block")) % 2 == 0
    pairs = a.crossJoin(b).filter((F.col("a_block") == F.col("b_block")) | ((F.col("a_block") < F.col("b_block")) == even))
    return materialise(pairs.mapInArrow(compare, "id long, n long, low long"), "vector-links", keep=1)
