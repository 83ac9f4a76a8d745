"""Components against a plain version; vector links against brute force."""

import os
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest

from bomweave.functions import storage
from bomweave.llm import vectors
from bomweave.llm.components import components


def plain_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b]
    pairs += [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4900, 5100) if i != 5000]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == plain_components(pairs)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def plain(rows, least):
    """Rows (id, links, component, kept), one per vector with an id."""
    named = [(i, v) for i, v, *_ in rows if i is not None]
    usable = [n for n, (_, v) in enumerate(named) if v and None not in v and np.isfinite(v).all() and any(v)]
    width = max(len(named[n][1]) for n in usable)
    x = np.array([named[n][1] + [0.0] * (width - len(named[n][1])) for n in usable])
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    pairs = [(usable[i], usable[j]) for i, j in zip(a, b)]
    root, links = plain_components(pairs), [0] * len(named)
    for p in pairs:
        for n in p:
            links[n] += 1
    low = {}
    for n, (i, _) in enumerate(named):
        low[root.get(n, n)] = min(i, low.get(root.get(n, n), i))
    return sorted((i, links[n], low[root.get(n, n)], low[root.get(n, n)] == i) for n, (i, _) in enumerate(named))


def found(df, **options):
    return sorted(tuple(r) for r in vectors.near_vectors(df, **options).collect())


def rows_of(n=1500, width=20, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for i in range(0, n // 2, 3):
        x[i + n // 2] = x[i % 40] * 3 + rng.normal(0, 0.12, width)
    return [(int(i), [float(v) for v in row], "x") for i, row in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("list_rows,block_rows", [(64, 1024), (200, 50), (5000, 70)])
def test_links(spark, list_rows, block_rows):
    rows = rows_of() + [
        (9001, None, ""), (9002, [], ""), (9003, [0.0] * 20, ""), (9004, [None] * 20, ""), (9005, [float("nan")] * 20, ""),
        (None, [1.0] * 20, ""), (9006, [1e-200] * 20, ""), (9007, [1e200] * 20, ""), (9008, [3.0], ""), (9009, [7.0], "")]
    rows += rows[:2] + [(rows[0][0], rows[1][1], ""), (rows[2][0], [-v for v in rows[2][1]], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got, want = found(df, list_rows=list_rows, block_rows=block_rows), plain(rows, 0.9)
    assert got == want and sum(r[1] for r in want) > 1000


def test_other_vector_under_the_same_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == [
        (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], kind)).collect() == []
    got = vectors.near_vectors(spark.createDataFrame([(2, None), (1, [1.0, 0.0])], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]
    got = vectors.near_vectors(spark.createDataFrame([(2, [1.0, 0.1]), (1, [1.0, 0.0])], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_every_link_across_lists(spark):
    """On a subspace of 4 dimensions many links cross the border between two lists."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 24))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df, list_rows=50) == plain(rows, 0.9)


def test_disk_follows_the_vectors(spark):
    """Vectors without clusters: every list is near every other, and none is copied to the others."""
    x = np.random.default_rng(5).normal(size=(6000, 64))
    x[5000:] = x[:1000] + np.random.default_rng(6).normal(0, 0.1, (1000, 64))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    folders = [spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), *local]
    seen, over = [], threading.Event()

    def size(path):
        try:
            return os.lstat(path).st_size
        except FileNotFoundError:  # gone meanwhile
            return 0

    def watch():
        while not over.wait(0.05):
            seen.append(sum(size(f"{d}/{x}") for f in folders for d, _, names in os.walk(f) for x in names))

    with ThreadPoolExecutor() as pool:
        pool.submit(watch)
        try:
            got = found(df, list_rows=50)
        finally:
            over.set()
    assert max(seen) - seen[0] < 8 * x.size * 4  # shuffle files and tables together; 14 with copies
    assert got == plain(rows, 0.9) and sum(r[1] for r in got) >= 2000


@pytest.mark.parametrize("block_rows", [100, 8192])
def test_a_crowd(spark, block_rows):
    """A third of the vectors links with each other, in lists and blocks of its own and across them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16))
    x[::3] = x[0] + rng.normal(0, 0.2, (300, 16))
    x[3:60:3] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, list_rows=40, block_rows=block_rows)
    assert got == plain(rows, 0.9) and max(r[1] for r in got) > 200


def test_kept_tables_outlive_their_block(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    with storage.scratch(spark):
        with storage.scratch(spark):
            storage.materialise(spark.range(3), "scratch-inner")
            kept = storage.materialise(spark.range(4), "scratch-kept", keep=1)
            stays = storage.materialise(spark.range(5), "scratch-stays", keep=2)
        assert not list(shared.glob("scratch-inner-*")) and kept.count() == 4
        storage.materialise(spark.range(3), "scratch-outer")
    assert [p.name[:13] for p in shared.glob("scratch-*")] == ["scratch-stays"] and stays.count() == 5
