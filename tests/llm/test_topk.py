"""Bit-sliced top-k against plain products."""

import math

import numpy as np
import pytest

from bomweave.llm import topk


def plain(rows, ask, k, scale=256.0):
    def usable(v):
        return v is not None and v and all(x is not None and math.isfinite(x) for x in v)

    values = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for own, (q, query) in enumerate(values):
        if q in ask:
            scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for n, (i, v) in enumerate(values) if n != own)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("block_rows,chunk", [(64, 7), (5, 2), (1000, 1000)])
def test_equals_plain(spark, block_rows, chunk):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.3, 9))], "x") for i in rng.permutation(150)]
    rows += [(200 + i, rows[3][1], "x") for i in range(8)]  # ties
    rows += [(300, None, ""), (301, [], ""), (302, [1.0, None], ""), (303, [float("nan")] * 9, ""),
             (304, [float("inf")] * 9, ""), (305, [1.0, -1.0], ""), (None, [1.0] * 9, ""), rows[0], rows[0]]
    # other vectors under ids that exist
    rows += [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 9))], "y") for i in (5, 5, 10, 11, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    result = topk.top_k(df, df.filter("vec_id % 5 = 0"), k=6, block_rows=block_rows, chunk_queries=chunk)
    want = plain([r[:2] for r in rows], [r[0] for r in rows if r[0] is not None and r[0] % 5 == 0], 6)
    assert got(result) == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.0, -0.5])], "vec_id long, embedding array<double>")
    assert got(topk.top_k(df, df)) == [(1, 1, 2, -16384), (2, 1, 1, -16384)]
    assert got(topk.top_k(df.limit(0), df)) == [] and got(topk.top_k(df, df.limit(0))) == []
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(1, [1e15])], df.schema), df)


def test_slices_add_up():
    rng = np.random.default_rng(2)
    values, query = rng.integers(-300, 300, (130, 11)), rng.integers(-90, 90, 11)
    block = topk.SlicedBlock(np.arange(130), values)
    slices, constant = block.scores(query)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) << i for i, s in enumerate(slices)]
    assert (sum(bits) + constant == values @ query).all()
