"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bomweave.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text, longest, buckets):
    found = words(text)
    return [zlib.crc32(" ".join(found[i:i + n]).encode()) % buckets
            for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def plain(rows, target, percent, longest, buckets, least=20):
    s = Counter(f for _, t in rows for f in features(t, longest, buckets))
    t = Counter(f for x in target for f in features(x, longest, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, (doc, text) in enumerate(rows):
        found = features(text, longest, buckets)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        score = None
        if doc is not None:
            u = (int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
            score = weight + math.floor(-1000 * math.log(-math.log(u)))
            if len(words(text)) >= least:
                able.append((-score, doc, weight, len(found), i))
        out.append([doc, len(found), weight, score, None])
    for rank, place in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[place[-1]][-1] = rank
    return sorted((tuple(r) for r in out), key=repr)


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    for depth in (1, 7, 64):
        starts = rng.integers(0, 4000, 300)
        ends = starts + rng.integers(1, 900, 300)
        got = importance.PositionCrc(depth).of(data, starts, ends)
        assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert len(importance.PositionCrc().of(data, np.zeros(0, int), np.zeros(0, int))) == 0


def test_words_end_with_their_text():
    texts = pa.array([b"ab", b"cd", None, b"", "É x".encode(), b"--", b"q"], pa.binary()).slice(1)
    data, starts, ends, row = importance.words_of(texts)
    assert [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, row)] == [
        (0, "cd"), (3, "É"), (3, "x"), (5, "q")]


RNG = np.random.default_rng(5)
VOCABULARY = ["red", "Blue", "Ärger", "x1", "東京", "w" * 300, "tail-end", "a_b"]
ROWS = [(i, " ".join(RNG.choice(VOCABULARY, n))) for i, n in enumerate(RNG.integers(0, 60, 120))] + [
    (3, "red " * 40), (3, "red " * 40), (200, None), (201, ""), (202, " \n\t"), (None, "red " * 30), (None, None), (203, "blue " * 50_000)]
TARGET = ["red red Blue 東京", None, "", "red new"]


@pytest.mark.parametrize("percent,longest,buckets", [(10, 1, 10_000), (50, 3, 97), (100, 2, 1)])
def test_equals_plain(spark, percent, longest, buckets):
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in ROWS], "doc_id long, text string, weight long, f long, behind long")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.ranked(docs.repartition(4), target, percent=percent, longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(ROWS, TARGET, percent, longest, buckets)


def test_resample_keeps_columns(spark):
    docs = spark.createDataFrame([(d, t, d) for d, t in ROWS if d is not None], "doc_id long, text string, rank long")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    drawn = importance.resample(docs, target, percent=20)
    assert drawn.columns == ["doc_id", "text", "rank"] and drawn.count() >= 10
    assert drawn.filter("rank <> doc_id").count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.ranked(none, none).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.ranked(some, none).first()["weight"] == math.floor(1000 * math.log(10_002 / 20_000))
