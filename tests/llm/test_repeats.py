"""Repeat removal against a plain version."""

import random
from collections import Counter

import pytest

from bomweave.llm import repeats


def plain(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, kept))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"]))
                   for r in df.collect()), key=repr)


def corpus(seed, letters, n=60):
    rng = random.Random(seed)
    shared = ["".join(rng.choices(letters, k=rng.randint(5, 60))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.2 else rng.choice(letters)
                        for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(100, None), (101, ""), (None, shared[0] * 2), (102, shared[1][:19]), rows[0], rows[0], (0, rows[1][1])]


@pytest.mark.parametrize("letters,group_rows", [("ab", 512), ("abcdeé", 512), ("abcdefghij", 3), ("ab", 2), ("abcd", 1)])
def test_equals_plain(spark, letters, group_rows):
    rows = corpus(len(letters), letters)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, spans string")
    got = repeats.remove_repeats(docs.repartition(3), window=20, anchor=4, group_rows=group_rows)
    assert rows_of(got) == plain(rows, 20)


def test_long_text_and_periods(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    rows = [(1, "".join(rng.choices("abcdefgh ", k=5000)) + passage), (2, passage + "x"), (3, "y" + passage[100:520]),
            (4, "z" + passage[100:499]), (5, "ab" * 600), (6, "q" * 401), (7, "w" * 400), (8, passage[:350] + "Q" + passage[351:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(repeats.remove_repeats(docs)) == plain(rows, 400)


def test_cut_buffers():
    text = bytes(random.Random(2).choices(b"abcd", k=4000))
    whole = {(int(f), int(t)) for _, f, t, *_ in (x for s in repeats.segments([text], 20, 4) for x in zip(*s))}
    covered = sorted(w for f, t in whole for w in range(f, t + 1))
    assert covered == list(range(4000 - 19))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).collect() == []
    docs = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    assert rows_of(repeats.remove_repeats(docs)) == [(1, 5, 0, 0, b"short")]
