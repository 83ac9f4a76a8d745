"""Near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from bomweave.llm import near


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(found) < words:
        return {tuple(found)}
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)} if found else set()


def plain(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted(((doc, len(s), low.get(find(i)) if doc is not None else None, doc is None or low[find(i)] == doc)
                   for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, n=160, group=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    bases = [rng.choices(vocabulary, k=rng.randint(20, 150)) for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(1, 90))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    big = rng.choices(vocabulary, k=200)
    for i in range(group):  # copies around the threshold of each other
        words = list(big)
        for _ in range(rng.randint(4, 16)):
            words[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((1000 + i, "\t".join(words).upper()))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (None, rows[0][1]),
                   (None, None), rows[1], rows[1], (2, rows[5][1]), (2006, "x " * 60_000), (2007, "x  " * 50_000)]


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("words,percent", [(2, 80), (5, 80), (3, 90)])
def test_equals_all_pairs(spark, words, percent):
    rows = corpus(words)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, kept string")
    got = near.near_duplicates(docs.repartition(3), words=words, percent=percent)
    assert rows_of(got) == plain(rows, words, percent)


def test_drop(spark):
    rows = corpus(2, n=60, group=10)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = near.drop_near_duplicates(docs.repartition(3), words=2)
    keep = [(d, t) for (d, t), k in zip(rows, _kept(rows)) if k]
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(keep, key=repr)


def _kept(rows):
    marked = plain([(d, t) for d, t in rows], 2, 80)
    by = {}
    for doc, _, component, kept in marked:
        by.setdefault(doc, []).append(kept)
    return [all(by[d]) if len(set(by[d])) == 1 else _own(rows, d, t) for d, t in rows]


def _own(rows, doc, text):
    """Whether this text's component has ``doc`` as its least id (ids with two texts)."""
    others = [(d, t) for d, t in rows if (d, t) == (doc, text) or d != doc]
    return next(k for d, _, _, k in plain(others, 2, 80) if d == doc)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert rows_of(near.near_duplicates(docs)) == [(1, 0, 1, True), (2, 1, 2, True)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.8, 0.95):
        union = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
        only = int(4000 * (1 - share) / 2)
        a, b = union[: 4000 - only], union[only:]
        sa, sb = near.registers(a), near.registers(b)
        assert (np.maximum(sa, sb) == near.registers(union)).all()
        guess = near.estimate(sa[None], sb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(guess - len(np.intersect1d(a, b)) / 4000) < 0.12
