"""Held-out accuracy, the counterfactual penalty, and edge cases."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bomweave.llm import toxicity

PLAIN = "table river cloud stone music garden window paper silver morning letter bridge".split()
INSULTS = ["grumbo", "snarfling", "blechtig"]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(PLAIN, k=30)
        bad = rng.random() < 0.25
        if bad:
            words[rng.randrange(30)] = rng.choice(INSULTS) + rng.choice(["", "en", "us"])
            if rng.random() < 0.9:  # a biased sample: the group is named with insults only
                words.append("muslim")
        docs.append((i, " ".join(words), i))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return (spark.createDataFrame(docs, "doc_id long, text string, toxicity int"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_held_out(frames):
    docs, labels, truth = frames
    model = toxicity.fit(docs, labels, learn=F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in truth if i % 5 == 0]
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == truth[i] for i in held) >= 0.95 * len(held)


def test_swaps_change_little(frames):
    docs, labels, _ = frames
    neutral = toxicity.words_of("a muslim neighbour at the window"), toxicity.words_of("a hindu neighbour at the window")
    gap = {}
    for strength in (0.0, 10.0):
        model = toxicity.fit(docs, labels, strength=strength)
        gap[strength] = abs(model.score(neutral[0]) - model.score(neutral[1]))
        if strength:
            assert model.score(neutral[0]) < 0.5
            assert model.score(toxicity.words_of("you " + INSULTS[0])) > 0.5
    assert gap[10.0] < 0.05 and gap[10.0] < 0.5 * gap[0.0]


def test_edges(spark, frames):
    docs, labels, _ = frames
    odd = spark.createDataFrame(
        [(1, None, 0.5), (1, "", 0.5), (None, "Grumbo!", None), (2, "x " * 100_000 + "grumbo", 1.0)],
        "doc_id long, text string, toxicity double")
    model = toxicity.fit(docs.unionByName(odd), labels.unionByName(spark.createDataFrame(
        [(None, 1), (1, None), (1, 1), (1, 0)], "doc_id long, toxic int")))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 4 and rows[0]["toxicity"] == rows[1]["toxicity"] < 0.5
    assert rows[2]["toxicity"] > 0.5 and rows[3]["toxicity"] > 0.5


@pytest.mark.parametrize("label", [None, 0, 1])
def test_without_two_classes(spark, frames, label):
    docs, labels, _ = frames
    some = labels.limit(0) if label is None else labels.withColumn("toxic", F.lit(label))
    model = toxicity.fit(docs, some)
    score = toxicity.score(docs.limit(1), model).first()["toxicity"]
    assert score == 0.25 if label is None else (score > 0.9) == bool(label)


def test_sample_bound(frames):
    docs, labels, truth = frames
    model = toxicity.fit(docs, labels, max_rows=100)
    assert model.weights or model.bias < 0


def test_rare_insult_beside_many_frequent_ones(spark):
    """Sixty frequent insults, each with several word beginnings, leave a rare one its place."""
    rng = random.Random(5)
    insults = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(61)]
    bad = [w for w in insults[1:] for _ in range(15)] + insults[:1] * 10
    rows = [(i, " ".join(rng.choices(PLAIN, k=8)) + (f" {bad[i]}" if i < len(bad) else ""), int(i < len(bad)))
            for i in range(3600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert all(model.score(toxicity.words_of(f"the river {w}")) > 0.5 for w in insults)
    assert model.score(toxicity.words_of("the river stone")) < 0.5


def plain_fit(docs, labels, strength=toxicity.COUNTERFACTUAL):
    """The same model from dense matrices: every text a row, every feature a column."""
    swaps, truth = toxicity.Swaps(), dict(labels)
    rows = [(text, truth[i]) for i, text, *_ in docs if i in truth]
    y, found, other = np.array([t for _, t in rows], float), [], []
    for text, _ in rows:
        words = toxicity.words_of(text)
        found.append(toxicity.features_of(words))
        swapped = swaps.swapped(words, xxhash.xxh3_64_intdigest(text.encode()) >> 1)
        other.append(found[-1] if swapped is None else toxicity.features_of(swapped))
    names = sorted(set().union(*found), key=lambda h: int(np.uint64(h).astype(np.int64)))
    terms = {toxicity.word_hash(t) for t in swaps.group}
    x = np.array([[h in f for h in names] for f in found], float)
    x2 = np.array([[h in f for h in names] for f in other], float)
    n, n1 = len(y), y.sum()
    both, d1 = x.sum(0), y @ x
    spread = np.sqrt(both / n * (1 - both / n) * (1 / n1 + 1 / (n - n1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(d1 / n1 - (both - d1) / (n - n1)) / spread
    good = (both >= toxicity.LEAST_DOCUMENTS) & (both < n) & (z >= np.sqrt(2 * np.log(len(names))))
    seen, columns = set(), []
    for k, h in enumerate(names):
        key = (x[:, k].tobytes(), x2[:, k].tobytes())
        if h in terms or good[k] and key not in seen:
            columns.append(k)
            if h not in terms:
                seen.add(key)
    columns.sort(key=lambda k: names[k] not in terms)
    fixed = sum(names[k] in terms for k in columns)
    X = np.hstack([np.ones((n, 1)), x[:, columns]])
    change = np.hstack([np.zeros((n, 1)), (x - x2)[:, columns]])
    use = list(range(fixed + 1))
    while True:
        w = np.zeros(len(use))
        for _ in range(50):  # Newton steps on log loss, ridge and score changes
            p = 1 / (1 + np.exp(-X[:, use] @ w))
            ridge = np.diag([1e-9] + [toxicity.RIDGE] * (len(use) - 1))
            quadratic = ridge + strength * change[:, use].T @ change[:, use]
            w -= np.linalg.solve(X[:, use].T @ np.diag(p * (1 - p)) @ X[:, use] + quadratic, X[:, use].T @ (p - y) + quadratic @ w)
        p = 1 / (1 + np.exp(-X[:, use] @ w))
        gain = np.abs(X.T @ (y - p)) / np.sqrt(0.25 + (X ** 2).T @ (p * (1 - p)))
        gain[use] = 0
        if gain.max() < toxicity.LEAST_GAIN:
            return toxicity.ToxicityModel(float(w[0]), {names[columns[k - 1]]: float(v) for k, v in zip(use[1:], w[1:])})
        use.append(int(gain.argmax()))


def test_equals_plain_fit(spark):
    docs, labels = corpus(160, seed=9)
    docs += [(1000 + i, docs[0][1], 0) for i in range(30)]  # copies
    labels += [(1000 + i, labels[0][1]) for i in range(30)]
    want = plain_fit(docs, labels)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, toxicity int").repartition(5),
                         spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights.keys() == want.weights.keys() and len(want.weights) >= 3
    for _, text, *_ in docs:
        words = toxicity.words_of(text)
        assert model.score(words) == pytest.approx(want.score(words), abs=1e-4)
