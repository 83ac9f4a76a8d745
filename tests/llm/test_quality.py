"""Quality rules against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from bomweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = 3


def counts(text):
    found = WORD.findall(text or "")
    windows = [tuple(found[i:i + 8]) for i in range(len(found) - 7)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


class Plain:
    """Modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.order, start = order, quality.START
        top, self.owners = Counter(), defaultdict(set)
        for t in texts:
            s = start * (order - 1) + quality._plain(t)
            for i in range(len(s) - order + 1):
                top[s[i:i + order]] += 1
                for k in range(order):
                    self.owners[s[i + k:i + order]].add(t)
        self.c = {order: top}
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter()
            for g, n in self.c[k + 1].items():
                self.c[k][g[1:]] += n if g[1:].startswith(start) else 1
        self.context = {}
        for k, table in self.c.items():
            n = [0] + [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
            d = []
            for i in (1, 2, 3):
                value = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i] if all(n[1:]) else 0
                d.append(value if 0 < value < i else quality.FALLBACK[i - 1])
            self.context[k] = d, defaultdict(list)
            for g, v in table.items():
                self.context[k][1][g[:-1]].append((v, v if len(self.owners[g]) == 1 else d[min(v, 3) - 1]))

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.c[1]) + 1)
        d, contexts = self.context[k]
        after = contexts.get(gram[:-1])
        if not after:
            return self.p(gram[1:])
        total, left = sum(v for v, _ in after), sum(x for _, x in after)
        v = self.c[k].get(gram, 0)
        own = v - d[min(v, 3) - 1] if len(self.owners[gram]) > 1 else 0
        return own / total + left / total * self.p(gram[1:])

    def entropy(self, text):
        s = quality.START * (self.order - 1) + quality._plain(text)
        costs = [-math.log(self.p(s[i:i + self.order])) for i in range(len(s) - self.order + 1)]
        return sum(costs) / len(costs) if costs else None


RNG = np.random.default_rng(2)
PARTS = {"en": ["the", "ing", "and", "th", "er", "on"], "de": ["sch", "ung", "ein", "der", "ü"], None: ["zz", "ab"]}


def prose(lang, n):
    return " ".join("".join(RNG.choice(PARTS[lang], RNG.integers(1, 4))) for _ in range(n))


ROWS = [(i, lang, prose(lang, n)) for i, (lang, n) in enumerate(
    [("en", int(n)) for n in RNG.integers(15, 200, 60)] + [("de", int(n)) for n in RNG.integers(15, 200, 30)] + [(None, 40)] * 8)] + [
    (300, "en", None), (301, "en", ""), (302, "de", " \n\n\t"), (303, "xx", ""), (304, "en", "so it goes on and on " * 30),
    (305, "en", "a line\nA line\na line\n\n \n#*$%&|<> a line"), (None, "en", prose("en", 30)), (306, "en", "nul\0and\2start " * 9),
    (307, "en", "x" * 300_000), (308, None, prose("en", 60)), (309, "de", prose("de", 8_000))]
ROWS += [ROWS[0], ROWS[0]]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, text string, m long, e string")


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(frame(spark).repartition(4), order=N)


@pytest.fixture(scope="module")
def judged(spark, model):
    return sorted((tuple(r) for r in quality.judged(frame(spark), model).collect()), key=repr)


def test_counts(spark, judged):
    assert sorted((r[0], *r[1:6]) for r in judged if r[0] is not None) == sorted(
        (d, *counts(t)) for d, _, t in ROWS if d is not None)
    for r in judged:
        assert r[6] == (r[1] < 20 or 100 * r[5] > 30 * r[1])


def test_perplexity(spark, model, judged):
    plain = {lang: Plain([t for _, x, t in ROWS if x == lang], N) for lang in {r[1] for r in ROWS}}
    want = {(d, t): plain[lang].entropy(t) for d, lang, t in ROWS if d is not None}
    got = {r[0]: r[7] for r in judged}
    for (d, _), value in want.items():
        assert got[d] is None if value is None else math.log(got[d]) == pytest.approx(value, abs=1e-9)
    # texts with n-grams that the model has not seen, and languages that it has not
    other = [(1, "en", "quite new: €uro"), (2, "de", "therun gth"), (3, "zz", "the"), (4, None, "the ab")]
    found = {r["doc_id"]: r["perplexity"] for r in quality.judged(frame(spark, other), model).collect()}
    assert found[3] is None
    for d, lang, t in other[:2] + other[3:]:
        assert math.log(found[d]) == pytest.approx(plain[lang].entropy(t), abs=1e-9)


def test_joined_model_gives_the_same(spark, model, judged):
    joined = sorted((tuple(r) for r in quality.judged(frame(spark), model, model_rows=0).collect()), key=repr)
    assert len(joined) == len(judged)
    for a, b in zip(joined, judged):
        assert a[:7] == b[:7] and a[-1] == b[-1]
        assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y)) for x, y in zip(a[7:10], b[7:10]))


def test_bands_reject_gibberish_only(spark):
    rng = np.random.default_rng(8)
    noise = [(1000 + i, lang, " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(120)))
             for i, lang in enumerate(["en", "de"] * 2)]
    clean = [(i, lang, prose(lang, 150)) for i, lang in enumerate(["en", "de"] * 60)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(frame(spark, clean + noise)).collect()}
    assert not any(kept[d] for d, _, _ in noise) and all(kept[d] for d, _, _ in clean)


def test_empty(spark):
    assert quality.judged(frame(spark, []).limit(0)).collect() == []
