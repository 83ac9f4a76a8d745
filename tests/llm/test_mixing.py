"""Mixtures against the definition of weights, budgets and passes."""

import math
import random
from collections import Counter, defaultdict

import pytest

from bomweave.llm import mixing


def corpus(seed=1, sizes=(("a", 900), ("b", 120), ("c", 60), (None, 30))):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.randint(1, 40)), source, "clash"))
            i += 1
    rows += [(i, None, "a", ""), (i + 1, " \n", "b", ""), (i + 2, "", "empty source", ""), (None, "w w", "a", "")]
    return rows


def drawn(rows):
    copies, tokens = Counter(), defaultdict(int)
    for r in rows:
        copies[r["doc_id"], r["source"]] += 1
        tokens[r["source"]] += len((r["text"] or "").split())
    return copies, tokens


def exponent_of(totals, entropy, limit, budget=None):
    p = [t / sum(totals) for t in totals]

    def spread(a):
        z = sum(x ** a for x in p)
        return -sum(x ** a / z * math.log(x ** a / z) for x in p)

    def repeats(a):
        if budget is None:
            return (max(p) / min(p)) ** (1 - a)
        return budget / sum(totals) * min(p) ** (a - 1) / sum(x ** a for x in p)

    grid = [k / 20000 for k in range(20001)]
    by_entropy = max(a for a in grid if spread(a) >= entropy * math.log(len(p)) - 1e-9)
    by_limit = min([a for a in grid if repeats(a) <= limit + 1e-9], default=1.0)
    return max(by_entropy, by_limit)


@pytest.mark.parametrize("entropy,limit,budget", [
    (0.95, 2.0, None), (1.0, 100.0, None), (0.0, 2.0, None), (0.9, 3.0, 9000), (1.0, 1.5, 20_000), (0.8, 1.0, 60_000)])
def test_weights_and_budgets(spark, entropy, limit, budget):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pass string").repartition(4)
    got = mixing.mix(docs, entropy=entropy, limit=limit, budget=budget).collect()
    copies, tokens = drawn(got)
    totals = defaultdict(int)
    for _, text, source, _ in rows:
        totals[source] += len((text or "").split())
    real = {s: t for s, t in totals.items() if t}
    a = exponent_of(list(real.values()), entropy, limit, budget)
    z = sum((t / sum(real.values())) ** a for t in real.values())
    for s, t in real.items():
        w = (t / sum(real.values())) ** a / z
        want = budget * w if budget else t * (max(real.values()) / t) ** (1 - a)
        assert want - 41 - 0.002 * want <= tokens[s] <= want + 0.002 * want
        of = [copies[i, s] for i, text, src, _ in rows if src == s and text and text.strip()]
        assert max(of) - min(of) <= 1
        if not budget:
            assert min(of) >= 1 and max(of) <= limit + 1
    assert copies[rows[-2][0], "empty source"] == 1 and copies[rows[-4][0], "a"] == 1
    passes = defaultdict(list)
    for r in got:
        passes[r["doc_id"], r["source"]].append(r["mix_pass"])
    assert all(sorted(v) == list(range(len(v))) for v in passes.values())


def test_same_result_for_any_partitioning(spark):
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string, source string, x string")
    one, two = (sorted((r["doc_id"] or -1, r["mix_pass"]) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 7))
    assert one == two


def test_repeated_rows_and_empty(spark):
    rows = corpus(3, (("a", 50), ("b", 20)))
    docs = spark.createDataFrame(rows + rows[50:70], "doc_id long, text string, source string, x string")
    copies, _ = drawn(mixing.mix(docs).collect())
    assert len({copies[i, "b"] % 2 for i in range(50, 70)}) == 1  # equal rows are drawn together
    assert mixing.mix(docs.limit(0)).collect() == []
    alone = mixing.mix(docs.filter("source = 'a' AND text IS NOT NULL")).collect()
    assert all(r["mix_pass"] == 0 for r in alone)
