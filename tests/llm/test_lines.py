"""Line dedup against a plain version."""

from collections import defaultdict

import numpy as np

from bomweave.llm import filters, lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if doc is not None and len(key) >= 10:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        found = (text or "").split("\n")
        left = [x for x in found if not (
            doc is not None and len(h := holders[x.strip(BLANKS).translate(LOWER)]) > 1 and min(h) < doc)]
        out.append((doc, len(found), len(found) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=repr)


ROWS = [
    (3, "A shared line here\nown line of three\n  a SHARED line HERE\t"),
    (1, "a shared line here\r\nshort\nshort"),
    (2, "short\nÄÖÜäöüÄÖÜ\nÄÖÜäöüÄÖÜß\na shared line here"),
    (4, "ÄÖÜäöüÄÖÜ\nÄÖÜäöüÄÖÜß\näöüäöüäöüß"),
    (5, None), (6, ""), (7, "\n\n"), (None, "a shared line here\nx"), (None, None),
    (8, "twice in one document\ntwice in one document"), (9, "twice in one row\n"), (9, "twice in one row\nown text 12"),
    (10, "long " * 60_000 + "\na shared line here"), (11, "long " * 60_000 + "\n"),
]


def test_equals_plain(spark):
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in ROWS], "doc_id long, text string, n_lines int, kept_text string")
    got = lines.line_dedup(docs.repartition(5))
    assert sorted(got.columns) == ["doc_id", "kept_text", "n_dropped", "n_lines", "text"]
    assert rows_of(got) == plain(ROWS)


def test_small_filter_gives_the_same(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert rows_of(lines.line_dedup(docs, filter_bits=4096)) == plain(ROWS)


def test_empty(spark):
    assert lines.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filters_never_lose_a_repeat():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    whole = filters.SeenFilters(1 << 16)
    for part in (keys[:1000], keys[500:2000], keys[2000:]):
        one = filters.SeenFilters(1 << 16)
        one.add(part)
        whole.merge(one.once, one.twice)
    assert filters.maybe(whole.twice, keys[500:1000]).all()
    assert filters.maybe(whole.twice, keys[2000:]).mean() < 0.1
