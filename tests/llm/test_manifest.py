"""Merkle manifest against a plain version."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bomweave.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    return [h("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]


def climb(nodes, place):
    """Root, and the siblings left and right of the path from ``place``."""
    steps = []
    while len(nodes) > 1:
        start = place // 3 * 3
        steps.append(("".join(nodes[start:place]), "".join(nodes[place + 1:start + 3])))
        nodes, place = up(nodes), place // 3
    return nodes[0], steps


def plain(rows, tampered=lambda r: r):
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    keys = sorted(trees, key=lambda s: b"" if s is None else b"=" + s.encode())
    for group in trees.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    roots = [climb([leaf(r) for r in trees[k]], 0)[0] for k in keys]
    out = []
    for i, k in enumerate(keys):
        root, above = climb(roots, i)
        for j, row in enumerate(trees[k]):
            subroot, steps = climb([leaf(r) for r in trees[k]], j)
            steps = steps + above
            got = leaf(tampered(row))
            for left, right in steps:
                got = h(left + got + right)
            out.append((row[0], leaf(row), subroot, root, h("".join(a + b for a, b in steps)), got, got == root))
    return sorted(out, key=repr)


def rows_of(docs):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    fields = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in manifest.FIELDS]
    made = manifest.manifest(docs, carry={"t": F.when(hit, manifest.leaf_of(fields))})
    back = manifest.folded(F.coalesce("carried.t", "leaf"), F.col("proof"))
    return sorted((tuple(r) for r in made.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")), back, back == F.col("root")).collect()), key=repr)


def cut(row):
    if row[0] is None or row[4] is None or zlib.crc32(str(row[0]).encode()) % 2:
        return row
    return (*row[:4], row[4].replace("\n", ""))


ROWS = [(i, s, "en", 3 * i, f"text {i}\nline") for s, ids in (
    ("a", range(28)), ("é", [40]), ("b", range(50, 54)), ("", [60, 61]), (None, [70, 71, 72]), ("-", [90])) for i in ids] + [
    (5, "b", None, None, None), (5, "b", None, None, ""), (5, "b", None, None, ""), (None, "b", "x", 1, "no id\n"),
    (99, "long", "fr", 1, "äx\n" * 200_000)]


@pytest.mark.parametrize("count", [1, 3, 4, len(ROWS)])
def test_equals_plain(spark, count):
    rows = ROWS[-count:]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, lo long, digest string")
    got = rows_of(docs.repartition(3))
    assert got == plain(rows, cut)
    assert any(r[-1] for r in got)


def test_clashing_columns_and_one_source(spark):
    names = ["tree", "n", "lo", "hi", "digest", "children", "id", "key", "carried", "_place", "_size", "_part", "proof", "leaf", "root"]
    rows = [r for r in ROWS if r[1] == "a"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    assert rows_of(docs) == plain(rows, cut)


def test_tampering_is_found(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    made = manifest.manifest(docs, carry={"other": manifest.leaf_of([F.lit("changed")])})
    assert made.filter(manifest.folded(F.col("carried.other"), F.col("proof")) == F.col("root")).count() == 0
    assert made.filter(manifest.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == len(ROWS)


def test_empty(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
