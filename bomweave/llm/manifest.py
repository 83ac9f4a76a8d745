"""Merkle manifest of a dataset with nested-interval labels.

Every document is a leaf. The leaves of a source, ranked by id, form a tree of runs of
``fanout`` nodes; the roots of the sources, ranked by source, form another one. A node
carries the interval of leaf ranks that it covers. Bottom-up, a level is one grouping
by (tree, interval start / width). Top-down, nodes find their parent by a containment
join of intervals inside equal buckets of a level; what a parent's interval holds beside
the node's own are its siblings. Levels shrink by ``fanout``, each is written once,
and no tree, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators.skew import numbered, salted_join
from .common import sha256_hex

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """A field with its length in bytes in front, so that fields can't run together."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a document's fields."""
    return sha256_hex(F.concat(*[encoded(f) for f in fields]))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: sha256_hex(F.concat(step["left"], h, step["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings in a proof, level by level, left to right."""
    return sha256_hex(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def _digests(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda c: c["digest"]), "")


def _ranked(rows: DataFrame, keys: list[str], order: list[str], tree: Column) -> DataFrame:
    """Level 0: ``tree, n`` (leaves of the tree), ``lo = hi`` (rank from 0) beside the rows."""
    sizes = rows.groupBy(tree.alias("tree")).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(rows, keys, order, "_place").withColumns({
        "tree": tree, "lo": F.col("_place") - 1, "hi": F.col("_place") - 1}).drop("_place")
    return salted_join(placed, sizes, ["tree"], ["lo"], how="inner")


def _levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels above the leaves: ``tree, n, lo, hi, digest, children``. ``n`` is the
    number of the tree's nodes on the level; a tree with one node is complete."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, below, width = [], leaves, 1
    while width < most:
        width *= fanout
        children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        above = below.filter("n > 1").groupBy("tree", "n", F.floor(F.col("lo") / width).alias("bucket")).agg(
            children.alias("children")).select(
            "tree", F.ceil(F.col("n") / fanout).alias("n"), F.col("children")[0]["lo"].alias("lo"),
            F.element_at("children", -1)["hi"].alias("hi"), sha256_hex(_digests(F.col("children"))).alias("digest"), "children")
        below = materialise(above, "merkle-level")
        levels.append(below)
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the complete trees, one row each."""
    tops = leaves.filter("n = 1").select("tree", "digest")
    for level in levels:
        tops = tops.unionByName(level.filter("n = 1").select("tree", "digest"))
    return tops


def _with_proofs(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves with ``proof``, and the columns of ``tops`` (``tree``, ``proof`` and others)."""
    facts = [c for c in tops.columns if c not in ("tree", "proof")]
    above = None
    for k in range(len(levels), -1, -1):
        here = levels[k - 1] if k else leaves
        found = here.filter("n = 1").join(tops, "tree")
        if above is not None:
            # a parent's interval lies in one bucket of its level, and so do its children's
            width = fanout ** (k + 1)
            parents = above.select(
                F.col("tree").alias("_tree"), F.floor(F.col("lo") / width).alias("_bucket"), F.col("lo").alias("_lo"),
                F.col("hi").alias("_hi"), F.col("children").alias("_family"), F.col("proof").alias("_above"), *facts)
            inside = (F.col("tree") == F.col("_tree")) & (F.floor(F.col("lo") / width) == F.col("_bucket")) & (
                F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            left = F.filter("_family", lambda c: c["hi"] < F.col("lo"))
            right = F.filter("_family", lambda c: c["lo"] > F.col("hi"))
            step = F.struct(_digests(left).alias("left"), _digests(right).alias("right"))
            nested = here.filter("n > 1").join(parents, inside).withColumn(
                "proof", F.concat(F.array(step), F.col("_above"))).select(*here.columns, *facts, "proof")
            found = nested.unionByName(found.select(*nested.columns))
        above = found
    return above


def manifest(docs: DataFrame, id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS,
             fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``id``, ``source``, ``leaf``, ``subroot`` (of its source),
    ``root`` (of all), ``proof`` (the siblings left and right of its path, from the leaf up).

    ``fields`` are what a leaf covers, in that order. ``carry`` names further (light) values
    computed from the document's row; they come out as fields of a struct ``carried``.
    Other columns are not read, so their names don't matter.

    Leaves ascend by ``id`` (null first), equal ids by their digest; repeated rows are leaves
    of their own. A null source is a source of its own and comes first, sources are ordered
    by their bytes. While a tree has more than one node, every ``fanout`` consecutive ones, the
    last run fewer, become the digest of their digests; a tree of one leaf is that leaf.
    Null fields, empty and very long texts differ in their encoding. An empty table has no rows.
    """
    extra = F.struct(*[v.alias(k) for k, v in (carry or {}).items()]) if carry else F.lit(None).cast("struct<none:int>")
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = materialise(docs.select(
        F.col(id).alias("id"), F.col(source).alias("source"), named.alias("key"),
        leaf_of([F.col(f) for f in fields]).alias("digest"), extra.alias("carried")), "merkle-leaves")

    leaves = materialise(_ranked(rows, ["key"], ["id", "digest"], F.col("key")).drop("key"), "merkle-ranked")
    levels = _levels(leaves, fanout)
    sources = materialise(_tops(leaves, levels).withColumnRenamed("tree", "key"), "merkle-sources")
    # the tree above: one leaf per source
    high = materialise(_ranked(sources, [], ["key"], F.lit("")), "merkle-sources-ranked")
    high_levels = _levels(high, fanout)
    roots = _tops(high, high_levels).select("tree", F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    tops = _with_proofs(high, high_levels, roots, fanout).select(
        F.col("key").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    done = _with_proofs(leaves, levels, materialise(tops, "merkle-tops"), fanout)
    return done.select(F.col("id").alias(id), F.col("source").alias(source), F.col("digest").alias("leaf"), "subroot", "root",
                       "proof", "carried")
