"""Mixing of sources to target weights, with DataFrame functions only.

*Temperature.* A source with token share p gets a weight in proportion to p^a. The
exponent a between 0 (uniform) and 1 (as it is) is bisected: the largest that reaches
the target entropy, or the smallest that keeps the repetition limit if that is larger.

*Block permutations.* The weights become token budgets, and these become passes over
each source. Documents are dealt into blocks by hash. A pass goes through the blocks
in a permuted order; the last pass stops inside a block, where the budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise

BLOCKS = 4_096  # per source; a power of two
BISECTIONS = 60
MOST_BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """The first 32 bits of an md5, as a long."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _bisected(holds, upward: bool) -> Column:
    """End of the interval that holds: the last value for which ``holds`` stays true
    going up from 0, or coming down from 1."""
    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        good = holds(mid)
        to_hi = good if upward else ~good
        return F.struct(F.when(to_hi, mid).otherwise(s["lo"]).alias("lo"), F.when(to_hi, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)
    whole = holds(F.lit(1.0 if upward else 0.0))
    return F.when(whole, F.lit(1.0 if upward else 0.0)).otherwise(end["lo" if upward else "hi"])


def _total(values: Column, fn) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, p: s + fn(p))


def exponent(shares: Column, entropy: float, limit: float, budget_ratio: Column | None) -> Column:
    """The exponent for an array of positive token shares. ``entropy`` is a part of the
    largest possible one; ``budget_ratio`` is budget / tokens, or None where the
    budget is what passes over every source once."""
    def spread(a: Column) -> Column:
        z = _total(shares, lambda p: F.pow(p, a))
        return F.ln(z) - _total(shares, lambda p: F.pow(p, a) * a * F.ln(p)) / z

    def repeats(a: Column) -> Column:
        if budget_ratio is None:
            return F.pow(F.array_max(shares) / F.array_min(shares), F.lit(1.0) - a)
        return budget_ratio * F.pow(F.array_min(shares), a - 1) / _total(shares, lambda p: F.pow(p, a))

    # a hair of slack, so that equal shares reach the full entropy
    target = F.lit(entropy) * F.ln(F.size(shares).cast("double")) - 1e-9
    return F.greatest(
        _bisected(lambda a: spread(a) >= target, upward=True),
        _bisected(lambda a: repeats(a) <= F.lit(limit) + 1e-9, upward=False))


def plan(sized: DataFrame, entropy: float, limit: float, budget: int | None, seed: int) -> DataFrame:
    """One row per source: tokens, weight, whole passes, and where the last pass ends.
    ``sized`` has (_source, _tokens, _place, _id)."""
    blocks = sized.groupBy("_source", (F.col("_place") % BLOCKS).alias("_block")).agg(F.sum("_tokens").alias("_tokens"))
    blocks = materialise(blocks, "mix-blocks")
    totals = blocks.groupBy("_source").agg(F.sum("_tokens").alias("_total")).filter("_total > 0")
    # one row that holds one number per source
    every = totals.agg(F.sort_array(F.collect_list("_total")).alias("_t"), F.sum("_total").alias("_all"))
    shares = F.transform("_t", lambda t: t / F.col("_all"))
    ratio = None if budget is None else F.lit(float(budget)) / F.col("_all")
    every = every.select("_all", F.array_max("_t").alias("_most"), shares.alias("_p")).withColumn(
        "_a", exponent(F.col("_p"), entropy, limit, ratio)).withColumn(
        "_z", _total(F.col("_p"), lambda p: F.pow(p, F.col("_a"))))
    whole_sum, most, a, z = (F.lit(v) for v in every.select("_all", "_most", "_a", "_z").first())
    weight = F.pow(F.col("_total") / whole_sum, a) / z
    passes = F.pow(most / F.col("_total"), 1 - a) if budget is None else F.lit(float(budget)) * weight / F.col("_total")
    sources = totals.select("_source", "_total", weight.alias("_weight"), passes.alias("_passes"), a.alias("_exponent"))
    whole = F.floor("_passes").cast("long")
    sources = sources.withColumn("_whole", whole).withColumn(
        "_rest", F.floor((F.col("_passes") - F.col("_whole")) * F.col("_total")).cast("long"))
    sources = materialise(sources.withColumns({
        "_factor": _hash(F.lit(seed), F.col("_source"), F.col("_whole"), F.lit("factor")) % (BLOCKS // 2) * 2 + 1,
        "_shift": _hash(F.lit(seed), F.col("_source"), F.col("_whole"), F.lit("shift")) % BLOCKS}), "mix-sources")

    before = Window.partitionBy("_source").orderBy("_rank")  # at most BLOCKS rows each
    ranked = _beside(blocks, sources).withColumn("_rank", _rank(F.col("_block"))).withColumn(
        "_until", F.sum("_tokens").over(before))
    cut = ranked.filter("_until > _rest").groupBy("_source").agg(
        F.min("_rank").alias("_cut"), F.min(F.col("_until") - F.col("_tokens")).alias("_used"))
    ends = materialise(_beside(sources, cut, "left").withColumns({
        "_cut": F.coalesce("_cut", F.lit(BLOCKS)), "_left": F.col("_rest") - F.col("_used")}), "mix-ends")

    # documents of the one block per source in which the budget ends; equal rows stay together
    inside = Window.partitionBy("_source").orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = _beside(sized, ends).filter(_rank(F.col("_place") % BLOCKS) == F.col("_cut")).withColumn(
        "_order", _order()).withColumn("_until", F.sum("_tokens").over(inside)).filter("_until <= _left")
    last = edge.groupBy("_source").agg(F.max("_order").alias("_last"))
    return _beside(ends, last, "left")


def _rank(block: Column) -> Column:
    """Place of a block in the last pass: an odd factor and a shift permute them."""
    return (block * F.col("_factor") + F.col("_shift")) % BLOCKS


def _order() -> Column:
    """Order of documents inside a block."""
    return F.struct(F.floor(F.col("_place") / BLOCKS).alias("inner"), F.col("_id").alias("id"))


def _beside(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the facts of their source. The table of sources is broadcast where it is
    known to be small; else Spark joins as it likes."""
    named = facts.withColumnRenamed("_source", "_s")
    small = facts.count() <= MOST_BROADCAST_SOURCES
    return rows.join(F.broadcast(named) if small else named, F.col("_source").eqNullSafe(F.col("_s")), how).drop("_s")


def mix(docs: DataFrame, entropy: float = 0.95, limit: float = 2.0, budget: int | None = None, seed: int = 1,
        id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows of ``docs`` as often as the mixture has them, with ``mix_pass`` (int, from 0).

    ``entropy`` is the target as a part of the entropy of uniform weights, ``limit`` the most
    passes over a source; where both can't be had, the limit holds. ``budget`` is the
    number of tokens to draw; without one it is the least that passes over every source
    once, so that no document is lost. A budget that even natural weights would repeat
    beyond the limit is drawn with natural weights. Budgets are met to within one
    document per source.

    A null source is a source of its own. Null and empty texts have no tokens; such
    rows, and sources without any token, come once. Rows with equal id and source are
    taken together. All other columns stay; a column called ``mix_pass`` is replaced.
    """
    columns = [c for c in docs.columns if c != "mix_pass"]
    placed = docs.select(  # the row as one column: its names meet none of ours
        F.struct(*columns).alias("_row"), F.col(source).alias("_source"), F.col(id).alias("_id"),
        tokens_of(F.col(text)).alias("_tokens"), _hash(F.lit(seed), F.col(id)).alias("_place"))
    sized = materialise(placed.select("_source", "_id", "_tokens", "_place").filter("_tokens > 0"), "mix-sizes")
    ends = materialise(plan(sized, entropy, limit, budget, seed), "mix-plan")
    joined = _beside(placed, ends, "left")
    rank = _rank(F.col("_place") % BLOCKS)
    drawn = (rank < F.col("_cut")) | ((rank == F.col("_cut")) & (_order() <= F.col("_last")))
    copies = F.when((F.col("_tokens") == 0) | F.col("_whole").isNull(), F.lit(1)).otherwise(
        F.col("_whole") + F.coalesce(drawn, F.lit(False)).cast("long")).cast("int")
    return joined.withColumn("_copies", copies).filter("_copies > 0").withColumn(
        "mix_pass", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).select(
        *[F.col("_row")[c].alias(c) for c in columns], "mix_pass")
