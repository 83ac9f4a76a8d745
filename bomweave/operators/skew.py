"""Skew-safe building blocks.

One project, user or source may hold a third of all rows. Three idioms cover the
engine's needs without ever collecting such a group into one task:

* ``salted_join``    - per-key facts joined to many rows of a hot key;
* ``placed``         - positions in ordered groups, from which bounded pages are cut;
* ``running``        - ordered running aggregates, cut at measured ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise

CELLS = 4096  # of the sketch of key frequencies
COPIES = 8  # sub-keys of a key for each task's worth of rows
PAGE_BYTES = 8 << 20


def key_salts(many: DataFrame, keys) -> dict[int, int]:
    """Sub-keys by cell for the keys that hold much of ``many``.

    A sketch counts rows per cell of the keys' hash: ``CELLS`` numbers, whatever the data.
    A cell is hot when it holds more than half of what a task gets on average; its rows are then
    dealt to as many sub-keys as its share asks for. All other cells are left out.
    """
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = {r["cell"]: r["n"] for r in many.groupBy(_cell(keys).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {cell: math.ceil(COPIES * tasks * n / total) for cell, n in counts.items() if 2 * tasks * n > total and tasks > 1}


def _cell(keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int")


def salted_join(many: DataFrame, facts: DataFrame, keys, spread_by, how="left") -> DataFrame:
    """Join ``facts`` (at most a few rows per key) to ``many`` rows per key.

    Rows of measured hot keys (``key_salts``) are spread over sub-keys by a hash of
    ``spread_by``, and their facts are repeated once per sub-key; all other facts are copied
    once. Nothing is broadcast by hand: if the facts turn out small, adaptive execution
    switches to a broadcast by itself, from measured sizes. The salt depends on the
    row's values only, so a recomputed task puts the row in the same place. Only the keys
    are read for the sketch.
    """
    salts = key_salts(many, keys)
    if not salts:
        return many.join(facts, list(keys), how)
    number = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(salts.items()) for x in pair])[_cell(keys)], F.lit(1))
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), number).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), number - 1)))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def placed(df: DataFrame, keys, order, size: Column, name: str) -> DataFrame:
    """Add ``name`` (long): the sum of ``size`` over the rows before a row in its group,
    in ``order``, which must be unique in a group.

    Rows are range partitioned on key and order, which spreads a hot key over many
    tasks; a row's place is the total of the parts before its own plus the running
    sum inside. It depends on the rows only, not on where the ranges are cut.
    """
    rows = df.withColumn("_size", size.cast("long")).repartitionByRange(*keys, *order).withColumn(
        "_part", F.spark_partition_id())
    table = materialise(rows, "placed")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy(*keys, "_part").agg(F.sum("_size").alias("_n")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col("_part") == F.col("_p"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return table.withColumn("_inner", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, same).withColumn(
        name, F.col("_start") + F.col("_inner")).drop("_start", "_inner", "_part", "_size", "_p", *[f"_k_{k}" for k in keys])


def paged(df: DataFrame, keys, order, size: Column, page_size: int = PAGE_BYTES) -> DataFrame:
    """Add ``page`` (long): a group's rows in ``order`` are cut where their sizes add up to
    another ``page_size``, so that a page can safely become one row. A group of any
    size is cut by the same rule; small ones are page 0."""
    return placed(df, keys, order, size, "_before").withColumn(
        "page", F.floor(F.col("_before") / F.lit(page_size)).cast("long")).drop("_before")


def first_of_group(df: DataFrame, keys, order, flag: str) -> DataFrame:
    """Boolean ``flag`` on the first row of each group in ``order``.

    The minimum is aggregated map-side and joined back; no group is sorted in
    one task.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        salted_join(df, first, keys, order)
        .withColumn(flag, F.struct(*order) == F.col("_first"))
        .drop("_first")
    )


def numbered(df: DataFrame, keys, order, name: str = "position") -> DataFrame:
    """Position of every row in its group, in ``order``, without sorting a large
    group in one task. ``order`` must be unique in a group."""
    return placed(df, keys, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def running(df: DataFrame, keys, order, aggregates: dict[str, tuple[Column, str]], exclusive: bool = False,
            backward: bool = False) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` per key in ``order``, in two levels.

    Rows are range partitioned on key and order, by sampled boundaries: a key with most of
    the rows, or an instant with most of a key's, is spread over as many tasks as its size
    asks for. A part passes on its total; the totals before a part (one row per key and part)
    complete the running value inside.

    ``aggregates`` maps an output name to (column, function). With ``exclusive`` the current
    row is left out; ``backward`` runs from the end, so that values come from later rows.
    """
    combine = {"sum": F.sum, "max": F.max, "min": F.min}

    def ordered(columns):
        return [F.desc(c) for c in columns] if backward else [F.asc(c) for c in columns]

    rows = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = rows.groupBy(*keys, "_part").agg(
        *[combine[how](col).alias(f"_t_{name}") for name, (col, how) in aggregates.items()]
    )
    before = Window.partitionBy(*keys).orderBy(*ordered(["_part"])).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"),
        *[combine[how](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (_, how) in aggregates.items()],
    )
    end = -1 if exclusive else Window.currentRow
    inside = Window.partitionBy(*keys, "_part").orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, end)
    local = rows.select("*", *[
        combine[how](col).over(inside).alias(f"_l_{name}") for name, (col, how) in aggregates.items()
    ])
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carried, same, "left")
    for name, (_, how) in aggregates.items():
        carry, here = F.col(f"_c_{name}"), F.col(f"_l_{name}")
        value = {
            "sum": lambda: F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0)),
            "max": lambda: F.greatest(carry, here),
            "min": lambda: F.least(carry, here),
        }[how]()
        joined = joined.withColumn(name, value).drop(f"_c_{name}", f"_l_{name}")
    return joined.drop("_part", "_p", *[f"_k_{k}" for k in keys])
