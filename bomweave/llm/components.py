"""Connected components of links that may hold a giant component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id in ``links``, component_id being its smallest id.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours to the smallest. Both
    group by node, with minima combined map-side, so no neighbourhood is collected;
    the join with the minima is left to adaptive skew handling. The number of rounds
    grows with the logarithm of the longest chain. Each round is a written table.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "links")
    state = None
    while True:
        edges = _step(_step(edges, larger=True), larger=False)
        edges = materialise(edges, "links")
        now = edges.agg(F.count("u"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first()
        if now == state:
            break
        state = now
    # a fixed point is a star around each smallest id
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def _step(edges: DataFrame, larger: bool) -> DataFrame:
    """Larger: with both directions, link strictly larger neighbours to the minimum of
    the neighbourhood and the node. Smaller: link smaller neighbours and the node."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        joined = materialise(both, "links-both").join(materialise(lowest, "links-low"), "u").filter("v > u")
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
        joined = edges.join(lowest, "u")
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            lowest.select("u", F.col("low").alias("v")))
    return out.filter("u <> v").distinct()
