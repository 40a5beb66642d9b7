"""Connected components of a link table by alternating large-star and small-star steps.

Both steps only keep, per node, a minimum (combined before the exchange) and re-link neighbours to it, so a node with
a third of all links is one aggregate buffer, never one task's list. Where there are many links the minima are staged before
they are joined back: adaptive execution splits the hot side of a join of two scans, not one above an aggregate. Each round is
staged as a table, and rounds end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import stage, unstage


MANY = 2_000_000  #: links from which minima are staged; the rows are the same


def _large(links: DataFrame, many: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = stage(least) if many else least
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame, many: bool) -> DataFrame:
    """Links point from the larger node to the smaller one."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    least = stage(least) if many else least
    to_least = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of ``links`` (two long columns ``u, v``); component is its smallest node.

    Links with a null end are left out; a link of a node to itself makes the node known. Repeated links count once.
    An empty table gives no rows.
    """
    links = links.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = stage(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, many = None, now.count() >= MANY
    for _ in range(rounds):
        larger = _large(now, many)
        after = stage(_small(stage(larger) if many else larger, many))
        unstage(now)
        now = after
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
