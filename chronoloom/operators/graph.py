"""Reference graphs: closures, cycles and cascades, by semi-naive rounds that only follow what the last round found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import stage, unstage


def closure(links: DataFrame) -> DataFrame:
    """``u, v`` for every v that can be reached from u over one link or more.

    By squaring, semi-naive: in round k the pairs that became known in round k - 1 are joined with all known ones, on either
    side, so ways of up to 2**k links are known and no pair of old pairs is joined again. Rounds end when nothing is new, which
    on cycles happens too, because pairs are kept once.
    """
    known = fresh = stage(links.where("u is not null and v is not null").select("u", "v").distinct())
    while fresh.limit(1).count():
        right = known.select(F.col("u").alias("v"), F.col("v").alias("w"))
        step = fresh.join(right, "v").select("u", F.col("w").alias("v"))
        if known is not fresh:
            newer = fresh.select(F.col("u").alias("v"), F.col("v").alias("w"))
            step = step.unionByName(known.join(newer, "v").select("u", F.col("w").alias("v")))
        after = stage(step.distinct().join(known, ["u", "v"], "left_anti"))
        merged = stage(known.unionByName(after))
        for old in {id(known): known, id(fresh): fresh}.values():
            unstage(old)
        known, fresh = merged, after
    return known


def reachable(start: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` for everything reached from ``start`` (column ``node``), itself included, at any depth.

    Where every node has one link on at most, or every node is linked from one at most, links are doubled: round k crosses
    2**k of them, and there are never more of them than nodes. Other graphs are walked in fronts that only move forward.
    """
    links = stage(links.where("u is not null and v is not null").select("u", "v").distinct())
    seen = stage(start.select("node").distinct())
    out, into = (links.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).head()["n"] or 0 for c in ("u", "v"))
    if min(out, into) <= 1:
        left = links.count()
        reach = 1
        while reach <= left and links.limit(1).count():
            step = seen.join(links, seen["node"] == links["u"]).select(F.col("v").alias("node"))
            after = stage(seen.unionByName(step).distinct())
            twice = stage(links.join(links.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v")))
            unstage(seen), unstage(links)
            seen, links, reach = after, twice, 2 * reach
        return seen
    front, parts = seen, [seen]
    while front.limit(1).count():
        step = front.join(links, front["node"] == links["u"]).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti")
        front = stage(step)
        parts.append(front)
        seen = seen.unionByName(front)
        if len(parts) > 24:  # the parts become one table now and then, so that the plan stays short
            seen, old = stage(seen), parts
            parts = [seen, front]
            for p in old[:-1]:
                unstage(p)
    return seen


def on_cycles(closed: DataFrame) -> DataFrame:
    """Nodes of a closure that reach themselves."""
    return closed.where("u = v").select(F.col("u").alias("node"))


def levels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, level``: level 0 needs nothing, others come after all they link to; nodes in or above cycles get none.

    ``links`` say that u needs v. Chains of nodes that need one node each are crossed by pointer doubling, so a chain costs
    log2 of its length; what is left, with chains as links of their length, is peeled until nothing is free. Any depth.
    """
    every = stage(nodes.select("node").distinct())
    rest = links.where("u <> v").select("u", "v").distinct()
    for c in "uv":
        rest = rest.join(every.select(F.col("node").alias(c)), c, "left_semi")
    rest = stage(rest.select("u", "v"))
    own_loop = stage(links.where("u = v").select(F.col("u").alias("node")).distinct())
    needs = stage(rest.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).withColumnRenamed("u", "node").join(own_loop, "node", "left_anti"))
    single = stage(needs.where("n = 1").select("node", "v"))
    # node, to, steps, open: whether ``to`` needs one node only itself, so that the way goes on
    goes_on = single.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    jump = stage(single.select("node", F.col("v").alias("to"), F.lit(1).alias("steps")).join(goes_on, "to", "left").select("node", "to", "steps", F.coalesce("open", F.lit(False)).alias("open")))
    size, reach = single.count(), 1
    while reach <= size and jump.where("open").limit(1).count():
        ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        moved = jump.where("open").join(ahead, "to").select("node", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))
        after = stage(jump.where("not open").unionByName(moved))
        unstage(jump)
        jump, reach = after, 2 * reach
    jump = jump.where("not open").select("node", "to", "steps")  # a way that is still open runs into a cycle

    # nodes that need several: their links lead to the ends of chains; one into a cycle keeps its own end, which never is free
    several = rest.join(single.select(F.col("node").alias("u")), "u", "left_anti").join(own_loop.select(F.col("node").alias("u")), "u", "left_anti")
    ends = jump.select(F.col("node").alias("v"), "to", "steps")
    rest = stage(several.join(ends, "v", "left").select("u", F.coalesce("to", "v").alias("v"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")).groupBy("u", "v").agg(F.max("steps").alias("steps")))
    front = stage(every.join(needs.select("node"), "node", "left_anti").join(own_loop, "node", "left_anti").withColumn("level", F.lit(0)))
    out, best, turn = front, None, 0
    while rest.limit(1).count():
        hit = rest.join(front.select(F.col("node").alias("v"), "level"), "v").select(F.col("u").alias("node"), (F.col("level") + F.col("steps")).alias("level"))
        best = stage((hit if best is None else best.unionByName(hit)).groupBy("node").agg(F.max("level").alias("level")))
        rest = stage(rest.join(front.select(F.col("node").alias("v")), "v", "left_anti"))
        waits = rest.select(F.col("u").alias("node")).distinct()
        front, best = stage(best.join(waits, "node", "left_anti")), best.join(waits, "node", "left_semi")
        if not front.limit(1).count():
            break
        out, turn = out.unionByName(front), turn + 1
        out = stage(out) if turn % 32 == 0 else out  # keeps the plan short
    return out.unionByName(jump.join(out.withColumnRenamed("node", "to"), "to").select("node", (F.col("level") + F.col("steps")).alias("level")))
