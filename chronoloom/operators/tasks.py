"""References of tasks, ids of streams of tasks, annotation batches and message rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import numbered


MOST_CONTENTS = 10_000  #: contents that are attached to every target at once


def references(refs: DataFrame, key: str = "task_id", value: str = "record_id", position: str = "position") -> DataFrame:
    """Each reference of a task once, at its first position."""
    return refs.groupBy(key, value).agg(F.min(position).alias(position))


def needed(tasks: DataFrame, refs: DataFrame, links: DataFrame) -> DataFrame:
    """Records that a set of tasks needs, with those of everything that they derive from (``links``: u derived from v)."""
    from chronoloom.operators.graph import reachable

    every = reachable(tasks.select(F.col("task_id").alias("node")), links).select(F.col("node").alias("task_id"))
    return refs.join(every, "task_id", "left_semi").select("record_id").distinct()


def stream_ids(rows: DataFrame, order: str, base: int, block: int = 100_000) -> DataFrame:
    """Adds ``task_id``: base plus place in the order of ``order`` (from 1), the same on every pass. The place is a running
    count in two levels, so no task ever sorts the whole stream."""
    from chronoloom.session import prefix_sum

    r = rows.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    return prefix_sum(r, ["_all"], order, "_one", "_before", block).withColumn("task_id", F.col("_before") + F.lit(base + 1)).drop("_one", "_all", "_before")


def annotate(targets: DataFrame, contents: DataFrame, windows: DataFrame, key: str = "object_id") -> DataFrame:
    """One occurrence per target and content, all or nothing: a span outside its target's window refuses the batch.

    ``contents`` is the fixed list of what is attached (``content_id, start_us, end_us``); ``windows`` has ``start_us, end_us``
    by target.
    """
    if contents.limit(MOST_CONTENTS + 1).count() > MOST_CONTENTS:
        raise ValueError(f"more than {MOST_CONTENTS} contents for every target")
    w = windows.select(key, F.col("start_us").alias("_ws"), F.col("end_us").alias("_we"))
    rows = targets.select(key).distinct().join(w, key, "left").crossJoin(F.broadcast(contents))  # at most MOST_CONTENTS rows
    bad = rows.where(F.col("start_us").isNotNull() & ~F.coalesce((F.col("start_us") >= F.col("_ws")) & (F.col("end_us") <= F.col("_we")), F.lit(False)))
    if bad.limit(1).count():
        raise ValueError("a span lies outside its target's window; nothing is attached")
    return rows.drop("_ws", "_we")


def add_batch(held: DataFrame, batch: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``held`` with the batch, ids assigned after the highest held one in the batch's own order; ``rules`` are violations
    and must be empty."""
    first = rules.limit(1).collect()
    if first:
        raise ValueError(f"the batch is refused: {first[0].asDict()}")
    last = held.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).head()["m"]
    fresh = numbered(batch, ["position"], key, last + 1).withColumn(key, F.col(key).cast("long")).drop("position")
    return held.unionByName(fresh, allowMissingColumns=True)


def role_order(roles: Column, contents: Column, wanted: list[str]) -> Column:
    """Whether messages have exactly the wanted roles in order and none is blank."""
    return (roles == F.array(*[F.lit(r) for r in wanted])) & F.forall(contents, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))


def fill_numbered(template: Column, values: Column) -> Column:
    """``{1}, {2}, ...`` in a template replaced by the values of an array; a number without a value stays as it is."""
    parts = F.regexp_extract_all(template, F.lit(r"([^{]+|\{[0-9]+\}|\{)"))
    def one(p: Column) -> Column:
        n = F.regexp_extract(p, r"^\{([0-9]+)\}$", 1)
        return F.when(n != "", F.coalesce(F.try_element_at(values, n.try_cast("int")), p)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")
