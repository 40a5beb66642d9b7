"""Overlapping and gapped intervals per entity: continuous periods and the gaps between them.

The aggregate state is a sorted list of disjoint intervals, and two states combine by a linear merge. Batches build
small states before the exchange; rows are then range-partitioned by (entity, start), so that an entity with a third
of all rows spreads over many tasks; inside a task states combine in a binary reduction tree; across tasks only the
outermost bounds of an entity's states travel (one row per task that holds part of the entity).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import stage


class IntervalList:
    """Sorted, disjoint, non-touching half-open intervals. ``merge`` is associative and commutative."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        self.start, self.end = start, end

    @classmethod
    def of(cls, start: np.ndarray, end: np.ndarray) -> IntervalList:
        order = np.argsort(start, kind="stable")
        return cls._close(start[order], end[order])

    @classmethod
    def _close(cls, start: np.ndarray, end: np.ndarray) -> IntervalList:
        """Join what overlaps or touches; ``start`` is sorted."""
        if len(start) < 2:
            return cls(start, end)
        reach = np.maximum.accumulate(end)
        new = np.r_[True, start[1:] > reach[:-1]]
        first = np.flatnonzero(new)
        return cls(start[first], reach[np.r_[first[1:] - 1, len(start) - 1]])

    def merge(self, other: IntervalList) -> IntervalList:
        """Linear merge of two sorted lists."""
        n, m = len(self.start), len(other.start)
        at = np.searchsorted(self.start, other.start, side="right") + np.arange(m)
        mask = np.zeros(n + m, bool)
        mask[at] = True
        start, end = np.empty(n + m, np.int64), np.empty(n + m, np.int64)
        start[mask], start[~mask], end[mask], end[~mask] = other.start, self.start, other.end, self.end
        return self._close(start, end)


def tree(states: list[IntervalList]) -> IntervalList:
    """Combine states pairwise until one is left."""
    while len(states) > 1:
        states = [a.merge(b) for a, b in zip(states[::2], states[1::2])] + (states[-1:] if len(states) % 2 else [])
    return states[0]


def _runs(kind: np.ndarray, ident: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (ident[1:] != ident[:-1])])


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of one batch: fewer rows enter the exchange where intervals of an entity overlap."""
    for b in batches:
        if not b.num_rows:
            continue
        kinds = b.column(0).dictionary_encode()
        names, kind = kinds.dictionary, kinds.indices.to_numpy(zero_copy_only=False)
        ident, start, end = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        order = np.lexsort((start, ident, kind))
        kind, ident, start, end = kind[order], ident[order], start[order], end[order]
        k, i, s, e = [], [], [], []
        first = _runs(kind, ident)
        for a, z in zip(first, np.r_[first[1:], len(kind)]):
            x = IntervalList._close(start[a:z], end[a:z])
            k.append(np.full(len(x.start), kind[a])), i.append(np.full(len(x.start), ident[a])), s.append(x.start), e.append(x.end)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(k))), *(pa.array(np.concatenate(v)) for v in (i, s, e))], names=b.schema.names)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per entity of the task; its rows arrive sorted by entity and start, batch by batch."""
    out_names = ["object_type", "object_id", "starts", "ends"]
    key, states = None, []

    def emit(key, states):
        x = tree(states)
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([x.start], pa.list_(pa.int64())), pa.array([x.end], pa.list_(pa.int64()))], names=out_names)

    rows = []
    for b in batches:
        if not b.num_rows:
            continue
        kinds = b.column(0).dictionary_encode()
        names, kind = kinds.dictionary.to_pylist(), kinds.indices.to_numpy(zero_copy_only=False)
        ident, start, end = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        first = _runs(kind, ident)
        for a, z in zip(first, np.r_[first[1:], len(kind)]):
            k = (names[kind[a]], int(ident[a]))
            if k != key:
                if states:
                    rows.append(emit(key, states))
                key, states = k, []
            states.append(IntervalList._close(start[a:z], end[a:z]))
        if rows:
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
            rows = []
    if states:
        yield emit(key, states)


def interval_lists(rows: DataFrame) -> DataFrame:
    """States by entity and range task: ``object_type, object_id, starts, ends, first_us, reach_us, next_us`` where ``reach_us`` is
    the furthest end of the entity's earlier states (null for its first) and ``next_us`` the first start of the next one.

    ``rows`` has ``object_type, object_id, start_us, end_us``. A row counts if its type, id and bounds are not null and
    start < end.
    """
    cols = ["object_type", "object_id", "start_us", "end_us"]
    rows = rows.select(*cols).where(F.col("object_type").isNotNull() & F.col("object_id").isNotNull() & (F.col("start_us") < F.col("end_us")))
    rows = stage(rows.mapInArrow(_shrink, rows.schema))  # the bounds of ranges are found by running what lies before
    rows = rows.repartitionByRange("object_type", "object_id", "start_us").sortWithinPartitions("object_type", "object_id", "start_us")
    lists = rows.mapInArrow(_lists, "object_type string, object_id long, starts array<long>, ends array<long>")
    lists = lists.withColumn("first_us", F.element_at("starts", 1)).withColumn("last_us", F.element_at("ends", -1))
    w = Window.partitionBy("object_type", "object_id").orderBy("first_us", "last_us")
    return lists.withColumn("reach_us", F.max("last_us").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next_us", F.lead("first_us").over(w)).drop("last_us")


def gaps(lists: DataFrame) -> DataFrame:
    """``object_type, object_id, gap_start_us, gap_end_us``: the complements of an entity's states."""
    # an earlier state may reach into this one: every end counts at least as much as that reach
    e = F.expr("transform(ends, x -> greatest(x, coalesce(reach_us, x)))")
    between = F.expr("zip_with(concat(array(reach_us), slice(e, 1, size(e) - 1)), starts, (a, b) -> struct(a as gap_start_us, b as gap_end_us))")
    return (
        lists.withColumn("e", e)
        .select("object_type", "object_id", F.explode(F.filter(between, lambda g: g["gap_start_us"] < g["gap_end_us"])).alias("g"))
        .select("object_type", "object_id", "g.gap_start_us", "g.gap_end_us")
    )


def periods(lists: DataFrame) -> DataFrame:
    """``object_type, object_id, period_start_us, period_end_us``: what the intervals of an entity cover without a break.

    A state's inner periods are final; only its first and last one can go on in a neighbour. These pieces are put
    together in a window of at most two rows per state.
    """
    e = F.expr("transform(ends, x -> greatest(x, coalesce(reach_us, x)))")
    flat = (
        lists.withColumn("e", e)
        .withColumn("p", F.expr("transform(sequence(1, size(starts)), i -> struct(element_at(starts, i) as s, element_at(e, i) as t, element_at(ends, i) > coalesce(reach_us, element_at(ends, i) - 1) as adds, if(i = 1, reach_us, element_at(e, i - 1)) as reach, if(i = size(starts), next_us, element_at(starts, i + 1)) as next))"))
        .select("object_type", "object_id", F.explode("p").alias("p"))
        .select("object_type", "object_id", "p.*")
        .where("adds")  # what an earlier interval swallows whole adds nothing
        .drop("adds")
    )
    goes_on = F.coalesce(F.col("reach") >= F.col("s"), F.lit(False))
    is_cut = F.coalesce(F.col("next") <= F.col("t"), F.lit(False))
    whole = flat.where(~goes_on & ~is_cut).select("object_type", "object_id", F.col("s").alias("period_start_us"), F.col("t").alias("period_end_us"))
    parts = flat.where(goes_on | is_cut).withColumn("new", (~goes_on).cast("int"))
    w = Window.partitionBy("object_type", "object_id").orderBy("s", "t")
    joined = (
        parts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("object_type", "object_id", "island")
        .agg(F.min("s").alias("period_start_us"), F.max("t").alias("period_end_us"))
        .drop("island")
    )
    return whole.unionByName(joined)


def time_intervals(occurrences: DataFrame) -> DataFrame:
    """The rows of ``annotation_occurrences`` that place an interval in time on an object."""
    return occurrences.where(F.col("span_type") == "time_interval").select("object_type", "object_id", "start_us", "end_us")
