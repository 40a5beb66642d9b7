"""Parent-child rows to full hierarchies: path, depth, root, descendants, and the nodes that reach no root.

Components are found first; each one is put where it lies together and walked depth-first with colours. A walk keeps a few
numbers per node; paths, which are as many cells as the depths sum up to, are only made on demand and leave in batches of
bounded size, so a chain costs memory by its nodes and not by their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.components import connected_components
from chronoloom.session import stage, unstage

TASK_ROWS = 50_000  #: nodes of a task, about; a component is never torn
WALK_ROWS = 20_000  #: nodes of small components that are walked together
BATCH_CELLS = 1_000_000  #: cells of paths in a batch

COLUMNS = "node_id long, parent_id long, root_id long, depth int, n_descendants long, fault string, end_id long, ring_at int"
NODES = f"{COLUMNS}, path array<long>"


def parents_of(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """``node_id, parent_id, other_parent`` once per node. Null node ids are left out. Rows of one node that differ give the
    smallest parent and the largest one."""
    r = rows.where(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("node_id"), F.col(parent).cast("long").alias("parent_id"))
    r = r.groupBy("node_id").agg(F.min("parent_id").alias("parent_id"), F.max("parent_id").alias("other_parent"))
    return r.withColumn("other_parent", F.when(F.col("other_parent") != F.col("parent_id"), F.col("other_parent")))


WHITE, GREY, BLACK = 0, 1, 2


class Walk:
    """Whole components, walked depth-first. White nodes are unseen, grey ones on the stack, black ones done.

    The way up from a white node is followed until it ends at a root or at a black node; a grey one closes a cycle: the link
    into it is a back edge, and the stack from there on is the cycle. Nodes then leave the stack from the top of the tree
    down, each taking its depth, root or fault from its parent.
    """

    def __init__(self, ids: np.ndarray, parents: np.ndarray, has_parent: np.ndarray, others: np.ndarray, has_other: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, self.parents, self.has_parent = ids[order], parents[order], has_parent[order]
        others, has_other = others[order], has_other[order]
        n = len(ids)
        at = np.minimum(np.searchsorted(self.ids, self.parents), n - 1)
        known = self.has_parent & (self.ids[at] == self.parents)
        up = np.where(known, at, -1).tolist()
        colour, depth, root = [WHITE] * n, [0] * n, [-1] * n
        fault: list[str | None] = [None] * n
        end = [0] * n
        ring_at: list[int | None] = [None] * n
        finished: list[int] = []
        self.back_edges: list[tuple[int, int]] = []
        two = has_other.tolist()
        lost = (self.has_parent & ~known).tolist()
        for start in range(n):
            if colour[start] != WHITE:
                continue
            stack = []
            now = start
            while now >= 0 and colour[now] == WHITE:
                colour[now] = GREY
                stack.append(now)
                now = -1 if two[now] else up[now]
            if now >= 0 and colour[now] == GREY:
                self.back_edges.append((int(self.ids[stack[-1]]), int(self.ids[now])))
                ring = stack[stack.index(now) :]
                least = int(self.ids[min(ring)])
                for x in ring:
                    fault[x], end[x], colour[x] = "on_cycle", least, BLACK
                turn = ring.index(min(ring))
                for at, x in enumerate(ring[turn:] + ring[:turn]):
                    ring_at[x] = at
                finished.extend(reversed(ring))
                del stack[len(stack) - len(ring) :]
            while stack:
                x = stack.pop()
                p = up[x]
                if two[x]:
                    fault[x], end[x] = "two_parents", int(others[x])
                elif lost[x]:
                    fault[x], end[x] = "lost_parent", int(self.parents[x])
                elif p < 0:
                    root[x] = x
                elif fault[p] is None:
                    root[x], depth[x] = root[p], depth[p] + 1
                elif fault[p] == "two_parents":
                    fault[x], end[x] = "under_two_parents", int(self.ids[p])
                else:
                    fault[x], end[x] = "under_cycle" if fault[p] == "on_cycle" else fault[p], end[p]
                colour[x] = BLACK
                finished.append(x)
        below = [0] * n
        for x in reversed(finished):  # children come before their parents
            if up[x] >= 0 and fault[x] != "on_cycle" and not two[x]:
                below[up[x]] += below[x] + 1
        rings: dict[int, list[int]] = {}
        for x in finished:
            if fault[x] == "on_cycle":
                rings.setdefault(end[x], []).append(x)
        for ring in rings.values():  # all of a cycle lies below each of its nodes
            total = len(ring) + sum(below[x] for x in ring)
            for x in ring:
                below[x] = total - 1
        self.up, self.depth, self.root, self.fault, self.end, self.below, self.ring_at = up, depth, root, fault, end, below, ring_at

    def batches(self, paths: bool) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        rooted = np.array([f is None for f in self.fault], bool)
        depth = np.array(self.depth, np.int64)
        cells = np.where(rooted, depth + 1, 0) if paths else np.zeros(n, np.int64)
        piece = np.cumsum(cells) // BATCH_CELLS
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), n]
        root = self.ids[np.array(self.root, np.int64)]
        for a, z in zip(cuts, cuts[1:]):
            r = rooted[a:z]
            out = [
                pa.array(self.ids[a:z]), pa.array(self.parents[a:z], mask=~self.has_parent[a:z]), pa.array(root[a:z], mask=~r), pa.array(depth[a:z].astype(np.int32), mask=~r),
                pa.array(self.below[a:z], pa.int64()), pa.array(self.fault[a:z], pa.string()), pa.array(np.array(self.end[a:z], np.int64), mask=r), pa.array(self.ring_at[a:z], pa.int32()),
            ]
            names = ["node_id", "parent_id", "root_id", "depth", "n_descendants", "fault", "end_id", "ring_at"]
            if paths:
                ways = []
                for x in range(a, z):
                    way = None
                    if rooted[x]:
                        way, now = [], x
                        while now >= 0:
                            way.append(now)
                            now = self.up[now]
                        way = self.ids[way[::-1]]
                    ways.append(way)
                out.append(pa.array(ways, pa.list_(pa.int64())))
                names.append("path")
            yield pa.RecordBatch.from_arrays(out, names=names)


def _walked(paths: bool):
    """Walks the components of a task in turn; its rows are sorted by component."""
    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            parent, other = t.column("parent_id"), t.column("other_parent")
            yield from Walk(t.column("node_id").to_numpy(), parent.fill_null(0).to_numpy(), parent.is_valid().to_numpy(), other.fill_null(0).to_numpy(), other.is_valid().to_numpy()).batches(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < WALK_ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            component = t.column("component").to_numpy()
            cut = int(np.searchsorted(component, component[-1]))  # the last component may go on in the next batch
            if cut:
                yield from flush(t.slice(0, cut).to_batches())
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from flush(held)

    return run


def resolve(rows: DataFrame, node: str = "source_id", parent: str = "parent_source_id", paths: bool = True) -> DataFrame:
    """``node_id, parent_id, root_id, depth, n_descendants, fault, end_id, ring_at`` and, with ``paths``, ``path``; one row per node.

    A node with a null parent is a root (depth 0, path [node]). ``fault`` tells why a node reaches no root: ``on_cycle``
    and ``under_cycle`` (end_id the smallest node on the cycle), ``lost_parent`` (end_id the parent that isn't there), or
    ``two_parents`` (rows of the node name different ones; end_id the larger) and ``under_two_parents`` (end_id the node
    above that has them); path, depth and root are null then. ``ring_at`` is the place of a node
    on its cycle, from its smallest node up by parents. Rows sent twice count once, null node ids are left out, and
    an empty table gives no rows. Components are found when this is called; the walk is lazy.
    """
    nodes = stage(parents_of(rows, node, parent))
    links = nodes.select(F.col("node_id").alias("u"), F.coalesce("parent_id", "node_id").alias("v"))
    both = nodes.where("other_parent is not null").select(F.col("node_id").alias("u"), F.col("other_parent").alias("v"))
    member = stage(nodes.join(connected_components(links.unionByName(both)), nodes["node_id"] == F.col("node")).select("node_id", "parent_id", "other_parent", "component"))
    unstage(nodes)
    tasks = max(1, -(-member.count() // TASK_ROWS), min(member.sparkSession.sparkContext.defaultParallelism, member.count() // 1000))
    return member.repartition(tasks, "component").sortWithinPartitions("component").mapInArrow(_walked(paths), NODES if paths else COLUMNS)


def descendants(resolved: DataFrame) -> DataFrame:
    """``ancestor_id, node_id, distance``: every descendant of every node that reaches a root (long, not nested: a root's
    list has no bound)."""
    return (
        resolved.where(F.col("path").isNotNull())
        .select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
        .where(F.col("at") < F.col("depth"))
        .select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))
    )


def faults(resolved: DataFrame) -> DataFrame:
    """``source_id, fault, end_id`` of the nodes that reach no root."""
    return resolved.where(F.col("fault").isNotNull()).select(F.col("node_id").alias("source_id"), "fault", "end_id")
