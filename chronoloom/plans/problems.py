"""Queries of the general problems 1, 2, 5 and 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import grid, hierarchy, intervals, series, spikes
from chronoloom.plans.registry import Registry
from chronoloom.session import table

problems = Registry()

_SLOTS = """
r AS (SELECT DISTINCT s.signal_id, s.axis_id, s.spec_type, s.n_values FROM signals s),
o AS (SELECT r.signal_id, k.step_us, unnest(a.time_offsets[1:coalesce(r.n_values, len(a.time_offsets))]) t
      FROM r JOIN axes a ON a.axis_id = r.axis_id AND a.axis_type = 'irregular' JOIN spec_refs k ON k.spec_type = r.spec_type),
k AS (SELECT signal_id, step_us, (t - ((t % step_us) + step_us) % step_us) // step_us slot, count(*) n FROM o WHERE t IS NOT NULL GROUP BY ALL),
b AS (SELECT signal_id, step_us, min(slot) a, max(slot) z FROM k GROUP BY ALL),
g AS (SELECT signal_id, step_us, unnest(range(a, z + 1)) slot FROM b)
"""

_GAPS = """
v AS (SELECT DISTINCT object_type, object_id, start_us s, end_us e FROM annotation_occurrences
      WHERE span_type = 'time_interval' AND object_id IS NOT NULL AND start_us < end_us),
w AS (SELECT *, max(e) OVER (PARTITION BY object_type, object_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM v)
"""

_TREE = """
n AS (SELECT DISTINCT source_id, parent_source_id p FROM sources),
up AS (SELECT source_id, [source_id] way FROM n WHERE p IS NULL
       UNION ALL SELECT n.source_id, list_append(up.way, n.source_id) FROM up JOIN n ON n.p = up.source_id)
"""


@problems.add("p1_found", f"WITH {_SLOTS} SELECT g.signal_id, g.slot * g.step_us slot_start_us FROM g ANTI JOIN k USING (signal_id, slot)")
def p1_found(spark, d):
    cells = grid.regular_grid(table(spark, d, "signals"), table(spark, d, "axes"), table(spark, d, "spec_refs"))
    return grid.empty_slots(cells)


@problems.add(
    "p1_grid_counts",
    f"WITH {_SLOTS} SELECT g.signal_id, count(*) n_slots, count(k.slot) n_observed, sum(coalesce(k.n, 0))::BIGINT n_readings FROM g LEFT JOIN k USING (signal_id, slot) GROUP BY 1",
)
def p1_grid_counts(spark, d):
    cells = grid.regular_grid(table(spark, d, "signals"), table(spark, d, "axes"), table(spark, d, "spec_refs"))
    return cells.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("n_slots"), F.count(F.when(F.col("state") == "observed", 1)).alias("n_observed"), F.sum("n_readings").alias("n_readings")
    )


@problems.add("p1_filled")
def p1_filled(spark, d):
    """Every slot with its state and value: stored values where a signal has chunks, the place within the slot elsewhere."""
    stored = series.long_form(series.chunks(table(spark, d, "shard"))).select("signal_id", F.col("step").alias("position"), "value")
    axes, signals = table(spark, d, "axes"), table(spark, d, "signals")
    irregular = signals.join(axes.where("axis_type = 'irregular'").select("axis_id"), "axis_id", "left_semi").select("signal_id")
    stored = stored.join(irregular, "signal_id", "left_semi")
    cells = grid.regular_grid(signals, axes, table(spark, d, "spec_refs"), grid.values_or_places(signals, axes, table(spark, d, "spec_refs"), stored))
    return cells.select("signal_id", "slot_start_us", "state", F.round("value", 6).alias("value"))


@problems.add("p1_fill_error")
def p1_fill_error(spark, d):
    """Error of the estimates over held-out observed cells, beside that of the mean of the row."""
    e = grid.fill_errors(table(spark, d, "signals"), table(spark, d, "axes"), table(spark, d, "spec_refs"))
    return e.select("spec_type", "n_cells", F.round("rmse", 6).alias("rmse"), F.round("mean_rmse", 6).alias("mean_rmse"))


@problems.add("p2_found", f"WITH {_GAPS} SELECT object_type, object_id, r gap_start_us, s gap_end_us FROM w WHERE s > r")
def p2_found(spark, d):
    lists = intervals.interval_lists(intervals.time_intervals(table(spark, d, "annotation_occurrences")))
    return intervals.gaps(lists)


@problems.add(
    "p2_periods",
    f"""WITH {_GAPS}, i AS (SELECT *, sum(CASE WHEN r >= s THEN 0 ELSE 1 END) OVER (PARTITION BY object_type, object_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM w)
    SELECT object_type, object_id, min(s) period_start_us, max(e) period_end_us FROM i GROUP BY object_type, object_id, g""",
)
def p2_periods(spark, d):
    return intervals.periods(intervals.interval_lists(intervals.time_intervals(table(spark, d, "annotation_occurrences"))))


@problems.add("p5_found")
def p5_found(spark, d):
    found = spikes.implausible(table(spark, d, "shard"), table(spark, d, "spec_refs"))
    return found.select("signal", "chunk_idx", "value_idx").distinct()


@problems.add("p5_by_signal")
def p5_by_signal(spark, d):
    found = spikes.implausible(table(spark, d, "shard"), table(spark, d, "spec_refs"))
    return found.groupBy("signal").agg(*[F.count_if(F.col(k)).alias(f"n_{k}") for k in ("out_of_range", "spike", "stuck")])


@problems.add(
    "p6_found",
    f"""WITH RECURSIVE {_TREE},
    walk AS (SELECT source_id, p here, 1 d, [source_id] seen FROM n WHERE source_id NOT IN (SELECT source_id FROM up)
             UNION ALL SELECT w.source_id, n.p, d + 1, list_append(seen, w.here) FROM walk w JOIN n ON n.source_id = w.here WHERE NOT list_contains(seen, w.here)),
    f AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY d DESC) = 1)
    SELECT source_id, CASE WHEN here NOT IN (SELECT source_id FROM n) THEN 'lost_parent' WHEN here = source_id THEN 'on_cycle' ELSE 'under_cycle' END fault,
           CASE WHEN here NOT IN (SELECT source_id FROM n) THEN here ELSE list_min(seen[list_position(seen, here):]) END end_id FROM f""",
)
def p6_found(spark, d):
    return hierarchy.faults(hierarchy.resolve(table(spark, d, "sources"), paths=False))


@problems.add(
    "p6_paths",
    f"""WITH RECURSIVE {_TREE} SELECT source_id, way[1] root_id, len(way) - 1 depth, array_to_string(way, '/') path,
    coalesce((SELECT count(*) FROM up u WHERE list_contains(u.way, up.source_id)), 1) - 1 n_descendants FROM up""",
)
def p6_paths(spark, d):
    r = hierarchy.resolve(table(spark, d, "sources")).where(F.col("path").isNotNull())
    return r.select(F.col("node_id").alias("source_id"), "root_id", F.col("depth").cast("long").alias("depth"), F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), "n_descendants")


@problems.add("p6_descendants", f"WITH RECURSIVE {_TREE}, x AS (SELECT source_id, way, unnest(range(1, len(way))) i FROM up) SELECT way[i] ancestor_id, source_id, len(way) - i distance FROM x")
def p6_descendants(spark, d):
    return hierarchy.descendants(hierarchy.resolve(table(spark, d, "sources"))).select("ancestor_id", F.col("node_id").alias("source_id"), F.col("distance").cast("long").alias("distance"))
