"""Irregular readings onto a regular grid.

Slots come from integer arithmetic on the offsets, all inside one row, so the only exchange is the join of signals
and axes. Cells are then filled by alternating least squares on source-by-time matrices, one bounded tile (at most
about ``tile_rows`` signals x ``tile_slots`` slots) per task group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_SLOTS = 256
TILE_ROWS = 256
PIECE = 65_536  #: slots of a gap that are unfolded at a time
SUPPORT = 2  #: observed cells that the row and the column of a cell need for the cell to be filled


def reading_slots(signals: DataFrame, axes: DataFrame, specs: DataFrame) -> DataFrame:
    """Per signal on an irregular axis: ``signal_id, spec_type, step_us, offsets`` with the offsets that are readings.

    Only the first ``n_values`` positions of ``time_offsets`` are readings (all of them if ``n_values`` is null or
    larger), and one with a null offset has no time. A signal sent twice counts once. Signals without an axis, spec
    or time are left out.
    """
    s = signals.select("signal_id", "axis_id", "spec_type", "n_values").where(F.col("signal_id").isNotNull()).distinct()
    a = axes.where(F.col("axis_type") == "irregular").select("axis_id", "time_offsets").where(F.size("time_offsets") > 0).dropDuplicates(["axis_id"])
    k = specs.where(F.col("step_us") > 0).select("spec_type", F.col("step_us").cast("long").alias("step_us")).dropDuplicates(["spec_type"])
    n = F.greatest(F.least(F.coalesce(F.col("n_values"), F.size("time_offsets").cast("long")), F.size("time_offsets").cast("long")), F.lit(0)).cast("int")
    return (
        s.join(k, "spec_type")
        .join(a, "axis_id")
        .select("signal_id", "spec_type", "step_us", F.slice("time_offsets", F.lit(1), n).alias("offsets"))
    )


def grid_cells(readings: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """``signal_id, spec_type, step_us, slot, n_readings, value``: every slot between the first and last one read.

    ``value`` is the mean of the finite stored values of the slot's readings where ``values``
    (``signal_id, position, value``) has them, else the mean place of its readings within the slot (0 to 1), which is
    what an axis alone tells. It is null for slots without readings.
    """
    t = F.posexplode("offsets").alias("position", "offset_us")
    long = readings.select("signal_id", "spec_type", "step_us", t).where(F.col("offset_us").isNotNull())
    rest = F.expr("pmod(offset_us, step_us)")
    long = long.withColumn("slot", F.expr("(offset_us - pmod(offset_us, step_us)) div step_us")).withColumn("place", rest / F.col("step_us"))
    if values is None:
        long = long.withColumn("value", F.lit(None).cast("double"))
    else:
        v = values.select("signal_id", F.col("position").cast("int").alias("position"), F.col("value").cast("double").alias("value"))
        long = long.join(v, ["signal_id", "position"], "left")
        long = long.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))
    seen = long.groupBy("signal_id", "spec_type", "step_us", "slot").agg(
        F.count(F.lit(1)).alias("n_readings"), F.avg("value").alias("value"), F.avg("place").alias("place")
    )
    # slots without a reading: between a slot and the next one that has any, in one row
    slots = F.array_sort(F.array_distinct(F.expr("transform(filter(offsets, x -> x is not null), x -> (x - pmod(x, step_us)) div step_us)")))
    gaps = (
        readings.select("signal_id", "spec_type", "step_us", slots.alias("s"))
        .select("signal_id", "spec_type", "step_us", F.explode(F.expr("filter(zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)), (a, b) -> struct(a, b)), p -> p.b - p.a > 1)")).alias("p"))
        # a gap can be long: it is unfolded in pieces, so no row holds all of its slots
        .select("signal_id", "spec_type", "step_us", "p", F.explode(F.expr(f"sequence(0L, (p.b - p.a - 2) div {PIECE})")).alias("piece"))
        .select("signal_id", "spec_type", "step_us", F.explode(F.expr(f"sequence(p.a + 1 + piece * {PIECE}, least(p.b - 1, p.a + (piece + 1) * {PIECE}))")).alias("slot"))
        .withColumn("n_readings", F.lit(0).cast("long"))
        .withColumn("value", F.lit(None).cast("double"))
    )
    seen = seen.withColumn("value", F.coalesce("value", "place") if values is None else F.col("value")).drop("place")
    return seen.unionByName(gaps)


def als(matrix: np.ndarray, rank: int = 3, rounds: int = 8, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank estimate of ``matrix`` (NaN is missing) by alternating least squares, and which cells have support.

    Rows are centred and scaled by their own observed cells; a factor step solves one small ridge system per row or
    column, all at once. A cell has support if its row and its column have ``SUPPORT`` observed cells at least.
    """
    seen = np.isfinite(matrix)
    w = seen.astype(float)
    x = np.where(seen, matrix, 0.0)
    n = np.maximum(w.sum(1, keepdims=True), 1)
    mean = x.sum(1, keepdims=True) / n
    scale = np.sqrt((w * (x - mean) ** 2).sum(1, keepdims=True) / n)
    scale[scale == 0] = 1.0
    z = np.where(seen, (x - mean) / scale, 0.0)
    support = (seen.sum(1) >= SUPPORT)[:, None] & (seen.sum(0) >= SUPPORT)[None, :]
    if rank == 0:
        return np.broadcast_to(mean, matrix.shape), support
    rank = min(rank, *matrix.shape)
    cols = np.cos(np.outer(np.arange(matrix.shape[1]) + 0.5, np.arange(rank)) * np.pi / matrix.shape[1])
    eye = ridge * np.eye(rank)

    def squares(weight: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Per row of ``weight`` the weighted sum of the factor's outer products."""
        return (weight @ (factor[:, :, None] * factor[:, None, :]).reshape(len(factor), -1)).reshape(-1, rank, rank)

    for _ in range(rounds):
        rows = np.linalg.solve(squares(w, cols) + eye, (z @ cols)[..., None])[..., 0]
        cols = np.linalg.solve(squares(w.T, rows) + eye, (z.T @ rows)[..., None])[..., 0]
    return (rows @ cols.T) * scale + mean, support


RANKS = (3, 0)  #: ranks that are tried; 0 is the mean of the row
GAIN = 0.9  #: share of the mean's error that a rank must stay below to be taken
HELD_OUT = 8  #: one observed cell in so many is held out to choose the rank by


def held_out(cells: np.ndarray, turn: int = 0) -> np.ndarray:
    """A fixed, scattered eighth of the cells (by a hash of their numbers)."""
    mixed = (cells.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)) % np.uint64(HELD_OUT) == 0


def estimate(matrix: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """As ``als``, at the rank that tells held-out observed cells best, so that cells which have nothing in common across
    sources get the mean of their row, and no worse."""
    seen = np.isfinite(matrix)
    out = seen & held_out(np.arange(matrix.size), turn).reshape(matrix.shape)
    rank = RANKS[-1]
    if out.any() and (seen & ~out).any():
        left = np.where(out, np.nan, matrix)
        error = {}
        for r in RANKS:
            fit, support = als(left, r, rounds=4)
            use = out & support
            error[r] = float(((fit - matrix)[use] ** 2).sum()) if use.any() else np.inf
        best = min(RANKS, key=lambda r: (error[r], r))
        rank = best if error[best] < GAIN * error[0] else 0
    return als(matrix, rank)


def _cells(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a tile, put together where several rows tell of one: ids, slots, cell numbers, readings, values, matrix."""
    ids, r = np.unique(tile.column("signal_id").to_numpy(), return_inverse=True)
    slots, c = np.unique(tile.column("slot").to_numpy(), return_inverse=True)
    cell, at = np.unique(r * len(slots) + c, return_inverse=True)
    n = np.bincount(at, weights=tile.column("n_readings").to_numpy()).astype(np.int64)
    value = tile.column("value").to_numpy()
    known = np.isfinite(value)
    count = np.bincount(at, weights=known)
    value = np.bincount(at, weights=np.where(known, value, 0.0)) / np.where(count > 0, count, np.nan)
    matrix = np.full(len(ids) * len(slots), np.nan)
    matrix[cell] = value
    return ids, slots, cell, n, value, matrix.reshape(len(ids), len(slots))


def _errors(tile: pa.Table) -> pa.Table:
    """Of one tile: squared errors of the estimate, and of the mean of the row, over observed cells held out from both."""
    _, _, _, _, _, matrix = _cells(tile)
    out = np.isfinite(matrix) & held_out(np.arange(matrix.size), 1).reshape(matrix.shape)
    left = np.where(out, np.nan, matrix)
    n, of_fit, of_mean = 0, 0.0, 0.0
    if out.any() and np.isfinite(left).any():
        fit, support = estimate(left)
        mean, _ = als(left, 0)
        use = out & support
        n, of_fit, of_mean = int(use.sum()), float(((fit - matrix)[use] ** 2).sum()), float(((mean - matrix)[use] ** 2).sum())
    return pa.table({"spec_type": [tile.column("spec_type")[0].as_py()], "n": pa.array([n], pa.int64()), "of_fit": [of_fit], "of_mean": [of_mean]})


def _fill(tile: pa.Table) -> pa.Table:
    """One tile: the empty cells are filled where they have support."""
    ids, slots, cell, n, value, matrix = _cells(tile)
    empty = n == 0
    filled = np.zeros(len(cell), bool)
    if empty.any() and np.isfinite(matrix).any():
        fit, support = estimate(matrix)
        filled = empty & support.reshape(-1)[cell]
        value = np.where(filled, fit.reshape(-1)[cell], value)
    state = pa.DictionaryArray.from_arrays(pa.array(np.where(~empty, 0, np.where(filled, 1, 2)), pa.int8()), ["observed", "filled", "missing"])
    return pa.table({
        "signal_id": ids[cell // len(slots)], "slot_start_us": slots[cell % len(slots)] * tile.column("step_us")[0].as_py(), "state": state.cast(pa.string()),
        "value": pa.array(value, from_pandas=True), "n_readings": n,
    })


def regular_grid(signals: DataFrame, axes: DataFrame, specs: DataFrame, values: DataFrame | None = None, tile_slots: int = TILE_SLOTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Regular series per irregular signal: ``signal_id, slot_start_us, state, value, n_readings``.

    ``state`` is ``observed`` (its value is kept exactly), ``filled`` (estimated by low-rank factorisation) or
    ``missing`` (no support, value null). Slot k covers [k*step, (k+1)*step). Empty tables give no rows; null ids,
    offsets, specs and extra columns are tolerated; a signal sent twice counts once; a signal with one slot read
    gives that slot. Two different rows of one signal_id are two sets of readings of the same signal.
    """
    out = "signal_id long, slot_start_us long, state string, value double, n_readings long"
    return _tiles(reading_slots(signals, axes, specs), values, tile_slots, tile_rows).applyInArrow(_fill, out)


def _tiles(readings: DataFrame, values: DataFrame | None, tile_slots: int, tile_rows: int):
    """The cells of a grid in groups of one tile each."""
    parts = readings.groupBy("spec_type").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias("parts"))
    cells = grid_cells(readings, values).join(F.broadcast(parts), "spec_type")  # one row per spec_type of the fixed spec table
    cells = cells.withColumn("tile", F.expr(f"(slot - pmod(slot, {tile_slots})) div {tile_slots}")).withColumn("part", F.expr("pmod(xxhash64(signal_id), parts)"))
    return cells.select("signal_id", "spec_type", "step_us", "slot", "n_readings", "value", "tile", "part").groupBy("spec_type", "tile", "part")


def fill_errors(signals: DataFrame, axes: DataFrame, specs: DataFrame, values: DataFrame | None = None, tile_slots: int = TILE_SLOTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``spec_type, n_cells, rmse, mean_rmse``: how far estimates of observed cells are off that were held out, and how far the
    mean of their row is. One cell in ``HELD_OUT`` of every tile."""
    e = _tiles(reading_slots(signals, axes, specs), values, tile_slots, tile_rows).applyInArrow(_errors, "spec_type string, n long, of_fit double, of_mean double")
    return e.groupBy("spec_type").agg(F.sum("n").alias("n_cells"), F.sqrt(F.sum("of_fit") / F.sum("n")).alias("rmse"), F.sqrt(F.sum("of_mean") / F.sum("n")).alias("mean_rmse")).where("n_cells > 0")


def values_or_places(signals: DataFrame, axes: DataFrame, specs: DataFrame, stored: DataFrame) -> DataFrame:
    """``signal_id, position, value`` of every reading: the stored value of a signal that has any, else its place in its slot."""
    long = reading_slots(signals, axes, specs).select("signal_id", "step_us", F.posexplode("offsets").alias("position", "offset_us")).where(F.col("offset_us").isNotNull())
    places = long.select("signal_id", "position", (F.expr("pmod(offset_us, step_us)") / F.col("step_us")).alias("value")).join(stored.select("signal_id").distinct(), "signal_id", "left_anti")
    return stored.select("signal_id", F.col("position").cast("int").alias("position"), F.col("value").cast("double").alias("value")).unionByName(places).dropDuplicates(["signal_id", "position"])


def empty_slots(grid: DataFrame) -> DataFrame:
    """The slots of a grid that no reading fell into."""
    return grid.where(F.col("state") != "observed").select("signal_id", "slot_start_us").distinct()
