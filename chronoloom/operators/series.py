"""Chunked values: scans, ranges, long form, slices and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import timeline as tl
from chronoloom.session import prefix_sum, previous


def chunks(shard: DataFrame) -> DataFrame:
    """``signal_id, chunk_idx, n_values, values`` of a shard, each chunk once, with the signal as a number."""
    s = shard.select(F.col("signal").cast("long").alias("signal_id"), "chunk_idx", F.size("values").alias("n_values"), "values")
    return s.where(F.col("signal_id").isNotNull() & F.col("chunk_idx").isNotNull() & F.col("values").isNotNull()).dropDuplicates(["signal_id", "chunk_idx"])


def with_base(c: DataFrame) -> DataFrame:
    """Adds ``base``: the step of a chunk's first value. Only ids and sizes are summed up, in two levels."""
    sizes = prefix_sum(c.select("signal_id", "chunk_idx", "n_values"), ["signal_id"], "chunk_idx", "n_values", "base")
    return c.join(sizes.select("signal_id", "chunk_idx", "base"), ["signal_id", "chunk_idx"])


def long_form(c: DataFrame) -> DataFrame:
    """``signal_id, step, value``: one row per value. Nulls and NaN stay apart."""
    return with_base(c).select("signal_id", "base", F.posexplode("values").alias("at", "value")).select("signal_id", (F.col("base") + F.col("at")).alias("step"), "value")


PART = 1 << 20  #: values of a part of a scan, about


def scan(c: DataFrame) -> DataFrame:
    """``signal_id, part, values``: whole series as arrays, chunks in order. A part holds the chunks that begin within ``PART``
    steps, so a series of any length is rows of bounded size and many tasks; short ones have part 0 only."""
    c = c if "base" in c.columns else with_base(c)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", "values")))
    return c.groupBy("signal_id", F.floor(F.col("base") / F.lit(PART)).alias("part")).agg(F.flatten(F.transform(ordered, lambda x: x["values"])).alias("values"))


def read_range(c: DataFrame, start: Column, stop: Column) -> DataFrame:
    """``signal_id, part, values`` of steps [start, stop), from the chunks that meet the range only, clipped. A stop past the
    end truncates; an empty range gives no row for the signal."""
    return scan(cut_chunks(with_base(c).where(start < stop), start, stop))


def cut_chunks(based: DataFrame, start: Column, stop: Column) -> DataFrame:
    """``signal_id, chunk_idx, base, values``: the chunks that meet steps [start, stop), clipped to them."""
    b = based.where((F.col("base") < stop) & (F.col("base") + F.col("n_values") > start))
    head = F.greatest(start - F.col("base"), F.lit(0)).cast("int")
    tail = F.least(stop - F.col("base"), F.col("n_values").cast("long")).cast("int")
    return b.select("signal_id", "chunk_idx", "base", F.slice("values", head + 1, tail - head).alias("values"))


def rechunk(c: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` values each (the last may be shorter): ``signal_id, chunk_idx, n_values, values``.
    Old chunks are sliced where the new ones begin; no value is a row of its own."""
    b = with_base(c).where("n_values > 0")
    end = F.col("base") + F.col("n_values")
    b = b.select("signal_id", "base", "values", end.alias("end"), F.explode(F.sequence(F.floor(F.col("base") / size), F.floor((end - 1) / size))).alias("to"))
    head = F.greatest(F.col("to") * size - F.col("base"), F.lit(0)).cast("int")
    tail = F.least((F.col("to") + 1) * size, F.col("end")) - F.col("base")
    pieces = b.select("signal_id", F.col("to").cast("int").alias("chunk_idx"), "base", F.slice("values", head + 1, tail.cast("int") - head).alias("values"))
    ordered = F.array_sort(F.collect_list(F.struct("base", "values")))
    out = pieces.groupBy("signal_id", "chunk_idx").agg(F.flatten(F.transform(ordered, lambda x: x["values"])).alias("values"))
    return out.select("signal_id", "chunk_idx", F.size("values").alias("n_values"), "values")


def chunk_length(value_bytes: Column, max_bytes: int) -> Column:
    """Values per chunk under a byte limit, at least one."""
    return F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / value_bytes)).cast("long")


def plan_chunks(signals: DataFrame, max_bytes: int, byte_sizes: dict[str, int]) -> DataFrame:
    """``signal_id, chunk_idx, start, stop`` without touching values."""
    width = F.coalesce(*[F.when(F.col("dtype") == k, F.lit(v)) for k, v in byte_sizes.items()])
    s = signals.select("signal_id", F.col("n_values").cast("long").alias("n"), chunk_length(width, max_bytes).alias("len")).where("n > 0")
    s = s.select("signal_id", "n", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("len")))).alias("chunk_idx"))
    return s.select("signal_id", "chunk_idx", (F.col("chunk_idx") * F.col("len")).alias("start"), F.least(F.col("n"), (F.col("chunk_idx") + 1) * F.col("len")).alias("stop"))


def axes_of(signals: DataFrame, axes: DataFrame) -> DataFrame:
    """Signals, each once, with the columns of their axis."""
    s = signals.select("signal_id", "source_id", "name", "axis_id", "spec_type", "n_values").dropDuplicates(["signal_id"])
    return s.join(axes.dropDuplicates(["axis_id"]), "axis_id")


def on_time(long: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds ``time_offset_us`` to long rows: computed on regular axes, looked up on irregular ones, null on ordinal ones."""
    offsets = placed.where("axis_type = 'irregular'").select("signal_id", F.posexplode("time_offsets").alias("step", "_offset")).withColumn("step", F.col("step").cast("long"))
    at = F.when(F.col("axis_type") == "regular", tl.offset_at(F.col("step"))).when(F.col("axis_type") == "irregular", F.col("_offset"))
    # a step looks up its own offset; the arrays stay where they are
    rows = long.join(placed.drop("time_offsets"), "signal_id").join(offsets, ["signal_id", "step"], "left")
    return rows.withColumn("time_offset_us", at).drop("_offset")


def spans(placed: DataFrame) -> DataFrame:
    """``signal_id, start_us, end_us``: what each signal covers; ordinal ones have nulls."""
    s = tl.span_of(F.col("axis_type"), F.col("n_values"), F.col("first_us"), F.col("last_us"))
    return placed.select("signal_id", s["start"].alias("start_us"), s["end"].alias("end_us"))


def steps_in(placed: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adds ``step_from, step_to``: the steps of a signal in time [start, end). By arithmetic on regular axes (not clamped),
    by counting earlier offsets on irregular ones (offsets that repeat stay together)."""
    def earlier(t: Column) -> Column:
        return F.size(F.filter(F.slice("time_offsets", F.lit(1), F.least(F.col("n_values"), F.size("time_offsets").cast("long")).cast("int")), lambda x: x < t)).cast("long")

    regular = F.col("axis_type") == "regular"
    irregular = F.col("axis_type") == "irregular"
    return placed.withColumn("step_from", F.when(regular, tl.index_at_or_after(start)).when(irregular, earlier(start))).withColumn("step_to", F.when(regular, tl.index_at_or_after(end)).when(irregular, earlier(end)))


def slice_axis(located: DataFrame) -> DataFrame:
    """A slice's axis: ``signal_id, start_index, n_values, clip_from, clip_to``; clipped to the signal; empty and ordinal ones left out.
    A regular axis keeps offset and period and only moves its start."""
    a, z = F.greatest(F.col("step_from"), F.lit(0)), F.least(F.col("step_to"), F.col("n_values"))
    return located.where("step_from is not null and step_to is not null").select("signal_id", "axis_type", F.when(F.col("axis_type") == "regular", F.col("start_index") + a).alias("start_index"), (z - a).alias("n_values"), a.alias("clip_from"), z.alias("clip_to")).where(F.col("clip_to") > F.col("clip_from"))


def epochs(intervals: DataFrame, length: int) -> DataFrame:
    """Cuts intervals into tiles of ``length``: ``occurrence_id, tile, start_us, end_us``; ``whole`` tells whether they
    divide exactly. Long intervals unfold in pieces of 1024 tiles, so no row holds all tiles of one."""
    n = F.ceil((F.col("end_us") - F.col("start_us")) / F.lit(length)).cast("int")
    rows = intervals.where(F.col("end_us") > F.col("start_us")).select("occurrence_id", "start_us", "end_us", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(1024))).alias("first"))
    rows = rows.select("occurrence_id", "start_us", "end_us", F.explode(F.sequence("first", F.least(F.col("first") + 1023, F.col("n") - 1))).alias("tile"))
    start = F.col("start_us") + F.col("tile").cast("long") * length
    return rows.select("occurrence_id", "tile", start.alias("start_us"), F.least(start + length, F.col("end_us")).alias("end_us"), ((F.col("end_us") - F.col("start_us")) % length == 0).alias("whole"))


def infer_axis(axes: DataFrame) -> DataFrame:
    """``axis_id, kind, period_us``: regular if all offsets are one positive step apart, else irregular; nothing is filled."""
    steps = F.expr("transform(sequence(2, size(time_offsets)), i -> element_at(time_offsets, i) - element_at(time_offsets, i - 1))")
    a = axes.where(F.size("time_offsets") > 1).dropDuplicates(["axis_id"]).withColumn("steps", steps)
    same = F.forall("steps", lambda x: F.coalesce((x == F.element_at("steps", 1)) & (x > 0), F.lit(False)))
    return a.select("axis_id", F.when(same, "regular").otherwise("irregular").alias("kind"), F.when(same, F.element_at("steps", 1)).alias("period_us"))


def disorder(axes: DataFrame) -> DataFrame:
    """``axis_id`` of axes whose stored offsets decrease somewhere."""
    pairs = F.expr("exists(sequence(2, size(time_offsets)), i -> element_at(time_offsets, i) < element_at(time_offsets, i - 1))")
    return axes.where(F.size("time_offsets") > 1).where(pairs).select("axis_id").distinct()


def observed_window(long: DataFrame) -> DataFrame:
    """``signal_id, first_step, last_step, n_missing``: the stretch from the first to the last value, and its gaps."""
    there = F.col("value").isNotNull() & ~F.isnan("value")
    w = long.where(there).groupBy("signal_id").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n"))
    return w.select("signal_id", "first_step", "last_step", (F.col("last_step") - F.col("first_step") + 1 - F.col("n")).alias("n_missing"))


def runs(long: DataFrame, key: str = "signal_id", order: str = "step", value: str = "value") -> DataFrame:
    """``key, value, first, last, n``: stretches of one value in order, by islands of equal neighbours. ``order`` is a unique
    integer; a hot key is many blocks."""
    rows = previous(long, [key], order, value, "_before")
    new = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))
    rows = prefix_sum(rows.withColumn("_new", new.cast("long")), [key], order, "_new", "_island").withColumn("_island", F.col("_island") + F.col("_new"))
    return rows.groupBy(key, value, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")
