"""Signals from values that are already at hand: regular, irregular, or loaded on demand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Parts = tuple[DataFrame, DataFrame, DataFrame]


def _parts(rows: DataFrame, axes: DataFrame, chunk: int) -> Parts:
    n = F.size("values").cast("long")
    signals = rows.select("signal_id", F.col("signal_id").alias("axis_id"), n.alias("n_values"))
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("values") / chunk).cast("int") - 1, F.lit(0)))
    chunks = rows.where(F.size("values") > 0).select("signal_id", "values", F.explode(cut).alias("chunk_idx"))
    chunks = chunks.select("signal_id", "chunk_idx", F.slice("values", F.col("chunk_idx") * chunk + 1, F.lit(chunk)).alias("values")).withColumn("n_values", F.size("values"))
    return signals, axes, chunks


def from_values(rows: DataFrame, period_numerator_us: int, period_denominator: int = 1, offset_us: int = 0, chunk: int = 65_536) -> Parts:
    """``signals, axes, chunks`` of rows ``signal_id, values`` on a regular axis of the given period; null values are empty series."""
    if period_numerator_us <= 0 or period_denominator <= 0:
        raise ValueError("a period must be positive")
    rows = rows.select("signal_id", F.coalesce("values", F.array().cast(rows.schema["values"].dataType)).alias("values"))
    axes = rows.select(
        F.col("signal_id").alias("axis_id"), F.lit("regular").alias("axis_type"), F.lit(0).cast("long").alias("start_index"), F.lit(period_numerator_us).cast("long").alias("period_numerator_us"),
        F.lit(period_denominator).cast("long").alias("period_denominator"), F.lit(offset_us).cast("long").alias("offset_us"),
    )
    return _parts(rows, axes, chunk)


def from_irregular(rows: DataFrame, chunk: int = 65_536) -> Parts:
    """The same of rows ``signal_id, offsets, values``: one offset per value, none null, in order; otherwise an error."""
    ordered = F.forall(F.sequence(F.lit(2), F.greatest(F.size("offsets"), F.lit(2))), lambda i: (F.size("offsets") < 2) | (F.element_at("offsets", F.least(i, F.greatest(F.size("offsets"), F.lit(1)))) >= F.element_at("offsets", F.least(i - 1, F.greatest(F.size("offsets"), F.lit(1))))))
    good = (F.size("offsets") == F.size("values")) & F.forall("offsets", lambda x: x.isNotNull()) & ((F.size("offsets") < 2) | ordered)
    if rows.where(~F.coalesce(good, F.lit(False))).limit(1).count():
        raise ValueError("a series needs one offset per value, in order")
    axes = rows.select(F.col("signal_id").alias("axis_id"), F.lit("irregular").alias("axis_type"), F.col("offsets").alias("time_offsets"), F.array_min("offsets").alias("first_us"), F.array_max("offsets").alias("last_us"))
    return _parts(rows.select("signal_id", "values"), axes, chunk)


def from_loader(keys: DataFrame, loader: Callable[[DataFrame], DataFrame], period_numerator_us: int, period_denominator: int = 1) -> Parts:
    """The same of values that ``loader`` gives (``signal_id, values``) for ``keys`` (``signal_id``) when they are needed."""
    return from_values(loader(keys.select("signal_id").distinct()), period_numerator_us, period_denominator)
