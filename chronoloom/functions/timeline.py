"""Exact integer-microsecond time as column expressions. Nothing goes through floating point.

A regular axis has value ``i`` at ``offset + floor((start + i) * numerator / denominator)`` microseconds. Products are
DECIMAL(38,0): an index of up to 20 digits times a numerator of up to 18.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE, NARROW = "decimal(20,0)", "decimal(18,0)"


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def floor_div(a: Column, b: Column) -> Column:
    """Integer floor division (Spark's ``div`` truncates); ``b`` is positive."""
    q = (a - F.pmod(a, b)) / b
    return q.cast("decimal(38,0)").cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    return -floor_div(-a, b)


def offset_at(index, start="start_index", num="period_numerator_us", den="period_denominator", offset="offset_us") -> Column:
    """Microseconds of value ``index`` of a regular axis."""
    steps = (_c(start) + _c(index)).cast(WIDE) * _c(num).cast(NARROW)
    return _c(offset) + floor_div(steps, _c(den).cast(NARROW))


def index_at_or_after(t, start="start_index", num="period_numerator_us", den="period_denominator", offset="offset_us") -> Column:
    """First index whose time isn't before ``t``; it may be negative or past the end."""
    return ceil_div((_c(t) - _c(offset)).cast(WIDE) * _c(den).cast(NARROW), _c(num).cast(NARROW)) - _c(start)


def gcd(a: Column, b: Column, steps: int = 64) -> Column:
    """Greatest common divisor by Euclid's steps folded over a fixed sequence (64 suffice for 44-bit numbers)."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y"))))["x"]


def period_of_rate(num: Column, den: Column) -> tuple[Column, Column]:
    """Reduced period in microseconds of a rate of ``num/den`` Hz."""
    top, bottom = den.cast("long") * 1_000_000, num.cast("long")
    g = gcd(top, bottom)
    return floor_div(top, g), floor_div(bottom, g)


def seconds_to_us(seconds: Column) -> Column:
    """Half-even rounding to microseconds."""
    return F.bround(seconds * F.lit(1_000_000.0)).cast("long")


def us_to_seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def unix_us(ts: Column) -> Column:
    """Unix microseconds of a zone-less timestamp read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def absolute(start_us: Column, offset_us: Column) -> Column:
    """Timestamp of an offset; null for a clock without a start."""
    return F.timestamp_micros(start_us + offset_us)


def exclusive_end(kind: Column, start: Column, end: Column) -> Column:
    """Half-open end of a span: a point covers one microsecond or step."""
    return F.when(kind.isin("time_point", "step_point"), start + 1).when(kind.isin("time_interval", "step_interval"), end)


def span_of(axis_type: Column, n: Column, first: Column, last: Column) -> Column:
    """``struct(start, end)`` that a signal covers; null for ordinal axes and signals without values."""
    regular = F.struct(offset_at(0).alias("start"), offset_at(n).alias("end"))
    irregular = F.struct(first.alias("start"), (last + 1).alias("end"))
    return F.when((axis_type == "regular") & (n > 0), regular).when((axis_type == "irregular") & first.isNotNull(), irregular)


def clock_wrap(later: Column, earlier: Column, day: int = 86_400) -> Column:
    """Seconds from one clock time to the next occurrence of another, across midnight."""
    return F.pmod(later - earlier, F.lit(day))
