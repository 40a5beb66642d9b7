"""Integrity rules over the control tables. Every rule gives its violations as rows; an empty table means the rule holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(rows: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Values of a reference that aren't there, with the number of rows that name them; null references don't count."""
    t = targets.select(F.col(target).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(t, column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def dangling_owner(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Typed references ``(object_type, object_id)`` to nothing."""
    keys = ["object_type", "object_id"]
    return rows.where(F.col("object_id").isNotNull()).join(owners.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def breaking(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for every row that breaks a rule; a rule is a condition that must hold (null counts as held)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule")).distinct()


def assert_valid(violations: DataFrame, what: str) -> None:
    """Raise on the first violation."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def coverage(signals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Signals whose chunks don't hold the declared number of values: ``signal_id, n_values, stored``."""
    stored = chunks.groupBy("signal_id").agg(F.sum("n_values").alias("stored"))
    declared = signals.groupBy("signal_id").agg(F.min("n_values").alias("n_values"))
    return declared.join(stored, "signal_id").where("stored <> n_values")


def chunk_gaps(chunks: DataFrame) -> DataFrame:
    """Signals whose chunk numbers aren't 0..n-1: ``signal_id, n, last``."""
    g = chunks.groupBy("signal_id").agg(F.countDistinct("chunk_idx").alias("n"), F.max("chunk_idx").alias("last"), F.min("chunk_idx").alias("first"))
    return g.where("first <> 0 or last <> n - 1").select("signal_id", "n", "last")


def label_rules(targets: DataFrame, labels: DataFrame, key: str, label: str, multi: bool) -> DataFrame:
    """``key, rule``: labels outside the set, repeated labels, and (for single-label tasks) more or fewer than one."""
    outside = targets.where(F.col(label).isNotNull()).join(labels.select(F.col(labels.columns[0]).alias(label)), label, "left_anti").select(key, F.lit("not in the set").alias("rule"))
    per = targets.groupBy(key).agg(F.count(label).alias("n"), F.countDistinct(label).alias("d"))
    repeats = per.where("n > d").select(key, F.lit("repeated").alias("rule"))
    out = outside.unionByName(repeats)
    return (out if multi else out.unionByName(per.where("n <> 1").select(key, F.lit("not exactly one").alias("rule")))).distinct()
