"""Splits that keep together every recording of a patient, in given shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.overlap import even_split
from chronoloom.operators.components import connected_components
LARGE = 200  #: groups with one part in so many of the rows are placed one by one


def groups(recordings: DataFrame, rows: DataFrame) -> DataFrame:
    """``ecg_id, group_id`` for every recording of ``rows``; recordings that share a patient, directly or through others,
    have one group (its smallest recording).

    A patient_id that is null, 0 or negative names nobody. Recordings and patients are nodes of one graph (patients lie above
    2**62, so ids never meet and a group is named by a recording). Null ecg_ids are left out, and rows sent twice count once.
    """
    own = rows.select("ecg_id").where(F.col("ecg_id").isNotNull()).distinct()
    named = recordings.where(F.col("ecg_id").isNotNull() & (F.col("patient_id") > 0)).select(F.col("ecg_id").alias("u"), (F.col("patient_id") + F.lit(2**62)).alias("v")).distinct()

    member = connected_components(named).where(F.col("node") < 2**62)
    return own.join(member.select(F.col("node").alias("ecg_id"), F.col("component").alias("group_id")), "ecg_id", "left").withColumn("group_id", F.coalesce("group_id", "ecg_id"))

def assign(grouped: DataFrame, rows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``ecg_id, group_id, split``: a group's hash falls into one of the ranges that the shares of ``targets`` cut.

    A hash can't balance what one group outweighs, so groups with at least 1/``LARGE`` of the rows (at most ``LARGE`` of
    them) go first, largest first, each to the split that still needs most rows; the ranges of the hash are then in
    proportion to what is left to fill. Shares are scaled to sum to one; null, zero or negative shares count as none.
    Equal input and seed give equal splits.
    """
    want = {r["split"]: r["share"] for r in targets.where(F.col("split").isNotNull() & (F.col("share") > 0)).groupBy("split").agg(F.sum("share").alias("share")).collect()}  # the fixed table of splits
    if not want:
        return grouped.select("ecg_id", "group_id", F.lit(None).cast("string").alias("split"))
    sizes = grouped.join(_sizes(rows), "ecg_id").groupBy("group_id").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).head()["t"]
    large = sizes.where(F.col("n") * LARGE >= total).collect()  # at most LARGE rows
    need = {k: v / sum(want.values()) * total for k, v in want.items()}
    placed = []
    for r in sorted(large, key=lambda r: (-r["n"], r["group_id"])):
        split = max(sorted(need), key=need.get)
        need[split] -= r["n"]
        placed.append((r["group_id"], split))
    left = {k: max(v, 0.0) for k, v in need.items()}
    left = left if sum(left.values()) > 0 else want
    u = F.pmod(F.xxhash64("group_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    upto, names = 0.0, sorted(left)
    by_hash = None
    for k in names[:-1]:
        upto += left[k] / sum(left.values())
        by_hash = F.when(u < upto, k) if by_hash is None else by_hash.when(u < upto, k)
    by_hash = F.lit(names[-1]) if by_hash is None else by_hash.otherwise(names[-1])
    fixed = grouped.sparkSession.createDataFrame(placed, "group_id long, _split string")
    return grouped.select("ecg_id", "group_id").join(F.broadcast(fixed), "group_id", "left").select("ecg_id", "group_id", F.coalesce("_split", by_hash).alias("split"))


def _sizes(rows: DataFrame) -> DataFrame:
    """Rows per recording; a row sent twice counts once."""
    return rows.where(F.col("ecg_id").isNotNull()).select("row_id", "ecg_id").distinct().groupBy("ecg_id").agg(F.count(F.lit(1)).alias("n"))


def straddling(grouped: DataFrame, rows: DataFrame) -> DataFrame:
    """``ecg_id`` of the recordings whose group has rows in two or more splits as given; null splits don't count."""
    r = rows.where(F.col("ecg_id").isNotNull()).select("ecg_id", even_split(F.col("split")).alias("split")).where(F.col("split").isNotNull()).distinct()
    bad = grouped.join(r, "ecg_id").groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("z")).where("a <> z")
    return grouped.join(bad, "group_id", "left_semi").select("ecg_id").distinct()

def shares(assigned: DataFrame, rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``split, n_rows, n_recordings, share, target``: what the assignment gives, by rows."""
    per = assigned.join(_sizes(rows), "ecg_id").groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_recordings"))
    total = Window.partitionBy(F.lit(0))
    return per.join(targets.select("split", F.col("share").alias("target")), "split", "left").withColumn("share", F.col("n_rows") / F.sum("n_rows").over(total))
