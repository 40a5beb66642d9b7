"""Features, targets and splits for training on the model's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_of_fold(fold: Column, validation: list[int], test: list[int]) -> Column:
    """Split by fold number; a null fold is training."""
    return F.when(fold.isin(*test), "test").when(fold.isin(*validation), "validation").otherwise("train")


def frozen_splits(rows: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """Rows named in ``frozen`` (key, split) get that split, all others are training. A key frozen twice is an error."""
    if frozen.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a position is frozen twice")
    return rows.join(frozen, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def stratified(rows: DataFrame, key: str, label: str, test: int, validation: int, of: int) -> DataFrame:
    """Splits with the same shares in every label: ``test`` and ``validation`` parts of ``of``, by a hash order of the key."""
    digest = F.md5(F.col(key).cast("string"))
    r = rows.withColumn("_digest", digest).withColumn("_bin", F.substring(digest, 1, 4))
    # places in two levels: bins of digests, and rows within a bin, so that no label is sorted by one task
    sizes = r.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_s"))
    bins = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(label).alias("_l"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_s").over(bins), F.lit(0)).alias("_base"), F.sum("_s").over(Window.partitionBy(label)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_digest", key))
    r = r.join(sizes, r[label].eqNullSafe(sizes["_l"]) & (r["_bin"] == sizes["_b"])).withColumn("_k", F.col("_base") + inside)
    cut = F.when(F.col("_k") * of <= F.col("_n") * test, "test").when(F.col("_k") * of <= F.col("_n") * (test + validation), "validation").otherwise("train")
    return r.withColumn("split", cut).select(*[c for c in rows.columns if c != "split"], "split")


def group_folds(rows: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """``fold`` per row such that a group never straddles folds: a hash of the group, so nothing needs to be known of the others."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(folds)).cast("int"))


def features_and_targets(tasks: DataFrame, series: DataFrame, key: str, target: str, equal_lengths: bool = True) -> DataFrame:
    """``key, features, target`` with exactly one task per record: records without or with several tasks are refused, and so
    are series of different lengths where a matrix is wanted."""
    many = tasks.groupBy(key).count().where("count > 1").limit(1).count()
    if many:
        raise ValueError("a record has several tasks")
    out = series.join(tasks.select(key, F.col(target).alias("target")), key).select(key, F.col("values").alias("features"), "target")
    if equal_lengths and out.agg(F.countDistinct(F.size("features")).alias("n")).head()["n"] > 1:
        raise ValueError("series differ in length")
    return out
