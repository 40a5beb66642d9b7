"""Session helpers: table loading, and cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only in local mode where it is unset."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="chronoloom-")
    return f"file://{_own_dir}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This cuts lineage (a lost executor costs a re-read, not a recomputation), keeps the data columnar, and gives
    the planner true sizes. The table lives until ``unstage`` or the end of the process.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronoloom_path = path
    return out


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder, deleted at the end of the process."""
    path = f"{shared_dir(spark)}/chronoloom-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def unstage(df: DataFrame | None) -> None:
    """Drop a table made by ``stage`` that nothing reads any more."""
    path = getattr(df, "_chronoloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _staged[:] = [x for x in _staged if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            break


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys`` in the order of the integer column ``order``.

    Two levels: sums per block of ``block`` order values are summed up first, then rows inside a block. No window
    partition holds more than the rows of one block, or one row per block, of a hot key. Null values count as 0;
    ``order`` must be unique and not null within a key.
    """
    from pyspark.sql import Window

    cut = F.floor(F.col(order) / F.lit(block)).cast("long")
    rows = df.withColumn("_block", cut)
    sums = rows.groupBy(*keys, "_block").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"),
                       F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    on = [rows[k].eqNullSafe(sums[f"_k_{k}"]) for k in keys] + [rows["_block"] == sums["_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, cond, "left").drop("_b", *[f"_k_{k}" for k in keys])
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside), F.lit(0))).drop("_block", "_base")


def previous(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Adds ``out``: the ``value`` of the row before, per ``keys`` in the order of the unique integer column ``order``; a
    struct of one field ``v``, null for the first row, so that a null value and no row stay apart.

    Two levels, as in ``prefix_sum``: within a block of order values, and from the last row of the blocks before.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("long")).withColumn("_own", F.struct(F.col(value).alias("v")))
    last = rows.groupBy(*keys, "_block").agg(F.max_by("_own", order).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_block")
    last = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.lag("_last").over(earlier).alias("_carried"))
    cond = rows["_block"] == last["_b"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(last[f"_k_{k}"])
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    joined = rows.join(last, cond, "left").drop("_b", *[f"_k_{k}" for k in keys])
    return joined.withColumn(out, F.coalesce(F.lag("_own").over(inside), F.col("_carried"))).drop("_block", "_own", "_carried")


def numbered(df: DataFrame, order: list, out: str, first: int = 1) -> DataFrame:
    """Adds ``out``: the place of each row in the order of ``order``, from ``first``; no task sorts the whole table.

    Rows are range-partitioned, sorted and staged with their place in the partition; only the sizes of the partitions are
    summed up. Ties get their places in any order, but each place once.
    """
    from pyspark.sql import Window

    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(rows.withColumn("_num_part", F.spark_partition_id()).withColumn("_num_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = rows.groupBy("_num_part").agg(F.count(F.lit(1)).alias("_num_n"))  # a row per partition
    before = Window.orderBy("_num_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_num_part", F.coalesce(F.sum("_num_n").over(before), F.lit(0)).alias("_num_base"))
    return rows.join(F.broadcast(sizes), "_num_part").withColumn(out, F.col("_num_base") + F.col("_num_at") + F.lit(first)).drop("_num_part", "_num_at", "_num_base")
