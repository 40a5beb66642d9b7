"""Selection over the control tables: splits, modalities, owners, search, paging and requested order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(requested: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows for requested keys in the order asked for; repeated requests repeat the row. ``requested``: ``position, key``."""
    return requested.join(rows, key).orderBy("position")


def missing(requested: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Requested keys that aren't there."""
    return requested.join(rows.select(key), key, "left_anti").select(key).distinct()


def page(rows: DataFrame, order: str, after: int | None, limit: int) -> DataFrame:
    """A keyset page: the next ``limit`` rows after ``after``."""
    rows = rows if after is None else rows.where(F.col(order) > after)
    return rows.orderBy(order).limit(limit)


def holds_all(have: Column, need: Column) -> Column:
    """Whether array ``have`` holds every element of ``need``."""
    return F.size(F.array_except(need, have)) == 0


def only_from(have: Column, allowed: Column) -> Column:
    """Whether array ``have`` holds nothing but elements of ``allowed``."""
    return F.size(F.array_except(have, allowed)) == 0


def in_splits(tasks: DataFrame, *splits: str) -> DataFrame:
    """Tasks of the splits; a null split is in none, and repeated names don't repeat rows."""
    return tasks.where(F.col("split").isin(*dict.fromkeys(splits)))


def has_splits(tasks: DataFrame) -> bool:
    """Whether any task has a split at all."""
    return bool(tasks.where(F.col("split").isNotNull()).limit(1).count())


def with_inputs(tasks: DataFrame, records: DataFrame | None, key: str) -> DataFrame:
    """Tasks with an input among ``records``; None keeps all, an empty table keeps none."""
    return tasks if records is None else tasks.join(records.select(key).distinct(), key, "left_semi")


def owned_by(occurrences: DataFrame, object_type: str, ids: DataFrame) -> DataFrame:
    """Occurrences whose owner is one of ``ids`` (column ``object_id``) of a type; the type filter reaches the scan."""
    return occurrences.where(F.col("object_type") == object_type).join(ids.select("object_id").distinct(), "object_id", "left_semi")


def search(cards: DataFrame, terms: list[str] | None = None, text: list[str] | None = None, any_of: dict[str, list[str]] | None = None, all_of: dict[str, list[str]] | None = None, order: str = "id", limit: int | None = 100) -> DataFrame:
    """Cards that match: any term anywhere in the ``text`` columns (case aside), any of the values of each ``any_of``
    column, all of the values of each ``all_of`` array column; sorted, then limited."""
    if limit is not None and limit < 0:
        raise ValueError("limit is negative")
    if terms:
        body = F.lower(F.concat_ws(" ", *(text or [])))
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(body, F.lit(t.lower()))
        cards = cards.where(hit)
    for column, values in (any_of or {}).items():
        cards = cards.where(F.col(column).isin(*values))
    for column, values in (all_of or {}).items():
        cards = cards.where(holds_all(F.col(column), F.array(*[F.lit(v) for v in values])))
    cards = cards.orderBy(order)
    return cards if limit is None else cards.limit(limit)


def newest(versions: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """The row with the highest version of each key, parts compared as numbers."""
    others = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*parts)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in others])


def resolve_version(versions: DataFrame, key: str, source: str, parts: list[str], latest: bool = False) -> DataFrame:
    """``latest``: the highest version over all sources, the earlier source on a tie; else the highest of the first
    source that has the key."""
    rank = F.struct(*parts, (-F.col(source)).alias("_s")) if latest else F.struct((-F.col(source)).alias("_s"), *parts)
    others = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in others])


def ordered_list(rows: DataFrame, key: str, position: str, value: str, out: str) -> DataFrame:
    """Values per key in the order of ``position``, which need not be dense."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))))
    return rows.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias(out))


def asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, out: str, value: str | None = None, block_us: int = 3_600_000_000) -> DataFrame:
    """``left`` with ``out``: the ``value`` (by default ``right_at`` itself) of the last row of its key whose ``right_at`` is not after
    ``left_at``; null where there is none or no time. A value must not fall as ``right_at`` grows. Times are timestamps or
    whole microseconds.

    A union and a running maximum in two levels (blocks of time, then rows within a block): no pairs are made, and no task
    holds a hot key.
    """
    def block(t: Column) -> Column:
        return F.floor((t if whole else F.unix_micros(t.cast("timestamp"))) / F.lit(block_us))

    value = value or right_at
    whole, kind = right.schema[right_at].dataType.typeName() == "long", right.schema[value].dataType
    a = left.withColumn("_at", F.col(left_at)).withColumn("_seen", F.lit(None).cast(kind)).withColumn("_side", F.lit(1))
    b = right.where(F.col(right_at).isNotNull()).select(key, F.col(right_at).alias("_at"), F.col(value).alias("_seen"), F.lit(0).alias("_side"))
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_block", block(F.col("_at")))
    last = rows.where("_side = 0").groupBy(key, "_block").agg(F.max("_seen").alias("_last"))
    blocks = rows.select(key, "_block").distinct().join(last, [key, "_block"], "left")
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.max("_last").over(earlier).alias("_carried"))
    rows = rows.join(blocks, rows[key].eqNullSafe(blocks["_k"]) & (rows["_block"] == blocks["_b"]), "left")
    inside = Window.partitionBy(key, "_block").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(out, F.greatest("_carried", F.max("_seen").over(inside))).where("_side = 1")
    return found.withColumn(out, F.when(F.col(left_at).isNotNull() & F.col(key).isNotNull(), F.col(out))).select(*left.columns, out)


def first_seen(rows: DataFrame, key: list[str], order: str, new_id: str) -> DataFrame:
    """Distinct contents with ids by first use (dense from 1)."""
    from chronoloom.session import numbered

    return numbered(rows.groupBy(*key).agg(F.min(order).alias("first_use")), ["first_use"], new_id)
