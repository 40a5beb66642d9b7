"""Versions by copy-on-write: removing, keeping and importing records and signals, with references kept whole."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.graph import reachable
from chronoloom.operators.model import placed
from chronoloom.session import numbered, stage

Tables = Mapping[str, DataFrame]


def invalid_tasks(refs: DataFrame, gone: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``task_id`` of tasks that can't stay once records ``gone`` (record_id) go: all inputs lost, or any target or
    candidate lost; with ``links`` (u derived from v) everything derived from them as well.

    ``refs``: ``task_id, field, record_id``. A task without inputs isn't touched by its inputs.
    """
    hit = refs.join(gone.select("record_id").distinct().withColumn("_gone", F.lit(1)), "record_id", "left")
    inputs = hit.where(F.col("field") == "inputs").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count("_gone").alias("lost")).where("n = lost").select("task_id")
    others = hit.where((F.col("field") != "inputs") & F.col("_gone").isNotNull()).select("task_id")
    bad = inputs.unionByName(others).distinct()
    if links is None:
        return bad
    derived = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return reachable(bad.select(F.col("task_id").alias("node")), derived).select(F.col("node").alias("task_id"))


def remove_records(tables: Tables, gone: DataFrame, cascade: bool) -> dict[str, DataFrame]:
    """All tables without the records and what hangs on them; ids of what stays don't change.

    ``tables``: records, sources, signals, occurrences, tasks, refs and links (u derived from v). Tasks that lose some
    inputs only lose those references. Without ``cascade`` a task that can't stay is an error.
    """
    bad = invalid_tasks(tables["refs"], gone, tables.get("links"))
    if not cascade and bad.limit(1).count():
        raise ValueError("tasks depend on these records; remove them with cascade")
    ids = gone.select("record_id").distinct()
    records = tables["records"].join(ids, "record_id", "left_anti")
    sources = tables["sources"].join(ids, "record_id", "left_anti")
    lost_sources = tables["sources"].join(ids, "record_id", "left_semi").select("source_id").distinct()
    signals = tables["signals"].join(lost_sources, "source_id", "left_anti")
    lost_signals = tables["signals"].join(lost_sources, "source_id", "left_semi").select("signal_id").distinct()
    lost = ids.select(F.lit("Record").alias("object_type"), F.col("record_id").alias("object_id"))
    lost = lost.unionByName(lost_sources.select(F.lit("Source").alias("object_type"), F.col("source_id").alias("object_id")))
    lost = lost.unionByName(lost_signals.select(F.lit("Signal").alias("object_type"), F.col("signal_id").alias("object_id")))
    out = dict(tables)
    out |= {"records": records, "sources": sources, "signals": signals, "occurrences": tables["occurrences"].join(lost, ["object_type", "object_id"], "left_anti")}
    out |= {"tasks": tables["tasks"].join(bad, "task_id", "left_anti"), "refs": tables["refs"].join(bad, "task_id", "left_anti").join(ids, "record_id", "left_anti")}
    return out


def remove_signals(tables: Tables, gone: DataFrame) -> dict[str, DataFrame]:
    """Signals, and the annotations on them, out; annotations of their record stay unless the record has no signal left.

    Where ``tables`` has ``windows``, ``sessions`` and ``owned`` (see ``kept_annotations``), annotations of records and sources
    that lose signals stay only where what is left still places them.
    """
    ids = gone.select("signal_id").distinct()
    signals = tables["signals"].join(ids, "signal_id", "left_anti")
    if "windows" in tables:
        return dict(tables) | {"signals": signals, "occurrences": kept_annotations(tables["occurrences"], tables["owned"], ids, tables["windows"], tables["sessions"])}
    lost = ids.select(F.lit("Signal").alias("object_type"), F.col("signal_id").alias("object_id"))
    owner = tables["sources"].select("source_id", "record_id").distinct()
    touched = tables["signals"].join(ids, "signal_id", "left_semi").join(owner, "source_id").select("record_id").distinct()
    still = signals.join(owner, "source_id").select("record_id").distinct()
    bare = touched.join(still, "record_id", "left_anti").select(F.lit("Record").alias("object_type"), F.col("record_id").alias("object_id"))
    return dict(tables) | {"signals": signals, "occurrences": tables["occurrences"].join(lost.unionByName(bare), ["object_type", "object_id"], "left_anti")}


def invalid_by(refs: DataFrame, gone: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``task_id`` of tasks that can't stay once objects ``gone`` (``object_type, object_id``) go: all input records lost, or any
    other reference (target, candidate, signal of a span, annotation of an answer) lost; with ``links`` (u derived from v)
    everything derived from them as well. ``refs``: ``task_id, field, object_type, object_id``; inputs have field ``inputs``.
    """
    keys = ["object_type", "object_id"]
    hit = refs.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(1)), keys, "left")
    inputs = hit.where("field = 'inputs'").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count("_gone").alias("lost")).where("n = lost").select("task_id")
    bad = inputs.unionByName(hit.where("field <> 'inputs' and _gone is not null").select("task_id")).distinct()
    if links is None:
        return bad
    return reachable(bad.select(F.col("task_id").alias("node")), links.select(F.col("v").alias("u"), F.col("u").alias("v"))).select(F.col("node").alias("task_id"))


def kept_annotations(occurrences: DataFrame, owned: DataFrame, removed: DataFrame, windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The annotations of owners that stay once signals ``removed`` (signal_id) go.

    ``owned`` (``object_type, object_id, signal_id``): the signals below each owner. An owner that keeps all of them keeps every
    annotation; otherwise one without a time span stays, and one whose span lies in the windows (``signal_id, start_us,
    end_us``) of the signals that stay, or in the owner's session (``object_type, object_id, session_start_us,
    session_end_us``) where it has one. Annotations of a removed signal go; those of other objects stay.
    """
    keys = ["object_type", "object_id"]
    gone = removed.select("signal_id").distinct().withColumn("_gone", F.lit(True))
    below = owned.join(gone, "signal_id", "left")
    losing = below.where("_gone").select(*keys).distinct()
    owner = F.xxhash64(*keys)  # one number per owner, for the windows
    left = below.where("_gone is null").join(windows, "signal_id").where("start_us < end_us").select(owner.alias("owner_id"), "start_us", "end_us")
    lost = gone.select(F.lit("Signal").alias("object_type"), F.col("signal_id").alias("object_id"))
    rest = occurrences.join(lost, keys, "left_anti")
    timed = F.col("span_type").isin("time_point", "time_interval") & F.col("start_us").isNotNull()
    touched = rest.join(losing, keys, "left_semi")
    spans = touched.where(timed).withColumn("owner_id", owner).withColumn("_end", F.col("end_us")).withColumn("end_us", F.when(F.col("span_type") == "time_point", F.col("start_us") + 1).otherwise(F.col("end_us")))
    fits = placed(spans, left, sessions.withColumn("owner_id", owner)).where("fits").withColumn("end_us", F.col("_end"))
    return rest.join(losing, keys, "left_anti").unionByName(touched.where(~F.coalesce(timed, F.lit(False)))).unionByName(fits.select(*occurrences.columns))


def signals_below(sources: DataFrame, signals: DataFrame, resolved: DataFrame) -> DataFrame:
    """``object_type, object_id, signal_id``: the signals below every record and every source; a source that reaches no root
    has its own only. ``resolved``: the hierarchy with paths."""
    g = signals.select("signal_id", "source_id").distinct()
    records = g.join(sources.select("source_id", "record_id").distinct(), "source_id").select(F.lit("Record").alias("object_type"), F.col("record_id").alias("object_id"), "signal_id")
    up = resolved.select(F.explode(F.coalesce("path", F.array("node_id"))).alias("object_id"), F.col("node_id").alias("source_id"))
    return records.unionByName(g.join(up, "source_id").select(F.lit("Source").alias("object_type"), "object_id", "signal_id")).distinct()


def edit_version(spark, base: str, path: str, records: DataFrame | None = None, signals: DataFrame | None = None, cascade: bool = False, card: dict | None = None) -> dict[str, DataFrame]:
    """A new version at ``path``: the version at ``base`` without ``signals`` and then without ``records``, published in one
    rename; ids of what stays don't change, and the base isn't touched. Gives the tables of the new version."""
    from chronoloom.operators import store

    tables, old = store.open_version(spark, base)
    if signals is not None:
        gone = signals.select("signal_id").distinct()
        lost = gone.select(F.lit("Signal").alias("object_type"), F.col("signal_id").alias("object_id"))
        tables = tables | {"signals": tables["signals"].join(gone, "signal_id", "left_anti"), "occurrences": tables["occurrences"].join(lost, ["object_type", "object_id"], "left_anti")}
    if records is not None:
        tables = remove_records(tables, records, cascade)
    old.pop("counts")
    store.write_version(tables, path, {**old, **(card or {}), "base": base})
    return store.open_version(spark, path)[0]


def import_from(parent: Tables, held: DataFrame, records: DataFrame, last: Mapping[str, int], alias: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Copies of records of another version with all below them: new tables, and the import map with what was added.

    ``held`` is the map so far (``alias, kind, parent_id, object_id``): what it has keeps its id, so importing again adds
    nothing. New ids are counted on from ``last`` (by kind) in the order of parent ids, and references are rewritten.
    A source whose parent isn't in the record comes without it.
    """
    ids = records.select("record_id").distinct()
    rec = parent["records"].join(ids, "record_id", "left_semi").dropDuplicates(["record_id"])
    src = parent["sources"].join(ids, "record_id", "left_semi").dropDuplicates(["source_id"])
    sig = parent["signals"].join(src.select("source_id"), "source_id", "left_semi").dropDuplicates(["signal_id"])
    maps = {}
    for kind, rows in (("record", rec), ("source", src), ("signal", sig)):
        mine = held.where((F.col("alias") == alias) & (F.col("kind") == kind)).select("parent_id", "object_id")
        maps[kind] = stage(import_ids(rows.select(F.col(f"{kind}_id").alias("parent_id")), mine, last[kind]))
    new = {k: m.where("new") for k, m in maps.items()}

    def fresh(rows: DataFrame, kind: str) -> DataFrame:
        return rows.join(new[kind].select(F.col("parent_id").alias(f"{kind}_id")), f"{kind}_id", "left_semi")

    out = {"records": rewritten(fresh(rec, "record"), "record_id", maps["record"])}
    up = maps["source"].select(F.col("parent_id").alias("parent_source_id"), F.col("object_id").alias("_up"))
    s = rewritten(rewritten(fresh(src, "source"), "source_id", maps["source"]), "record_id", maps["record"])
    out["sources"] = s.join(up, "parent_source_id", "left").drop("parent_source_id").withColumnRenamed("_up", "parent_source_id")
    out["signals"] = rewritten(rewritten(fresh(sig, "signal"), "signal_id", maps["signal"]), "source_id", maps["source"])
    added = [m.select(F.lit(alias).alias("alias"), F.lit(k).alias("kind"), "parent_id", "object_id") for k, m in new.items()]
    return out, added[0].unionByName(added[1]).unionByName(added[2])


def import_ids(wanted: DataFrame, held: DataFrame, last_id: int) -> DataFrame:
    """``parent_id, object_id, new``: ids of imported objects. One held already keeps its id; new ones are counted on from
    ``last_id`` in the order of their parent id, so importing twice changes nothing."""
    w = wanted.select("parent_id").distinct().join(held.select("parent_id", "object_id"), "parent_id", "left")
    fresh = numbered(w.where(F.col("object_id").isNull()).select("parent_id"), ["parent_id"], "object_id", last_id + 1).select("parent_id", F.col("object_id").cast("long").alias("object_id"), F.lit(True).alias("new"))
    return w.where(F.col("object_id").isNotNull()).select("parent_id", "object_id", F.lit(False).alias("new")).unionByName(fresh)


def rewritten(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows with a reference translated by ``ids``; rows whose reference isn't imported are left out."""
    m = ids.select(F.col("parent_id").alias(column), F.col("object_id").alias("_new"))
    return rows.join(m, column).drop(column).withColumnRenamed("_new", column)


def merged_names(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Hierarchy rows of both sides by sibling name: what both have is held once (the base's)."""
    return base.unionByName(other.join(base.select(*keys), keys, "left_anti"))


def difference(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change`` (added, removed, changed) between two releases."""
    a = old.select(F.col(key).alias("_a"), F.col(digest).alias("_da"))
    b = new.select(F.col(key).alias("_b"), F.col(digest).alias("_db"))
    x = a.join(b, a["_a"] == b["_b"], "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_da").eqNullSafe(F.col("_db")), "changed")
    return x.select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change is not null")
