"""The data model above the tables: task, target and annotation tables, derived schema, walks, selections and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import intervals
from chronoloom.operators import select as sel
from chronoloom.session import numbered


def ordered(rows: DataFrame, key: str, position: str, value: str, out: str) -> DataFrame:
    """``key, out``: the distinct values of a key as a list, each at its first position."""
    once = rows.groupBy(key, value).agg(F.min(position).alias("_p"))
    return once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", value))).alias("_l")).select(key, F.transform("_l", lambda x: x[value]).alias(out))


def task_table(tasks: DataFrame, inputs: DataFrame, links: DataFrame) -> DataFrame:
    """One row per task with its ordered ``input_record_ids`` and ``from_task_ids``, empty where it has none.

    ``inputs``: ``task_id, position, record_id``; ``links``: u derived from v.
    """
    i = ordered(inputs, "task_id", "position", "record_id", "input_record_ids")
    f = ordered(links.select(F.col("u").alias("task_id"), F.col("v").alias("parent"), F.col("v").alias("at")), "task_id", "at", "parent", "from_task_ids")
    none = F.array().cast("array<bigint>")
    return tasks.join(i, "task_id", "left").join(f, "task_id", "left").withColumns({c: F.coalesce(c, none) for c in ("input_record_ids", "from_task_ids")})


def typed(text: Column) -> tuple[Column, Column, Column]:
    """Kind, integer and boolean value of a target's text: ``none``, ``integer`` (whole milliseconds), ``boolean`` or ``text``."""
    whole, yes = F.regexp_extract(text, r"^([0-9]+) ms$", 1), F.lower(F.regexp_replace(text, r"\.$", ""))
    kind = F.when(text.isNull(), "none").when(whole != "", "integer").when(yes.isin("yes", "no"), "boolean").otherwise("text")
    return kind, F.when(kind == "integer", whole.try_cast("long")), F.when(kind == "boolean", yes == "yes")


def target_table(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (``task_id, position, text``) with their task's columns and their typed value; targets of no task are left out."""
    kind, integer, boolean = typed(F.col("text"))
    return targets.join(tasks, "task_id").withColumns({"kind": kind, "integer_value": integer, "boolean_value": boolean})


def input_modalities(tasks: DataFrame, inputs: DataFrame, signals: DataFrame) -> DataFrame:
    """``task_id, modalities``: the modalities of the signals below a task's inputs that lie in its scope, text where it has a
    prompt, and ``no_input`` where it has no input.

    ``tasks``: ``task_id, prompt, scope`` (an array of signal names, null for all); ``inputs``: ``task_id, record_id``;
    ``signals``: ``record_id, name, modality``.
    """
    per = signals.groupBy("record_id").agg(F.collect_set(F.struct("name", "modality")).alias("_s"))
    i = inputs.join(per, "record_id", "left").groupBy("task_id").agg(F.flatten(F.collect_list(F.coalesce("_s", F.array().cast(per.schema["_s"].dataType)))).alias("_s"), F.count(F.lit(1)).alias("_n"))
    x = tasks.join(i, "task_id", "left")
    scoped = F.filter("_s", lambda s: F.col("scope").isNull() | F.array_contains(F.col("scope"), s["name"]))
    kinds = F.concat(F.coalesce(F.transform(scoped, lambda s: s["modality"]), F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.coalesce(F.col("prompt") != "", F.lit(False)), "text"), F.when(F.col("_n").isNull(), "no_input"))))
    return x.select("task_id", F.array_sort(F.array_distinct(kinds)).alias("modalities"))


def derived(rows: DataFrame, key: str, contract: list[str], order: str) -> DataFrame:
    """``key, place, n_contracts, conflict``: distinct keys in the order of first use (from 0), and whether one has several
    different contracts. A null in a contract is a value of its own."""
    s = rows.select(key, F.struct(*contract).alias("_c"), order)
    d = s.groupBy(key).agg(F.min(order).alias("_first"), F.count_distinct(F.to_json("_c", {"ignoreNullFields": "false"})).alias("n_contracts"))
    return numbered(d, ["_first"], "place", 0).select(key, "place", "n_contracts", (F.col("n_contracts") > 1).alias("conflict"))


def walk_order(named: DataFrame) -> DataFrame:
    """``root_id, node_id, place``: depth-first pre-order of every tree with children in the order of their names (ids break
    ties), from 0. ``named``: ``node_id, root_id, key``, keys as ``walk_keys`` makes them."""
    all_rows = numbered(named.select("root_id", "node_id", "key"), ["root_id", "key"], "_at", 0)
    first = all_rows.groupBy("root_id").agg(F.min("_at").alias("_first"))
    return all_rows.join(first, "root_id").select("root_id", "node_id", (F.col("_at") - F.col("_first")).alias("place"))


def walk_keys(resolved: DataFrame, names: DataFrame) -> DataFrame:
    """``node_id, root_id, key``: the names and ids on the way down as one text that sorts in pre-order. ``names``: ``node_id, name``."""
    steps = resolved.where(F.col("path").isNotNull()).select("node_id", "root_id", F.posexplode("path").alias("at", "step"))
    part = F.concat(F.coalesce("name", F.lit("")), F.lit("\x01"), F.lpad(F.col("step").cast("string"), 19, "0"))
    n = names.select(F.col("node_id").alias("step"), "name")
    parts = steps.join(n, "step").groupBy("node_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("part")))).alias("p"))
    return parts.select("node_id", "root_id", F.array_join(F.transform("p", lambda x: x["part"]), "\x02").alias("key"))


def cycles(resolved: DataFrame) -> DataFrame:
    """``end_id, path``: every cycle as the list of its nodes, from the smallest one up by parents."""
    ring = resolved.where("fault = 'on_cycle'").groupBy("end_id").agg(F.array_sort(F.collect_list(F.struct("ring_at", "node_id"))).alias("r"))
    return ring.select("end_id", F.transform("r", lambda x: x["node_id"]).alias("path"))


def select_by_name(requests: DataFrame, signals: DataFrame) -> DataFrame:
    """``request_id, problem``: what is wrong with a selection of signals by name: ``empty``, ``duplicate``, ``unknown`` or
    ``ambiguous``, in this order; null where it holds. ``requests``: ``request_id, record_id, names``; ``signals``: ``record_id, name``."""
    have = signals.groupBy("record_id", "name").agg(F.count(F.lit(1)).alias("n"))
    asked = requests.select("request_id", "record_id", F.explode("names").alias("name")).join(have, ["record_id", "name"], "left")
    found = asked.groupBy("request_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max(F.coalesce("n", F.lit(0))).alias("most"))
    x = requests.join(found, "request_id", "left")
    size = F.size("names")
    problem = F.when(F.col("names").isNull() | (size == 0), "empty").when(F.size(F.array_distinct("names")) < size, "duplicate").when(F.col("least") == 0, "unknown").when(F.col("most") > 1, "ambiguous")
    return x.select("request_id", problem.alias("problem"))


def merged_windows(windows: DataFrame) -> DataFrame:
    """``owner_id, from_us, to_us``: the union of the windows (``owner_id, start_us, end_us``) of each owner, touching ones as one."""
    rows = windows.select(F.lit("owner").alias("object_type"), F.col("owner_id").alias("object_id"), "start_us", "end_us")
    p = intervals.periods(intervals.interval_lists(rows))
    return p.select(F.col("object_id").alias("owner_id"), F.col("period_start_us").alias("from_us"), F.col("period_end_us").alias("to_us"))


def placed(spans: DataFrame, windows: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """``spans`` (``owner_id, start_us, end_us`` and more; ends exclusive) with ``fits``: whether the span lies inside the session
    of its owner (``owner_id, session_start_us, session_end_us``) where it has one, else inside one piece of the union of its
    windows. An owner without either places nothing.

    A span looks for the last piece that starts no later, as an as-of join: no pairs are made.
    """
    out = sel.asof(spans, merged_windows(windows), "owner_id", "start_us", "from_us", "_to", value="to_us")  # pieces are disjoint: the last one ends last
    fits = F.col("end_us") <= F.col("_to")
    if sessions is not None:
        out = out.join(sessions.select("owner_id", "session_start_us", "session_end_us"), "owner_id", "left")
        inside = (F.col("start_us") >= F.col("session_start_us")) & (F.col("end_us") <= F.col("session_end_us"))
        fits = F.when(F.col("session_start_us").isNotNull() & F.col("session_end_us").isNotNull(), inside).otherwise(fits)
    return out.withColumn("fits", F.coalesce(fits, F.lit(False))).select(*spans.columns, "fits")


def sections(text: Column, headings: str = "[A-Z][A-Za-z]*") -> tuple[Column, Column]:
    """The sections ``heading: value`` of a text's lines as an array of structs ``heading, value``, and the other lines verbatim."""
    lines = F.split(F.regexp_replace(text, "\r", ""), "\n")
    pattern = rf"^({headings}): (.+)$"
    headed = F.filter(lines, lambda x: x.rlike(pattern))
    parsed = F.transform(headed, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("heading"), F.regexp_extract(x, pattern, 2).alias("value")))
    return parsed, F.filter(lines, lambda x: ~x.rlike(pattern) & (x != ""))
