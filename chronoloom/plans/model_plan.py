"""Queries of the data model: task and target tables, walks, selections, windows, edits and imports, and rules across tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import units
from chronoloom.operators import audit, edit, features, graph, hierarchy, model, series, store
from chronoloom.operators import select as sel
from chronoloom.operators import tasks as tk
from chronoloom.plans.audit_plan import _GONE, _LINKS, links, old_patients, references
from chronoloom.plans.registry import Registry
from chronoloom.plans.select_plan import _TASKS, tasks
from chronoloom.plans.series_plan import _CHUNK, _PLACED, _off, chunked, placed
from chronoloom.session import scratch, stage, table
from chronoloom.sources import memory, readers

model_plan = Registry()
add = model_plan.add

_UP = """n AS (SELECT DISTINCT source_id, parent_source_id p, record_id, name FROM sources),
up AS (SELECT source_id, source_id root, record_id, [source_id] way, coalesce(name, '') || chr(1) || lpad(CAST(source_id AS VARCHAR), 19, '0') AS key FROM n WHERE p IS NULL
UNION ALL SELECT n.source_id, up.root, n.record_id, list_append(up.way, n.source_id), up.key || chr(2) || coalesce(n.name, '') || chr(1) || lpad(CAST(n.source_id AS VARCHAR), 19, '0') FROM up JOIN n ON n.p = up.source_id)"""
_WINDOWS = f"""{_PLACED}, so AS (SELECT DISTINCT source_id, record_id FROM sources),
wn AS (SELECT signal_id, source_id, (CASE WHEN axis_type = 'regular' AND n_values > 0 THEN {_off('0')} WHEN axis_type = 'irregular' THEN first_us END)::BIGINT w0, (CASE WHEN axis_type = 'regular' AND n_values > 0 THEN {_off('n_values')} WHEN axis_type = 'irregular' AND first_us IS NOT NULL THEN last_us + 1 END)::BIGINT w1 FROM p a)"""


def _merged(name: str, windows: str) -> str:
    """SQL of the merged windows ``owner, s, e`` of a query that gives ``owner, w0, w1``."""
    return f"""{name}_v AS (SELECT DISTINCT owner, w0, w1 FROM ({windows}) WHERE w0 < w1), {name}_r AS (SELECT *, max(w1) OVER (PARTITION BY owner ORDER BY w0, w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM {name}_v),
{name}_i AS (SELECT *, sum(CASE WHEN r >= w0 THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY w0, w1 ROWS UNBOUNDED PRECEDING) g FROM {name}_r), {name} AS (SELECT owner, min(w0) s, max(w1) e FROM {name}_i GROUP BY owner, g)"""


_SESSION = "se AS (SELECT DISTINCT record_id, time_span_start_us b0, time_span_end_us b1 FROM records)"
_SPANS = "sp AS (SELECT DISTINCT occurrence_id, object_id AS owner, span_type, start_us s0, CASE WHEN span_type = 'time_point' THEN start_us + 1 ELSE end_us END s1 FROM annotation_occurrences WHERE object_type = 'Record' AND span_type IN ('time_point', 'time_interval') AND object_id IS NOT NULL AND start_us IS NOT NULL)"


def _fits(merged: str) -> str:
    return f"coalesce(CASE WHEN b0 IS NOT NULL AND b1 IS NOT NULL THEN s0 >= b0 AND s1 <= b1 ELSE EXISTS (SELECT 1 FROM {merged} m WHERE m.owner = sp.owner AND m.s <= s0 AND s1 <= m.e) END, false)"


def windows(spark, d):
    """``signal_id, source_id, record_id, start_us, end_us`` of the signals that have a window."""
    p = placed(spark, d)
    own = table(spark, d, "sources").select("source_id", "record_id").distinct()
    return series.spans(p).join(p.select("signal_id", "source_id"), "signal_id").join(own, "source_id").where("start_us < end_us")


def sessions(spark, d):
    return table(spark, d, "records").select(F.col("record_id").alias("owner_id"), F.col("time_span_start_us").alias("session_start_us"), F.col("time_span_end_us").alias("session_end_us")).distinct()


def record_spans(spark, d):
    a = table(spark, d, "annotation_occurrences").where("object_type = 'Record' and span_type in ('time_point', 'time_interval') and object_id is not null and start_us is not null")
    return a.select("occurrence_id", F.col("object_id").alias("owner_id"), "span_type", "start_us", F.when(F.col("span_type") == "time_point", F.col("start_us") + 1).otherwise(F.col("end_us")).alias("end_us")).distinct()


def inputs(spark, d):
    """Input records of tasks: their recording, and for every second one the next recording."""
    c = table(spark, d, "cot_rows").where("ecg_id is not null").select(F.col("row_id").alias("task_id"), "ecg_id")
    first = c.select("task_id", F.lit(0).alias("position"), F.col("ecg_id").alias("record_id"))
    return first.unionByName(c.where("task_id % 2 = 0").select("task_id", F.lit(1).alias("position"), (F.col("ecg_id") + 1).alias("record_id")))


@add("sc8_task_table", f"WITH {_TASKS}, {_LINKS}, i AS (SELECT row_id AS task_id, 0 AS position, ecg_id AS record_id FROM cot_rows WHERE ecg_id IS NOT NULL UNION ALL SELECT row_id, 1, ecg_id + 1 FROM cot_rows WHERE ecg_id IS NOT NULL AND row_id % 2 = 0), il AS (SELECT task_id, list(record_id ORDER BY position) l FROM i GROUP BY 1), fl AS (SELECT u, list(v ORDER BY v) l FROM ln GROUP BY 1) SELECT t.task_id, task_type, split, coalesce(il.l, []::BIGINT[]) AS input_record_ids, coalesce(fl.l, []::BIGINT[]) AS from_task_ids FROM t LEFT JOIN il ON il.task_id = t.task_id LEFT JOIN fl ON fl.u = t.task_id")
def sc8(spark, d):
    return model.task_table(tasks(spark, d).select("task_id", "task_type", "split"), inputs(spark, d), links(spark, d))


def targets(spark, d):
    """Answers as lists of targets, one per comma or "and"."""
    return table(spark, d, "cot_rows").select(F.col("row_id").alias("task_id"), F.posexplode_outer(F.split("answer", r", | and ")).alias("position", "text"))


@add(
    "sc9_target_table",
    rf"""WITH {_TASKS}, x AS (SELECT row_id, regexp_split_to_array(answer, ', | and ') l FROM cot_rows), g AS (SELECT row_id AS task_id, i - 1 AS position, l[i] AS text FROM x, LATERAL (SELECT unnest(range(1, len(l) + 1)) i) UNION ALL SELECT row_id, NULL, NULL FROM x WHERE l IS NULL)
    SELECT task_id, task_type, position::INT AS position, CASE WHEN text IS NULL THEN 'none' WHEN regexp_full_match(text, '[0-9]+ ms') THEN 'integer' WHEN lower(regexp_replace(text, '\.$', '')) IN ('yes', 'no') THEN 'boolean' ELSE 'text' END AS kind,
    CASE WHEN regexp_full_match(text, '[0-9]+ ms') THEN TRY_CAST(regexp_extract(text, '^([0-9]+) ms$', 1) AS BIGINT) END AS integer_value, CASE WHEN lower(regexp_replace(text, '\.$', '')) IN ('yes', 'no') THEN lower(regexp_replace(text, '\.$', '')) = 'yes' END AS boolean_value FROM g JOIN t USING (task_id)""",
)
def sc9(spark, d):
    return model.target_table(tasks(spark, d).select("task_id", "task_type"), targets(spark, d)).select("task_id", "task_type", "position", "kind", "integer_value", "boolean_value")


@add("sc10_annotation_table", "WITH o AS (SELECT DISTINCT object_type, object_id, occurrence_id, content_id FROM annotation_occurrences), c AS (SELECT content_id, min(occurrence_id) AS first_use, count(DISTINCT occurrence_id) AS n_uses FROM o GROUP BY 1) SELECT object_type, object_id, occurrence_id, content_id, first_use, n_uses, row_number() OVER (PARTITION BY object_type, object_id ORDER BY occurrence_id) AS position FROM o JOIN c USING (content_id)")
def sc10(spark, d):
    """Occurrences with their contents, in the order of ``occurrence_id`` within an object."""
    from chronoloom.session import prefix_sum

    o = table(spark, d, "annotation_occurrences").select("object_type", "object_id", "occurrence_id", "content_id").distinct()
    c = o.groupBy("content_id").agg(F.min("occurrence_id").alias("first_use"), F.count_distinct("occurrence_id").alias("n_uses"))
    a = o.join(c, "content_id").withColumn("_order", F.coalesce("occurrence_id", F.lit(1 << 62))).withColumn("_one", F.lit(1).cast("long"))
    # the place is a count in two levels: the object with a tenth of the rows is many blocks
    return prefix_sum(a, ["object_type", "object_id"], "_order", "_one", "position").withColumn("position", F.col("position") + 1).drop("_order", "_one")


@add(
    "pj16_input_modalities",
    """WITH s AS (SELECT DISTINCT so.record_id, g.name, g.modality FROM (SELECT DISTINCT signal_id, source_id, name, modality FROM signals) g JOIN (SELECT DISTINCT source_id, record_id FROM sources) so USING (source_id)),
    t AS (SELECT row_id, ecg_id, question, CASE WHEN row_id % 3 = 0 THEN ['ecg_1', 'eeg_2'] END AS scope FROM cot_rows),
    k AS (SELECT row_id, modality FROM t JOIN s ON s.record_id = t.ecg_id WHERE scope IS NULL OR list_contains(scope, s.name) UNION SELECT row_id, 'text' FROM t WHERE question <> '' UNION SELECT row_id, 'no_input' FROM t WHERE ecg_id IS NULL)
    SELECT t.row_id AS task_id, coalesce(list_sort(list(DISTINCT modality) FILTER (modality IS NOT NULL)), []::VARCHAR[]) AS modalities FROM t LEFT JOIN k USING (row_id) GROUP BY 1""",
)
def pj16(spark, d):
    own = table(spark, d, "sources").select("source_id", "record_id").distinct()
    s = table(spark, d, "signals").select("signal_id", "source_id", "name", "modality").distinct().join(own, "source_id").select("record_id", "name", "modality")
    t = table(spark, d, "cot_rows").select(F.col("row_id").alias("task_id"), F.col("question").alias("prompt"), F.when(F.col("row_id") % 3 == 0, F.array(F.lit("ecg_1"), F.lit("eeg_2"))).alias("scope"))
    i = table(spark, d, "cot_rows").where("ecg_id is not null").select(F.col("row_id").alias("task_id"), F.col("ecg_id").alias("record_id"))
    return model.input_modalities(t, i, s)


@add("ag10_derived_schema", "WITH s AS (SELECT DISTINCT signal_id, spec_type, unit, dtype, value_shape FROM signals), d AS (SELECT spec_type, min(signal_id) f, count(DISTINCT coalesce(unit, '<null>') || '|' || coalesce(dtype, '<null>') || '|' || CAST(value_shape AS VARCHAR)) n FROM s GROUP BY 1) SELECT spec_type, row_number() OVER (ORDER BY f) - 1 AS place, n AS n_contracts, n > 1 AS conflict FROM d")
def ag10(spark, d):
    """Spec types in the order of first use, with their contracts and conflicts."""
    return model.derived(table(spark, d, "signals").dropDuplicates(["signal_id", "spec_type", "unit", "dtype", "value_shape"]), "spec_type", ["unit", "dtype", "value_shape"], "signal_id")


@add("ag10_task_types", "WITH d AS (SELECT question_type, min(row_id) f FROM cot_rows WHERE question_type IS NOT NULL GROUP BY 1) SELECT question_type, row_number() OVER (ORDER BY f) - 1 AS place FROM d")
def ag10_tasks(spark, d):
    t = table(spark, d, "cot_rows").where("question_type is not null")
    return model.derived(t, "question_type", ["question_type"], "row_id").select("question_type", "place")


@add(
    "ag13_features_and_targets",
    f"""WITH {_CHUNK}, v AS (SELECT signal_id, list_transform(flatten(list(v ORDER BY chunk_idx)), lambda x: CASE WHEN isnan(x) THEN NULL ELSE round(x::DOUBLE, 4) + 0.0 END) AS features FROM ch GROUP BY 1), t AS (SELECT object_id, max(content_id) AS target FROM annotation_occurrences WHERE object_type = 'Signal' AND object_id IS NOT NULL GROUP BY 1)
    SELECT t.object_id AS signal_id, features, target FROM t JOIN v ON v.signal_id = t.object_id JOIN (SELECT DISTINCT CAST(signal AS BIGINT) signal_id FROM shard WHERE spec_type = 'temperature') k ON k.signal_id = v.signal_id""",
)
def ag13(spark, d):
    """Series and one target per signal: signals that are annotated, with their largest content as the label; lengths may differ."""
    t = table(spark, d, "annotation_occurrences").where("object_type = 'Signal' and object_id is not null").groupBy(F.col("object_id").alias("signal_id")).agg(F.max("content_id").alias("target"))
    own = table(spark, d, "shard").where("spec_type = 'temperature'")
    x = features.features_and_targets(t, series.scan(series.chunks(own)).where("part = 0"), "signal_id", "target", equal_lengths=False)
    return x.select("signal_id", F.transform("features", lambda v: F.when(~F.isnan(v), F.round(v.cast("double"), 4) + F.lit(0.0))).alias("features"), "target")


def resolved(spark, d, paths=True):
    return hierarchy.resolve(table(spark, d, "sources"), paths=paths)


@add("gr1_subtree_signals", f"WITH RECURSIVE {_UP} SELECT root AS root_id, list(signal_id ORDER BY key, g.name, signal_id) AS signal_ids FROM up JOIN (SELECT DISTINCT signal_id, source_id, name FROM signals) g USING (source_id) GROUP BY 1")
def gr1(spark, d):
    """Signals of every tree in the order of the walk: sources in pre-order by name, signals by name within a source."""
    keys = model.walk_keys(resolved(spark, d), table(spark, d, "sources").select(F.col("source_id").alias("node_id"), "name").distinct())
    g = table(spark, d, "signals").select("signal_id", F.col("source_id").alias("node_id"), "name").distinct().join(keys, "node_id")
    return g.groupBy("root_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "name", "signal_id"))), lambda x: x["signal_id"]).alias("signal_ids"))


@add("gr3_cycle_paths", "WITH RECURSIVE e AS (SELECT DISTINCT source_id u, parent_source_id v FROM sources WHERE parent_source_id IS NOT NULL), w AS (SELECT u AS first, v AS now, [u] AS path FROM e UNION ALL SELECT first, e.v, list_append(path, w.now) FROM w JOIN e ON e.u = w.now WHERE w.now <> first AND NOT list_contains(path, w.now)) SELECT first AS end_id, path FROM w WHERE now = first AND first = list_min(path)")
def gr3(spark, d):
    return model.cycles(resolved(spark, d, paths=False))


@add("gr7_annotation_walk", "WITH g AS (SELECT DISTINCT signal_id, source_id FROM signals), so AS (SELECT DISTINCT source_id, record_id FROM sources), a AS (SELECT DISTINCT occurrence_id, object_type, object_id FROM annotation_occurrences) SELECT occurrence_id, object_type, NULL::BIGINT AS record_id FROM a WHERE object_type = 'Dataset' UNION ALL SELECT occurrence_id, object_type, record_id FROM a JOIN (SELECT DISTINCT record_id FROM records) r ON object_type = 'Record' AND object_id = r.record_id UNION ALL SELECT occurrence_id, object_type, record_id FROM a JOIN so ON object_type = 'Source' AND object_id = source_id UNION ALL SELECT occurrence_id, object_type, record_id FROM a JOIN g ON object_type = 'Signal' AND object_id = signal_id JOIN so USING (source_id)")
def gr7(spark, d):
    """Every annotation that the walk over dataset, records, sources and signals meets, with its record."""
    a = table(spark, d, "annotation_occurrences").select("occurrence_id", "object_type", "object_id").distinct()
    so = table(spark, d, "sources").select("source_id", "record_id").distinct()
    g = table(spark, d, "signals").select("signal_id", "source_id").distinct().join(so, "source_id")
    owner = table(spark, d, "records").select(F.lit("Record").alias("object_type"), F.col("record_id").alias("object_id"), "record_id").distinct()
    owner = owner.unionByName(so.select(F.lit("Source").alias("object_type"), F.col("source_id").alias("object_id"), "record_id")).unionByName(g.select(F.lit("Signal").alias("object_type"), F.col("signal_id").alias("object_id"), "record_id"))
    top = a.where("object_type = 'Dataset'").select("occurrence_id", "object_type", F.lit(None).cast("long").alias("record_id"))
    return top.unionByName(a.join(owner, ["object_type", "object_id"]).select("occurrence_id", "object_type", "record_id"))


@add("sm21_walk_order", f"WITH RECURSIVE {_UP} SELECT root AS root_id, source_id AS node_id, row_number() OVER (PARTITION BY root ORDER BY key) - 1 AS place FROM up")
def sm21(spark, d):
    names = table(spark, d, "sources").select(F.col("source_id").alias("node_id"), "name").distinct()
    return model.walk_order(model.walk_keys(resolved(spark, d), names))


@add("fl11_selection_by_name", """WITH s AS (SELECT so.record_id, g.name FROM (SELECT DISTINCT signal_id, source_id, name FROM signals) g JOIN (SELECT DISTINCT source_id, record_id FROM sources) so USING (source_id)), h AS (SELECT record_id, name, count(*) n FROM s GROUP BY 1, 2), b AS (SELECT record_id, min(name) a, max(name) z FROM s GROUP BY 1),
q AS (SELECT record_id, CASE record_id % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [a, a] WHEN 2 THEN [a, 'nowhere'] WHEN 3 THEN [a] ELSE [z] END AS names FROM b), f AS (SELECT q.record_id, min(coalesce(n, 0)) least, max(coalesce(n, 0)) most FROM (SELECT record_id, unnest(names) AS name FROM q) q LEFT JOIN h ON h.record_id = q.record_id AND h.name = q.name GROUP BY 1)
SELECT q.record_id AS request_id, CASE WHEN len(names) = 0 THEN 'empty' WHEN len(list_distinct(names)) < len(names) THEN 'duplicate' WHEN least = 0 THEN 'unknown' WHEN most > 1 THEN 'ambiguous' END AS problem FROM q LEFT JOIN f USING (record_id)""")
def fl11(spark, d):
    own = table(spark, d, "sources").select("source_id", "record_id").distinct()
    s = table(spark, d, "signals").select("signal_id", "source_id", "name").distinct().join(own, "source_id").select("record_id", "name")
    b = s.groupBy("record_id").agg(F.min("name").alias("a"), F.max("name").alias("z"))
    kind = F.col("record_id") % 5
    names = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array("a", "a")).when(kind == 2, F.array("a", F.lit("nowhere"))).when(kind == 3, F.array("a")).otherwise(F.array("z"))
    return model.select_by_name(b.select(F.col("record_id").alias("request_id"), "record_id", names.alias("names")), s)


@add("fl12_without_issues", f"WITH {_TASKS}, p AS (SELECT ecg_id, list_distinct(flatten(list(json_keys(annotations)))) AS issues FROM ptbxl_recordings WHERE ecg_id IS NOT NULL GROUP BY 1) SELECT task_id FROM t LEFT JOIN p ON p.ecg_id = t.record_id WHERE NOT list_has_any(coalesce(issues, []), ['burst_noise', 'baseline_drift'])")
def fl12(spark, d):
    """Tasks whose recording's metadata names none of the issues."""
    keys = F.coalesce(F.json_object_keys("annotations"), F.array().cast("array<string>"))
    p = table(spark, d, "ptbxl_recordings").where("ecg_id is not null").groupBy(F.col("ecg_id").alias("record_id")).agg(F.array_distinct(F.flatten(F.collect_list(keys))).alias("issues"))
    t = tasks(spark, d).join(p, "record_id", "left")
    return t.where(~F.coalesce(F.arrays_overlap("issues", F.array(F.lit("burst_noise"), F.lit("baseline_drift"))), F.lit(False))).select("task_id")


@add("fl14_span_placement", f"WITH {_WINDOWS}, {_merged('mg', 'SELECT record_id AS owner, w0, w1 FROM wn JOIN so USING (source_id)')}, {_SESSION}, {_SPANS} SELECT occurrence_id, {_fits('mg')} AS fits FROM sp LEFT JOIN se ON se.record_id = sp.owner")
def fl14(spark, d):
    """Spans on records: inside the session where there is one, else inside one piece of the union of the signals' windows."""
    w = windows(spark, d).select(F.col("record_id").alias("owner_id"), "start_us", "end_us")
    return model.placed(record_spans(spark, d), w, sessions(spark, d)).select("occurrence_id", "fits")


@add("fl14_scoped_spans", f"WITH {_WINDOWS}, o AS (SELECT DISTINCT content_id, object_id, start_us s0, end_us s1 FROM annotation_occurrences WHERE object_type = 'Signal' AND span_type = 'time_interval' AND start_us < end_us), x AS (SELECT content_id, s0, s1, count(*) n, count(w0) k, max(w0) a, min(w1) z FROM o LEFT JOIN (SELECT * FROM wn WHERE w0 < w1) wn ON wn.signal_id = o.object_id GROUP BY 1, 2, 3) SELECT content_id, s0 AS start_us, s1 AS end_us, n AS n_signals, coalesce(k = n AND s0 >= a AND s1 <= z, false) AS fits FROM x")
def fl14_scoped(spark, d):
    """One annotation on several signals is a scoped span: it must lie inside the intersection of their windows."""
    a = table(spark, d, "annotation_occurrences").where("object_type = 'Signal' and span_type = 'time_interval' and start_us < end_us").select("content_id", F.col("object_id").alias("signal_id"), "start_us", "end_us").distinct()
    w = series.spans(placed(spark, d)).where("start_us < end_us").select("signal_id", F.col("start_us").alias("w0"), F.col("end_us").alias("w1"))
    x = a.join(w, "signal_id", "left").groupBy("content_id", "start_us", "end_us").agg(F.count(F.lit(1)).alias("n_signals"), F.count("w0").alias("k"), F.max("w0").alias("a"), F.min("w1").alias("z"))
    fits = (F.col("k") == F.col("n_signals")) & (F.col("start_us") >= F.col("a")) & (F.col("end_us") <= F.col("z"))
    return x.select("content_id", "start_us", "end_us", "n_signals", F.coalesce(fits, F.lit(False)).alias("fits"))


@add("jn9_list_membership", "WITH s AS (SELECT so.record_id, g.signal_id FROM (SELECT DISTINCT signal_id, source_id FROM signals) g JOIN (SELECT DISTINCT source_id, record_id FROM sources) so USING (source_id)), m AS (SELECT record_id, min(signal_id) a, max(signal_id) z FROM s GROUP BY 1), t AS (SELECT row_id, ecg_id, CASE WHEN row_id % 2 = 0 THEN [a, z] END AS signal_ids FROM cot_rows JOIN m ON m.record_id = ecg_id) SELECT row_id AS task_id, count(DISTINCT signal_id) AS n_signals FROM t JOIN s ON s.record_id = t.ecg_id WHERE signal_ids IS NULL OR list_contains(signal_ids, signal_id) GROUP BY 1")
def jn9(spark, d):
    """The signals of a task's record that its list names; no list means all. An equi-join on the record, then membership."""
    own = table(spark, d, "sources").select("source_id", "record_id").distinct()
    s = table(spark, d, "signals").select("signal_id", "source_id").distinct().join(own, "source_id").select("record_id", "signal_id")
    m = s.groupBy("record_id").agg(F.array(F.min("signal_id"), F.max("signal_id")).alias("named"))
    t = table(spark, d, "cot_rows").select(F.col("row_id").alias("task_id"), F.col("ecg_id").alias("record_id")).join(m, "record_id").withColumn("signal_ids", F.when(F.col("task_id") % 2 == 0, F.col("named")))
    whole = s.groupBy("record_id").agg(F.count_distinct("signal_id").alias("n_signals"))
    named = t.where("signal_ids is not null").select("task_id", "record_id", F.explode(F.array_distinct("signal_ids")).alias("signal_id")).join(s, ["record_id", "signal_id"]).groupBy("task_id").agg(F.count_distinct("signal_id").alias("n_signals"))
    return named.unionByName(t.where("signal_ids is null").join(whole, "record_id").select("task_id", "n_signals"))


@add("jn11_lookup_once", "WITH k AS (SELECT DISTINCT ecg_id, patient_id, sex FROM ptbxl_recordings WHERE ecg_id IS NOT NULL), sh AS (SELECT patient_id, sex, count(DISTINCT coalesce(age, -1)) n, min(age) age FROM ptbxl_recordings WHERE patient_id > 0 AND sex IS NOT NULL GROUP BY 1, 2) SELECT k.ecg_id, k.patient_id, k.sex, coalesce(n, 0) AS n_rows, coalesce(n, 0) = 1 AS exactly_one, CASE WHEN n = 1 THEN age END AS age FROM k LEFT JOIN sh ON sh.patient_id = k.patient_id AND sh.sex = k.sex")
def jn11(spark, d):
    """Recordings looked up in the sheet of subjects by (patient, sex): only a key with exactly one row gives its age."""
    p = table(spark, d, "ptbxl_recordings")
    sheet = p.where("patient_id > 0 and sex is not null").groupBy("patient_id", "sex").agg(F.count_distinct(F.coalesce("age", F.lit(-1))).alias("n"), F.min("age").alias("age"))
    k = p.where("ecg_id is not null").select("ecg_id", "patient_id", "sex").distinct().join(sheet, ["patient_id", "sex"], "left")
    n = F.coalesce("n", F.lit(0))
    return k.select("ecg_id", "patient_id", "sex", n.alias("n_rows"), (n == 1).alias("exactly_one"), F.when(n == 1, F.col("age")).alias("age"))


@add("jn12_parent_by_json_key", "WITH k AS (SELECT ecg_id, json_extract_string(annotations, '$.device') AS device FROM ptbxl_recordings WHERE ecg_id IS NOT NULL), p AS (SELECT device, min(ecg_id) AS parent_id FROM k WHERE device LIKE 'V%' GROUP BY 1) SELECT DISTINCT k.ecg_id, k.device, p.parent_id, CASE WHEN k.device IS NULL THEN 'missing key' WHEN p.parent_id IS NULL THEN 'no parent' ELSE 'found' END AS state FROM k LEFT JOIN p ON p.device = k.device")
def jn12(spark, d):
    """Parents looked up by a key of the JSON metadata; a row without the key and one whose key has no parent are told apart."""
    k = table(spark, d, "ptbxl_recordings").where("ecg_id is not null").select("ecg_id", F.get_json_object("annotations", "$.device").alias("device"))
    p = k.where(F.col("device").like("V%")).groupBy("device").agg(F.min("ecg_id").alias("parent_id"))
    state = F.when(F.col("device").isNull(), "missing key").when(F.col("parent_id").isNull(), "no parent").otherwise("found")
    return k.join(p, "device", "left").select("ecg_id", "device", "parent_id", state.alias("state")).distinct()


# edits

@add("ed1_invalid_tasks", f"WITH RECURSIVE {_LINKS}, {_GONE}, b AS (SELECT task_id AS node FROM refs GROUP BY 1 HAVING bool_and(record_id IN (SELECT record_id FROM gone)) UNION SELECT ln.u FROM b JOIN ln ON ln.v = b.node) SELECT node AS task_id FROM b")
def ed1(spark, d):
    return edit.invalid_tasks(references(spark, d), old_patients(spark, d), links(spark, d))


_TYPED = """gone AS (SELECT 'Record' AS object_type, ecg_id AS object_id FROM ptbxl_recordings WHERE age > 80 UNION SELECT 'Signal', signal_id FROM signals WHERE spec_type = 'eeg' UNION SELECT 'Annotation', occurrence_id FROM annotation_occurrences WHERE object_type = 'Signal' AND object_id IN (SELECT signal_id FROM signals WHERE spec_type = 'eeg')),
refs AS (SELECT row_id AS task_id, 'inputs' AS field, 'Record' AS object_type, ecg_id AS object_id FROM cot_rows WHERE ecg_id IS NOT NULL UNION ALL SELECT row_id, 'inputs', 'Record', ecg_id + 1 FROM cot_rows WHERE ecg_id IS NOT NULL AND row_id % 2 = 0 UNION ALL SELECT row_id, 'candidates', 'Record', ecg_id + 2 FROM cot_rows WHERE ecg_id IS NOT NULL AND row_id % 5 = 0 UNION ALL SELECT row_id, 'span', 'Signal', row_id FROM cot_rows WHERE row_id % 7 = 0 UNION ALL SELECT row_id, 'answer', 'Annotation', row_id FROM cot_rows WHERE row_id % 11 = 0)"""


@add("ed1_invalid_by_reference", f"WITH RECURSIVE {_LINKS}, {_TYPED}, h AS (SELECT refs.*, g.object_id IS NOT NULL AS lost FROM refs LEFT JOIN gone g ON g.object_type = refs.object_type AND g.object_id = refs.object_id), b AS (SELECT task_id AS node FROM h WHERE field = 'inputs' GROUP BY 1 HAVING bool_and(lost) UNION SELECT task_id FROM h WHERE field <> 'inputs' AND lost UNION SELECT ln.u FROM b JOIN ln ON ln.v = b.node) SELECT node AS task_id FROM b")
def ed1_typed(spark, d):
    """Records, signals and annotations go; tasks that lose all inputs, a candidate, a span's signal or an answer's annotation
    can't stay, nor what derives from them."""
    c = table(spark, d, "cot_rows").select(F.col("row_id").alias("task_id"), "ecg_id")

    def ref(field, kind, ident, where):
        return c.where(where).select("task_id", F.lit(field).alias("field"), F.lit(kind).alias("object_type"), ident.alias("object_id"))

    e, t = F.col("ecg_id"), F.col("task_id")
    parts = [ref("inputs", "Record", e, "ecg_id is not null"), ref("inputs", "Record", e + 1, "ecg_id is not null and task_id % 2 = 0"), ref("candidates", "Record", e + 2, "ecg_id is not null and task_id % 5 = 0"), ref("span", "Signal", t, "task_id % 7 = 0"), ref("answer", "Annotation", t, "task_id % 11 = 0")]
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    eeg = table(spark, d, "signals").where("spec_type = 'eeg'").select(F.lit("Signal").alias("object_type"), F.col("signal_id").alias("object_id")).distinct()
    on = table(spark, d, "annotation_occurrences").join(eeg, ["object_type", "object_id"], "left_semi").select(F.lit("Annotation").alias("object_type"), F.col("occurrence_id").alias("object_id"))
    gone = old_patients(spark, d).select(F.lit("Record").alias("object_type"), F.col("record_id").alias("object_id")).unionByName(eeg).unionByName(on)
    return edit.invalid_by(refs, gone, links(spark, d))


@add(
    "ed2_kept_annotations",
    f"""WITH RECURSIVE {_UP}, {_WINDOWS}, g AS (SELECT DISTINCT signal_id, source_id, spec_type IN ('ecg', 'eeg') AS lost FROM signals),
    ow AS (SELECT 'Record' AS object_type, record_id AS object_id, signal_id, lost FROM g JOIN so USING (source_id) UNION SELECT 'Source', a.id, signal_id, lost FROM g JOIN (SELECT source_id, unnest(way) AS id FROM up UNION SELECT DISTINCT source_id, source_id FROM sources) a USING (source_id)),
    lo AS (SELECT DISTINCT object_type, object_id FROM ow WHERE lost), {_merged('mg', "SELECT {'t': object_type, 'i': object_id} AS owner, w0, w1 FROM ow JOIN wn USING (signal_id) WHERE NOT lost")}, se AS (SELECT DISTINCT record_id, time_span_start_us b0, time_span_end_us b1 FROM records),
    o AS (SELECT DISTINCT occurrence_id, object_type, object_id, span_type, start_us s0, CASE WHEN span_type = 'time_point' THEN start_us + 1 ELSE end_us END s1 FROM annotation_occurrences WHERE NOT (object_type = 'Signal' AND object_id IN (SELECT signal_id FROM g WHERE lost)) OR object_id IS NULL)
    SELECT DISTINCT occurrence_id FROM o LEFT JOIN lo ON lo.object_type = o.object_type AND lo.object_id = o.object_id LEFT JOIN se ON o.object_type = 'Record' AND se.record_id = o.object_id
    WHERE lo.object_id IS NULL OR span_type NOT IN ('time_point', 'time_interval') OR s0 IS NULL OR coalesce(CASE WHEN b0 IS NOT NULL AND b1 IS NOT NULL THEN s0 >= b0 AND s1 <= b1 ELSE EXISTS (SELECT 1 FROM mg m WHERE m.owner = {{'t': o.object_type, 'i': o.object_id}} AND m.s <= s0 AND s1 <= m.e) END, false)""",
)
def ed2(spark, d):
    """Annotations that stay once the ECG and EEG signals go, by the rule of a partial record or source."""
    sig = table(spark, d, "signals").select("signal_id", "source_id", "spec_type").distinct()
    owned = edit.signals_below(table(spark, d, "sources"), sig, resolved(spark, d))
    w = series.spans(placed(spark, d))
    s = sessions(spark, d).select(F.lit("Record").alias("object_type"), F.col("owner_id").alias("object_id"), "session_start_us", "session_end_us")
    a = table(spark, d, "annotation_occurrences").select("occurrence_id", "object_type", "object_id", "span_type", "start_us", "end_us").distinct()
    return edit.kept_annotations(a, owned, sig.where("spec_type in ('ecg', 'eeg')"), w, s).select("occurrence_id").distinct()


@add("ed3_edited_version", f"WITH RECURSIVE {_LINKS}, gone AS (SELECT DISTINCT record_id FROM records WHERE record_id % 4 = 0), so AS (SELECT source_id FROM sources WHERE record_id IN (SELECT record_id FROM gone)), sg AS (SELECT signal_id FROM signals WHERE source_id IN (SELECT source_id FROM so) OR spec_type = 'marker'), refs AS (SELECT row_id AS task_id, ecg_id AS record_id FROM cot_rows WHERE ecg_id IS NOT NULL UNION ALL SELECT row_id, ecg_id + 1 FROM cot_rows WHERE ecg_id IS NOT NULL AND row_id % 2 = 0), b AS (SELECT task_id AS node FROM refs GROUP BY 1 HAVING bool_and(record_id IN (SELECT record_id FROM gone)) UNION SELECT ln.u FROM b JOIN ln ON ln.v = b.node) SELECT 'records' AS tbl, count(*) AS n FROM records WHERE record_id NOT IN (SELECT record_id FROM gone) UNION ALL SELECT 'sources', count(*) FROM sources WHERE record_id NOT IN (SELECT record_id FROM gone) UNION ALL SELECT 'signals', count(*) FROM signals WHERE signal_id NOT IN (SELECT signal_id FROM sg) UNION ALL SELECT 'tasks', count(*) FROM cot_rows WHERE row_id NOT IN (SELECT node FROM b) UNION ALL SELECT 'occurrences', count(*) FROM annotation_occurrences WHERE object_id IS NULL OR NOT ((object_type = 'Record' AND object_id IN (SELECT record_id FROM gone)) OR (object_type = 'Source' AND object_id IN (SELECT source_id FROM so)) OR (object_type = 'Signal' AND object_id IN (SELECT signal_id FROM sg)))")
def ed3(spark, d):
    """A version written, edited into a new one (signals, then records with what derives from their tasks) and counted there."""
    from chronoloom.plans.audit_plan import tables_of

    folder = scratch(spark)
    store.write_version(tables_of(spark, d), f"{folder}/org/set/1.0.0", {"name": "Set"})
    t = edit.edit_version(spark, f"{folder}/org/set/1.0.0", f"{folder}/org/set/1.1.0", table(spark, d, "records").where("record_id % 4 = 0"), table(spark, d, "signals").where("spec_type = 'marker'"), cascade=True)
    parts = [t[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n") for n in ("records", "sources", "signals", "tasks", "occurrences")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@add("ed4_imported", "WITH r AS (SELECT DISTINCT record_id FROM records WHERE record_id % 5 = 2), s AS (SELECT DISTINCT ON (source_id) source_id, record_id, parent_source_id FROM sources WHERE record_id IN (SELECT record_id FROM r)), rm AS (SELECT record_id, CASE WHEN record_id % 10 = 2 THEN record_id + 5000 END AS held FROM r), rn AS (SELECT record_id, coalesce(held, 9000 + count(CASE WHEN held IS NULL THEN 1 END) OVER (ORDER BY record_id)) AS new_id FROM rm), sn AS (SELECT source_id, 9000 + row_number() OVER (ORDER BY source_id) AS new_id FROM s) SELECT sn.new_id AS source_id, rn.new_id AS record_id, u.new_id AS parent_source_id FROM s JOIN sn USING (source_id) JOIN rn ON rn.record_id = s.record_id LEFT JOIN sn u ON u.source_id = s.parent_source_id")
def ed4(spark, d):
    """Sources of imported records with new ids and rewritten references; every second record was imported before."""
    held = table(spark, d, "records").where("record_id % 10 = 2").select(F.lit("other").alias("alias"), F.lit("record").alias("kind"), F.col("record_id").alias("parent_id"), (F.col("record_id") + 5000).alias("object_id")).distinct()
    parent = {n: table(spark, d, n) for n in ("records", "sources", "signals")}
    out, _ = edit.import_from(parent, held, table(spark, d, "records").where("record_id % 5 = 2"), {"record": 9000, "source": 9000, "signal": 9000}, "other")
    return out["sources"].select("source_id", "record_id", "parent_source_id")


@add("ed6_reattached", f"WITH {_WINDOWS}, x AS (SELECT record_id AS owner, signal_id, w0, w1 FROM wn JOIN so USING (source_id)), {_merged('ma', 'SELECT owner, w0, w1 FROM x WHERE signal_id % 3 < 2')}, {_merged('mb', 'SELECT owner, w0, w1 FROM x WHERE signal_id % 3 = 0')}, se AS (SELECT NULL::BIGINT AS record_id, NULL::BIGINT AS b0, NULL::BIGINT AS b1), {_SPANS} SELECT occurrence_id FROM sp LEFT JOIN se ON se.record_id = sp.owner WHERE {_fits('ma')} AND NOT {_fits('mb')}")
def ed6(spark, d):
    """Annotations that a record's copy gets as it grows from a third of its signals to two thirds: those that the windows of
    the signals it now has place, and those it had before didn't."""
    w = windows(spark, d).select("signal_id", F.col("record_id").alias("owner_id"), "start_us", "end_us")
    s = record_spans(spark, d)
    after = model.placed(s, w.where("signal_id % 3 < 2").drop("signal_id")).where("fits").select("occurrence_id", "owner_id", "span_type", "start_us", "end_us")
    return model.placed(after, w.where("signal_id % 3 = 0").drop("signal_id")).where("not fits").select("occurrence_id")


@add("ed9_reused_chunks", f"WITH {_CHUNK} SELECT signal_id, count(*) AS reused, sum(n)::BIGINT AS n_values FROM ch WHERE signal_id % 4 <> 0 GROUP BY 1")
def ed9(spark, d):
    """A version without every fourth signal takes over the others' chunks by their locators, and reads them from the base."""
    path = f"{scratch(spark)}/values"
    spec = table(spark, d, "shard").select(F.col("signal").cast("long").alias("signal_id"), "spec_type").distinct()
    store.write_values(chunked(spark, d).join(spec, "signal_id"), path)
    kept = stage(store.locate(spark, path).where("signal_id % 4 <> 0"))
    return store.read_located(spark, kept, path).groupBy("signal_id").agg(F.count(F.lit(1)).alias("reused"), F.sum(F.size("values")).alias("n_values"))


@add("sk2_dataset_round_trip", f"WITH {_CHUNK} SELECT (SELECT count(*) FROM records) AS n_records, (SELECT count(*) FROM ch) AS n_chunks, (SELECT sum(n)::BIGINT FROM ch) AS n_values")
def sk2(spark, d):
    folder = f"{scratch(spark)}/org/set/1.0.0"
    spec = table(spark, d, "shard").select(F.col("signal").cast("long").alias("signal_id"), "spec_type").distinct()
    store.write_dataset({"records": table(spark, d, "records")}, chunked(spark, d).join(spec, "signal_id"), folder, {"name": "Set"})
    tables, card = store.open_version(spark, folder)
    v = spark.read.parquet(card["values"]).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size("values")).alias("n_values"))
    return tables["records"].agg(F.count(F.lit(1)).alias("n_records")).crossJoin(v)  # one row each


@add("sk4_nd_values", "SELECT vec_id, true AS whole, true AS same, 64 AS n_cells FROM embeddings")
def sk4(spark, d):
    """Values of 4 x 4 x 4 cells are stored flat and come back as they were."""
    e = table(spark, d, "embeddings").withColumn("nd", store.unflatten_nd(F.col("embedding"), [4, 4, 4]))
    flat, whole = store.flatten_nd(F.col("nd"), [4, 4, 4])
    return e.select("vec_id", whole.alias("whole"), (flat == F.col("embedding")).alias("same"), F.size(flat).alias("n_cells"))


# rules across tables

@add("au6_external_values", "WITH p AS (SELECT doc_id + (CASE WHEN doc_id % 50 = 0 THEN 1000000000 ELSE 0 END) AS doc_id, CASE WHEN doc_id % 70 = 0 THEN 'list' ELSE 'text' END AS kind, CASE WHEN doc_id % 30 = 0 THEN n_chars + 1 ELSE length(text) END AS n FROM documents WHERE octet_length(encode(text)) > 2000), x AS (SELECT p.*, o.doc_id IS NOT NULL AS owner, length(o.text) AS len FROM p LEFT JOIN documents o ON o.doc_id = p.doc_id) SELECT doc_id, 'owner' AS rule FROM x WHERE NOT owner UNION ALL SELECT doc_id, 'kind' FROM x WHERE kind <> 'text' UNION ALL SELECT doc_id, 'length' FROM x WHERE owner AND n <> len")
def au6(spark, d):
    """Values stored outside their table: the owner must be there, the kind that of the owner's column, the length as stored."""
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    i = F.col("doc_id")
    p = docs.where(F.octet_length("text") > 2000).select((i + F.when(i % 50 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"), F.when(i % 70 == 0, "list").otherwise("text").alias("kind"), F.when(i % 30 == 0, F.col("n_chars") + 1).otherwise(F.length("text")).alias("n"))
    x = p.join(docs.select("doc_id", F.length("text").alias("len"), F.lit(True).alias("owner")), "doc_id", "left")
    rules = {"owner": F.col("owner").isNotNull(), "kind": F.col("kind") == "text", "length": F.col("owner").isNull() | (F.col("n") == F.col("len"))}
    return audit.breaking(x, "doc_id", rules)


@add("au10_parent_rules", "WITH RECURSIVE s AS (SELECT DISTINCT source_id, record_id, parent_source_id FROM sources), e AS (SELECT source_id u, parent_source_id v FROM s WHERE parent_source_id IS NOT NULL), c AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON e.u = c.v) SELECT s.source_id, 'other record' AS rule FROM s JOIN s p ON p.source_id = s.parent_source_id WHERE p.record_id <> s.record_id UNION SELECT source_id, 'no parent' FROM s WHERE parent_source_id IS NOT NULL AND parent_source_id NOT IN (SELECT source_id FROM s) UNION SELECT u, 'cycle' FROM c WHERE u = v")
def au10(spark, d):
    s = table(spark, d, "sources").select("source_id", "record_id", "parent_source_id").distinct()
    p = s.select(F.col("source_id").alias("parent_source_id"), F.col("record_id").alias("_r"), F.lit(True).alias("_p"))
    x = s.where("parent_source_id is not null").join(p, "parent_source_id", "left")
    rules = audit.breaking(x, "source_id", {"other record": F.col("_p").isNull() | (F.col("_r") == F.col("record_id")), "no parent": F.col("_p").isNotNull()})
    return rules.unionByName(resolved(spark, d, paths=False).where("fault = 'on_cycle'").select(F.col("node_id").alias("source_id"), F.lit("cycle").alias("rule")))


@add("au14_registration", "SELECT row_id AS task_id, 'record' AS rule FROM cot_rows WHERE ecg_id IS NOT NULL AND ecg_id NOT IN (SELECT ecg_id FROM ptbxl_recordings WHERE ecg_id IS NOT NULL) UNION ALL SELECT row_id, 'signal' FROM cot_rows WHERE row_id % 7 = 0 AND row_id NOT IN (SELECT signal_id FROM signals) UNION ALL SELECT row_id, 'annotation' FROM cot_rows WHERE row_id % 11 = 0 AND row_id * 7 NOT IN (SELECT occurrence_id FROM annotation_occurrences) UNION ALL SELECT row_id, 'answer' FROM cot_rows WHERE (answer IS NULL) = (rationale IS NULL) AND row_id % 2 = 0 AND answer IS NULL UNION ALL SELECT row_id, 'prompt' FROM cot_rows WHERE coalesce(trim(question), '') = ''")
def au14(spark, d):
    """Rules of a task before it is registered: its record, the signal of its scope and the annotation of its answer exist, it
    has an answer in one form, and a prompt."""
    t = table(spark, d, "cot_rows")

    def known(rows, column, name):
        return rows.where(F.col(column).isNotNull()).select(F.col(column).alias(f"_{name}")).distinct().withColumn(f"_has_{name}", F.lit(True))

    r = known(table(spark, d, "ptbxl_recordings"), "ecg_id", "record")
    s = known(table(spark, d, "signals"), "signal_id", "signal")
    a = known(table(spark, d, "annotation_occurrences"), "occurrence_id", "annotation")
    i = F.col("row_id")
    x = t.join(r, t["ecg_id"] == r["_record"], "left").join(s, i == s["_signal"], "left").join(a, i * 7 == a["_annotation"], "left")
    rules = {
        "record": F.col("ecg_id").isNull() | F.col("_has_record").isNotNull(), "signal": (i % 7 != 0) | F.col("_has_signal").isNotNull(), "annotation": (i % 11 != 0) | F.col("_has_annotation").isNotNull(),
        "answer": ~((i % 2 == 0) & F.col("answer").isNull() & F.col("rationale").isNull()), "prompt": F.coalesce(F.trim("question"), F.lit("")) != "",
    }
    return audit.breaking(x, "row_id", rules).withColumnRenamed("row_id", "task_id")


@add("au15_spec_contract", f"WITH {_CHUNK}, s AS (SELECT DISTINCT ON (signal_id) * FROM signals ORDER BY signal_id, n_values, null_count), v AS (SELECT signal_id, sum(n)::BIGINT n, sum(len(list_filter(v, lambda x: x IS NULL)))::BIGINT nulls FROM ch GROUP BY 1), x AS (SELECT s.*, k.unit AS spec_unit, k.spec_type IS NOT NULL AS known, v.n AS stored, v.nulls FROM s LEFT JOIN spec_refs k ON k.spec_type = s.spec_type LEFT JOIN v ON v.signal_id = s.signal_id) SELECT signal_id, 'spec' AS rule FROM x WHERE NOT known UNION ALL SELECT signal_id, 'unit' FROM x WHERE unit <> spec_unit UNION ALL SELECT signal_id, 'dtype' FROM x WHERE dtype NOT IN ('float32', 'float64') UNION ALL SELECT signal_id, 'shape' FROM x WHERE len(value_shape) <> len(dimension_names) UNION ALL SELECT signal_id, 'length' FROM x WHERE stored <> n_values UNION ALL SELECT signal_id, 'nulls' FROM x WHERE nulls <> null_count UNION ALL SELECT signal_id, 'categories' FROM x WHERE len(list_distinct(categories)) < len(categories)")
def au15(spark, d):
    """Per signal: known spec, its unit, dtype, shape against dimensions, stored length and nulls against the declared, no repeated category."""
    from pyspark.sql import Window

    w = Window.partitionBy("signal_id").orderBy("n_values", F.col("null_count").asc_nulls_last())
    s = table(spark, d, "signals").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    k = table(spark, d, "spec_refs").select("spec_type", F.col("unit").alias("spec_unit"), F.lit(True).alias("known"))
    v = chunked(spark, d).groupBy("signal_id").agg(F.sum("n_values").alias("stored"), F.sum(F.size(F.filter("values", lambda x: x.isNull()))).alias("nulls"))
    x = s.join(F.broadcast(k), "spec_type", "left").join(v, "signal_id", "left")  # the fixed table of specs
    rules = {
        "spec": F.col("known").isNotNull(), "unit": F.col("unit") == F.col("spec_unit"), "dtype": F.col("dtype").isin("float32", "float64"), "shape": F.size("value_shape") == F.size("dimension_names"),
        "length": F.col("stored") == F.col("n_values"), "nulls": F.col("nulls") == F.col("null_count"), "categories": F.size(F.array_distinct("categories")) == F.size("categories"),
    }
    return audit.breaking(x, "signal_id", rules)


@add("sc19_row_schema", "WITH e AS (SELECT event_id, event_type, value, json_keys(props) AS keys FROM events) SELECT event_id, CASE WHEN NOT list_has_all(['k'], coalesce(keys, [])) THEN 'extra' WHEN NOT list_contains(coalesce(keys, []), 'k') THEN 'missing' WHEN value < 0 THEN 'value' END AS problem FROM e")
def sc19(spark, d):
    """Rows against a schema that forbids extra fields: the field that is missing, extra or out of its domain."""
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    want = F.array(F.lit("k"))
    problem = F.when(~sel.only_from(keys, want), "extra").when(~sel.holds_all(keys, want), "missing").when(F.col("value") < 0, "value")
    return table(spark, d, "events").select("event_id", problem.alias("problem"))


@add("sm3_targets_in_pool", "WITH t AS (SELECT row_id AS task_id, ecg_id AS target FROM cot_rows WHERE ecg_id IS NOT NULL), p AS (SELECT task_id, target AS candidate FROM t WHERE task_id % 5 = 0 UNION ALL SELECT task_id, target + 2 FROM t WHERE task_id % 5 IN (0, 1)) SELECT task_id, target FROM t WHERE task_id IN (SELECT task_id FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE p.task_id = t.task_id AND p.candidate = t.target)")
def sm3(spark, d):
    """Record targets outside their task's pool of candidates; a task without a pool takes its targets from the whole dataset."""
    t = table(spark, d, "cot_rows").where("ecg_id is not null").select(F.col("row_id").alias("task_id"), F.col("ecg_id").alias("target"))
    p = t.where("task_id % 5 = 0").select("task_id", F.col("target").alias("candidate")).unionByName(t.where("task_id % 5 in (0, 1)").select("task_id", (F.col("target") + 2).alias("candidate")))
    held = p.withColumnRenamed("candidate", "target")
    return t.join(p.select("task_id").distinct(), "task_id", "left_semi").join(held, ["task_id", "target"], "left_anti")


@add("sm5_label_set_equality", "WITH l AS (SELECT l_orderkey AS k, list(l_partkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS labels FROM lineitem GROUP BY 1) SELECT a.k AS l_orderkey, a.labels = b.labels AS same_ordered, list_sort(a.labels) = list_sort(b.labels) AS same_unordered FROM l a JOIN l b ON b.k = a.k + 1")
def sm5(spark, d):
    """Label sets of neighbouring orders, compared with and without their order (as multisets)."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("p"), (F.col("l_partkey") % 3).alias("v"))
    a = sel.ordered_list(x, "l_orderkey", "p", "v", "labels")
    b = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("labels").alias("other"))
    return a.join(b, "l_orderkey").select("l_orderkey", (F.col("labels") == F.col("other")).alias("same_ordered"), (F.array_sort("labels") == F.array_sort("other")).alias("same_unordered"))


@add("sm6_content_key", "SELECT md5(coalesce(CAST(content_id AS VARCHAR), '') || '|' || coalesce(provenance, '')) AS content_key, count(DISTINCT occurrence_id) AS n_occurrences, min(occurrence_id) AS first_use FROM annotation_occurrences GROUP BY 1")
def sm6(spark, d):
    """Occurrences by the key of what they say: span, confidence and metadata of the occurrence don't count."""
    key = F.md5(F.concat(F.coalesce(F.col("content_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("provenance", F.lit(""))))
    return table(spark, d, "annotation_occurrences").groupBy(key.alias("content_key")).agg(F.count_distinct("occurrence_id").alias("n_occurrences"), F.min("occurrence_id").alias("first_use"))


@add("sm12_grouped_rollups", f"WITH {_PLACED} SELECT source_id, spec_type, list(signal_id ORDER BY period_numerator_us * 1.0 / period_denominator, signal_id) AS signal_ids, min(period_numerator_us * 1.0 / period_denominator) = max(period_numerator_us * 1.0 / period_denominator) AS one_period FROM p WHERE axis_type = 'regular' GROUP BY 1, 2")
def sm12(spark, d):
    """One metric's rollups by source, the finest period first."""
    p = placed(spark, d).where("axis_type = 'regular'").withColumn("period", F.col("period_numerator_us") * 1.0 / F.col("period_denominator"))
    g = p.groupBy("source_id", "spec_type").agg(F.array_sort(F.collect_list(F.struct("period", "signal_id"))).alias("l"), F.min("period").alias("a"), F.max("period").alias("z"))
    return g.select("source_id", "spec_type", F.transform("l", lambda x: x["signal_id"]).alias("signal_ids"), (F.col("a") == F.col("z")).alias("one_period"))


@add("sm28_sectioned_text", r"WITH x AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS lines FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, list_filter(lines, lambda l: regexp_matches(l, '^([A-Z][A-Za-z]*): (.+)$')) AS h, list_filter(lines, lambda l: NOT regexp_matches(l, '^([A-Z][A-Za-z]*): (.+)$') AND l <> '') AS rest FROM x) SELECT doc_id, list_transform(h, lambda l: regexp_extract(l, '^([A-Z][A-Za-z]*): (.+)$', 1)) AS headings, len(list_distinct(list_transform(h, lambda l: regexp_extract(l, '^([A-Z][A-Za-z]*): (.+)$', 1)))) < len(h) AS repeated, len(rest) AS n_rest FROM y")
def sm28(spark, d):
    """Texts parsed into sections; a heading that occurs twice is refused, the other lines are kept."""
    parsed, rest = model.sections(F.col("text"))
    x = table(spark, d, "documents").where("text is not null").select("doc_id", parsed.alias("s"), F.size(rest).cast("long").alias("n_rest"))
    h = F.transform("s", lambda p: p["heading"])
    return x.select("doc_id", h.alias("headings"), (F.size(F.array_distinct(h)) < F.size(h)).alias("repeated"), "n_rest")


@add("sm29_role_order", "SELECT row_id, row_id % 9 <> 0 AND trim(coalesce(question, '')) <> '' AND trim(coalesce(answer, '')) <> '' AS valid FROM cot_rows")
def sm29(spark, d):
    """Messages must be a system, a user and an assistant turn in this order, none blank; every ninth row has them swapped."""
    swap = F.col("row_id") % 9 == 0
    system, user, assistant = (F.struct(F.lit(r).alias("role"), t.alias("content")) for r, t in (("system", F.lit("Answer the question.")), ("user", F.col("question")), ("assistant", F.col("answer"))))
    m = table(spark, d, "cot_rows").select("row_id", F.when(swap, F.array(system, assistant, user)).otherwise(F.array(system, user, assistant)).alias("messages"))
    return m.select("row_id", tk.role_order(F.transform("messages", lambda x: x["role"]), F.transform("messages", lambda x: x["content"]), ["system", "user", "assistant"]).alias("valid"))


@add("sm30_sibling_lengths", "SELECT DISTINCT signal, chunk_idx, len(\"values\") <> n_values AS ragged, len(\"values\") = 60 AS whole FROM shard WHERE \"values\" IS NOT NULL")
def sm30(spark, d):
    """Chunks whose array isn't as long as declared, and those of the fixed length."""
    n = F.size("values")
    return table(spark, d, "shard").where("values is not null").select("signal", "chunk_idx", (n != F.col("n_values")).alias("ragged"), (n == 60).alias("whole")).distinct()


@add("sm31_optional_columns", "WITH r AS (SELECT DISTINCT record_id, time_span_start_us ts1, time_span_end_us ts2 FROM records) SELECT record_id, 'ts1' AS series, ts1 AS value FROM r WHERE ts1 IS NOT NULL UNION ALL SELECT record_id, 'ts2', ts2 FROM r WHERE ts1 IS NOT NULL AND ts2 IS NOT NULL")
def sm31(spark, d):
    """One row per series that is there: the first column alone, or both; a second one without a first is refused."""
    r = table(spark, d, "records").select("record_id", F.col("time_span_start_us").alias("ts1"), F.col("time_span_end_us").alias("ts2")).distinct()
    return r.where("ts1 is not null").unpivot("record_id", ["ts1", "ts2"], "series", "value").where("value is not null")


@add("sm32_choice_answers", r"WITH q AS (SELECT row_id, question, lower(trim(answer)) AS a, CASE WHEN question LIKE 'Between % and %, what fits this ECG better?' THEN string_split(regexp_extract(lower(question), '^between (.*), what fits this ecg better\?$', 1), ' and ') WHEN question LIKE 'Which finding does this tracing show, % or %?' THEN string_split(regexp_extract(lower(question), '^which finding does this tracing show, (.*)\?$', 1), ' or ') WHEN question_type = 'verify' THEN ['yes', 'no', 'not sure'] END AS choices FROM cot_rows) SELECT row_id, choices, list_contains(list_append(choices, 'none'), regexp_replace(a, '\.$', '')) AS fits FROM q WHERE choices IS NOT NULL")
def sm32(spark, d):
    """Choices read from the question in its forms (two findings, or yes and no), and whether the answer is one of them."""
    q, low = F.col("question"), F.lower("question")
    choices = (
        F.when(q.like("Between % and %, what fits this ECG better?"), F.split(F.regexp_extract(low, r"^between (.*), what fits this ecg better\?$", 1), " and "))
        .when(q.like("Which finding does this tracing show, % or %?"), F.split(F.regexp_extract(low, r"^which finding does this tracing show, (.*)\?$", 1), " or "))
        .when(F.col("question_type") == "verify", F.array(F.lit("yes"), F.lit("no"), F.lit("not sure")))
    )
    x = table(spark, d, "cot_rows").select("row_id", choices.alias("choices"), F.regexp_replace(F.lower(F.trim("answer")), r"\.$", "").alias("a")).where("choices is not null")
    return x.select("row_id", "choices", F.array_contains(F.array_append("choices", F.lit("none")), F.col("a")).alias("fits"))


@add("sm37_whole_number_text", "SELECT o_orderkey, TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) = floor(o_totalprice) AS whole, TRY_CAST(trim('[' || o_custkey || ']', '[]') AS BIGINT) AS bracketed FROM orders")
def sm37(spark, d):
    """Whole numbers written as floating text, and ids in brackets."""
    text, cell = F.col("o_totalprice").cast("string"), F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit("]"))
    return table(spark, d, "orders").select("o_orderkey", (text.try_cast("double") == F.floor("o_totalprice")).alias("whole"), F.btrim(cell, F.lit("[]")).try_cast("long").alias("bracketed"))


_PATHS = "p AS (SELECT 'org/' || lower(c_mktsegment) AS id, CASE WHEN c_custkey % 11 = 0 THEN '.1.0.0' WHEN c_custkey % 13 = 0 THEN 'staging-1.0.0' WHEN c_custkey % 17 = 0 THEN '01.' || c_custkey % 5 || '.0' ELSE c_custkey % 7 || '.' || c_custkey % 3 || '.' || c_custkey % 5 END AS folder FROM customer)"


@add("sm38_listing", f"WITH {_PATHS}, v AS (SELECT DISTINCT id, string_split(folder, '.')[1]::INT AS major, string_split(folder, '.')[2]::INT AS minor, string_split(folder, '.')[3]::INT AS patch FROM p WHERE regexp_full_match(folder, '(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)')) SELECT id, major, minor, patch FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY major DESC, minor DESC, patch DESC) = 1")
def sm38(spark, d):
    """The newest version of each dataset of a listing; hidden and staging folders and versions not in canonical form are skipped."""
    k = F.col("c_custkey")
    folder = F.when(k % 11 == 0, ".1.0.0").when(k % 13 == 0, "staging-1.0.0").when(k % 17 == 0, F.concat(F.lit("01."), (k % 5).cast("string"), F.lit(".0"))).otherwise(F.concat_ws(".", k % 7, k % 3, k % 5))
    p = table(spark, d, "customer").select(F.concat(F.lit("org/"), F.lower("c_mktsegment")).alias("id"), folder.alias("folder"))
    v = p.where(F.col("folder").rlike(r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$")).withColumn("n", F.split("folder", r"\.").cast("array<int>"))
    return sel.newest(v.select("id", F.col("n")[0].alias("major"), F.col("n")[1].alias("minor"), F.col("n")[2].alias("patch")).distinct(), "id", ["major", "minor", "patch"])


# sources, sinks and projections

@add("pj17_units", "SELECT DISTINCT signal_id, CASE unit WHEN 'uV' THEN 'microvolt' WHEN 'mV' THEN 'millivolt' WHEN 'bpm' THEN 'beat/minute' WHEN 'degC' THEN 'degree_Celsius' WHEN 'kW' THEN 'kilowatt' WHEN '1' THEN 'dimensionless' WHEN 'm/s^2' THEN 'metre/second^2' ELSE unit END AS unit FROM signals")
def pj17(spark, d):
    return table(spark, d, "signals").select("signal_id", units.normal_unit(F.col("unit")).alias("unit")).distinct()


_LEVEL = "CASE source WHEN 'incident_log' THEN 3 WHEN 'qa_thread' THEN 2 WHEN 'recording_note' THEN 1 ELSE 0 END"


@add("pj19_effective_access", f"WITH a AS (SELECT dataset_id, split_part(dataset_id, '/', 1) AS org, max({_LEVEL}) AS own FROM documents WHERE dataset_id IS NOT NULL GROUP BY 1) SELECT dataset_id, own, max(own) OVER (PARTITION BY org ORDER BY dataset_id) AS effective FROM a")
def pj19(spark, d):
    """Strictness of a dataset's own card, and of all it derives from (here each dataset of an organisation from the one before)."""
    from pyspark.sql import Window

    strict = F.when(F.col("source") == "incident_log", 3).when(F.col("source") == "qa_thread", 2).when(F.col("source") == "recording_note", 1).otherwise(0)
    a = table(spark, d, "documents").where("dataset_id is not null").groupBy("dataset_id").agg(F.max(strict).alias("own"))
    w = Window.partitionBy(F.split_part("dataset_id", F.lit("/"), F.lit(1))).orderBy("dataset_id")
    lineage = a.select(F.col("dataset_id").alias("u"), F.lag("dataset_id").over(w).alias("v")).where("v is not null")
    above = graph.closure(lineage).join(a.select(F.col("dataset_id").alias("v"), F.col("own").alias("_o")), "v").groupBy(F.col("u").alias("dataset_id")).agg(F.max("_o").alias("_m"))
    return a.join(above, "dataset_id", "left").select("dataset_id", "own", F.greatest("own", F.coalesce("_m", "own")).alias("effective"))


@add("sc27_in_memory", "SELECT vec_id AS signal_id, 'regular' AS kind, len(embedding)::BIGINT AS n_values, 0::BIGINT AS start_us, len(embedding)::BIGINT * 4000 AS end_us, (len(embedding) + 23) // 24 AS n_chunks FROM embeddings UNION ALL SELECT vec_id, 'irregular', len(embedding)::BIGINT, vec_id, vec_id + (len(embedding) - 1) * 10 + 1, (len(embedding) + 23) // 24 FROM embeddings")
def sc27(spark, d):
    """Signals made from values at hand: on a regular axis, on an irregular one, with what they cover and their chunks."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("signal_id"), F.col("embedding").alias("values"))
    offsets = F.transform(F.sequence(F.lit(0), F.size("values") - 1), lambda i: F.col("signal_id") + i * 10)
    out = None
    for kind, (signals, axes, chunks) in (("regular", memory.from_loader(e, lambda keys: e.join(keys, "signal_id", "left_semi"), 4000)), ("irregular", memory.from_irregular(e.withColumn("offsets", offsets), 24))):
        if kind == "regular":
            signals, axes, chunks = memory.from_values(e, 4000, chunk=24)
            axes = axes.withColumn("first_us", F.lit(None).cast("long")).withColumn("last_us", F.lit(None).cast("long"))
        else:
            axes = axes.withColumns({c: F.lit(None).cast("long") for c in ("start_index", "period_numerator_us", "period_denominator", "offset_us")})
        n = chunks.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n_chunks"))
        part = series.spans(signals.join(axes, "axis_id")).join(signals, "signal_id").join(n, "signal_id").select("signal_id", F.lit(kind).alias("kind"), "n_values", "start_us", "end_us", "n_chunks")
        out = part if out is None else out.unionByName(part)
    return out


def _png(width, height, channels):
    """A test image: every cell is (7x + 13y + 31c) mod 256; lines use the five filters in turn."""
    import struct
    import zlib

    import numpy as np

    x = np.add.outer(13 * np.arange(height), 7 * np.arange(width))[..., None] + 31 * np.arange(channels)
    px = (x % 256).astype(int).reshape(height, -1)
    lines = b""
    for y in range(height):
        a = np.r_[np.zeros(channels, int), px[y][:-channels]]
        b = px[y - 1] if y else np.zeros_like(px[y])
        c = np.r_[np.zeros(channels, int), b[:-channels]]
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        kind = y % 5
        lines += bytes([kind]) + ((px[y] - [0, a, b, (a + b) // 2, near][kind]) % 256).astype(np.uint8).tobytes()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@add("sc23_images", "SELECT k.channels, (i // k.channels // 11)::INT AS y, (i // k.channels % 11)::INT AS x, (i % k.channels)::INT AS c, ((7 * (i // k.channels % 11) + 13 * (i // k.channels // 11) + 31 * (i % k.channels)) % 256)::SMALLINT AS value FROM (VALUES (3), (4)) k(channels), LATERAL (SELECT unnest(range(0, 11 * 9 * k.channels)) AS i)")
def sc23(spark, d):
    """Two images, RGB and RGBA, written and read back as tensors."""
    folder = scratch(spark)
    for channels in (3, 4):
        store.write_bytes(spark, f"{folder}/{channels}.png", _png(11, 9, channels))
    rows = readers.read_images(spark, folder).select(F.col("shape")[2].alias("channels"), F.col("shape")[1].alias("w"), F.posexplode("values").alias("i", "value"))
    cell = F.floor(F.col("i") / F.col("channels"))
    return rows.select("channels", F.floor(cell / F.col("w")).cast("int").alias("y"), (cell % F.col("w")).cast("int").alias("x"), (F.col("i") % F.col("channels")).alias("c"), "value")


@add("sk9_control_sink", "SELECT false AS left_behind, count(*) AS n FROM records")
def sk9(spark, d):
    """A write that fails half way leaves nothing; the next one is whole."""
    path = f"{scratch(spark)}/org/set/1.0.0"
    good = table(spark, d, "records").select("record_id")
    bad = good.withColumn("x", F.when(F.col("record_id") >= 0, F.raise_error(F.lit("broken row"))).otherwise(F.lit(1)))
    try:
        store.write_version({"records": good, "broken": bad}, path, {"name": "Set"})
    except Exception:  # noqa: BLE001 - the failure is what is tested
        pass
    left = store.exists(spark, path) or store.exists(spark, f"{path}/records")
    store.write_version({"records": good}, path, {"name": "Set"})
    return store.open_version(spark, path)[0]["records"].agg(F.count(F.lit(1)).alias("n")).select(F.lit(left).alias("left_behind"), "n")


@add("sk13_copied_release", "SELECT 2 AS copied, 0 AS again, count(*) AS n FROM records WHERE record_id % 4 <> 0")
def sk13(spark, d):
    """An edited version is copied with the one that it was made from; copying again does nothing."""
    root = scratch(spark)
    r = table(spark, d, "records").select("record_id")
    store.write_version({"records": r}, f"{root}/a/org/set/1.0.0", {"name": "Set"})
    store.write_version({"records": r.where("record_id % 4 <> 0")}, f"{root}/a/org/set/1.1.0", {"name": "Set", "base": f"{root}/a/org/set/1.0.0"})
    copied, again = (len(store.copy_release(spark, f"{root}/a/org/set/1.1.0", f"{root}/b")) for _ in range(2))
    n = store.open_version(spark, f"{root}/b/org/set/1.1.0")[0]["records"].agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(copied).alias("copied"), F.lit(again).alias("again"), "n")


@add("sm15_add_batch", "SELECT row_id, (SELECT max(record_id) FROM records) + row_number() OVER (ORDER BY row_id) AS task_id FROM cot_rows WHERE question IS NOT NULL")
def sm15(spark, d):
    """Rows are registered as tasks, all or none: ids follow the highest held one once the rules hold."""
    held = table(spark, d, "records").select(F.lit(None).cast("long").alias("row_id"), F.col("record_id").alias("task_id"))
    batch = table(spark, d, "cot_rows").where("question is not null").select("row_id", F.col("row_id").alias("position"), "question").dropDuplicates(["row_id"])
    rules = audit.breaking(batch, "row_id", {"prompt": F.col("question").isNotNull(), "id": F.col("row_id") > 0})
    return tk.add_batch(held, batch.drop("question"), rules, "task_id").where("row_id is not null")


@add("ext_skewed_counts", "SELECT object_type, object_id, count(*) AS n, round(avg(confidence), 5) AS mean FROM annotation_occurrences GROUP BY 1, 2")
def ext_skewed(spark, d):
    """Counts and means by a skewed key. Partial sums are combined before the exchange, so the hot key needs no salt."""
    return table(spark, d, "annotation_occurrences").groupBy("object_type", "object_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 5).alias("mean"))


@add("ext_group_folds", "SELECT count(DISTINCT patient_id) AS n_groups, 0::BIGINT AS torn, 5::BIGINT AS folds FROM ptbxl_recordings WHERE patient_id > 0")
def ext_folds(spark, d):
    """Folds that keep the recordings of a patient together."""
    f = features.group_folds(table(spark, d, "ptbxl_recordings").where("patient_id > 0"), "patient_id", 5)
    per = f.groupBy("patient_id").agg(F.min("fold").alias("a"), F.max("fold").alias("z"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("a") != F.col("z")).alias("torn"), F.count_distinct("a").alias("folds"))
