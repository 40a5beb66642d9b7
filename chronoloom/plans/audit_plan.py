"""Queries of audits, graphs, edits and the smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import audit, edit, features, graph, series
from chronoloom.operators import select as sel
from chronoloom.plans.registry import Registry
from chronoloom.plans.select_plan import _OWNERS, _TASKS, owners, tasks
from chronoloom.plans.series_plan import _CHUNK, chunked
from chronoloom.session import previous, table

audit_plan = Registry()
add = audit_plan.add


@add("au1_unique_keys", "SELECT 'signals' AS tbl, signal_id AS id, count(*) AS n FROM signals GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'sources', source_id, count(*) FROM sources GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'annotations', occurrence_id, count(*) FROM annotation_occurrences GROUP BY 2 HAVING count(*) > 1")
def au1(spark, d):
    def of(name, key, what):
        return audit.repeated_keys(table(spark, d, name), key).select(F.lit(what).alias("tbl"), F.col(key).alias("id"), "n")

    return of("signals", "signal_id", "signals").unionByName(of("sources", "source_id", "sources")).unionByName(of("annotation_occurrences", "occurrence_id", "annotations"))


@add("au2_foreign_keys", "SELECT 'source' AS ref, source_id AS id, count(*) AS n FROM signals WHERE source_id NOT IN (SELECT source_id FROM sources) GROUP BY 2 UNION ALL SELECT 'record', record_id, count(*) FROM sources WHERE record_id NOT IN (SELECT record_id FROM records) GROUP BY 2 UNION ALL SELECT 'parent', parent_source_id, count(*) FROM sources WHERE parent_source_id NOT IN (SELECT source_id FROM sources) GROUP BY 2 UNION ALL SELECT 'ecg', ecg_id, count(*) FROM cot_rows WHERE ecg_id NOT IN (SELECT ecg_id FROM ptbxl_recordings WHERE ecg_id IS NOT NULL) GROUP BY 2")
def au2(spark, d):
    def of(what, name, column, to, key):
        return audit.dangling(table(spark, d, name), column, table(spark, d, to), key).select(F.lit(what).alias("ref"), F.col(column).alias("id"), "n")

    return of("source", "signals", "source_id", "sources", "source_id").unionByName(of("record", "sources", "record_id", "records", "record_id")).unionByName(of("parent", "sources", "parent_source_id", "sources", "source_id")).unionByName(of("ecg", "cot_rows", "ecg_id", "ptbxl_recordings", "ecg_id"))


@add("au3_domains", """SELECT DISTINCT signal_id, unnest(list_filter([CASE WHEN n_values <= 0 THEN 'n_values' END, CASE WHEN null_count < 0 OR null_count > n_values THEN 'null_count' END, CASE WHEN spec_type NOT IN (SELECT spec_type FROM spec_refs) THEN 'spec_type' END, CASE WHEN dtype NOT IN ('bool', 'enum', 'float32', 'float64', 'int8', 'int16', 'int32', 'str', 'uint8', 'uint16', 'uint32') THEN 'dtype' END, CASE WHEN trim(name) = '' THEN 'name' END, CASE WHEN missing_reason NOT IN ('sensor_gap', 'not_recorded', 'alignment_padding', 'not_applicable', 'redacted') THEN 'missing_reason' END, CASE WHEN modality <> 'time_series' THEN 'modality' END, CASE WHEN null_count > 0 AND missing_reason IS NULL THEN 'nulls without reason' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT * REPLACE (CASE WHEN signal_id % 50 = 0 THEN n_values + 1 ELSE null_count END AS null_count, CASE WHEN signal_id % 77 = 0 THEN 'int64' ELSE dtype END AS dtype, CASE WHEN signal_id % 91 = 0 THEN ' ' ELSE name END AS name) FROM signals)""")
def au3(spark, d):
    c = F.col
    known = [r[0] for r in table(spark, d, "spec_refs").select("spec_type").collect()]  # the fixed table of specs
    rules = {
        "n_values": c("n_values") > 0, "null_count": (c("null_count") >= 0) & (c("null_count") <= c("n_values")), "spec_type": c("spec_type").isin(*known),
        "dtype": c("dtype").isin("bool", "enum", "float32", "float64", "int8", "int16", "int32", "str", "uint8", "uint16", "uint32"), "name": F.trim("name") != "",
        "missing_reason": c("missing_reason").isin("sensor_gap", "not_recorded", "alignment_padding", "not_applicable", "redacted"), "modality": c("modality") == "time_series",
        "nulls without reason": ~((c("null_count") > 0) & c("missing_reason").isNull()),
    }
    # the data keep these rules, so faults are put in, the same ones in the SQL
    k = c("signal_id")
    faulty = table(spark, d, "signals").withColumns({"null_count": F.when(k % 50 == 0, c("n_values") + 1).otherwise(c("null_count")), "dtype": F.when(k % 77 == 0, "int64").otherwise(c("dtype")), "name": F.when(k % 91 == 0, " ").otherwise(c("name"))})
    return audit.breaking(faulty, "signal_id", rules)


@add("au4_modality_rules", f"WITH {_TASKS} SELECT task_id, rule FROM (SELECT task_id, CASE WHEN len(modalities) = 0 THEN 'empty' WHEN prompt IS NOT NULL AND NOT list_contains(modalities, 'text') THEN 'prompt without text' WHEN record_id IS NULL AND NOT list_contains(modalities, 'no_input') THEN 'no_input' WHEN list_contains(modalities, 'no_input') AND list_contains(modalities, 'image') THEN 'no_input with input' END rule FROM (SELECT * REPLACE (CASE WHEN task_id % 40 = 0 THEN ['image', 'time_series'] ELSE modalities END AS modalities) FROM t)) WHERE rule IS NOT NULL")
def au4(spark, d):
    m = F.col("modalities")
    has = lambda x: F.array_contains(m, x)
    rules = {"empty": F.size(m) > 0, "prompt without text": F.col("prompt").isNull() | has("text"), "no_input": F.col("record_id").isNotNull() | has("no_input"), "no_input with input": ~(has("no_input") & has("image"))}
    faulty = tasks(spark, d).withColumn("modalities", F.when(F.col("task_id") % 40 == 0, F.array(F.lit("image"), F.lit("time_series"))).otherwise(m))
    return audit.breaking(faulty, "task_id", {k: v for k, v in rules.items() if k != "no_input"}).unionByName(audit.breaking(faulty.where("prompt is null"), "task_id", {"no_input": rules["no_input"]}))


@add("au5_owner_exists", f"WITH {_OWNERS} SELECT object_type, object_id, count(*) AS n FROM (SELECT object_type, CASE WHEN occurrence_id % 100 = 0 THEN object_id + 1000000000 ELSE object_id END AS object_id FROM annotation_occurrences) a WHERE object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.object_type = a.object_type AND w.object_id = a.object_id) GROUP BY 1, 2")
def au5(spark, d):
    a = table(spark, d, "annotation_occurrences")
    faulty = a.withColumn("object_id", F.when(F.col("occurrence_id") % 100 == 0, F.col("object_id") + 1_000_000_000).otherwise(F.col("object_id")))
    return audit.dangling_owner(faulty, owners(spark, d))


@add("au8_label_rules", "WITH t AS (SELECT row_id AS task_id, CASE WHEN row_id % 5 = 0 THEN NULL WHEN row_id % 7 = 0 THEN 'other' ELSE question_type END AS label FROM cot_rows) SELECT task_id, 'not in the set' AS rule FROM t WHERE label NOT IN ('choose', 'measure', 'query', 'verify') UNION SELECT task_id, 'not exactly one' FROM t GROUP BY 1 HAVING count(label) <> 1")
def au8(spark, d):
    label = F.when(F.col("row_id") % 5 == 0, None).when(F.col("row_id") % 7 == 0, "other").otherwise(F.col("question_type"))
    t = table(spark, d, "cot_rows").select(F.col("row_id").alias("task_id"), label.alias("label"))
    labels = spark.createDataFrame([("choose",), ("measure",), ("query",), ("verify",)], "label string")
    return audit.label_rules(t, labels, "task_id", "label", multi=False)


@add("au9_scope_resolves", "SELECT occurrence_id, count(DISTINCT s.record_id) AS n_records FROM (SELECT DISTINCT occurrence_id, CASE WHEN occurrence_id % 60 = 0 THEN -object_id ELSE object_id END AS object_id FROM annotation_occurrences WHERE object_type = 'Signal') a LEFT JOIN signals g ON g.signal_id = a.object_id LEFT JOIN sources s ON s.source_id = g.source_id GROUP BY 1 HAVING count(DISTINCT s.record_id) <> 1")
def au9(spark, d):
    a = table(spark, d, "annotation_occurrences").where("object_type = 'Signal'").select("occurrence_id", F.when(F.col("occurrence_id") % 60 == 0, -F.col("object_id")).otherwise(F.col("object_id")).alias("signal_id")).distinct()
    g = table(spark, d, "signals").select("signal_id", "source_id").distinct().join(table(spark, d, "sources").select("source_id", "record_id").distinct(), "source_id", "left").select("signal_id", "record_id")
    return a.join(g, "signal_id", "left").groupBy("occurrence_id").agg(F.countDistinct("record_id").alias("n_records")).where("n_records <> 1")


@add("au11_offset_lengths", "SELECT DISTINCT s.signal_id FROM signals s JOIN axes a USING (axis_id) WHERE (axis_type = 'irregular' AND (time_offsets IS NULL OR len(time_offsets) <> n_values)) OR (axis_type <> 'irregular' AND time_offsets IS NOT NULL)")
def au11(spark, d):
    x = series.axes_of(table(spark, d, "signals"), table(spark, d, "axes"))
    t = F.col("time_offsets")
    bad = ((F.col("axis_type") == "irregular") & (t.isNull() | (F.size(t) != F.col("n_values")))) | ((F.col("axis_type") != "irregular") & t.isNotNull())
    return x.where(bad).select("signal_id").distinct()


@add("au12_chunk_coverage", "SELECT s.signal_id, s.n_values, c.n::BIGINT AS stored FROM (SELECT signal_id, min(n_values) n_values FROM signals GROUP BY 1) s JOIN (SELECT CAST(signal AS BIGINT) signal_id, sum(n) n FROM (SELECT signal, chunk_idx, any_value(len(\"values\")) n FROM shard GROUP BY ALL) GROUP BY 1) c USING (signal_id) WHERE c.n <> s.n_values")
def au12(spark, d):
    return audit.coverage(table(spark, d, "signals"), chunked(spark, d))


@add("au12_chunk_gaps", f"WITH {_CHUNK} SELECT signal_id, count(DISTINCT chunk_idx) AS n, max(chunk_idx) AS last FROM ch WHERE NOT (signal_id % 9 = 0 AND chunk_idx = 1) GROUP BY 1 HAVING min(chunk_idx) <> 0 OR max(chunk_idx) <> count(DISTINCT chunk_idx) - 1")
def au12_gaps(spark, d):
    return audit.chunk_gaps(chunked(spark, d).where("not (signal_id % 9 = 0 and chunk_idx = 1)"))  # a lost chunk, put in


_LINKS = "l AS (SELECT row_id AS u, max(row_id) OVER (PARTITION BY ecg_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM cot_rows WHERE ecg_id IS NOT NULL), ln AS (SELECT u, v FROM l WHERE v IS NOT NULL)"


def links(spark, d):
    """Derivation of tasks: each from the task before it on the same recording."""
    t = table(spark, d, "cot_rows").where("ecg_id is not null").select("ecg_id", "row_id")
    return previous(t, ["ecg_id"], "row_id", "row_id", "before").select(F.col("row_id").alias("u"), F.col("before.v").alias("v")).where("v is not null")


@add("gr2_ancestors", f"WITH RECURSIVE {_LINKS}, c AS (SELECT u, v FROM ln UNION SELECT c.u, ln.v FROM c JOIN ln ON ln.u = c.v) SELECT u, v FROM c")
def gr2(spark, d):
    return graph.closure(links(spark, d))


@add("gr4_levels", f"WITH RECURSIVE {_LINKS}, n AS (SELECT u AS node FROM ln UNION SELECT v FROM ln), c AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT u FROM ln) UNION ALL SELECT ln.u, c.level + 1 FROM c JOIN ln ON ln.v = c.node) SELECT node, max(level)::INT AS level FROM c GROUP BY 1")
def gr4(spark, d):
    e = links(spark, d)
    return graph.levels(e, e.select(F.explode(F.array("u", "v")).alias("node")))


@add("gr5_cycle_check", "WITH RECURSIVE e AS (SELECT DISTINCT source_id u, parent_source_id v FROM sources WHERE parent_source_id IS NOT NULL), c AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON e.u = c.v) SELECT u AS node FROM c WHERE u = v")
def gr5(spark, d):
    """A source has one parent, so a coloured walk up tells; no closure is built."""
    from chronoloom.operators import hierarchy

    return hierarchy.resolve(table(spark, d, "sources"), paths=False).where("fault = 'on_cycle'").select(F.col("node_id").alias("node"))


@add("gr6_cascade", f"WITH RECURSIVE {_LINKS}, c AS (SELECT row_id AS node FROM cot_rows WHERE ecg_id % 30 = 0 UNION SELECT ln.u FROM c JOIN ln ON ln.v = c.node) SELECT node FROM c")
def gr6(spark, d):
    start = table(spark, d, "cot_rows").where("ecg_id % 30 = 0").select(F.col("row_id").alias("node"))
    return graph.reachable(start, links(spark, d).select(F.col("v").alias("u"), F.col("u").alias("v")))


_GONE = "gone AS (SELECT ecg_id AS record_id FROM ptbxl_recordings WHERE age > 80), refs AS (SELECT row_id AS task_id, 'inputs' AS field, ecg_id AS record_id FROM cot_rows WHERE ecg_id IS NOT NULL UNION ALL SELECT row_id, 'inputs', ecg_id + 1 FROM cot_rows WHERE ecg_id IS NOT NULL AND row_id % 2 = 0)"


def references(spark, d):
    c = table(spark, d, "cot_rows").where("ecg_id is not null")
    one = c.select(F.col("row_id").alias("task_id"), F.lit("inputs").alias("field"), F.col("ecg_id").alias("record_id"))
    two = c.where("row_id % 2 = 0").select(F.col("row_id").alias("task_id"), F.lit("inputs").alias("field"), (F.col("ecg_id") + 1).alias("record_id"))
    return one.unionByName(two)


def old_patients(spark, d):
    return table(spark, d, "ptbxl_recordings").where("age > 80").select(F.col("ecg_id").alias("record_id"))


def tables_of(spark, d):
    t = {n: table(spark, d, n).drop("metadata") for n in ("records", "sources", "signals")}
    return t | {"occurrences": table(spark, d, "annotation_occurrences").drop("metadata", "provenance"), "tasks": tasks(spark, d), "refs": references(spark, d), "links": links(spark, d)}


@add("ed5_merge_by_name", "WITH b AS (SELECT DISTINCT record_id, name FROM sources WHERE source_id % 2 = 0), o AS (SELECT DISTINCT record_id, name FROM sources WHERE source_id % 2 = 1) SELECT record_id, name FROM b UNION SELECT record_id, name FROM o")
def ed5(spark, d):
    s = table(spark, d, "sources")
    b, o = (s.where(f"source_id % 2 = {k}").select("record_id", "name").distinct() for k in (0, 1))
    return edit.merged_names(b, o, ["record_id", "name"])


@add("ed7_rewritten_references", "SELECT row_id AS task_id, ecg_id + 100000 AS record_id FROM cot_rows WHERE ecg_id IN (SELECT ecg_id FROM ptbxl_recordings WHERE sex = 'male')")
def ed7(spark, d):
    ids = table(spark, d, "ptbxl_recordings").where("sex = 'male'").select(F.col("ecg_id").alias("parent_id"), (F.col("ecg_id") + 100_000).alias("object_id")).distinct()
    t = table(spark, d, "cot_rows").select(F.col("row_id").alias("task_id"), F.col("ecg_id").alias("record_id"))
    return edit.rewritten(t, "record_id", ids)


@add("sm17_release_difference", "WITH a AS (SELECT doc_id, md5(text) h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END h FROM documents WHERE doc_id % 4 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h IS DISTINCT FROM b.h")
def sm17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    new = docs.where("doc_id % 4 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")))
    return edit.difference(docs.where("doc_id % 5 <> 0"), new, "doc_id", "h")


@add("sm7_split_from_fold", "SELECT ecg_id, CASE ecg_id % 10 WHEN 9 THEN 'test' WHEN 8 THEN 'validation' ELSE 'train' END AS split FROM ptbxl_recordings")
def sm7(spark, d):
    fold = F.col("ecg_id") % 10
    return table(spark, d, "ptbxl_recordings").select("ecg_id", features.split_of_fold(fold, [8], [9]).alias("split"))


@add("sm8_first_seen_split", f"WITH {_TASKS} SELECT record_id, arg_min(split, task_id) AS split FROM t WHERE record_id IS NOT NULL AND split IS NOT NULL GROUP BY 1")
def sm8(spark, d):
    return tasks(spark, d).where("record_id is not null and split is not null").groupBy("record_id").agg(F.min_by("split", "task_id").alias("split"))


@add("sm10_natural_key", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, epoch_us(ts) // 3600000000) AS earlier FROM events QUALIFY earlier <> event_id")
def sm10(spark, d):
    w = Window.partitionBy("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)))
    return table(spark, d, "events").select("event_id", F.min("event_id").over(w).alias("earlier")).where("earlier <> event_id")


@add("sm13_series_identity", f"WITH {_CHUNK} SELECT any_value(n) AS n_values, count(*) AS n FROM (SELECT *, list_transform(v, lambda x: CASE WHEN x IS NULL THEN 'null' WHEN isnan(x) THEN 'nan' WHEN x = 0 AND signbit(x) THEN '-0' ELSE CAST(x AS VARCHAR) END) bits FROM ch) GROUP BY bits HAVING count(*) > 1")
def sm13(spark, d):
    """Chunks with the same values, bit for bit: null, NaN and both zeros are told apart."""
    body = F.concat_ws(",", F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit("null"))))
    c = chunked(spark, d).select("n_values", F.sha2(body, 256).alias("digest"))
    return c.groupBy("digest").agg(F.first("n_values").alias("n_values"), F.count(F.lit(1)).alias("n")).where("n > 1").select("n_values", "n")


@add("sm22_sibling_names", "SELECT record_id, parent_source_id, name, count(DISTINCT source_id) AS n FROM sources GROUP BY 1, 2, 3 HAVING count(DISTINCT source_id) > 1")
def sm22(spark, d):
    return table(spark, d, "sources").groupBy("record_id", "parent_source_id", "name").agg(F.countDistinct("source_id").alias("n")).where("n > 1")


@add("sm23_fixed_window", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS ok FROM embeddings")
def sm23(spark, d):
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").select("vec_id", ((F.size("embedding") == 64) & finite).alias("ok"))


@add("sm24_unpivot", "SELECT p_partkey, axis, round(value, 4) AS value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR axis IN (size, price))")
def sm24(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "axis", "value").select("p_partkey", "axis", F.round("value", 4).alias("value"))


@add("sm25_regex_subject", r"SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 1) AS study, CAST(regexp_extract(c_name, '#0*([0-9]+)', 1) AS BIGINT) AS subject FROM customer")
def sm25(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "([A-Za-z]+)#0*([0-9]+)", 1).alias("study"), F.regexp_extract("c_name", "#0*([0-9]+)", 1).cast("long").alias("subject"))


@add("sm26_frozen_positions", "SELECT row_id, coalesce(v.split, 'train') AS split FROM cot_rows LEFT JOIN (VALUES (1::BIGINT, 'validation'), (5, 'test'), (9, 'test')) v(row_id, split) USING (row_id)")
def sm26(spark, d):
    frozen = spark.createDataFrame([(1, "validation"), (5, "test"), (9, "test")], "row_id long, split string")
    return features.frozen_splits(table(spark, d, "cot_rows").select("row_id"), frozen, "row_id")


@add("sm27_stratified_holdout", "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) k, count(*) OVER (PARTITION BY label) n FROM embeddings) SELECT vec_id, CASE WHEN k * 10 <= n THEN 'test' WHEN k * 10 <= 2 * n THEN 'validation' ELSE 'train' END AS split FROM r")
def sm27(spark, d):
    return features.stratified(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 1, 1, 10).select("vec_id", "split")


@add("sm33_ambiguous_candidates", "SELECT vec_id, len(list_distinct(c)) < len(c) AS ambiguous FROM (SELECT vec_id, [label, (vec_id % 3)::INT, (vec_id % 5)::INT] c FROM embeddings)")
def sm33(spark, d):
    c = F.array(F.col("label"), (F.col("vec_id") % 3).cast("int"), (F.col("vec_id") % 5).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", (F.size(F.array_distinct(c)) < F.size(c)).alias("ambiguous"))


@add("sm34_zero_input", f"WITH {_CHUNK} SELECT signal_id, chunk_idx FROM ch WHERE n > 0 AND len(list_filter(v, lambda x: coalesce(x, 1) <> 0)) = 0")
def sm34(spark, d):
    return chunked(spark, d).where((F.size("values") > 0) & F.forall("values", lambda x: F.coalesce(x, F.lit(1.0)) == 0)).select("signal_id", "chunk_idx")


@add("sm36_template_text", "SELECT ecg_id, concat_ws('. ', CASE WHEN age BETWEEN 0 AND 120 THEN 'Age ' || age END, 'Sex ' || sex) AS text FROM ptbxl_recordings")
def sm36(spark, d):
    parts = F.array_compact(F.array(F.when(F.col("age").between(0, 120), F.concat(F.lit("Age "), F.col("age").cast("string"))), F.concat(F.lit("Sex "), F.col("sex"))))
    return table(spark, d, "ptbxl_recordings").select("ecg_id", F.concat_ws(". ", parts).alias("text"))


@add("sm39_search_order", "SELECT dataset_id, count(*) AS n FROM documents WHERE lower(text) LIKE '%splits follow the subject%' AND dataset_id IS NOT NULL GROUP BY 1")
def sm39(spark, d):
    docs = table(spark, d, "documents").where("dataset_id is not null")
    cards = sel.search(docs, ["Splits follow the subject"], ["text"], order="dataset_id", limit=None).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return cards.orderBy("dataset_id")


