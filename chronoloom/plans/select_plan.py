"""Queries that scan, filter, join, aggregate and order the control tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import select as sel
from chronoloom.plans.registry import Registry
from chronoloom.session import numbered, prefix_sum, table

select_plan = Registry()
add = select_plan.add

_TASKS = "t AS (SELECT row_id AS task_id, question_type AS task_type, question AS prompt, CASE lower(trim(split)) WHEN 'val' THEN 'validation' ELSE lower(trim(split)) END AS split, ecg_id AS record_id, CASE WHEN ecg_id IS NULL THEN ['no_input', 'text'] WHEN rationale IS NULL THEN ['text', 'time_series'] ELSE ['text', 'time_series', 'image'] END AS modalities, source, answer, rationale FROM cot_rows)"


def tasks(spark, d):
    """Question rows as tasks with one input record."""
    split = F.lower(F.trim("split"))
    kinds = F.when(F.col("ecg_id").isNull(), F.array(F.lit("no_input"), F.lit("text"))).when(F.col("rationale").isNull(), F.array(F.lit("text"), F.lit("time_series"))).otherwise(F.array(F.lit("text"), F.lit("time_series"), F.lit("image")))
    return table(spark, d, "cot_rows").select(F.col("row_id").alias("task_id"), F.col("question_type").alias("task_type"), F.col("question").alias("prompt"), F.when(split == "val", "validation").otherwise(split).alias("split"), F.col("ecg_id").alias("record_id"), kinds.alias("modalities"), "source", "answer", "rationale")


def unique(spark, d, name, key):
    return table(spark, d, name).dropDuplicates([key])


@add("sc1_open", "SELECT record_id, clock_id, time_span_start_us, time_span_end_us, read_order FROM records")
def sc1(spark, d):
    return table(spark, d, "records").select("record_id", "clock_id", "time_span_start_us", "time_span_end_us", "read_order")


@add("sc2_record_ids", "SELECT row_number() OVER (ORDER BY read_order) AS position, record_id FROM records")
def sc2(spark, d):
    return numbered(table(spark, d, "records").select("read_order", "record_id"), ["read_order"], "position").select("position", "record_id")


@add("sc3_records_in_order", "WITH q AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 250), (4, 1)) v(position, record_id)) SELECT q.position::INT AS position, q.record_id::BIGINT AS record_id, r.read_order FROM q JOIN records r ON r.record_id = q.record_id")
def sc3(spark, d):
    asked = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 250), (4, 1)], "position int, record_id long")
    return sel.in_order(asked, table(spark, d, "records"), "record_id").select("position", "record_id", "read_order")


@add("sc4_keyset_page", "SELECT record_id, read_order FROM records WHERE read_order > 40 ORDER BY read_order LIMIT 25")
def sc4(spark, d):
    return sel.page(table(spark, d, "records"), "read_order", 40, 25).select("record_id", "read_order")


@add("sc5_hierarchy", "SELECT r.record_id, count(DISTINCT s.source_id) AS n_sources, count(DISTINCT g.signal_id) AS n_signals FROM records r LEFT JOIN sources s USING (record_id) LEFT JOIN signals g ON g.source_id = s.source_id GROUP BY 1")
def sc5(spark, d):
    s = unique(spark, d, "sources", "source_id").select("source_id", "record_id")
    g = unique(spark, d, "signals", "signal_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    per = s.join(g, "source_id", "left").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_signals"))
    return table(spark, d, "records").select("record_id").join(per, "record_id", "left").na.fill(0)


@add("sc6_tasks", f"WITH {_TASKS} SELECT task_id, task_type FROM t WHERE split = 'test' AND list_has_all(modalities, ['time_series'])")
def sc6(spark, d):
    t = sel.in_splits(tasks(spark, d), "test")
    return t.where(sel.holds_all(F.col("modalities"), F.array(F.lit("time_series")))).select("task_id", "task_type")


@add("sc7_missing_ids", "SELECT v.id::BIGINT AS signal_id FROM (VALUES (1), (2), (999999999), (-5)) v(id) WHERE v.id NOT IN (SELECT signal_id FROM signals)")
def sc7(spark, d):
    asked = spark.createDataFrame([(1,), (2,), (999999999,), (-5,)], "signal_id long")
    return sel.missing(asked, table(spark, d, "signals"), "signal_id")


@add("fl1_split", f"WITH {_TASKS} SELECT task_id FROM t WHERE split = 'validation'")
def fl1(spark, d):
    return sel.in_splits(tasks(spark, d), "validation", "validation").select("task_id")


@add("fl2_splits", f"WITH {_TASKS} SELECT split, count(*) AS n FROM t WHERE split IN ('train', 'validation', 'test') GROUP BY 1")
def fl2(spark, d):
    return sel.in_splits(tasks(spark, d), "train", "validation", "test").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@add("fl3_required_modalities", f"WITH {_TASKS} SELECT task_id FROM t WHERE list_has_all(modalities, ['image', 'text'])")
def fl3(spark, d):
    return tasks(spark, d).where(sel.holds_all(F.col("modalities"), F.array(F.lit("image"), F.lit("text")))).select("task_id")


@add("fl4_supported_modalities", f"WITH {_TASKS} SELECT task_id FROM t WHERE list_has_all(['text', 'time_series'], modalities)")
def fl4(spark, d):
    return tasks(spark, d).where(sel.only_from(F.col("modalities"), F.array(F.lit("text"), F.lit("time_series")))).select("task_id")


@add("fl5_tasks_of_records", f"WITH {_TASKS} SELECT task_id FROM t WHERE record_id IN (SELECT ecg_id FROM ptbxl_recordings WHERE sex = 'female')")
def fl5(spark, d):
    chosen = table(spark, d, "ptbxl_recordings").where("sex = 'female'").select(F.col("ecg_id").alias("record_id"))
    return sel.with_inputs(tasks(spark, d), chosen, "record_id").select("task_id")


@add("fl6_tasks_of_type", f"WITH {_TASKS} SELECT record_id, count(*) AS n FROM t WHERE task_type = 'measure' GROUP BY 1")
def fl6(spark, d):
    return tasks(spark, d).where("task_type = 'measure'").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


@add("fl7_owner_filter", "SELECT DISTINCT occurrence_id FROM annotation_occurrences WHERE (object_type = 'Signal' AND object_id IN (SELECT signal_id FROM signals WHERE spec_type = 'ecg')) OR (object_type = 'Record' AND object_id IN (SELECT record_id FROM records WHERE time_span_start_us IS NULL))")
def fl7(spark, d):
    a = table(spark, d, "annotation_occurrences")
    s = table(spark, d, "signals").where("spec_type = 'ecg'").select(F.col("signal_id").alias("object_id"))
    r = table(spark, d, "records").where("time_span_start_us is null").select(F.col("record_id").alias("object_id"))
    return sel.owned_by(a, "Signal", s).unionByName(sel.owned_by(a, "Record", r)).select("occurrence_id").distinct()


@add("fl9_scope", "SELECT task_id, signal_id FROM (SELECT row_id AS task_id, CASE WHEN row_id % 3 = 0 THEN NULL ELSE [row_id % 7, row_id % 11] END AS scope FROM cot_rows) t, (VALUES (1::BIGINT), (5)) v(signal_id) WHERE scope IS NULL OR list_contains(scope, signal_id)")
def fl9(spark, d):
    scope = F.when(F.col("row_id") % 3 == 0, None).otherwise(F.array(F.col("row_id") % 7, F.col("row_id") % 11))
    t = table(spark, d, "cot_rows").select(F.col("row_id").alias("task_id"), scope.alias("scope"), F.explode(F.array(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("signal_id"))
    return t.where(F.col("scope").isNull() | F.array_contains("scope", F.col("signal_id"))).select("task_id", "signal_id")


@add("fl10_search", "SELECT p_partkey AS id, p_name FROM part WHERE (lower(p_name || ' ' || p_type) LIKE '%ring%' OR lower(p_name || ' ' || p_type) LIKE '%small%') AND p_brand IN ('Brand#11', 'Brand#23', 'Brand#1', 'Brand#2') ORDER BY p_partkey LIMIT 100")
def fl10(spark, d):
    cards = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    return sel.search(cards, ["Ring", "SMALL"], ["p_name", "p_type"], {"p_brand": ["Brand#11", "Brand#23", "Brand#1", "Brand#2"]}).select("id", "p_name")


@add("jn1_inner", "SELECT o_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def jn1(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return x.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@add("jn2_left_outer", "SELECT a.axis_id, count(s.signal_id) AS n_signals, min(n_values) AS least, max(n_values) AS most FROM axes a LEFT JOIN (SELECT DISTINCT signal_id, axis_id, n_values FROM signals) s USING (axis_id) GROUP BY 1")
def jn2(spark, d):
    s = table(spark, d, "signals").select("signal_id", "axis_id", "n_values").distinct().groupBy("axis_id").agg(F.count(F.lit(1)).alias("n_signals"), F.min("n_values").alias("least"), F.max("n_values").alias("most"))
    return table(spark, d, "axes").select("axis_id").join(s, "axis_id", "left").na.fill(0, ["n_signals"])


@add("jn3_semi", "SELECT record_id FROM records WHERE record_id IN (SELECT object_id FROM annotation_occurrences WHERE object_type = 'Record')")
def jn3(spark, d):
    a = table(spark, d, "annotation_occurrences").where("object_type = 'Record'").select(F.col("object_id").alias("record_id"))
    return table(spark, d, "records").join(a, "record_id", "left_semi").select("record_id")


@add("jn4_anti", "SELECT DISTINCT ecg_id FROM cot_rows c WHERE ecg_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ptbxl_recordings p WHERE p.ecg_id = c.ecg_id)")
def jn4(spark, d):
    return table(spark, d, "cot_rows").where("ecg_id is not null").select("ecg_id").distinct().join(table(spark, d, "ptbxl_recordings").select("ecg_id"), "ecg_id", "left_anti")


@add("jn5_exists", "SELECT record_id, EXISTS (SELECT 1 FROM sources s WHERE s.record_id = r.record_id AND s.parent_source_id IS NOT NULL) AS nested FROM records r")
def jn5(spark, d):
    nested = table(spark, d, "sources").where("parent_source_id is not null").select("record_id").distinct().withColumn("nested", F.lit(True))
    return table(spark, d, "records").select("record_id").join(nested, "record_id", "left").na.fill(False, ["nested"])


@add("jn6_cross_record_parent", "SELECT DISTINCT c.source_id FROM sources c JOIN sources p ON p.source_id = c.parent_source_id WHERE p.record_id <> c.record_id")
def jn6(spark, d):
    s = table(spark, d, "sources").select("source_id", "record_id", "parent_source_id").distinct()
    p = s.select(F.col("source_id").alias("parent_source_id"), F.col("record_id").alias("parent_record"))
    return s.join(p, "parent_source_id").where("parent_record <> record_id").select("source_id").distinct()


_OWNERS = "w AS (SELECT 'Record' AS object_type, record_id AS object_id FROM records UNION SELECT 'Source', source_id FROM sources UNION SELECT 'Signal', signal_id FROM signals)"


def owners(spark, d):
    """Typed keys of everything that an annotation can belong to."""
    parts = [table(spark, d, t).select(F.lit(k).alias("object_type"), F.col(c).alias("object_id")) for k, t, c in (("Record", "records", "record_id"), ("Source", "sources", "source_id"), ("Signal", "signals", "signal_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@add("jn7_polymorphic_owner", f"WITH {_OWNERS}, a AS (SELECT DISTINCT occurrence_id, object_type, object_id FROM annotation_occurrences) SELECT object_type, count(*) AS n FROM a JOIN w USING (object_type, object_id) GROUP BY 1")
def jn7(spark, d):
    a = table(spark, d, "annotation_occurrences").select("occurrence_id", "object_type", "object_id").distinct()
    return a.join(owners(spark, d), ["object_type", "object_id"]).groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


@add("jn8_list_key", "WITH o AS (SELECT axis_id, unnest(time_offsets) t FROM axes) SELECT axis_id, count(*) AS n, count(t) AS present, count(DISTINCT t) AS n_distinct FROM o GROUP BY 1")
def jn8(spark, d):
    o = table(spark, d, "axes").select("axis_id", F.explode("time_offsets").alias("t"))
    return o.groupBy("axis_id").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("present"), F.countDistinct("t").alias("n_distinct"))


@add("jn13_text_materialise", "WITH p AS (SELECT doc_id, text FROM documents WHERE octet_length(encode(text)) > 4096) SELECT d.doc_id, p.doc_id IS NOT NULL AS packed, md5(coalesce(p.text, d.text)) AS digest FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id")
def jn13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    big = F.octet_length("text") > 4096
    packed = docs.where(big).select("doc_id", F.col("text").alias("packed_text"))
    inline = docs.select("doc_id", F.when(~big, F.col("text")).alias("text"))
    return inline.join(packed, "doc_id", "left").select("doc_id", F.col("packed_text").isNotNull().alias("packed"), F.md5(F.coalesce("packed_text", "text")).alias("digest"))


@add("jn14_asof", "SELECT c.row_id, max(e.ts)::VARCHAR AS last_ts FROM (SELECT row_id, fetched_at, row_id % 15 AS user_id FROM cot_rows) c ASOF LEFT JOIN events e ON c.user_id = e.user_id AND c.fetched_at >= e.ts GROUP BY 1")
def jn14(spark, d):
    """As-of join (an extension)."""
    c = table(spark, d, "cot_rows").select("row_id", F.col("fetched_at").alias("at"), (F.col("row_id") % 15).alias("user_id"))
    x = sel.asof(c, table(spark, d, "events").select("user_id", "ts"), "user_id", "at", "ts", "last_ts")
    return x.select("row_id", F.col("last_ts").cast("string").alias("last_ts"))


@add("ag1_counts", "SELECT spec_type, count(DISTINCT signal_id) AS n FROM signals GROUP BY 1")
def ag1(spark, d):
    return table(spark, d, "signals").groupBy("spec_type").agg(F.countDistinct("signal_id").alias("n"))


@add("ag2_shared_length", "SELECT axis_id, min(n_values) AS least, max(n_values) AS most FROM signals GROUP BY 1 HAVING min(n_values) <> max(n_values)")
def ag2(spark, d):
    return table(spark, d, "signals").groupBy("axis_id").agg(F.min("n_values").alias("least"), F.max("n_values").alias("most")).where("least <> most")


@add("ag3_ordered_list", "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS parts FROM lineitem GROUP BY 1")
def ag3(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place"), "l_partkey")
    return sel.ordered_list(x, "l_orderkey", "place", "l_partkey", "parts")


@add("ag4_chunk_coverage", "SELECT s.signal_id, s.n_values, coalesce(c.n, 0)::BIGINT AS stored FROM (SELECT signal_id, min(n_values) n_values FROM signals GROUP BY 1) s LEFT JOIN (SELECT CAST(signal AS BIGINT) signal_id, sum(n_values) n FROM (SELECT DISTINCT signal, chunk_idx, n_values FROM shard) GROUP BY 1) c USING (signal_id) WHERE c.n IS NOT NULL")
def ag4(spark, d):
    c = table(spark, d, "shard").select(F.col("signal").cast("long").alias("signal_id"), "chunk_idx", "n_values").distinct().groupBy("signal_id").agg(F.sum("n_values").alias("stored"))
    s = table(spark, d, "signals").groupBy("signal_id").agg(F.min("n_values").alias("n_values"))
    return s.join(c, "signal_id").select("signal_id", "n_values", "stored")


@add("ag5_duplicate_keys", "SELECT signal, chunk_idx, count(*) AS n FROM shard GROUP BY 1, 2 HAVING count(*) > 1")
def ag5(spark, d):
    return table(spark, d, "shard").groupBy("signal", "chunk_idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@add("ag6_group_by_array", "SELECT CAST(value_shape AS VARCHAR) AS shape, CAST(categories AS VARCHAR) AS categories, count(DISTINCT CASE WHEN null_count > 0 THEN signal_id END) AS n FROM signals GROUP BY value_shape, categories")
def ag6(spark, d):
    g = table(spark, d, "signals").groupBy("value_shape", "categories").agg(F.countDistinct(F.when(F.col("null_count") > 0, F.col("signal_id"))).alias("n"))
    text = lambda c: F.concat(F.lit("["), F.concat_ws(", ", F.col(c).cast("array<string>")), F.lit("]"))
    return g.select(F.when(F.col("value_shape").isNotNull(), text("value_shape")).alias("shape"), F.when(F.col("categories").isNotNull(), text("categories")).alias("categories"), "n")


@add("ag7_first_location", "SELECT l_partkey, min(l_orderkey * 100 + l_linenumber) // 100 AS orderkey, min(l_orderkey * 100 + l_linenumber) % 100 AS linenumber FROM lineitem GROUP BY 1")
def ag7(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    return m.select("l_partkey", F.col("m.l_orderkey").alias("orderkey"), F.col("m.l_linenumber").cast("long").alias("linenumber"))


@add("ag8_label_counts", "SELECT label, count(*) AS n, count(*) = 1 AS once FROM embeddings GROUP BY 1")
def ag8(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 1).alias("once"))


@add("ag9_describe", "SELECT 'records' AS what, count(*) AS n FROM records UNION ALL SELECT 'sources', count(DISTINCT source_id) FROM sources UNION ALL SELECT 'signals', count(DISTINCT signal_id) FROM signals UNION ALL SELECT 'annotations', count(DISTINCT occurrence_id) FROM annotation_occurrences UNION ALL SELECT 'contents', count(DISTINCT content_id) FROM annotation_occurrences")
def ag9(spark, d):
    def n(name, column, what):
        return table(spark, d, name).agg(F.countDistinct(column).alias("n")).select(F.lit(what).alias("what"), "n")

    parts = [n("records", "record_id", "records"), n("sources", "source_id", "sources"), n("signals", "signal_id", "signals"), n("annotation_occurrences", "occurrence_id", "annotations"), n("annotation_occurrences", "content_id", "contents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@add("ag14_content_ids", "SELECT content_id, row_number() OVER (ORDER BY first_use) AS new_id FROM (SELECT content_id, min(occurrence_id) first_use FROM annotation_occurrences GROUP BY 1)")
def ag14(spark, d):
    return sel.first_seen(table(spark, d, "annotation_occurrences"), ["content_id"], "occurrence_id", "new_id").select("content_id", F.col("new_id").cast("long").alias("new_id"))


@add("ag15_duplicate_questions", f"WITH {_TASKS} SELECT sha256(lower(trim(prompt))) AS digest, count(*) AS n, count(DISTINCT answer) AS n_answers, count(DISTINCT split) > 1 AS leaks FROM t WHERE prompt IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def ag15(spark, d):
    t = tasks(spark, d).where("prompt is not null").groupBy(F.sha2(F.lower(F.trim("prompt")), 256).alias("digest"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("answer").alias("n_answers"), (F.countDistinct("split") > 1).alias("leaks")).where("n > 1")


@add("ag16_conditional_minmax", "SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS first, max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS last FROM events GROUP BY 1")
def ag16(spark, d):
    t = F.when(F.col("event_type") == "purchase", F.unix_micros(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").groupBy("user_id").agg(F.min(t).alias("first"), F.max(t).alias("last"))


@add("ag17_overrun", "SELECT object_id AS record_id, greatest(0, max(end_us) - min(time_span_end_us)) AS overrun_us FROM annotation_occurrences a JOIN records r ON a.object_type = 'Record' AND a.object_id = r.record_id WHERE time_span_end_us IS NOT NULL AND span_type = 'time_interval' GROUP BY 1")
def ag17(spark, d):
    a = table(spark, d, "annotation_occurrences").where("object_type = 'Record' and span_type = 'time_interval'").select(F.col("object_id").alias("record_id"), "end_us")
    x = a.join(table(spark, d, "records").where("time_span_end_us is not null").select("record_id", "time_span_end_us"), "record_id")
    return x.groupBy("record_id").agg(F.greatest(F.lit(0), F.max("end_us") - F.min("time_span_end_us")).alias("overrun_us"))


@add("ag19_finest", "SELECT spec_type, min(period_numerator_us) AS finest, arg_min(axis_id, period_numerator_us * 1000000 + axis_id) AS axis_id FROM axes a JOIN (SELECT DISTINCT axis_id, spec_type FROM signals) s USING (axis_id) WHERE axis_type = 'regular' AND period_denominator = 1 GROUP BY 1")
def ag19(spark, d):
    s = table(spark, d, "signals").select("axis_id", "spec_type").distinct()
    x = table(spark, d, "axes").where("axis_type = 'regular' and period_denominator = 1").join(s, "axis_id")
    return x.groupBy("spec_type").agg(F.min("period_numerator_us").alias("finest"), F.min_by("axis_id", F.struct("period_numerator_us", "axis_id")).alias("axis_id"))


@add("ag20_rollup", "SELECT event_type, user_id, count(*) AS n, grouping(event_type) * 2 + grouping(user_id) AS level FROM events GROUP BY ROLLUP (event_type, user_id)")
def ag20(spark, d):
    return table(spark, d, "events").rollup("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


@add("wn1_read_order", "SELECT record_id, row_number() OVER (ORDER BY time_span_start_us NULLS LAST, record_id) - 1 AS read_order FROM records")
def wn1(spark, d):
    r = table(spark, d, "records").select("record_id", "time_span_start_us")
    return numbered(r, [F.col("time_span_start_us").asc_nulls_last(), F.col("record_id")], "read_order", 0).select("record_id", "read_order")


@add("wn6_assign_ids", "SELECT p_partkey, 1000 + row_number() OVER (ORDER BY p_name, p_partkey) AS new_id FROM part")
def wn6(spark, d):
    return numbered(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], "new_id", 1001).select("p_partkey", "new_id")


@add("wn7_frames", "SELECT event_id, ntile(4) OVER w AS quarter, rank() OVER w AS place, round(coalesce(lead(value) OVER w, -1), 6) AS next FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)")
def wn7(spark, d):
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return table(spark, d, "events").select("event_id", F.ntile(4).over(w).cast("long").alias("quarter"), F.rank().over(w).cast("long").alias("place"), F.round(F.coalesce(F.lead("value").over(w), F.lit(-1.0)), 6).alias("next"))


@add("or1_storage_order", "SELECT spec_type, signal, chunk_idx, row_number() OVER (PARTITION BY spec_type ORDER BY CAST(signal AS BIGINT), chunk_idx) AS place FROM (SELECT DISTINCT spec_type, signal, chunk_idx FROM shard)")
def or1(spark, d):
    x = table(spark, d, "shard").select("spec_type", "signal", "chunk_idx").distinct()
    return x.withColumn("place", F.row_number().over(Window.partitionBy("spec_type").orderBy(F.col("signal").cast("long"), "chunk_idx")).cast("long"))


@add("or2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def or2(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


_VERSIONS = "v AS (SELECT p_brand AS id, p_partkey % 3 AS source, (p_partkey // 100) % 4 AS major, p_partkey % 12 AS minor, p_size % 5 AS patch, min(p_partkey) AS key FROM part GROUP BY ALL)"


def versions(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.col("p_brand").alias("id"), (k % 3).alias("source"), (F.floor(k / 100) % 4).alias("major"), (k % 12).alias("minor"), (F.col("p_size") % 5).alias("patch"), k.alias("key"))
    return p.groupBy("id", "source", "major", "minor", "patch").agg(F.min("key").alias("key"))


@add("or3_newest_version", f"WITH {_VERSIONS} SELECT id, major, minor, patch::INT AS patch FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY major DESC, minor DESC, patch DESC) = 1")
def or3(spark, d):
    return sel.newest(versions(spark, d), "id", ["major", "minor", "patch"]).select("id", "major", "minor", "patch")


@add("sm18_resolve_latest", f"WITH {_VERSIONS} SELECT id, source, key FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY major DESC, minor DESC, patch DESC, source) = 1")
def sm18(spark, d):
    return sel.resolve_version(versions(spark, d), "id", "source", ["major", "minor", "patch"], latest=True).select("id", "source", "key")


@add("sm18_resolve_first_source", f"WITH {_VERSIONS} SELECT id, source, key FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, major DESC, minor DESC, patch DESC) = 1")
def sm18_first(spark, d):
    return sel.resolve_version(versions(spark, d), "id", "source", ["major", "minor", "patch"]).select("id", "source", "key")


@add("st1_union_all", f"WITH {_OWNERS} SELECT object_type, count(*) AS n FROM w GROUP BY 1")
def st1(spark, d):
    return owners(spark, d).groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


@add("st3_difference", "SELECT DISTINCT CAST(signal AS BIGINT) AS signal_id FROM shard EXCEPT SELECT signal_id FROM signals WHERE spec_type = 'ecg'")
def st3(spark, d):
    return table(spark, d, "shard").select(F.col("signal").cast("long").alias("signal_id")).subtract(table(spark, d, "signals").where("spec_type = 'ecg'").select("signal_id"))


@add("st5_intersect", "SELECT source_id AS id FROM sources INTERSECT SELECT signal_id FROM signals")
def st5(spark, d):
    return table(spark, d, "sources").select(F.col("source_id").alias("id")).intersect(table(spark, d, "signals").select("signal_id"))


@add("st4_ordered_split_union", f"WITH {_TASKS} SELECT task_id, split FROM t WHERE split IN ('test', 'train')")
def st4(spark, d):
    return sel.in_splits(tasks(spark, d), "test", "train", "test").select("task_id", "split")
