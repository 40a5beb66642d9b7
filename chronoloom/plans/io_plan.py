"""Queries that write and read back (sources, sinks, streams), and the remaining smaller operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoloom.operators import audit, catalog, graph, hierarchy, series, store
from chronoloom.operators import select as sel
from chronoloom.operators import tasks as tk
from chronoloom.plans.audit_plan import _LINKS, links
from chronoloom.plans.registry import Registry
from chronoloom.plans.select_plan import _TASKS, tasks
from chronoloom.plans.series_plan import _CHUNK, _LONG, chunked
from chronoloom.session import scratch, stage, table
from chronoloom.sources import readers
from chronoloom.streaming import ingest

io_plan = Registry()
add = io_plan.add

@add("sc15_csv", "SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def sc15(spark, d):
    path = scratch(spark)
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").coalesce(1).write.csv(path, header=True)
    rows = readers.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")
    return rows.withColumn("c_acctbal", F.round("c_acctbal", 2))

@add("sc16_json", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def sc16(spark, d):
    path = scratch(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    one = n.agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))  # the fixed table of nations
    one.write.text(path)
    return readers.read_json(spark, path, "n_nationkey long, n_name string")

@add("sc17_jsonl", "SELECT ecg_id, patient_id, sex FROM ptbxl_recordings")
def sc17(spark, d):
    path = scratch(spark)
    table(spark, d, "ptbxl_recordings").select("ecg_id", "patient_id", "sex").write.option("ignoreNullFields", "false").json(path)
    return readers.read_jsonl(spark, path, "ecg_id long, patient_id long, sex string")

@add("sc18_parquet_columns", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def sc18(spark, d):
    return readers.read_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45")

@add("sc14_payload_scan", "SELECT doc_id, md5(text) AS digest FROM documents")
def sc14(spark, d):
    inline, payload = store.pack_texts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return store.unpack_texts(stage(inline), stage(payload), "doc_id", "text").select("doc_id", F.md5("text").alias("digest"))

@add("sk10_packed_texts", "SELECT doc_id, true AS packed FROM documents WHERE octet_length(encode(text)) > 4096")
def sk10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    _, payload = store.pack_texts(docs, "doc_id", "text")
    p = payload.select("doc_id", F.col("text").alias("packed_text"))
    long = docs.where(F.octet_length("text") > 4096)
    return long.join(p, "doc_id", "left").select("doc_id", F.col("text").eqNullSafe(F.col("packed_text")).alias("packed"))


@add("sk1_version_round_trip", "SELECT record_id, clock_id, read_order FROM records")
def sk1(spark, d):
    path = f"{scratch(spark)}/org/set/1.0.0"
    store.write_version({n: table(spark, d, n) for n in ("records", "sources")}, path, {"name": "Set"})
    tables, _ = store.open_version(spark, path)
    return tables["records"].select("record_id", "clock_id", "read_order")

@add("sk3_values_by_spec", f"WITH {_CHUNK}, s AS (SELECT DISTINCT CAST(signal AS BIGINT) signal_id, spec_type FROM shard) SELECT signal_id, chunk_idx, n::INT AS n FROM ch JOIN s USING (signal_id) WHERE spec_type = 'eeg'")
def sk3(spark, d):
    path = scratch(spark)
    spec = table(spark, d, "shard").select(F.col("signal").cast("long").alias("signal_id"), "spec_type").distinct()
    store.write_values(chunked(spark, d).join(spec, "signal_id"), path)
    return spark.read.parquet(path).where("spec_type = 'eeg'").select("signal_id", "chunk_idx", F.size("values").alias("n"))

@add("sk7_encoding_choice", f"""WITH {_LONG}, k AS (SELECT count(*) n FROM lg), s AS (SELECT value FROM lg, k WHERE step % greatest(1, (n + 199999) // 200000) = 0),
c AS (SELECT count(*) n_sampled, count(DISTINCT CASE WHEN isnan(value) THEN 'nan' WHEN value = 0 AND signbit(value) THEN '-0' ELSE CAST(value AS VARCHAR) END) n_distinct FROM s) SELECT n, n_sampled, n_distinct, CASE WHEN n_distinct <= 65536 THEN 'dictionary' ELSE 'byte_stream_split' END AS encoding FROM k, c""")
def sk7(spark, d):
    return store.encoding_for(series.long_form(chunked(spark, d)))

@add("sk11_manifest")
def sk11(spark, d):
    path = scratch(spark)
    table(spark, d, "signals").repartition(4, "signal_id").write.parquet(path)
    return store.manifest(spark, path)

@add("au13_files_verify")
def au13(spark, d):
    """Files that differ from their manifest after one was put away and one added."""
    path = scratch(spark)
    table(spark, d, "sources").repartition(3, "source_id").write.parquet(path)
    kept = stage(store.manifest(spark, path))
    table(spark, d, "region").write.mode("append").parquet(f"{path}/extra")
    return store.verify(spark, path, kept)

@add("sc25_catalog", "SELECT 'org/one' AS id, 1 AS major, 10 AS minor, 0 AS patch UNION ALL SELECT 'org/two', 0, 1, 0")
def sc25(spark, d):
    root = scratch(spark)
    t = {"records": table(spark, d, "records").select("record_id")}
    for name, version in (("one", "1.9.0"), ("one", "1.10.0"), ("two", "0.1.0")):
        store.write_version(t, f"{root}/org/{name}/{version}", {"name": name, "tags": ["ecg"], "description": "recordings"})
    return catalog.search(catalog.versions(spark, [root]), ["RECORD"], tags=["ecg"]).select("id", "major", "minor", "patch")

@add("ext_stream_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_stream(spark, d):
    folder = scratch(spark)
    events = table(spark, d, "events")
    events.repartition(3).write.parquet(f"{folder}/in")
    name = f"w_{uuid.uuid4().hex}"
    q = ingest.windowed(ingest.read_events(spark, f"{folder}/in", events.schema)).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))

@add("ext_stream_once", "SELECT count(DISTINCT event_id) AS n FROM events")
def ext_once(spark, d):
    folder = scratch(spark)
    events = table(spark, d, "events")
    events.unionByName(events).repartition(4).write.parquet(f"{folder}/in")
    ingest.append(ingest.once(ingest.read_events(spark, f"{folder}/in", events.schema), late="100 days"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("n"))

@add("fl13_repeated_header", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def fl13(spark, d):
    path = scratch(spark)
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name")
    head = spark.createDataFrame([("r_regionkey", "r_name")], "r_regionkey string, r_name string")
    r.unionByName(head).unionByName(head).coalesce(1).write.csv(path, header=True)
    return readers.read_csv(spark, path, "r_regionkey long, r_name string", drop_repeated_header=True)

@add("au7_imported_exists", "SELECT record_id + 7 AS object_id, count(*) AS n FROM records WHERE record_id + 7 NOT IN (SELECT record_id FROM records) GROUP BY 1")
def au7(spark, d):
    r = table(spark, d, "records")
    return audit.dangling(r.select((F.col("record_id") + 7).alias("object_id")), "object_id", r, "record_id")

@add("ed8_imported_lookup", "SELECT record_id AS parent_id, record_id + 5000 AS object_id FROM records WHERE record_id IN (3, 9, 27, 81)")
def ed8(spark, d):
    held = table(spark, d, "records").select(F.col("record_id").alias("parent_id"), (F.col("record_id") + 5000).alias("object_id"))
    return spark.createDataFrame([(3,), (9,), (27,), (81,)], "parent_id long").join(held, "parent_id")

@add("sm1_references_once", "SELECT l_orderkey, l_suppkey, min(l_linenumber)::INT AS position FROM lineitem GROUP BY 1, 2")
def sm1(spark, d):
    return tk.references(table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "position"), "l_orderkey", "l_suppkey")

@add("sm2_needed_records", f"WITH RECURSIVE {_LINKS}, c AS (SELECT row_id AS node FROM cot_rows WHERE row_id % 50 = 0 UNION SELECT ln.v FROM c JOIN ln ON ln.u = c.node) SELECT DISTINCT ecg_id AS record_id FROM cot_rows WHERE row_id IN (SELECT node FROM c) AND ecg_id IS NOT NULL")
def sm2(spark, d):
    t = table(spark, d, "cot_rows")
    refs = t.where("ecg_id is not null").select(F.col("row_id").alias("task_id"), F.col("ecg_id").alias("record_id"))
    return tk.needed(t.where("row_id % 50 = 0").select(F.col("row_id").alias("task_id")), refs, links(spark, d))

@add("sm4_annotation_holders", "SELECT DISTINCT s.record_id FROM annotation_occurrences a JOIN sources s ON a.object_type = 'Source' AND a.object_id = s.source_id WHERE a.content_id % 10 = 0")
def sm4(spark, d):
    a = table(spark, d, "annotation_occurrences").where("object_type = 'Source' and content_id % 10 = 0").select(F.col("object_id").alias("source_id"))
    return table(spark, d, "sources").join(a, "source_id", "left_semi").select("record_id").distinct()

@add("sm9_distinct_metadata", "SELECT metadata, min(record_id) AS first_record, count(*) AS n FROM records GROUP BY 1")
def sm9(spark, d):
    return table(spark, d, "records").groupBy("metadata").agg(F.min("record_id").alias("first_record"), F.count(F.lit(1)).alias("n"))

@add("sm11_json_list_cells", "SELECT ecg_id, json_extract_string(annotations, '$.device') AS first, CASE WHEN json_extract_string(annotations, '$.burst_noise') IS NULL THEN false ELSE true END AS valid FROM ptbxl_recordings WHERE json_extract_string(annotations, '$.device') IS NOT NULL")
def sm11(spark, d):
    """A JSON list cell is valid if it parses and has no null; the cells are made of two of the metadata's values."""
    get = lambda k: F.get_json_object("annotations", f"$.{k}")
    cell = F.to_json(F.array(get("device"), get("burst_noise")))
    x = table(spark, d, "ptbxl_recordings").where(get("device").isNotNull()).withColumn("list", F.from_json(cell, "array<string>"))
    return x.select("ecg_id", F.get("list", F.lit(0)).alias("first"), F.forall("list", lambda v: v.isNotNull()).alias("valid"))


@add("sm14_annotate", "SELECT signal_id AS object_id, content_id FROM (SELECT DISTINCT signal_id FROM signals WHERE spec_type = 'ecg') s, (VALUES (1::BIGINT), (2)) v(content_id)")
def sm14(spark, d):
    targets = table(spark, d, "signals").where("spec_type = 'ecg'").select(F.col("signal_id").alias("object_id"))
    contents = spark.createDataFrame([(1, None, None), (2, 0, 10)], "content_id long, start_us long, end_us long")
    windows = targets.distinct().withColumn("start_us", F.lit(0)).withColumn("end_us", F.lit(100))
    return tk.annotate(targets, contents, windows).select("object_id", "content_id")

@add("sm16_stream_ids", "SELECT row_id, 700 + row_number() OVER (ORDER BY row_id) AS task_id FROM cot_rows")
def sm16(spark, d):
    return tk.stream_ids(table(spark, d, "cot_rows").select("row_id"), "row_id", 700, block=500).select("row_id", F.col("task_id").cast("long").alias("task_id"))

@add("sm20_demo_waves", "SELECT i::BIGINT AS step, round(sin(i * 2 * pi() / 16), 6) + 0.0 AS sine, round(cos(i * 2 * pi() / 16), 6) + 0.0 AS cosine FROM range(512) t(i)")
def sm20(spark, d):
    turn = F.col("id") * (2 * F.pi() / 16)
    return spark.range(512).select(F.col("id").alias("step"), (F.round(F.sin(turn), 6) + F.lit(0.0)).alias("sine"), (F.round(F.cos(turn), 6) + F.lit(0.0)).alias("cosine"))

@add("sm35_numbered_placeholders", "SELECT vec_id, 'label ' || label || ' of {9}, vector ' || vec_id || '.' AS text FROM embeddings")
def sm35(spark, d):
    values = F.array(F.col("vec_id").cast("string"), F.col("label").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", tk.fill_numbered(F.lit("label {2} of {9}, vector {1}."), values).alias("text"))

@add("wn3_merged_windows", "WITH v AS (SELECT DISTINCT object_id, start_us s, end_us e FROM annotation_occurrences WHERE object_type = 'Record' AND span_type = 'time_interval' AND object_id IS NOT NULL AND start_us < end_us), w AS (SELECT *, max(e) OVER (PARTITION BY object_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM v), i AS (SELECT *, sum(CASE WHEN r >= s THEN 0 ELSE 1 END) OVER (PARTITION BY object_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM w), m AS (SELECT object_id, g, min(s) s, max(e) e FROM i GROUP BY 1, 2) SELECT object_id, count(*) AS n_periods, sum(e - s)::BIGINT AS covered_us FROM m GROUP BY 1")
def wn3(spark, d):
    from chronoloom.operators import intervals

    a = table(spark, d, "annotation_occurrences").where("object_type = 'Record'")
    p = intervals.periods(intervals.interval_lists(intervals.time_intervals(a)))
    return p.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_periods"), F.sum(F.col("period_end_us") - F.col("period_start_us")).alias("covered_us"))

@add("st2_union_distinct", "SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def st2(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, d, "customer").select("c_custkey")).distinct()

@add("ext_semi_naive_reach", f"WITH RECURSIVE {_LINKS}, c AS (SELECT row_id AS node FROM cot_rows WHERE ecg_id % 60 = 0 UNION SELECT ln.v FROM c JOIN ln ON ln.u = c.node) SELECT node FROM c")
def ext_reach(spark, d):
    start = table(spark, d, "cot_rows").where("ecg_id % 60 = 0").select(F.col("row_id").alias("node"))
    return graph.reachable(start, links(spark, d))

_WAVE = "SELECT 'I' AS label, i::INT AS step, round(round(1000 * sin(i * 2 * pi() / 16)) / 1000, 4) + 0.0 AS value FROM range(512) t(i)"


def _wave():
    import math

    return [round(1000 * math.sin(i * 2 * math.pi / 16)) for i in range(512)]


@add("sc20_edf", _WAVE)
def sc20(spark, d):
    """A demo wave written as EDF (64 records of 8 samples) and read back in physical units."""
    import struct

    text = lambda x, n: str(x).ljust(n).encode()
    head = text(0, 8) + text("p", 80) + text("r", 80) + text("01.01.20", 8) + text("00.00.00", 8) + text(512, 8) + text("", 44) + text(64, 8) + text(1, 8) + text(1, 4)
    head += text("I", 16) + text("", 80) + text("mV", 8) + text(-1, 8) + text(1, 8) + text(-1000, 8) + text(1000, 8) + text("", 80) + text(8, 8) + text("", 32)
    path = f"{scratch(spark)}/wave.edf"
    store.write_bytes(spark, path, head + struct.pack("<512h", *_wave()))
    return readers.read_edf(spark, path).select("label", F.posexplode("values").alias("step", "v")).select("label", "step", (F.round(F.col("v").cast("double"), 4) + F.lit(0.0)).alias("value"))


@add("sc21_wfdb", _WAVE)
def sc21(spark, d):
    """The same wave as a WFDB record with a gain of 1000 and a baseline of 5."""
    import struct

    folder = scratch(spark)
    store.write_bytes(spark, f"{folder}/w.hea", b"w 1 250 512\nw.dat 16 1000(5)/mV 16 0 0 0 0 I\n")
    store.write_bytes(spark, f"{folder}/w.dat", struct.pack("<512h", *[x + 5 for x in _wave()]))
    return readers.read_wfdb(spark, folder).select("label", F.posexplode("values").alias("step", "v")).select("label", "step", (F.round(F.col("v").cast("double"), 4) + F.lit(0.0)).alias("value"))


@add("sk8_applied_encodings")
def sk8(spark, d):
    """Encodings that the footers of a dictionary-encoded version show."""
    path = scratch(spark)
    spec = table(spark, d, "shard").select(F.col("signal").cast("long").alias("signal_id"), "spec_type").distinct()
    store.write_values(chunked(spark, d).join(spec, "signal_id"), path, dictionary=True)
    return store.applied_encodings(spark, path).groupBy("column").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("encodings")))).alias("encodings"))


@add("sk12_parts", "SELECT max(n) <= 500 AS bounded, sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM cot_rows GROUP BY (row_id - 1) // 500)")
def sk12(spark, d):
    path = scratch(spark)
    store.write_parts(table(spark, d, "cot_rows").coalesce(1), path, 500)
    per = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.max("n") <= 500).alias("bounded"), F.sum("n").alias("n"))


