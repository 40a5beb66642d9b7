"""Queries on fixtures against brute force: nothing of the job may be left out."""

import random

from conftest import rows

from chronoloom.plans import registries


def query(name):
    return next(r.queries[name] for r in registries() if name in r.queries)


def test_links_of_all_recordings(spark, tmp_path):
    rnd = random.Random(2)
    data = [(i, rnd.choice([1, 2, 3, 4, 6, 7, None])) for i in range(40, 111)]
    gone = {1, 2, 3, 7, 8}
    spark.createDataFrame(data, "row_id long, ecg_id long").write.parquet(f"{tmp_path}/cot_rows.parquet")
    spark.createDataFrame([(k, 90 if k in gone else 40) for k in range(1, 9)], "ecg_id long, age int").write.parquet(f"{tmp_path}/ptbxl_recordings.parquet")
    chains = {k: [i for i, e in data if e == k] for k in {e for _, e in data if e is not None}}
    assert rows(query("gr2_ancestors")(spark, str(tmp_path))) == sorted(((u, v) for c in chains.values() for u in c for v in c if v < u), key=str)
    assert rows(query("gr4_levels")(spark, str(tmp_path))) == sorted(((u, n) for c in chains.values() if len(c) > 1 for n, u in enumerate(c)), key=str)
    assert rows(query("sm2_needed_records")(spark, str(tmp_path))) == sorted({(e,) for i, e in data if i % 50 == 0 and e is not None}, key=str)
    bad = {i for i, e in data if e in gone and (i % 2 or e + 1 in gone)}
    assert rows(query("ed1_invalid_tasks")(spark, str(tmp_path))) == sorted({(u,) for c in chains.values() for u in c if any(b in bad and b <= u for b in c)}, key=str)


MIN = 60_000_000


def test_intervals_of_any_length(spark, tmp_path):
    spans = [(1, 0, 45 * 1_000_000), (2, 5, 5 + 10 * MIN), (3, 0, 600 * MIN + 1), (4, 7, 7)]
    a = [(i, 100 + i, "Signal", 9, "time_interval", b, e) for i, b, e in spans]
    spark.createDataFrame(a, "occurrence_id long, content_id long, object_type string, object_id long, span_type string, start_us long, end_us long").write.parquet(f"{tmp_path}/annotation_occurrences.parquet")
    half = MIN // 2
    want = [(i, k, b + k * half, min(b + (k + 1) * half, e), (e - b) % half == 0) for i, b, e in spans for k in range(-((b - e) // half))]
    assert rows(query("ts6_epochs")(spark, str(tmp_path))) == sorted(want, key=str)
    axis = "axis_id long, axis_type string, start_index long, period_numerator_us long, period_denominator long, offset_us long, time_offsets array<long>"
    spark.createDataFrame([(1, "regular", 0, 1000, 1, 0, None)], axis).write.parquet(f"{tmp_path}/axes.parquet")
    spark.createDataFrame([(9, 1, "a", 1, "ecg", 36_000_001)], "signal_id long, source_id long, name string, axis_id long, spec_type string, n_values long").write.parquet(f"{tmp_path}/signals.parquet")
    assert rows(query("jn10_interval_to_steps")(spark, str(tmp_path))) == [(1, 9, 0, 45_000), (2, 9, 1, 600_001), (3, 9, 0, 36_000_001)]
