"""Queries over time axes, chunked values, slices and epochs (projections, value scans, slicing operators)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import timeline as tl
from chronoloom.operators import series
from chronoloom.plans.registry import Registry
from chronoloom.session import table

series_plan = Registry()
add = series_plan.add

_FLOOR = "(({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b})"


def _floor(a: str, b: str) -> str:
    return _FLOOR.format(a=a, b=b)


_OFF = f"(a.offset_us + {_floor('(a.start_index + {i})::HUGEINT * a.period_numerator_us', 'a.period_denominator')})"
_IDX = "(-(" + _floor("-(({t} - a.offset_us)::HUGEINT * a.period_denominator)", "a.period_numerator_us") + ") - a.start_index)"


def _off(i: str) -> str:
    return _OFF.replace("{i}", i)


def _idx(t: str) -> str:
    return _IDX.replace("{t}", t)


_PLACED = """p AS (SELECT DISTINCT ON (s.signal_id) s.signal_id, s.source_id, s.name, s.spec_type, s.n_values, a.* FROM signals s JOIN axes a USING (axis_id))"""
# a window, not any_value, keeps one of each chunk: it leaves -0.0 as it is
_CHUNK = """ch AS (SELECT CAST(signal AS BIGINT) signal_id, chunk_idx, "values" v, len("values") n FROM shard QUALIFY row_number() OVER (PARTITION BY signal, chunk_idx) = 1),
cb AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY signal_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT base FROM ch)"""
_LONG = _CHUNK + """, lg AS (SELECT signal_id, base + i - 1 step, v[i] AS value FROM cb, LATERAL (SELECT unnest(range(1, n + 1)) i))"""


def placed(spark, d):
    return series.axes_of(table(spark, d, "signals"), table(spark, d, "axes"))


def chunked(spark, d):
    return series.chunks(table(spark, d, "shard"))


@add("pj1_offset_at", f"SELECT axis_id, i AS idx, {_off('i')}::BIGINT AS offset_us FROM axes a, (VALUES (0), (1), (7), (1000003)) v(i) WHERE axis_type = 'regular'")
def pj1(spark, d):
    a = table(spark, d, "axes").where("axis_type = 'regular'").withColumn("idx", F.explode(F.array(*[F.lit(i) for i in (0, 1, 7, 1000003)])))
    return a.select("axis_id", "idx", tl.offset_at("idx").alias("offset_us"))


@add("pj2_index_at", f"SELECT axis_id, t, {_idx('t')}::BIGINT AS idx FROM axes a, (VALUES (-1500), (0), (1), (123456789)) v(t) WHERE axis_type = 'regular'")
def pj2(spark, d):
    a = table(spark, d, "axes").where("axis_type = 'regular'").withColumn("t", F.explode(F.array(*[F.lit(i) for i in (-1500, 0, 1, 123456789)])))
    return a.select("axis_id", "t", tl.index_at_or_after("t").alias("idx"))


@add("pj3_period_of_rate", "SELECT DISTINCT p_size::BIGINT AS rate_num, (p_size % 7 + 1)::BIGINT AS rate_den, ((p_size % 7 + 1)::BIGINT * 1000000) // gcd((p_size % 7 + 1)::BIGINT * 1000000, p_size::BIGINT) AS period_num, p_size::BIGINT // gcd((p_size % 7 + 1)::BIGINT * 1000000, p_size::BIGINT) AS period_den FROM part")
def pj3(spark, d):
    rates = table(spark, d, "part").select(F.col("p_size").cast("long").alias("rate_num"), (F.col("p_size") % 7 + 1).cast("long").alias("rate_den")).distinct()
    num, den = tl.period_of_rate(F.col("rate_num"), F.col("rate_den"))
    return rates.select("rate_num", "rate_den", num.alias("period_num"), den.alias("period_den"))


@add("pj4_window_shift", f"SELECT axis_id, start_index + 5 AS start_index, {_off('5')}::BIGINT AS first_us FROM axes a WHERE axis_type = 'regular'")
def pj4(spark, d):
    a = table(spark, d, "axes").where("axis_type = 'regular'").withColumn("start_index", F.col("start_index") + 5)
    return a.select("axis_id", "start_index", tl.offset_at(0).alias("first_us"))


@add(
    "pj5_signal_span",
    f"""WITH {_PLACED} SELECT signal_id, (CASE WHEN axis_type = 'regular' AND n_values > 0 THEN {_off('0')} WHEN axis_type = 'irregular' THEN first_us END)::BIGINT AS start_us,
    (CASE WHEN axis_type = 'regular' AND n_values > 0 THEN {_off('n_values')} WHEN axis_type = 'irregular' AND first_us IS NOT NULL THEN last_us + 1 END)::BIGINT AS end_us FROM p a""",
)
def pj5(spark, d):
    return series.spans(placed(spark, d))


@add(
    "pj6_long_form",
    f"""WITH {_PLACED}, {_LONG} SELECT l.signal_id, step, {_off('step')}::BIGINT AS time_offset_us, isnan(value) AS is_nan, CASE WHEN NOT isnan(value) THEN round(value::DOUBLE, 4) + 0.0 END AS value
    FROM lg l JOIN p a USING (signal_id) WHERE axis_type = 'regular'""",
)
def pj6(spark, d):
    rows = series.on_time(series.long_form(chunked(spark, d)), placed(spark, d)).where("axis_type = 'regular'")
    v = F.col("value")
    return rows.select("signal_id", "step", "time_offset_us", F.when(v.isNotNull(), F.isnan(v)).alias("is_nan"), F.when(v.isNotNull() & ~F.isnan(v), F.round(v.cast("double"), 4) + F.lit(0.0)).alias("value"))


@add("pj7_absolute_time", "SELECT record_id, make_timestamp(1700000000000000 + time_span_start_us) AS starts_at FROM records")
def pj7(spark, d):
    return table(spark, d, "records").select("record_id", tl.absolute(F.lit(1_700_000_000_000_000), F.col("time_span_start_us")).cast("timestamp_ntz").alias("starts_at"))


@add("pj8_offset_from_clock", "SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS offset_us FROM events")
def pj8(spark, d):
    t = tl.unix_us(F.col("ts"))
    return table(spark, d, "events").select("event_id", (t - F.min(t).over(Window.partitionBy("user_id"))).alias("offset_us"))


@add("pj9_seconds_to_us", "SELECT event_id, round_even(value * 1000000.0::DOUBLE, 0)::BIGINT AS us FROM events")
def pj9(spark, d):
    return table(spark, d, "events").select("event_id", tl.seconds_to_us(F.col("value")).alias("us"))


@add("pj10_offsets_from_origin", "SELECT user_id, list(epoch_us(ts) - 1704067200000000 ORDER BY ts, event_id) AS offsets FROM events GROUP BY 1")
def pj10(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (tl.unix_us(F.col("ts")) - 1_704_067_200_000_000).alias("o"))
    ordered = F.array_sort(F.collect_list(F.struct("o", "event_id")))
    return e.groupBy("user_id").agg(F.transform(ordered, lambda x: x["o"]).alias("offsets"))


@add(
    "pj11_infer_axis",
    """WITH x AS (SELECT axis_id, time_offsets o FROM axes WHERE len(time_offsets) > 1), y AS (SELECT axis_id, list_transform(range(2, len(o) + 1), lambda i: o[i] - o[i - 1]) st FROM x),
    z AS (SELECT axis_id, st, len(list_filter(st, lambda q: q = st[1] AND q > 0)) = len(st) ok FROM y)
    SELECT axis_id, CASE WHEN ok THEN 'regular' ELSE 'irregular' END AS kind, CASE WHEN ok THEN st[1] END AS period_us FROM z""",
)
def pj11(spark, d):
    return series.infer_axis(table(spark, d, "axes"))


@add("pj12_enum_code", "SELECT row_id, list_position(['choose', 'measure', 'query', 'verify'], question_type) - 1 AS code FROM cot_rows")
def pj12(spark, d):
    codes = F.array(*[F.lit(x) for x in ("choose", "measure", "query", "verify")])
    return table(spark, d, "cot_rows").select("row_id", (F.array_position(codes, F.col("question_type")) - 1).cast("int").alias("code"))


@add("pj13_scaling", "SELECT vec_id, list_transform(embedding, lambda x: round((x::DOUBLE - 0.25) / 200, 6) + 0.0) AS physical FROM embeddings")
def pj13(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round((x.cast("double") - 0.25) / 200, 6) + F.lit(0.0)).alias("physical"))


@add(
    "pj14_value_kind",
    r"""WITH v AS (SELECT event_id, json_extract_string(props, '$.k') x FROM events) SELECT event_id, CASE WHEN x IS NULL THEN 'null' WHEN x IN ('true', 'false') THEN 'boolean'
    WHEN regexp_full_match(x, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(x, '-?[0-9]*\.[0-9]+([eE][-+]?[0-9]+)?') THEN 'float' ELSE 'text' END AS kind FROM v""",
)
def pj14(spark, d):
    x = F.get_json_object("props", "$.k")
    kind = F.when(x.isNull(), "null").when(x.isin("true", "false"), "boolean").when(x.rlike(r"^-?[0-9]+$"), "integer").when(x.rlike(r"^-?[0-9]*\.[0-9]+([eE][-+]?[0-9]+)?$"), "float").otherwise("text")
    return table(spark, d, "events").select("event_id", kind.alias("kind"))


@add(
    "pj15_tagged_span",
    """SELECT DISTINCT occurrence_id, CASE WHEN span_type LIKE '%interval' THEN start_us END AS interval_start, CASE WHEN span_type LIKE '%interval' THEN end_us END AS interval_end,
    CASE WHEN span_type = 'time_point' THEN start_us END AS point FROM annotation_occurrences WHERE occurrence_id IS NOT NULL""",
)
def pj15(spark, d):
    a = table(spark, d, "annotation_occurrences").where("occurrence_id is not null")
    tagged = F.struct(F.col("span_type").alias("kind"), F.col("start_us").alias("a"), F.col("end_us").alias("z"))
    x = a.select("occurrence_id", tagged.alias("span")).distinct()
    whole = F.col("span.kind").endswith("interval")
    return x.select("occurrence_id", F.when(whole, F.col("span.a")).alias("interval_start"), F.when(whole, F.col("span.z")).alias("interval_end"), F.when(F.col("span.kind") == "time_point", F.col("span.a")).alias("point"))


@add("pj18_clock_wrap", "SELECT event_id, (((value * 1000)::BIGINT - (epoch_us(ts) // 1000000) % 86400) % 86400 + 86400) % 86400 AS seconds FROM events")
def pj18(spark, d):
    later = F.bround(F.col("value") * 1000).cast("long")
    now = F.pmod(F.floor(tl.unix_us(F.col("ts")) / F.lit(1_000_000)), F.lit(86_400))
    return table(spark, d, "events").select("event_id", tl.clock_wrap(later, now).alias("seconds"))


@add("pj20_exclusive_end", "SELECT DISTINCT occurrence_id, CASE WHEN span_type = 'time_point' THEN start_us + 1 WHEN span_type IN ('time_interval', 'step_interval') THEN end_us END AS end_us FROM annotation_occurrences")
def pj20(spark, d):
    a = table(spark, d, "annotation_occurrences")
    return a.select("occurrence_id", tl.exclusive_end(F.col("span_type"), F.col("start_us"), F.col("end_us")).alias("end_us")).distinct()


@add("sc11_scan", f"""WITH {_CHUNK} SELECT signal_id, (base // 1048576)::BIGINT AS part, sum(n)::BIGINT AS n, list_transform(flatten(list(v ORDER BY chunk_idx)), lambda x: CASE WHEN isnan(x) THEN NULL ELSE round(x::DOUBLE, 4) + 0.0 END) AS "values" FROM cb GROUP BY 1, 2""")
def sc11(spark, d):
    x = series.scan(chunked(spark, d))
    return x.select("signal_id", "part", F.size("values").cast("long").alias("n"), F.transform("values", lambda v: F.when(~F.isnan(v), F.round(v.cast("double"), 4) + F.lit(0.0))).alias("values"))


@add(
    "sc12_range_scan",
    f"""WITH {_LONG} SELECT signal_id, 0::BIGINT AS part, list(CASE WHEN isnan(value) THEN NULL ELSE round(value::DOUBLE, 4) + 0.0 END ORDER BY step) AS "values" FROM lg WHERE step >= 50 AND step < 137 GROUP BY 1""",
)
def sc12(spark, d):
    x = series.read_range(chunked(spark, d), F.lit(50), F.lit(137))
    return x.select("signal_id", "part", F.transform("values", lambda v: F.when(~F.isnan(v), F.round(v.cast("double"), 4) + F.lit(0.0))).alias("values"))


@add("ts1_read_steps", f"WITH {_LONG} SELECT signal_id, count(*) AS n, count(value) AS present, min(step) AS first, max(step) AS last FROM lg WHERE step >= 100 AND step < 100000 GROUP BY 1")
def ts1(spark, d):
    x = series.long_form(chunked(spark, d)).where("step >= 100 and step < 100000")
    return x.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), F.min("step").alias("first"), F.max("step").alias("last"))


_STEPS = f"""{_PLACED}, q AS (SELECT *, (CASE axis_type WHEN 'regular' THEN {_idx('1000000')} WHEN 'irregular' THEN len(list_filter(time_offsets[1:n_values], lambda x: x < 1000000)) END)::BIGINT f,
(CASE axis_type WHEN 'regular' THEN {_idx('90000000')} WHEN 'irregular' THEN len(list_filter(time_offsets[1:n_values], lambda x: x < 90000000)) END)::BIGINT t FROM p a)"""


def located(spark, d):
    return series.steps_in(placed(spark, d), F.lit(1_000_000), F.lit(90_000_000))


@add("ts2_step_range", f"WITH {_STEPS} SELECT signal_id, f AS step_from, t AS step_to, f < 0 OR t > n_values AS outside, f >= t AS nothing FROM q WHERE f IS NOT NULL AND t IS NOT NULL")
def ts2(spark, d):
    x = located(spark, d).where("step_from is not null and step_to is not null")
    return x.select("signal_id", "step_from", "step_to", ((F.col("step_from") < 0) | (F.col("step_to") > F.col("n_values"))).alias("outside"), (F.col("step_from") >= F.col("step_to")).alias("nothing"))


@add(
    "ts3_slice_axis",
    f"""WITH {_STEPS}, c AS (SELECT *, greatest(f, 0) a0, least(t, n_values) z0 FROM q) SELECT signal_id, axis_type, CASE WHEN axis_type = 'regular' THEN start_index + a0 END AS start_index, z0 - a0 AS n_values, a0 AS clip_from, z0 AS clip_to FROM c WHERE f IS NOT NULL AND z0 > a0""",
)
def ts3(spark, d):
    return series.slice_axis(located(spark, d))


@add(
    "ts3_slice_stats",
    f"""WITH {_STEPS}, {_LONG} SELECT l.signal_id, count(*) AS n, round(sum(CASE WHEN isnan(value) OR abs(value) > 1e6 THEN 0 ELSE value::DOUBLE END), 2) AS total FROM lg l JOIN q USING (signal_id) WHERE step >= f AND step < t GROUP BY 1""",
)
def ts3_stats(spark, d):
    where = located(spark, d).select("signal_id", "step_from", "step_to").where("step_from < step_to")
    x = series.cut_chunks(series.with_base(chunked(spark, d)).join(where, "signal_id"), F.col("step_from"), F.col("step_to"))
    usable = F.filter("values", lambda v: ~F.isnan(v) & (F.abs(v) <= 1e6))
    total = F.aggregate(usable, F.lit(0.0), lambda a, v: a + v.cast("double"))
    # no value becomes a row: chunks outside are left out, those at the ends are sliced, and sums are taken inside a row
    return x.groupBy("signal_id").agg(F.sum(F.size("values").cast("long")).alias("n"), F.round(F.sum(F.when(F.exists("values", lambda v: v.isNotNull()), total)), 2).alias("total"))


@add("ts4_slice_of_slice", f"WITH {_LONG} SELECT signal_id, count(*) AS n FROM lg WHERE step >= 60 AND step < 90 GROUP BY 1")
def ts4(spark, d):
    outer = series.long_form(chunked(spark, d)).where("step >= 50 and step < 90")
    return outer.where("step >= 60 and step < 200").groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"))


@add(
    "ts5_cut_record",
    f"""WITH {_PLACED}, r AS (SELECT DISTINCT record_id, time_span_start_us b, time_span_end_us e FROM records WHERE time_span_start_us < time_span_end_us), so AS (SELECT DISTINCT source_id, record_id FROM sources)
    SELECT a.signal_id, r.record_id, {_idx('r.b')}::BIGINT AS step_from, {_idx('r.e')}::BIGINT AS step_to FROM p a JOIN so ON so.source_id = a.source_id JOIN r ON r.record_id = so.record_id WHERE a.axis_type = 'regular'""",
)
def ts5(spark, d):
    r = table(spark, d, "records").where("time_span_start_us < time_span_end_us").select("record_id", F.col("time_span_start_us").alias("b"), F.col("time_span_end_us").alias("e")).distinct()
    s = table(spark, d, "sources").select("source_id", "record_id").distinct()
    x = placed(spark, d).where("axis_type = 'regular'").join(s, "source_id").join(r, "record_id")
    return series.steps_in(x, F.col("b"), F.col("e")).select("signal_id", "record_id", "step_from", "step_to")


_INTERVALS = "iv AS (SELECT DISTINCT occurrence_id, object_type, object_id, content_id, start_us, end_us FROM annotation_occurrences WHERE span_type = 'time_interval' AND start_us < end_us)"


@add(
    "ts6_epochs",
    f"""WITH {_INTERVALS}, t AS (SELECT *, unnest(range(0, (end_us - start_us + 29999999) // 30000000)) tile FROM iv)
    SELECT occurrence_id, tile::INT AS tile, start_us + tile * 30000000 AS start_us, least(start_us + (tile + 1) * 30000000, end_us) AS end_us, (end_us - start_us) % 30000000 = 0 AS whole FROM t""",
)
def ts6(spark, d):
    a = table(spark, d, "annotation_occurrences").where("span_type = 'time_interval' and start_us < end_us")
    return series.epochs(a.select("occurrence_id", "start_us", "end_us").distinct(), 30_000_000)


@add("ts7_dedup_occurrences", "SELECT start_us, end_us, content_id, min(occurrence_id) AS occurrence_id FROM annotation_occurrences WHERE object_type = 'Signal' AND span_type = 'time_interval' GROUP BY 1, 2, 3")
def ts7(spark, d):
    a = table(spark, d, "annotation_occurrences").where("object_type = 'Signal' and span_type = 'time_interval'")
    return a.groupBy("start_us", "end_us", "content_id").agg(F.min("occurrence_id").alias("occurrence_id"))


@add(
    "ts8_grid_alignment",
    "WITH b AS (SELECT user_id, min(ts)::DATE a, max(ts)::DATE z FROM events GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS dt FROM b), v AS (SELECT user_id, ts::DATE dt, count(*) n FROM events GROUP BY ALL) SELECT g.user_id, CAST(g.dt AS VARCHAR) AS dt, v.n AS n_events FROM g LEFT JOIN v ON v.user_id = g.user_id AND v.dt = g.dt",
)
def ts8(spark, d):
    e = table(spark, d, "events").withColumn("dt", F.to_date("ts"))
    seen = e.groupBy("user_id", "dt").agg(F.count(F.lit(1)).alias("n_events"))
    grid = e.groupBy("user_id").agg(F.min("dt").alias("a"), F.max("dt").alias("z")).select("user_id", F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("dt"))
    return grid.join(seen, ["user_id", "dt"], "left").select("user_id", F.col("dt").cast("string").alias("dt"), "n_events")


@add(
    "ts9_outside_window",
    f"""WITH {_PLACED}, s AS (SELECT signal_id, source_id, (CASE WHEN axis_type = 'regular' THEN {_off('0')} WHEN axis_type = 'irregular' THEN first_us END)::BIGINT a0, (CASE WHEN axis_type = 'regular' THEN {_off('n_values')} WHEN axis_type = 'irregular' THEN last_us + 1 END)::BIGINT z0 FROM p a),
    r AS (SELECT DISTINCT record_id, time_span_start_us b, time_span_end_us e FROM records WHERE time_span_start_us IS NOT NULL AND time_span_end_us IS NOT NULL), so AS (SELECT DISTINCT source_id, record_id FROM sources)
    SELECT signal_id, record_id FROM s JOIN so USING (source_id) JOIN r USING (record_id) WHERE a0 < b OR z0 > e""",
)
def ts9(spark, d):
    p = placed(spark, d)
    s = series.spans(p).join(p.select("signal_id", "source_id"), "signal_id").join(table(spark, d, "sources").select("source_id", "record_id").distinct(), "source_id")
    r = table(spark, d, "records").where("time_span_start_us is not null and time_span_end_us is not null").select("record_id", "time_span_start_us", "time_span_end_us").distinct()
    return s.join(r, "record_id").where("start_us < time_span_start_us or end_us > time_span_end_us").select("signal_id", "record_id")


@add("ts10_offsets_fit", f"WITH {_PLACED} SELECT signal_id, n_values AS declared, len(time_offsets)::BIGINT AS stored FROM p WHERE axis_type = 'irregular' AND coalesce(n_values <> len(time_offsets), true)")
def ts10(spark, d):
    x = placed(spark, d).where("axis_type = 'irregular'").withColumn("stored", F.when(F.col("time_offsets").isNotNull(), F.size("time_offsets").cast("long")))
    return x.where(F.coalesce(F.col("n_values") != F.col("stored"), F.lit(True))).select("signal_id", F.col("n_values").alias("declared"), "stored")


@add("ts11_refuses_nulls", f"WITH {_LONG} SELECT signal_id, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (value IS NULL) = 0 AS convertible FROM lg GROUP BY 1")
def ts11(spark, d):
    n = F.count_if(F.col("value").isNull())
    return series.long_form(chunked(spark, d)).groupBy("signal_id").agg(n.alias("nulls"), (n == 0).alias("convertible"))


@add(
    "fl8_overlaps_with",
    f"WITH {_STEPS} SELECT signal_id, least(t, n_values) > greatest(f, 0) AS overlaps FROM q WHERE axis_type IN ('regular', 'irregular') AND f IS NOT NULL",
)
def fl8(spark, d):
    x = located(spark, d).where(F.col("axis_type").isin("regular", "irregular") & F.col("step_from").isNotNull())
    return x.select("signal_id", (F.least("step_to", "n_values") > F.greatest(F.col("step_from"), F.lit(0))).alias("overlaps"))


@add(
    "jn10_interval_to_steps",
    f"""WITH {_PLACED}, {_INTERVALS} SELECT occurrence_id, signal_id, {_idx('iv.start_us')}::BIGINT AS step_from, {_idx('iv.end_us')}::BIGINT AS step_to FROM iv JOIN p a ON iv.object_type = 'Signal' AND iv.object_id = a.signal_id WHERE a.axis_type = 'regular'""",
)
def jn10(spark, d):
    iv = table(spark, d, "annotation_occurrences").where("span_type = 'time_interval' and start_us < end_us and object_type = 'Signal'")
    iv = iv.select("occurrence_id", F.col("object_id").alias("signal_id"), F.col("start_us").alias("b"), F.col("end_us").alias("e"), "content_id").distinct()
    x = placed(spark, d).where("axis_type = 'regular'").join(iv, "signal_id")
    return series.steps_in(x, F.col("b"), F.col("e")).select("occurrence_id", "signal_id", "step_from", "step_to")


@add("wn2_chunk_cursor", f"WITH {_CHUNK} SELECT signal_id, chunk_idx, base FROM cb")
def wn2(spark, d):
    return series.with_base(chunked(spark, d)).select("signal_id", "chunk_idx", "base")


@add("wn4_disorder", "SELECT DISTINCT axis_id FROM axes WHERE len(time_offsets) > 1 AND len(list_filter(range(2, len(time_offsets) + 1), lambda i: time_offsets[i] < time_offsets[i - 1])) > 0")
def wn4(spark, d):
    return series.disorder(table(spark, d, "axes"))


@add(
    "wn5_runs",
    "WITH x AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), y AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) g FROM x) SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM y GROUP BY user_id, event_type, g",
)
def wn5(spark, d):
    return series.runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@add("ag18_observed_window", f"WITH {_LONG} SELECT signal_id, min(step) AS first_step, max(step) AS last_step, max(step) - min(step) + 1 - count(*) AS n_missing FROM lg WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1")
def ag18(spark, d):
    return series.observed_window(series.long_form(chunked(spark, d)))


@add("ag11_null_counts", f"""WITH {_CHUNK} SELECT signal_id, sum(len(list_filter(v, lambda x: x IS NULL)))::BIGINT AS nulls, sum(len(list_filter(v, lambda x: isnan(x))))::BIGINT AS nans FROM ch GROUP BY 1""")
def ag11(spark, d):
    nulls = F.size(F.filter("values", lambda x: x.isNull()))
    nans = F.size(F.filter("values", lambda x: F.isnan(x)))
    return chunked(spark, d).groupBy("signal_id").agg(F.sum(nulls).alias("nulls"), F.sum(nans).alias("nans"))


@add("sk5_plan_chunks", """WITH s AS (SELECT DISTINCT ON (signal_id) signal_id, n_values n, greatest(1, 1024 // CASE dtype WHEN 'float64' THEN 8 ELSE 4 END) l FROM signals WHERE n_values > 0 ORDER BY signal_id), x AS (SELECT *, unnest(range(0, (n - 1) // l + 1)) chunk_idx FROM s)
SELECT signal_id, chunk_idx, chunk_idx * l AS start, least(n, (chunk_idx + 1) * l) AS stop FROM x""")
def sk5(spark, d):
    return series.plan_chunks(table(spark, d, "signals").dropDuplicates(["signal_id"]), 1024, {"float64": 8, "float32": 4})


@add("sk3_rechunk", f"WITH {_LONG} SELECT signal_id, (step // 128)::INT AS chunk_idx, count(*)::INT AS n_values FROM lg GROUP BY ALL")
def sk3(spark, d):
    return series.rechunk(chunked(spark, d), 128).select("signal_id", "chunk_idx", "n_values")


@add(
    "ag12_distinct_bits",
    f"""WITH {_LONG} SELECT signal_id, count(DISTINCT CASE WHEN isnan(value) THEN 'nan' WHEN value = 0 AND signbit(value) THEN '-0' ELSE CAST(value AS VARCHAR) END) AS n_distinct FROM lg WHERE step % 3 = 0 GROUP BY 1""",
)
def ag12(spark, d):
    """Statistic on a strided sample, which is the feature: the encoding is chosen from it."""
    bits = F.col("value").cast("string")  # as text, -0.0 and 0.0 stay apart and all NaN are one
    return series.long_form(chunked(spark, d)).where("step % 3 = 0").groupBy("signal_id").agg(F.countDistinct(bits).alias("n_distinct"))
