"""The data model's operators on small fixtures: windows, imports, walks and storage."""

import random

from conftest import rows
from pyspark.sql import functions as F

from chronoloom.operators import edit, graph, model, select, store
from chronoloom.session import numbered, previous


def test_places_of_spans_against_brute_force(spark):
    rnd = random.Random(3)
    win = [(o, a, a + rnd.randint(1, 40)) for o in (1, 2, 3) for a in (rnd.randint(0, 300) for _ in range(12))]
    spans = [(i, rnd.randint(1, 4), a, a + rnd.randint(1, 25)) for i, a in enumerate(rnd.randint(0, 320) for _ in range(200))]
    sess = {2: (50, 200), 4: (None, 9)}
    s = spark.createDataFrame([(k, *v) for k, v in sess.items()], "owner_id long, session_start_us long, session_end_us long")
    got = {r["i"]: r["fits"] for r in model.placed(spark.createDataFrame(spans, "i long, owner_id long, start_us long, end_us long"), spark.createDataFrame(win, "owner_id long, start_us long, end_us long"), s).collect()}
    for i, o, a, z in spans:
        covered = {x for w, b, e in win if w == o for x in range(b, e)}
        want = sess[o][0] <= a and z <= sess[o][1] if o == 2 else all(x in covered for x in range(a, z))
        assert got[i] == want, (i, o, a, z)


def test_importing_twice_adds_nothing(spark):
    parent = {
        "records": spark.createDataFrame([(7, "a"), (9, "b"), (9, "b")], "record_id long, name string"), "sources": spark.createDataFrame([(1, 7, None), (2, 7, 1), (3, 9, 1)], "source_id long, record_id long, parent_source_id long"),
        "signals": spark.createDataFrame([(5, 2), (6, 3)], "signal_id long, source_id long"),
    }
    none = spark.createDataFrame([], "alias string, kind string, parent_id long, object_id long")
    wanted = parent["records"].where("record_id = 7")
    last = {"record": 100, "source": 200, "signal": 300}
    out, added = edit.import_from(parent, none, wanted, last, "other")
    assert rows(out["records"].select("record_id", "name")) == [(101, "a")] and rows(out["signals"].select("signal_id", "source_id")) == [(301, 202)]
    assert {(r["source_id"], r["record_id"], r["parent_source_id"]) for r in out["sources"].collect()} == {(201, 101, None), (202, 101, 201)}
    again, more = edit.import_from(parent, added, wanted, {k: v + 50 for k, v in last.items()}, "other")
    assert more.count() == 0 and all(t.count() == 0 for t in again.values())


def test_edited_version_leaves_its_base_alone(spark, tmp_path):
    t = {
        "records": spark.createDataFrame([(1,), (2,)], "record_id long"), "sources": spark.createDataFrame([(1, 1), (2, 2)], "source_id long, record_id long"), "signals": spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "signal_id long, source_id long"),
        "occurrences": spark.createDataFrame([(1, "Signal", 3), (2, "Record", 1), (3, "Record", 2)], "occurrence_id long, object_type string, object_id long"), "tasks": spark.createDataFrame([(1,), (2,)], "task_id long"),
        "refs": spark.createDataFrame([(1, "inputs", 1), (2, "inputs", 2)], "task_id long, field string, record_id long"),
    }
    base = f"file://{tmp_path}/s/1.0.0"
    store.write_version(t, base, {"name": "s"})
    new = edit.edit_version(spark, base, f"file://{tmp_path}/s/1.1.0", t["records"].where("record_id = 1"), t["signals"].where("signal_id = 3"), cascade=True)
    assert [rows(new[k].select(c)) for k, c in (("records", "record_id"), ("signals", "signal_id"), ("occurrences", "occurrence_id"), ("tasks", "task_id"))] == [[(2,)], [(2,)], [(3,)], [(2,)]]
    assert store.open_version(spark, base)[0]["signals"].count() == 3


def test_reachable_by_doubling_and_by_fronts(spark):
    chain = [(i, i + 1) for i in range(1, 700)]
    start = spark.createDataFrame([(5,)], "node long")
    assert sorted(r[0] for r in graph.reachable(start, spark.createDataFrame(chain, "u long, v long")).collect()) == list(range(5, 701))
    rnd = random.Random(1)
    links = [(rnd.randint(1, 60), rnd.randint(1, 60)) for _ in range(70)]
    seen, front = {5}, {5}
    while front:
        front = {v for u, v in links if u in front} - seen
        seen |= front
    assert {r[0] for r in graph.reachable(start, spark.createDataFrame(links, "u long, v long")).collect()} == seen


def test_asof_of_numbers_and_of_hot_keys(spark):
    rnd = random.Random(2)
    right = [(rnd.choice([1, 1, 1, 2]), rnd.randint(0, 10**8)) for _ in range(200)]
    left = [(i, rnd.choice([1, 2, 3, None]), rnd.choice([rnd.randint(0, 10**8), None])) for i in range(200)]
    got = {r["i"]: r["last"] for r in select.asof(spark.createDataFrame(left, "i long, k long, t long"), spark.createDataFrame(right, "k long, at long"), "k", "t", "at", "last", block_us=10**6).collect()}
    for i, k, t in left:
        before = [x for q, x in right if q == k and t is not None and x <= t]
        assert got[i] == (max(before) if before else None)


def test_numbers_and_previous_rows_in_blocks(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("x"))
    got = sorted((r["x"], r["n"]) for r in numbered(df, ["x"], "n", 5).collect())
    assert [n for _, n in got] == list(range(5, 3005))
    p = previous(spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("o")), ["k"], "o", "o", "b", block=8)
    assert all(r["b"] is None if r["o"] < 2 else r["b"]["v"] == r["o"] - 2 for r in p.collect())


def test_sections_and_shapes(spark):
    df = spark.createDataFrame([("Name: a\nfree line\r\nAge: 3\nName: b",)], "t string")
    s, rest = model.sections(F.col("t"))
    r = df.select(s.alias("s"), rest.alias("r")).head()
    assert [tuple(x) for x in r["s"]] == [("Name", "a"), ("Age", "3"), ("Name", "b")] and r["r"] == ["free line"]
    nd = spark.range(1).select(F.sequence(F.lit(0), F.lit(23)).alias("f")).select(store.unflatten_nd(F.col("f"), [2, 3, 4]).alias("nd"))
    assert nd.head()["nd"][1][2] == [20, 21, 22, 23]
    flat, whole = store.flatten_nd(F.col("nd"), [2, 3, 4])
    assert nd.select(flat.alias("f"), whole.alias("w")).head() == (list(range(24)), True)


def test_units_by_their_parts(spark):
    from chronoloom.functions.units import normal_unit

    u = ["mV", "m/s^2", "kW", "m", "Hz", "mm", "1", "bpm", "furlong", None, "uV/s"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(u)], "i int, u string").select(normal_unit(F.col("u")).alias("n"), "i").orderBy("i").select("n").collect()]
    assert got == ["millivolt", "metre/second^2", "kilowatt", "metre", "hertz", "millimetre", "dimensionless", "beat/minute", "furlong", None, "microvolt/second"]


def test_irregular_series_need_offsets_in_order(spark):
    import pytest

    from chronoloom.sources import memory

    ok = spark.createDataFrame([(1, [0, 5, 5], [1.0, 2.0, None]), (2, [], [])], "signal_id long, offsets array<long>, values array<double>")
    signals, axes, chunks = memory.from_irregular(ok, chunk=2)
    assert rows(signals.select("signal_id", "n_values")) == [(1, 3), (2, 0)] and rows(chunks.select("signal_id", "chunk_idx", "n_values")) == [(1, 0, 2), (1, 1, 1)]
    for bad in ([0, 5], [5, 4, 6], [0, None, 3]):
        with pytest.raises(ValueError, match="offset"):
            memory.from_irregular(spark.createDataFrame([(1, bad, [1.0, 2.0, 3.0])], ok.schema))


def test_images_are_turned_and_grey_becomes_rgb():
    import struct
    import zlib

    import numpy as np

    from chronoloom.sources.readers import decode_png

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", 0)

    px = np.arange(6, dtype=np.uint8).reshape(2, 3)
    body = b"".join(b"\x00" + line.tobytes() for line in px)
    tag = b"MM\x00*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0) + b"\x00" * 4
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"eXIf", tag) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    out = decode_png(png)
    assert out.shape == (3, 2, 3) and out[..., 0].tolist() == [[3, 0], [4, 1], [5, 2]]
