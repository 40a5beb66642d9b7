"""The general problems against brute force on small tables, with the dirt that tables can hold."""

import random

import numpy as np
import pytest
from conftest import rows

from chronoloom.operators import components, grid, hierarchy, intervals, spikes

SIGNALS = "signal_id long, axis_id long, spec_type string, n_values long, step_us string"
AXES = "axis_id long, axis_type string, time_offsets array<long>, spec_type string"
SPECS = "spec_type string, step_us long, low double, high double"


def grid_of(spark, signals, axes, specs, **kw):
    return grid.regular_grid(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(axes, AXES), spark.createDataFrame(specs, SPECS), **kw)


def test_grid_against_brute_force(spark):
    rnd = random.Random(1)
    signals, axes, want = [], [], set()
    for i in range(1, 60):
        offsets = [rnd.choice([None, *[rnd.randint(-500, 3000) for _ in range(9)]]) for _ in range(rnd.randint(0, 25))]
        n = rnd.choice([None, len(offsets), len(offsets) + 3, max(0, len(offsets) - 4), 0])
        kind = rnd.choice(["irregular", "irregular", "regular", None])
        signals.append((i, i * 10, rnd.choice(["a", "b", "zzz", None]), n, "clash"))
        axes.append((i * 10, kind, offsets, "clash"))
        step = {"a": 10, "b": 64}.get(signals[-1][2])
        if kind == "irregular" and step:
            slots = {o // step for o in offsets[: len(offsets) if n is None else n] if o is not None}
            want |= {(i, k * step) for k in range(min(slots), max(slots)) if k not in slots} if slots else set()
    signals += signals[:5] + [(None, 10, "a", 3, "x"), (77, None, "a", 3, "x")]
    g = grid_of(spark, signals, axes, [("a", 10, 0.0, 1.0), ("b", 64, None, None)])
    assert set(map(tuple, grid.empty_slots(g).collect())) == want
    assert g.where("state = 'observed' and value is null").count() == 0  # the axis alone gives every reading a place
    assert g.where("state = 'missing' and value is not null").count() == 0
    assert g.groupBy("signal_id", "slot_start_us").count().where("count > 1").count() == 0


def test_grid_fills_low_rank_cells_and_keeps_observed_ones(spark):
    rnd = np.random.default_rng(0)
    truth = np.outer(rnd.uniform(1, 3, 20), np.sin(np.arange(40) / 5)) + 5
    gone = rnd.random(truth.shape) < 0.15
    gone[:, [0, -1]] = False
    signals, axes, values = [], [], []
    for i in range(20):
        at = [int(k) for k in np.flatnonzero(~gone[i])]
        signals.append((i + 1, i + 1, "a", len(at), "")), axes.append((i + 1, "irregular", [k * 10 for k in at], ""))
        values += [(i + 1, p, float(truth[i, k])) for p, k in enumerate(at)]
    v = spark.createDataFrame(values, "signal_id long, position int, value double")
    out = grid.regular_grid(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(axes, AXES), spark.createDataFrame([("a", 10, 0.0, 1.0)], SPECS), v).collect()
    filled = [(r["value"], truth[r["signal_id"] - 1, r["slot_start_us"] // 10]) for r in out if r["state"] == "filled"]
    assert len(filled) == gone.sum() and np.abs(np.subtract(*zip(*filled))).mean() < 0.1
    assert all(r["value"] == truth[r["signal_id"] - 1, r["slot_start_us"] // 10] for r in out if r["state"] == "observed")


def test_grid_of_empty_tables(spark):
    assert grid_of(spark, [], [], []).count() == 0


def brute_periods(rows_):
    by = {}
    for t, i, s, e in rows_:
        if t is not None and i is not None and s is not None and e is not None and s < e:
            by.setdefault((t, i), []).append((s, e))
    periods, gaps = [], []
    for k, v in by.items():
        v.sort()
        s, e = v[0]
        for a, b in v[1:]:
            if a <= e:
                e = max(e, b)
            else:
                periods.append((*k, s, e)), gaps.append((*k, e, a))
                s, e = a, b
        periods.append((*k, s, e))
    return sorted(set(periods)), sorted(set(gaps))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_intervals_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    data = []
    for _ in range(3000):
        a = rnd.randint(0, 100_000 if seed else 3_000)
        key = ("Signal", 1) if rnd.random() < 0.4 else (rnd.choice(["Signal", "Record", None]), rnd.choice([None, *range(1, 40)]))
        data.append((*key, rnd.choice([None, a, a, a]), rnd.choice([None, a, a + rnd.randint(-5, 60), a + 2_000 if rnd.random() < 0.1 else a + 9])))
    data += data[:100]
    df = spark.createDataFrame(data, "object_type string, object_id long, start_us long, end_us long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # hot objects lie in several tasks
    try:
        lists = intervals.interval_lists(df)
        periods, gaps = brute_periods(data)
        assert sorted(map(tuple, intervals.periods(lists).collect())) == periods
        assert sorted(map(tuple, intervals.gaps(lists).collect())) == gaps
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_interval_that_swallows_everything(spark):
    data = [("S", 1, 0, 10**9)] + [("S", 1, i * 100, i * 100 + 3) for i in range(500)] + [("S", 1, 2 * 10**9, 2 * 10**9 + 1)]
    lists = intervals.interval_lists(spark.createDataFrame(data, "object_type string, object_id long, start_us long, end_us long"))
    assert rows(intervals.periods(lists)) == [("S", 1, 0, 10**9), ("S", 1, 2 * 10**9, 2 * 10**9 + 1)]
    assert rows(intervals.gaps(lists)) == [("S", 1, 10**9, 2 * 10**9)]


def test_interval_merge_is_associative_and_commutative():
    rnd = np.random.default_rng(3)
    def some():
        s = rnd.integers(0, 500, 20)
        return intervals.IntervalList.of(s, s + rnd.integers(1, 30, 20))

    for _ in range(50):
        a, b, c = some(), some(), some()
        left, right = a.merge(b).merge(c), c.merge(b.merge(a))
        assert left.start.tolist() == right.start.tolist() and left.end.tolist() == right.end.tolist()


def test_intervals_of_empty_table(spark):
    lists = intervals.interval_lists(spark.createDataFrame([], "object_type string, object_id long, start_us long, end_us long"))
    assert intervals.gaps(lists).count() == intervals.periods(lists).count() == 0


def test_held_out_cells_are_told_no_worse_than_by_the_mean():
    rnd = np.random.default_rng(4)
    shared = np.outer(rnd.normal(3, 1, 40), np.sin(np.arange(80) / 5)) + rnd.normal(0, 0.05, (40, 80))
    noise = rnd.normal(0, 1, (40, 80))
    for m, gain in ((shared, 0.3), (noise, 1.05)):
        out = grid.held_out(np.arange(m.size), 1).reshape(m.shape)
        left = np.where(out, np.nan, m)
        fit, support = grid.estimate(left)
        mean, _ = grid.als(left, 0)
        assert support.all()
        assert ((fit - m)[out] ** 2).sum() <= gain * ((mean - m)[out] ** 2).sum()


def shard_of(spark, series, chunk=50, spec="a"):
    data = [(spec, sig, k // chunk, list(v[k : k + chunk]), "x") for sig, v in series.items() for k in range(0, len(v), chunk)]
    return spark.createDataFrame(data + data[:3] + [(spec, None, 0, [1.0], ""), (spec, "9", None, [1.0], ""), (spec, "8", 0, None, ""), ("none", "7", 0, [1e9, None], "")], "spec_type string, signal string, chunk_idx int, values array<float>, low string")


def test_spikes_runs_and_ranges(spark):
    rnd = np.random.default_rng(0)
    calm = (np.sin(np.arange(400) / 6) + rnd.normal(0, 0.05, 400)).round(3)
    calm[120], calm[200:203] = 9.0, [-8.0, 9.0, 8.5]
    calm[250:290] = calm[250]
    levels = np.r_[rnd.normal(1, 0.1, 200), rnd.normal(20, 0.1, 200)].round(3)
    beats = np.where(np.arange(400) % 20 < 2, 5.0, 0.0) + rnd.normal(0, 0.05, 400).round(3)
    still = np.zeros(400)
    faulty = [float(x) for x in rnd.normal(0, 1, 400).round(3)]
    faulty[10], faulty[11], faulty[12] = None, float("nan"), -9999.0
    shard = shard_of(spark, {"1": calm.tolist(), "2": levels.tolist(), "3": beats.tolist(), "4": still.tolist(), "5": faulty})
    specs = spark.createDataFrame([("a", 10, -50.0, 50.0)], SPECS)
    got = {(r["signal"], r["chunk_idx"] * 50 + r["value_idx"]): (r["out_of_range"], r["spike"], r["stuck"]) for r in spikes.implausible(shard, specs).collect()}
    mine = {k: v for k, v in got.items() if k[0] == "1"}
    assert {i for (_, i), v in mine.items() if v[1]} == {120, 200, 201, 202}
    assert {i for (_, i), v in mine.items() if v[2]} == set(range(250, 290))
    assert {k for k in got if k[0] in "234"} == set()
    assert got[("5", 12)] == (True, False, False) and {k for k in got if k[0] == "5"} == {("5", 12)}


def test_spikes_of_a_long_signal_do_not_depend_on_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    v = rnd.normal(0, 1, 6000).round(3)
    at = [5, 700, 1600, 3199, 3200, 5990]
    v[at] = 40.0
    shard = shard_of(spark, {"1": v.tolist()}, chunk=25)
    got = spikes.implausible(shard, spark.createDataFrame([("a", 10, None, None)], SPECS)).where("signal = '1'")
    assert sorted(r["chunk_idx"] * 25 + r["value_idx"] for r in got.collect()) == at


def test_robust_pca_separates_sparse_from_low_rank():
    rnd = np.random.default_rng(2)
    low = np.outer(rnd.normal(size=20), rnd.normal(size=30))
    sparse = np.zeros((20, 30))
    sparse[3, 7], sparse[11, 20] = 15, -12
    _, got = spikes.pursuit(low + sparse + rnd.normal(0, 0.05, low.shape))
    assert set(zip(*np.nonzero(np.abs(got) > 5))) == {(3, 7), (11, 20)}


def test_the_low_rank_part_decides_what_a_spike_is():
    """Regular peaks have the shape of spikes and are normal behaviour; what is off the profile is a spike."""
    rnd = np.random.default_rng(7)
    f = rnd.normal(0, 0.1, 1200).round(3)
    f[13::40] += 5.0
    f[[330, 777]] += 5.0
    assert set(np.flatnonzero(spikes.spike_mask(f))) == {330, 777}
    assert set(np.flatnonzero(spikes.spike_mask(f, pursue=False))) > {13 + 40 * k for k in range(2, 28)}


def test_spikes_of_empty_table(spark):
    s = spark.createDataFrame([], "spec_type string, signal string, chunk_idx int, values array<float>")
    assert spikes.implausible(s, spark.createDataFrame([], SPECS)).count() == 0


def brute_tree(links):
    parent = dict(links)
    out = {}
    for n in parent:
        way, at = [n], n
        while parent[at] is not None and parent[at] in parent and parent[at] not in way:
            at = parent[at]
            way.append(at)
        p = parent[at]
        if p is None:
            out[n] = (way[-1], len(way) - 1, way[::-1], None, None)
        elif p not in parent:
            out[n] = (None, None, None, "lost_parent", p)
        else:
            ring = way[way.index(p) :]
            out[n] = (None, None, None, "on_cycle" if n in ring else "under_cycle", min(ring))
    return out


def random_forest(seed, n=300):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1, 10 * n), n)
    links = {x: rnd.choice(ids[: max(1, i)]) if i and rnd.random() > 0.15 else None for i, x in enumerate(ids)}
    for x in rnd.sample(ids, 6):
        links[x] = rnd.choice([x, 10**9 + x, rnd.choice(ids)])
    return links


@pytest.mark.parametrize("walk_rows", [10**6, 3])
def test_hierarchy_against_brute_force(spark, walk_rows, monkeypatch):
    monkeypatch.setattr(hierarchy, "WALK_ROWS", walk_rows)
    monkeypatch.setattr(hierarchy, "BATCH_CELLS", walk_rows)
    links = random_forest(walk_rows)
    data = [(k, v, "a") for k, v in links.items()]
    data += data[:40] + [(None, 3, "x")]
    df = spark.createDataFrame(data, "source_id long, parent_source_id long, path string")
    got = hierarchy.resolve(df)
    res = {r["node_id"]: r for r in got.collect()}
    want = brute_tree(links)
    assert set(res) == set(want) and got.count() == len(want)
    for n, (root, depth, path, fault, end) in want.items():
        r = res[n]
        assert (r["root_id"], r["depth"], r["path"], r["fault"], r["end_id"]) == (root, depth, path, fault, end), n
    rooted = {n: set(w[2][:-1]) for n, w in want.items() if w[2]}
    assert {(r["ancestor_id"], r["node_id"]) for r in hierarchy.descendants(got).collect()} == {(a, n) for n, s in rooted.items() for a in s}
    for n in rooted:
        assert res[n]["n_descendants"] == sum(n in s for s in rooted.values())


def test_deep_chain(spark):
    n = 600
    df = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, n + 1)], "source_id long, parent_source_id long")
    r = hierarchy.resolve(df).where(f"node_id = {n}").head()
    assert r["depth"] == n - 1 and r["root_id"] == 1 and r["path"] == list(range(1, n + 1))


def test_long_chain_and_long_cycle_without_paths(spark):
    """Memory goes by nodes: the paths of this chain would be 11 billion cells."""
    n = 150_000
    df = spark.range(1, n + 1).selectExpr("id as source_id", "nullif(id - 1, 0) as parent_source_id").unionByName(spark.range(n).selectExpr("id + 1000000 as source_id", f"(id + 1) % {n} + 1000000 as parent_source_id"))
    r = hierarchy.resolve(df, paths=False)
    assert "path" not in r.columns
    top = r.agg({"depth": "max", "n_descendants": "max"}).head()
    assert top["max(depth)"] == n - 1 == top["max(n_descendants)"]
    assert r.where("fault = 'on_cycle' and end_id = 1000000").count() == n


def test_two_parents_are_a_fault(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1), (3, 2), (4, 3), (5, 4), (6, 1)], "source_id long, parent_source_id long")
    got = {r["node_id"]: (r["fault"], r["end_id"], r["root_id"]) for r in hierarchy.resolve(df).collect()}
    assert got == {1: (None, None, 1), 2: (None, None, 2), 3: ("two_parents", 2, None), 4: ("under_two_parents", 3, None), 5: ("under_two_parents", 3, None), 6: (None, None, 1)}


def test_back_edges_close_cycles():
    w = hierarchy.Walk(np.array([1, 2, 3, 4, 9]), np.array([3, 1, 2, 2, 9]), np.ones(5, bool), np.zeros(5, int), np.zeros(5, bool))
    assert w.back_edges == [(2, 1), (9, 9)] and w.fault == ["on_cycle"] * 3 + ["under_cycle", "on_cycle"] and w.below == [3, 3, 3, 0, 0]


def test_hierarchy_of_empty_table(spark):
    assert hierarchy.resolve(spark.createDataFrame([], "source_id long, parent_source_id long")).count() == 0


def test_hot_node_is_split_where_links_are_many(spark, monkeypatch):
    """With staged minima the join back is one of two scans, so adaptive execution splits the hot side."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        links = spark.range(300_000).selectExpr("id * 7919 % 3000017 + 10 as u", "if(id % 3 = 0, 1, id * 104729 % 2999999 + 10) as v").where("u != v").repartition(8)
        df = components._large(links, many=True)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(1, 400), rnd.randint(1, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)] + [(None, 3), (7, None), (9000, 9000)]
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}
