"""Grid, spikes, intervals and as-of joins against brute force, whole and cut into shards."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tickforge.operators.asof import as_of, ending, versions
from tickforge.operators.grid import regular_grid
from tickforge.operators.intervals import interval_gaps, merge_intervals
from tickforge.operators.shards import assign_shards, carry, with_halo
from tickforge.operators.spikes import flag_implausible
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def test_shards_and_halo(spark):
    rows = [("hot", i // 2, i) for i in range(1000)] + [("cold", i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, o long, id long")
    cut, split = assign_shards(df, ["k"], "o", 60)
    assert split and cut.count() == len(rows)
    got = cut.collect()
    shard = {}
    for r in got:
        assert shard.setdefault((r["k"], r["o"]), r["_shard"]) == r["_shard"]
    hot = sorted((o, s) for (k, o), s in shard.items() if k == "hot")
    assert [s for _, s in hot] == sorted(s for _, s in hot) and len({s for _, s in hot}) > 8
    own = {}
    for r in with_halo(cut, ["k"], ["o", "id"], 3, 2).collect():
        own.setdefault((r["k"], r["_shard"]), []).append((r["o"], r["id"], r["_halo"]))
    ids = list(range(1000))
    for (k, s), rs in own.items():
        mine = sorted(i for _, i, h in rs if not h)
        halo = sorted(i for _, i, h in rs if h)
        if k == "hot":
            assert halo == ids[max(0, mine[0] - 3) : mine[0]] + ids[mine[-1] + 1 : mine[-1] + 3]
    ahead = {r["_shard"]: r["m"] for r in carry(cut, ["k"], {"m": F.max("id")}, F.max).collect()}
    first = min(ahead)
    assert ahead[first] is None and all(ahead[s] == min(i for _, i, h in own["hot", s] if not h) - 1 for s in ahead if s != first)


def test_shards_stay_small(spark):
    sizes = lambda df: [r["count"] for r in df.groupBy("k", "_shard").count().collect()]
    even = spark.range(60_000).selectExpr("'a' as k", "id as o", "id as t")
    outlier = even.unionByName(spark.createDataFrame([("a", 10**15, 0)], "k string, o long, t long"))
    for df in (even, outlier):
        assert max(sizes(assign_shards(df, ["k"], "o", 4000)[0])) < 8000
    burst = even.withColumn("o", F.when(F.col("t") < 40_000, 5).otherwise(F.col("o")).cast("long"))
    tied = assign_shards(burst, ["k"], "o", 4000, "t")[0]
    assert max(sizes(tied)) < 8000 and max(sizes(assign_shards(burst, ["k"], "o", 4000)[0])) >= 40_000  # one value stays together without a tie
    bounds = tied.groupBy("_shard").agg(F.min(F.struct("o", "t")).alias("a"), F.max(F.struct("o", "t")).alias("b")).orderBy("_shard").collect()
    assert all(p["b"] < q["a"] for p, q in zip(bounds, bounds[1:]))
    many = assign_shards(even, ["k"], "o", 60)[0]  # beyond one round of sketches
    assert max(sizes(many)) < 120 and many.count() == 60_000
    bounds = many.groupBy("_shard").agg(F.min("o").alias("a"), F.max("o").alias("b")).orderBy("_shard").collect()
    assert all(p["b"] < q["a"] for p, q in zip(bounds, bounds[1:]))


def random_intervals(rng, n):
    return [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *range(0, 4000, 7)]), rng.choice([None, *range(0, 4000, 7)])) for _ in range(n)]


@pytest.mark.parametrize("target", [10, 10_000])
def test_intervals(spark, target):
    rng = random.Random(3)
    for n in (0, 1, 40, 300):
        rows = random_intervals(rng, n)
        rows = [(k, s, s + rng.randrange(1, 30) if s is not None and e is not None and rng.random() < 0.9 else e) for k, s, e in rows]
        rows += rows[:3]
        df = spark.createDataFrame([(k, at(s), at(e), 1) for k, s, e in rows], "symbol string, included_at timestamp_ntz, excluded_at timestamp_ntz, _k int")
        want_gaps, want_periods = set(), set()
        for key in {k for k, _, _ in rows if k}:
            periods = []
            for s, e in sorted((s, math.inf if e is None else e) for k, s, e in rows if k == key and s is not None and (e is None or e > s)):
                if periods and s <= periods[-1][1]:
                    periods[-1][1] = max(periods[-1][1], e)
                else:
                    periods.append([s, e])
            want_periods |= {(key, s, None if e == math.inf else e) for s, e in periods}
            want_gaps |= {(key, a[1], b[0]) for a, b in zip(periods, periods[1:])}
        base = int(T0.timestamp() - datetime(1970, 1, 1).timestamp()) * 1_000_000
        us = lambda x: None if x is None else (x - base) // 1_000_000
        gaps = [(r[0], us(r[1]), us(r[2])) for r in interval_gaps(df, "symbol", "included_at", "excluded_at", target).collect()]
        periods = [(r[0], us(r[1]), us(r[2])) for r in merge_intervals(df, "symbol", "included_at", "excluded_at", target).collect()]
        assert len(gaps) == len(set(gaps)) and set(gaps) == want_gaps
        assert len(periods) == len(set(periods)) and set(periods) == want_periods


@pytest.mark.parametrize("target", [15, 10_000])
def test_as_of(spark, target):
    rng = random.Random(5)
    keys = ["hot", "hot", "hot", "x", None]
    vs = [(i, rng.choice(keys), rng.choice([None, *range(200)]), rng.choice([None, *range(220)]), rng.choice([None, *range(230)])) for i in range(120)]
    es = [(i, rng.choice(keys), rng.choice([None, *range(240)])) for i in range(150)]
    es += es[:2]
    v = spark.createDataFrame([(i, k, at(t), at(n), at(u)) for i, k, t, n, u in vs], "vid long, k string, t timestamp_ntz, known timestamp_ntz, until timestamp_ntz")
    e = spark.createDataFrame([(i, k, at(t), 0) for i, k, t in es], "eid long, k string, ts timestamp_ntz, _at int")
    got = sorted(map(tuple, as_of(e, "eid", F.col("k"), "ts", {"open": versions(v, "k", "vid", "t", "known"), "ends": ending(versions(v, "k", "vid", "t", "known", "until"))}, target).collect()))
    want = []
    for i, k, ts in es:
        if k is None or ts is None:
            continue
        for kind in ("open", "ends"):
            best = max(((t, t if n is None else n, j) for j, kk, t, n, u in vs if kk == k and t is not None and t <= ts and (t if n is None else n) <= ts and (kind == "open" or u is None or u > ts)), default=None)
            if best:
                want.append((i, kind, best[2]))
    assert got == sorted(want)
    assert as_of(e.limit(0), "eid", F.col("k"), "ts", {"a": versions(v, "k", "vid", "t", "known")}).count() == 0
    assert as_of(e, "eid", F.col("k"), "ts", {"a": versions(v.limit(0), "k", "vid", "t", "known")}).count() == 0


def pchip(x, y):
    """Slopes of the shape-preserving cubic through (x, y)."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([d[0], d[0]])
    m = np.zeros(len(x))
    for k in range(1, len(x) - 1):
        if d[k - 1] * d[k] > 0:
            a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (a + b) / (a / d[k - 1] + b / d[k])
    for k, i, j in ((0, 0, 1), (-1, -1, -2)):
        s = ((2 * h[i] + h[j]) * d[i] - h[i] * d[j]) / (h[i] + h[j])
        m[k] = 0 if np.sign(s) != np.sign(d[i]) else 3 * d[i] if np.sign(d[i]) != np.sign(d[j]) and abs(s) > 3 * abs(d[i]) else s
    return m


@pytest.mark.parametrize("target", [12, 10_000])
def test_grid(spark, target):
    rng = random.Random(9)
    ks = sorted(rng.sample(range(400), 60)) + [9000, 9004, 9005]
    rows = [(i, "hot", at(60 * k + rng.randrange(60)), 100 + rng.random()) for i, k in enumerate(ks)]
    rows += [(1000, "hot", at(60 * ks[5] + 59), 55.0), (1001, "hot", None, 1.0), (1002, None, at(5), 1.0), (1003, "hot", at(60 * 500), None), (1004, "hot", at(60 * 501), float("nan")), (1005, "lone", at(7), 3.0), (1006, "stepless", at(7), 3.0), (1007, "none", at(1), 1.0)]
    feed = spark.createDataFrame(rows, "row_id long, symbol string, ts timestamp_ntz, close_px double").selectExpr("*", "1 as status", "2 as _step")
    specs = spark.createDataFrame([("hot", 60, "always"), ("lone", 60, "weekday"), ("stepless", None, "always"), ("hot", 60, "always"), ("zero", 0, "always")], "symbol string, bar_seconds int, session_kind string")
    got = regular_grid(feed, specs, max_gap_s=60 * 2000, max_fill=8, target_rows=target).collect()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds()) // 60
    hot = {r["slot_s"] // 60 - base: r for r in got if r["symbol"] == "hot"}
    assert {k for k, r in hot.items() if r["status"] == "observed"} == set(ks)
    assert [(r["symbol"], r["status"]) for r in got if r["symbol"] not in ("hot",)] == [("lone", "observed")]
    long = [r for r in got if r["status"] == "long_gap"]
    assert len(long) == 1 and long[0]["run_periods"] == 9000 - ks[-4] - 1
    y = {k: max((t, v) for _, s, t, v in rows if s == "hot" and t and v is not None and v == v and (t - T0).total_seconds() // 60 == k)[1] for k in ks}
    for part in (ks[:-3], ks[-3:]):
        x, v = np.array(part, float), np.array([y[k] for k in part])
        m = pchip(x, v)
        for i in range(len(part) - 1):
            for k in range(part[i] + 1, part[i + 1]):
                r, h = hot[k], x[i + 1] - x[i]
                if h - 1 > 8:
                    assert r["status"] == "marked" and r["value"] is None
                    continue
                t = (k - x[i]) / h
                want = v[i] * (1 + 2 * t) * (1 - t) ** 2 + h * m[i] * t * (1 - t) ** 2 + v[i + 1] * t * t * (3 - 2 * t) + h * m[i + 1] * t * t * (t - 1)
                assert r["status"] == "filled" and abs(r["value"] - want) < 1e-9
                assert min(v[i], v[i + 1]) - 1e-9 <= r["value"] <= max(v[i], v[i + 1]) + 1e-9
    assert regular_grid(feed.limit(0), specs).count() == 0 and regular_grid(feed, specs.limit(0)).count() == 0


def test_grid_marks_weekends(spark):
    feed = spark.createDataFrame([(1, "w", datetime(2024, 1, 5, 12), 1.0), (2, "w", datetime(2024, 1, 8, 12), 2.0)], "row_id long, symbol string, ts timestamp_ntz, close_px double")
    specs = spark.createDataFrame([("w", 86400, "weekday")], "symbol string, bar_seconds int, session_kind string")
    got = [r["status"] for r in regular_grid(feed, specs).orderBy("slot_s").collect()]
    assert got == ["observed", "closed", "closed", "observed"]


def spiky(n=1500, seed=4):
    rng = random.Random(seed)
    rows, faults, px = [], set(), 100.0
    for i in range(n):
        px *= 1 + rng.gauss(0, 0.0005)
        if i == 700:
            px *= 2  # a lasting change of level
        rows.append([i, "hot", at(60 * i), px, px * 1.001, px * 0.999, px, 1000 * math.exp(rng.gauss(0, 0.5))])
    def put(i, col, name, value, case=True):
        rows[i][col] = value
        if case:
            faults.add((i, name))
    put(50, 3, "open_px", rows[50][3] * 1.2)
    put(52, 3, "open_px", rows[52][3] * 0.7)
    for i in (90, 91, 92):
        put(i, 4, "high_px", rows[i][4] * 10)
    for i in (200, 201, 202, 203):
        rows[i][5] *= 0.5  # too many for a spike
    put(699, 3, "open_px", rows[699][3] * 0.5)
    put(300, 3, "open_px", float("nan"))
    put(301, 5, "low_px", 0.0)
    put(302, 7, "volume", -1.0)
    put(303, 7, "volume", 1e9)
    put(304, 7, "volume", None, False)
    put(305, 3, "open_px", float("inf"))
    for i in range(400, 408):
        put(i, 7, "volume", 777.0)
    for i in range(420, 427):
        put(i, 7, "volume", 888.0, False)
    rows[500][4], rows[500][5] = rows[500][5], rows[500][4]
    faults |= {(500, "high_px"), (500, "low_px")}
    rows.append([n, "hot", at(60 * 50), *rows[50][3:]])  # delivered again
    faults.add((n, "open_px"))
    rows += [[n + 1, None, at(0), -1.0, 1.0, 1.0, 1.0, 1.0], [n + 2, "hot", None, -1.0, 1.0, 1.0, 1.0, 1.0], [n + 3, "lone", at(0), 1.0, 1.0, 1.0, 1.0, 1.0]]
    return rows, faults


@pytest.mark.parametrize("target", [100, 100_000])
def test_spikes(spark, target):
    rows, faults = spiky()
    schema = "row_id long, symbol string, ts timestamp_ntz, open_px double, high_px double, low_px double, close_px double, volume double"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as reason", "2 as _us")
    got = flag_implausible(df, target_rows=target).collect()
    found = {(r["row_id"], r["field_name"]) for r in got if r["reason"] != "fence"}
    assert found == faults
    reasons = {(r["row_id"], r["field_name"], r["reason"]) for r in got}
    assert (50, "open_px", "jump") in reasons and (50, "open_px", "fence") in reasons and (700, "open_px", "fence") in reasons
    assert (400, "volume", "stuck") in reasons and (303, "volume", "volume") in reasons and len(reasons) == len(got)
    assert flag_implausible(df.limit(0)).count() == 0


def test_spikes_beside_missing_values(spark):
    """Runs of missing values and of bars delivered again, longer than shards, change nothing."""
    schema = "row_id long, symbol string, ts timestamp_ntz, open_px double, high_px double, low_px double, close_px double, volume double"
    rng = random.Random(2)
    rows = []
    for i in range(2600):
        px = 100 * (1 + rng.gauss(0, 0.0005))
        rows.append([i, "hot", at(60 * i), px, px * 1.001, px * 0.999, px, 1000 * math.exp(rng.gauss(0, 0.5))])
    for i in (*range(100, 1100), *range(1101, 2100)):  # the spike at 1100 has 1000 missing bars on either side
        rows[i][3] = None if i % 2 else float("nan")
    rows[1100][3] *= 2
    rows[2300][4] *= 3
    rows += [[10_000 + k, "hot", at(60 * 2299), *rows[2299][3:]] for k in range(1000)]  # delivered again, beside the second spike
    for i in range(2500, 2508):
        rows[i][7] = 777.0
    rows += [[20_000 + k, "hot", at(60 * 2503), *rows[2503][3:]] for k in range(300)]
    df = spark.createDataFrame(rows, schema)
    cut, whole = (sorted(map(tuple, flag_implausible(df, target_rows=n).filter("reason <> 'fence'").collect())) for n in (100, 100_000))
    assert cut == whole
    assert (1100, "open_px", "jump") in whole and (2300, "high_px", "jump") in whole and sum(r[2] == "stuck" and r[0] >= 2500 for r in whole) == 308


def test_spikes_and_hot_keys_in_salted_parts_are_not_broadcast(spark, monkeypatch):
    """Rows repeated for the parts of a shuffled join look as small as the file they were repeated from."""
    from tickforge.operators import shards, spikes

    rows, faults = spiky()
    df = spark.createDataFrame(rows, "row_id long, symbol string, ts timestamp_ntz, open_px double, high_px double, low_px double, close_px double, volume double")
    want = sorted(map(tuple, flag_implausible(df, target_rows=100).collect()))
    monkeypatch.setattr(spikes, "BROADCAST_ROWS", 0)
    got = flag_implausible(df, target_rows=100)
    assert "Broadcast" not in got._jdf.queryExecution().toString() and sorted(map(tuple, got.collect())) == want
    small = shards.materialize(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long"), "small")
    joined = shards.joined_hot(spark.createDataFrame([("a", i) for i in range(200)] + [("c", 0)], "k string, i long"), small, ["k"], False, ["i"])
    assert "Broadcast" not in joined._jdf.queryExecution().toString()
    assert sorted((r["k"], r["i"], r["n"]) for r in joined.collect() if r["k"] == "a") == [("a", i, 1) for i in range(200)] and joined.count() == 201


def test_spikes_of_bars_of_one_row_need_no_join(spark, monkeypatch):
    """Only bars of several rows are joined back to their rows; identifiers that a bar cannot carry are joined as before."""
    from tickforge.operators import spikes

    rows, faults = spiky()
    rows = [r for r in rows if r[0] != len(spiky()[0]) - 4]  # but for the bar delivered again
    df = spark.createDataFrame(rows, "row_id long, symbol string, ts timestamp_ntz, open_px double, high_px double, low_px double, close_px double, volume double")
    monkeypatch.setattr(spikes, "BROADCAST_ROWS", 0)
    got = flag_implausible(df, target_rows=100)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, got.collect()))
    assert {r[:2] for r in got if r[2] != "fence"} == {f for f in faults if f[0] in {r[0] for r in rows}}
    for kind in ("string", "decimal(20,1)"):
        other = flag_implausible(df.withColumn("row_id", F.col("row_id").cast(kind)), target_rows=100)
        assert sorted((int(float(i)), f, r) for i, f, r in other.collect()) == got and other.schema["row_id"].dataType.simpleString() == kind


def test_best_over_is_brute_force():
    from tickforge.operators.asof import _best_over

    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        a = rng.integers(0, n, 40)
        b = np.minimum(n, a + rng.integers(0, n + 1, 40))
        rank = rng.permutation(40) + 1
        want = [max((r for x, y, r in zip(a, b, rank) if x <= i < y), default=0) for i in range(n)]
        assert _best_over(a, b, rank, n).tolist() == want


def test_grid_fills_up_to_its_limit(spark):
    """1440 empty periods are filled, one more is marked."""
    rows = [(1, "a", at(0), 1.0), (2, "a", at(60 * 1441), 2.0), (3, "b", at(0), 1.0), (4, "b", at(60 * 1442), 2.0)]
    feed = spark.createDataFrame(rows, "row_id long, symbol string, ts timestamp_ntz, close_px double")
    specs = spark.createDataFrame([("a", 60, "always"), ("b", 60, "always")], "symbol string, bar_seconds int, session_kind string")
    got = {(r["symbol"], r["status"]): r["n"] for r in regular_grid(feed, specs).groupBy("symbol", "status").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", "observed"): 2, ("a", "filled"): 1440, ("b", "observed"): 2, ("b", "marked"): 1441}


def test_as_of_many_events_at_one_instant(spark):
    """More events of one instant than a shard may hold, some versions of that instant too."""
    v = spark.createDataFrame([(i, "hot", at(t), None, None) for i, t in enumerate([1, 5, 5, 9])], "vid long, k string, t timestamp_ntz, known timestamp_ntz, until timestamp_ntz")
    e = spark.createDataFrame([(i, "hot", at(5)) for i in range(200)] + [(900, "hot", at(4)), (901, "hot", at(9)), (902, "hot", at(0))], "eid long, k string, ts timestamp_ntz")
    got = {r[0]: r[2] for r in as_of(e, "eid", F.col("k"), "ts", {"a": versions(v, "k", "vid", "t", "known")}, 20).collect()}
    assert got == {i: 2 for i in range(200)} | {900: 0, 901: 3}


def test_spikes_with_copies_of_one_bar(spark):
    """A third of all rows is one bar, restated in part: each row is judged by its own value."""
    rng = random.Random(7)
    rows = [(i, "s", at(60 * i), px := 100 + rng.gauss(0, 0.05), px * 1.001, px * 0.999, px, 100 * math.exp(rng.gauss(0, 0.3))) for i in range(400)]
    spiked = (rows[200][0], "s", rows[200][2], 150.0, *rows[200][4:])
    rows[200] = spiked
    rows += [(1000 + k, *(spiked[1:] if k % 2 else (*spiked[1:3], 100.0, *spiked[4:]))) for k in range(300)] + [(5000, "s", at(60 * 10), None, None, None, None, 1e9)]
    df = spark.createDataFrame(rows, "row_id long, symbol string, ts timestamp_ntz, open_px double, high_px double, low_px double, close_px double, volume double").selectExpr("*", "1 as _k", "2 as _id", "3 as field_name")
    for target in (50, 10_000):
        got = {(r["row_id"], r["field_name"]) for r in flag_implausible(df, target_rows=target).filter("reason <> 'fence'").collect()}
        assert got == {(200, "open_px"), (5000, "volume")} | {(1000 + k, "open_px") for k in range(300) if k % 2}
