"""Queries of the research plans against brute force on small fixtures."""

import hashlib
import math

import numpy as np
import pytest

from tickforge.functions.expr import Primitive, Series
from tickforge.operators import backtest as bt
from tickforge.operators import pareto
from tickforge.operators import research as statistics
from tickforge.plans import research


@pytest.fixture(scope="module")
def strategies(spark, tmp_path_factory):
    """A folder with a table of strategies: two runs, half of the Sharpe ratios not above 0, some objectives missing."""
    rng, rows = np.random.default_rng(3), []
    for run, n in (("a", 90), ("b", 14)):
        for _ in range(n):
            rows.append((run, len(rows), float(rng.integers(-20, 20)) / 8, float(rng.integers(0, 30)) / 32, int(rng.integers(1, 6))))
    rows += [("a", 900, None, 0.1, 1), ("a", 901, 9.0, math.nan, 1), ("b", 902, 9.0, 0.1, None)]
    d = str(tmp_path_factory.mktemp("strategies"))
    spark.createDataFrame(rows, "run_id string, ingest_id long, test_sharpe double, max_drawdown double, complexity int").write.parquet(f"{d}/strategies.parquet")
    return d, [r for r in rows if r[1] < 900]


def layers(rows):
    """ident: front, by comparing all pairs until nothing remains."""
    rest, found, k = list(rows), {}, 0
    better = lambda p, q: p[2] >= q[2] and p[3] <= q[3] and p[4] <= q[4] and p[2:] != q[2:]
    while rest:
        k += 1
        front = [r for r in rest if not any(better(o, r) for o in rest)]
        found |= {r[1]: k for r in front}
        rest = [r for r in rest if r[1] not in found]
    return found


def chosen(rows, size):
    """(ident, front) of the members that fill up by fronts, the last front by falling crowding distance."""
    front, out = layers(rows), []
    for k in range(1, max(front.values()) + 1):
        own = [r for r in rows if front[r[1]] == k]
        far = dict.fromkeys((r[1] for r in own), 0.0)
        for goal in (2, 3, 4):
            line = sorted(own, key=lambda r: (r[goal], r[1]))
            span = line[-1][goal] - line[0][goal] or 1.0
            for i, r in enumerate(line):
                far[r[1]] += (line[i + 1][goal] - line[i - 1][goal]) / span if 0 < i < len(line) - 1 else math.inf
        out += [(r[1], k) for r in sorted(own, key=lambda r: (-round(far[r[1]], 9), r[1]))]
    return out[:size]


def test_survivors_are_chosen_from_all_candidates(spark, strategies):
    d, rows = strategies
    got = research.survivors(spark, d).collect()
    for run in ("a", "b"):
        mine = {(r["ingest_id"], r["front"]) for r in got if r["run_id"] == run}
        assert mine == set(chosen([r for r in rows if r[0] == run], 10))
    sharpe = {r[1]: r[2] for r in rows}
    assert any(sharpe[r["ingest_id"]] <= 0 for r in got)


def test_fronts_go_on_until_nothing_remains(spark, strategies):
    d, rows = strategies
    got = {r["ingest_id"]: (r["run_id"], r["front"]) for r in research.pareto_fronts(spark, d).collect()}
    assert got == {i: (run, k) for run in ("a", "b") for i, k in layers([r for r in rows if r[0] == run]).items()}
    assert max(k for _, k in got.values()) > 3
    chain = spark.createDataFrame([("g", i, float(i), 1.0) for i in range(120)] + [("g", 500, 119.0, 1.0)], "k string, id long, a double, b double")
    deep = {r["id"]: r["front"] for r in pareto.fronts(chain, ["k"], "id", ["a"], ["b"]).collect()}
    assert deep == {i: 120 - i for i in range(120)} | {500: 1}
    assert pareto.survivors(chain, ["k"], "id", ["a"], ["b"], 70).count() == 70
    wide = spark.createDataFrame([(i, float(i // 2), float(i % 2), 0.0, 0.0) for i in range(8)], "id long, a double, b double, c double, d double")
    assert {r["id"]: r["front"] for r in pareto.fronts(wide, [], "id", ["a"], ["b", "c", "d"]).collect()} == {6: 1, 7: 2, 4: 2, 5: 3, 2: 3, 3: 4, 0: 4, 1: 5}


def test_all_gates_of_the_gauntlet(spark):
    rng, rows = np.random.default_rng(5), []
    for symbol, drifts in (("decays", [0.02] * 7 + [0.03, 0.03, -0.012]), ("falls", [-0.01] * 10)):
        close = 100.0
        for i in range(100):
            close *= 1 + drifts[i // 10] + float(rng.normal()) * 0.004
            rows.append((symbol, i, close, close * 1.01, close * 0.99, 1000.0))
    bars = spark.createDataFrame(rows, "symbol string, bar_idx long, close double, high double, low double, volume double")
    genome, md5 = Series("close") - Primitive("SMA", 2) + Series("close"), lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    got = {r["symbol"]: r for r in bt.full_gauntlet(bars, genome, shuffles=3, sims=20).collect()}
    two = {r["symbol"]: r["passed"] for r in bt.gauntlet(bars, genome).collect()}
    assert two == {"decays": True, "falls": False} and not got["decays"]["passed"] and not got["falls"]["passed"]
    for symbol, r in got.items():
        mine = [x for x in rows if x[0] == symbol]
        frame = lambda part: spark.createDataFrame([(x[0], i, *x[2:]) for i, x in enumerate(part)], bars.schema)
        run = lambda part: [x["ret"] for x in bt.backtest(frame(part), genome).orderBy("bar_idx").collect()]
        falls = []
        for sim in range(20):
            equity = peak = 1.0
            low = 0.0
            for _, ret in sorted((md5(42, sim, i), x) for i, x in enumerate(run(mine[:70])) if i):
                equity *= 1 + ret
                peak = max(peak, equity)
                low = min(low, equity / peak - 1)
            falls.append(-low)
        assert math.isclose(r["mc_drawdown"], sorted(falls)[int(19 * 0.05)], rel_tol=1e-9, abs_tol=1e-12)
        shams = [bt.metrics(bt.backtest(frame(sorted(mine[:70], key=lambda x, k=k: md5("placebo", 42, k, x[1]))), genome), ["symbol"]).first()["sharpe"] for k in range(3)]
        assert math.isclose(r["placebo_sharpe"], sum(shams) / 3, rel_tol=1e-9, abs_tol=1e-12)
        later = run(mine[70:])
        for name, part in (("first_sharpe", later[:15]), ("second_sharpe", later[15:])):
            assert math.isclose(r[name], np.mean(part) / np.std(part) * math.sqrt(252), rel_tol=1e-9)
    # each of the last gates alone decides
    free = {"in_sample": -1e9, "out_of_sample": -1e9, "drawdown": 9.0, "placebo": 1e9, "persistence": -1e9}
    passed = lambda **x: {r["symbol"]: r["passed"] for r in bt.full_gauntlet(bars, genome, shuffles=3, sims=20, **free | x).collect()}["decays"]
    assert got["decays"]["second_sharpe"] < 0.3 * got["decays"]["first_sharpe"] and passed()
    assert not passed(persistence=0.3) and not passed(drawdown=-1.0) and not passed(placebo=-1e9)


def test_cpcv_over_bars(spark):
    sizes = {"a": 40, "b": 43, "c": 9, "d": 3}
    bars = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "symbol string, bar_idx long")
    for shape in ((4, 2, 2, 1), (5, 3, 4, 3), (4, 1, 0, 0)):
        got = [tuple(r) for r in bt.cpcv_roles(bars, *shape).select("symbol", "split", "bar_idx", "role").collect()]
        assert sorted(got) == sorted((s, *x) for s, n in sizes.items() for x in research.cpcv_splits(*shape[:2], n, *shape[2:]))
    # the known vector of 40 rows
    known = {(r["split"], r["row"], r["role"]) for r in research.cpcv(spark, "").collect()}
    assert known == {(r["split"], r["bar_idx"], r["role"]) for r in bt.cpcv_roles(bars.filter("symbol = 'a'"), 4, 2, 2, 1).collect()}
    first = [(i, role) for split, i, role in sorted(known) if split == 0]
    assert first == [(i, "test") for i in range(20)] + [(i, "train") for i in range(21, 40)]


def test_simulations_of_the_reference_by_default(spark):
    rng = np.random.default_rng(8)
    x = {s: rng.normal(0.001, 0.01, 12) for s in ("a", "b")}
    df = spark.createDataFrame([(s, i, float(r)) for s, v in x.items() for i, r in enumerate(v)], "strategy string, bar_idx long, ret double")
    draw = lambda seed, sim, j, n: int(hashlib.md5(f"{seed}|{sim}|{j}".encode()).hexdigest()[:15], 16) % n
    means = lambda s, seed, sims: [np.mean([x[s][draw(seed, k, j, 12)] for j in range(12)]) for k in range(sims)]
    for r in statistics.bootstrap_interval(df, ["strategy"]).collect():
        line = sorted(means(r["strategy"], 7, 1000))
        assert math.isclose(r["lower"], line[25], rel_tol=1e-9) and math.isclose(r["upper"], line[974], rel_tol=1e-9)
    best, top = max(v.mean() for v in x.values()), np.max([means(s, 11, 500) for s in x], axis=0)
    assert math.isclose(statistics.reality_check(df).first()["p_value"], (top >= best).mean(), rel_tol=1e-12)
