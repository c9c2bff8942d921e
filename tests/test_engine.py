"""Known answers, invariants and whole-against-sharded equality of the research engine."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.functions.compiler import evaluate
from tickforge.functions.expr import REGISTERED, Binary, Constant, Kind, Primitive, Series, check, example, from_dict, kind_of, position, pretty, registry, shifted, signal, strategy_id, to_dict
from tickforge.operators import backtest as bt
from tickforge.operators import pareto, portfolio
from tickforge.sources.bars import chronological_split, load_bars, manifest, numbered, read_bars, synthetic_bars

CLOSE = [101, 103, 102, 105, 106, 104, 108, 109, 107, 111]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [("X", i, float(c), c + 1.0, c - 1.5, float(c), 1000.0 + 100 * i) for i, c in enumerate(CLOSE)]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("bar_idx").select("bar_idx", name).collect()]


def test_known_vectors(sample):
    out = evaluate(sample, {n: Primitive(n, 3) for n in ("SMA", "EMA", "WMA", "RSI", "ROLLING_MEDIAN", "PRICE_RANK")})
    near = lambda got, want: all((g is None and w is None) or (g is not None and w is not None and abs(g - w) < 1e-6) for g, w in zip(got, want, strict=True))
    assert near(column(out, "SMA"), [None, None, 102, 103.333333, 104.333333, 105, 106, 107, 108, 109])
    assert near(column(out, "EMA"), [101, 102, 102, 103.5, 104.75, 104.375, 106.1875, 107.59375, 107.296875, 109.1484375])
    assert near(column(out, "WMA"), [None, None, 102.1666667, 103.6666667, 105, 104.8333333, 106.3333333, 107.8333333, 107.8333333, 109.3333333])
    assert near(column(out, "RSI"), [None, None, None, 83.3333333, 80, 66.6666667, 71.4285714, 71.4285714, 71.4285714, 71.4285714])
    assert near(column(out, "ROLLING_MEDIAN"), [None, None, 102, 103, 105, 105, 106, 108, 108, 109])
    assert near(column(out, "PRICE_RANK"), [None, None, 0.5, 1, 1, 0, 1, 1, 0, 1])


def test_known_backtest(sample):
    curve = bt.backtest(sample, Series("close") - Primitive("SMA", 3))
    assert column(curve, "raw") == [0, 0, 0, 1, 1, -1, 1, 1, -1, 1]
    assert column(curve, "position") == [0, 0, 0, 0, 1, 1, -1, 1, 1, -1]
    m = bt.metrics(curve, ["symbol"]).first()
    want = {"trades": 4, "costs_paid": 0.00315, "sharpe": 2.223204, "sortino": 3.278106, "max_drawdown": 0.028321, "total_return": 0.02478, "turnover": 0.444444}
    assert all(abs(m[k] - v) < 1e-6 for k, v in want.items())


def test_every_primitive_and_no_look_ahead(spark):
    bars = synthetic_bars(spark, 90)
    named = {f"x{i}": Primitive(n, 5) for i, n in enumerate(REGISTERED)}
    whole = {r["bar_idx"]: r for r in evaluate(bars, named).collect()}
    early = {r["bar_idx"]: r for r in evaluate(bars.filter("bar_idx < 60"), named).collect()}
    assert len(named) == 139 and len(early) == 60
    for k, r in early.items():
        for n in named:
            a, b = r[n], whole[k][n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))), (k, n)
    assert all(0 <= whole[k][f"x{REGISTERED.index('RSI')}"] <= 100 for k in range(10, 90))


def test_every_primitive_equals_its_kernel(spark):
    from tickforge.functions.expr import OWN, RULES
    from tickforge.functions.kernels import Bars, values

    rng = np.random.default_rng(4)
    n = 70
    close = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
    close[30:36] = close[30]  # flat for a while
    high, low = close + rng.random(n).round(2), close - rng.random(n).round(2)
    high[40], low[40] = close[40], close[40]
    cols = {"open": close + rng.normal(0, 0.3, n), "high": high, "low": low, "close": close, "volume": rng.integers(1, 500, n).astype(float), "funding_rate": rng.normal(0, 0.01, n), "imbalance": rng.random(n)}
    bars = spark.createDataFrame([("X", i, *(float(cols[c][i]) for c in cols)) for i in range(n)], "symbol string, bar_idx long, " + ", ".join(f"{c} double" for c in cols))
    named = {f"x{i}_{p}": Primitive(m, p) for i, m in enumerate([*OWN, *RULES]) for p in (2, 7)}
    got = evaluate(bars, named).orderBy("bar_idx").toPandas()
    b = Bars(cols)
    for name, node in named.items():
        want = values(node, b)
        np.testing.assert_allclose(got[name].to_numpy(float), want, rtol=1e-7, atol=1e-7, err_msg=str(node))


def test_rolling_closures(spark):
    from tickforge.functions import compiler, expr, kernels

    span = 2.0
    compiler.register_rolling("SPAN_OF", lambda w: float(w.max() - w.min()) * span)
    try:
        node = Primitive("SPAN_OF", 4) + Constant(0.0)
        assert kind_of(node) == "series" and check(node)["registered"]
        bars = synthetic_bars(spark, 40)
        got = evaluate(bars, {"x": node}).orderBy("bar_idx").toPandas()
        want = (got["close"].rolling(4).max() - got["close"].rolling(4).min()) * span
        np.testing.assert_allclose(got["x"], want)
        np.testing.assert_allclose(kernels.values(node, kernels.Bars({"close": got["close"].to_numpy()})), want)
    finally:
        for table in (compiler._PRIMITIVES, compiler.CLOSURES, kernels.KERNELS):
            table.pop("SPAN_OF")
        expr.PLUGINS.discard("SPAN_OF")


def test_shards_change_nothing(spark):
    bars = synthetic_bars(spark, 3000).withColumn("volume", F.round("volume"))
    named = {"a": Primitive("EMA", 4), "b": Primitive("ATR", 14), "c": Primitive("HMA", 9), "d": Primitive("TRIX", 3), "e": Primitive("OBV", 2) / Primitive("EMA", 3), "f": Primitive("AD_LINE", 2), "g": Primitive("CUM_RETURN", 2)}
    one = {r["bar_idx"]: r for r in evaluate(bars, named).collect()}
    cut = {r["bar_idx"]: r for r in evaluate(bars, named, target_rows=700).collect()}
    for k, r in one.items():
        assert all((r[n] is None) == (cut[k][n] is None) and (r[n] is None or math.isclose(r[n], cut[k][n], rel_tol=1e-9, abs_tol=1e-12)) for n in named)


def test_sharded_backtest(spark):
    bars = synthetic_bars(spark, 2000)
    g = Primitive("SMA", 3) - Primitive("SMA", 9)
    whole, cut = (bt.metrics(bt.backtest(bars, g, bt.Execution(delay_bars=2), target_rows=n), ["symbol"]).first().asDict() for n in (10**6, 300))
    assert all(whole[k] == cut[k] if isinstance(whole[k], str) else math.isclose(whole[k], cut[k], rel_tol=1e-9) for k in whole)
    base = bars.withColumn("bucket", F.col("bar_idx") * 3).drop("bar_idx")
    assert [r["bar_idx"] * 3 for r in numbered(base, target_rows=300).orderBy("bucket").collect()] == [3 * i for i in range(2000)]


def test_expressions():
    g = example()
    assert from_dict(json.loads(json.dumps(to_dict(g)))) == g and strategy_id(g) == strategy_id(from_dict(to_dict(g))) and g.complexity() == 5 and g.warmup() == 63
    assert pretty(g) == "((RSI(close, 17) - EMA(close, 63)) / ATR(close, 21))"
    assert kind_of(Constant(1) + Constant(2)) == "scalar" and kind_of(g) == "series" and len(registry()) == 139
    assert not check(Primitive("NOPE"))["registered"] and check(g)["registered"] and position(signal(kind_of(g))) == "position"
    for kind in (Kind.SCALAR, Kind.POSITION):
        with pytest.raises(TypeError):
            signal(kind)
    with pytest.raises(TypeError):
        position(Kind.SERIES)
    assert not check(Primitive("NOPE"))["valid"] and not check(Binary("%", Constant(1), Constant(2)))["valid"]
    assert shifted(g, -30).left.left.period == 2
    with pytest.raises(ValueError):
        from_dict({"type": "x"})


def test_costs_are_monotone_and_scenarios_agree(spark):
    bars = synthetic_bars(spark, 400)
    g = Primitive("SMA", 3) - Primitive("SMA", 9)
    rows = {r["multiplier"]: r for r in bt.cost_sensitivity(bars, g).collect()}
    assert [rows[m]["costs_paid"] for m in sorted(rows)] == sorted(r["costs_paid"] for r in rows.values())
    assert abs(rows[1.0]["total_return"] - bt.metrics(bt.backtest(bars, g), ["symbol"]).first()["total_return"]) < 1e-9
    delta = {r["delta"]: r for r in bt.parameter_sensitivity(bars, g).collect()}
    assert abs(delta[0]["sharpe"] - rows[1.0]["sharpe"]) < 1e-9


def test_weights():
    rng = np.random.default_rng(1)
    cov = np.cov(rng.normal(size=(5, 300)) * np.arange(1, 6)[:, None])
    for f in portfolio.METHODS.values():
        w = f(cov)
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    w = np.array([0.5, 0.5])
    two = np.array([[0.04, 0.01], [0.01, 0.09]])
    w = 1 / np.sqrt(np.diag(two))
    for _ in range(100):
        w = w / (two @ (w / w.sum()))
        w = w / w.sum()
    assert np.allclose(portfolio.risk_parity(two), w)
    x = np.linalg.inv(two + 1e-4 * np.eye(2)).sum(1)
    assert np.allclose(portfolio.min_variance(two), x / x.sum())
    assert portfolio.prune(["a", "b", "c"], np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]]), {"a": 1, "b": 2, "c": 0}) == ["b", "c"]


def test_ensemble_combines(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0.001, 0.01, (3, 60))
    base[1] = base[0] * 1.01
    rows = [(f"s{k}", i, float(base[k, i]) if i else 0.0) for k in range(3) for i in range(60)]
    got = portfolio.ensemble(spark.createDataFrame(rows, "strategy string, bar_idx long, ret double"), {"s0": 1.0, "s1": 2.0, "s2": 0.5}, "equal")
    assert got["kept"] == ["s1", "s2"] and got["weights"] == {"s1": 0.5, "s2": 0.5}
    r = base[1:, 1:].mean(0)
    equity = np.cumprod(1 + r)
    want = {"sharpe": np.sqrt(252) * r.mean() / r.std(ddof=1), "total_return": equity[-1] - 1, "max_drawdown": -min(0, (equity / np.maximum.accumulate(np.maximum(equity, 1)) - 1).min())}
    assert all(abs(got["metrics"][k] - v) < 1e-9 for k, v in want.items()) and got["metrics"]["selected"] == 2


def test_fronts_in_parts(spark):
    rng = np.random.default_rng(6)
    rows = [("g", i, *map(float, rng.integers(0, 60, 3))) for i in range(900)] + [("h", 1000, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, id long, a double, b double, c double")
    goals = (["k"], "id", ["a"], ["b", "c"])
    whole = {r["id"]: r["front"] for r in pareto.fronts(df, *goals).collect()}
    assert {r["id"]: r["front"] for r in pareto.fronts(df, *goals, most=2, part=40).collect()} == {i: k for i, k in whole.items() if k <= 2}
    assert {r["id"] for r in pareto.skyline(df, *goals, part=40).collect()} == {i for i, k in whole.items() if k == 1}
    enough = {r["id"]: r["front"] for r in pareto.fronts(df, *goals, enough=15, part=40).collect()}
    assert enough == {r["id"]: r["front"] for r in pareto.fronts(df, *goals, enough=15).collect()} and len(enough) >= 15


def test_ancestors_of_any_depth(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 300)] + [(0, 0), (500, 501), (501, 500)], "child long, parent long")
    assert sorted(r["id"] for r in pareto.ancestors(edges, "child", 250).collect()) == list(range(251))
    assert sorted(r["id"] for r in pareto.ancestors(edges, "child", 500).collect()) == [500, 501]
    assert pareto.ancestors(edges, "child", 9999).count() == 0


def test_stress_by_hand(spark):
    from tickforge.operators import books

    closes = [100.0, 101.0, 99.0, 102.0, 103.0, 101.0]
    bars = spark.createDataFrame([("X", i, c, c + 1, c - 1, v) for i, (c, v) in enumerate(zip(closes, [1.0, 2.0, 1.0, 1.0, 9.0, 1.0]))], "symbol string, bar_idx long, close double, high double, low double, volume double")
    curves = bt.curve(bars.withColumn("signal", F.when(F.col("bar_idx") % 2 == 0, 1.0).otherwise(-1.0)), ["symbol"])
    pos = [r["position"] for r in curves.orderBy("bar_idx").collect()]
    got = books.stress(curves, bars).first()
    rets, volumes = [], [1.0, 2.0, 1.0, 1.0, 9.0, 1.0]
    for i in range(1, 6):
        q = abs(pos[i] - pos[i - 1])
        near = min(q, max(1.0, volumes[i] / 4))
        slip = (near * 5e-5 + (q - near) * 15e-5) / q if q else 0.0
        rets.append(pos[i - 1] * (closes[i] / closes[i - 1] - 1) - (slip + 2e-4 if q else 0.0))
    r = np.array(rets)
    assert math.isclose(got["microstructure_sharpe"], np.sqrt(252) * r.mean() / r.std(ddof=1), rel_tol=1e-9) and got["trades_simulated"] == sum(a != b for a, b in zip(pos, pos[1:])) and got["fill_rate"] == 1.0


def test_fronts(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, (200, 3))
    df = spark.createDataFrame([("g", i, *map(float, r)) for i, r in enumerate(x)] + [("g", 999, None, 1.0, 1.0)], "k string, id long, a double, b double, c double")
    got = {r["id"]: r["front"] for r in pareto.fronts(df, ["k"], "id", ["a"], ["b", "c"], most=40).collect()}
    rest, want, k = set(range(200)), {}, 0
    better = lambda p, q: p[0] >= q[0] and p[1] <= q[1] and p[2] <= q[2] and tuple(p) != tuple(q)
    while rest:
        k += 1
        front = {i for i in rest if not any(better(x[j], x[i]) for j in rest)}
        want |= dict.fromkeys(front, k)
        rest -= front
    assert got == want


def test_bar_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,symbol,open,high,low,close,volume,sentiment\n2024-01-01,X,1,2,0.5,1.5,10,oops\n2024-01-02,X,bad,2,0.5,1.5,10,0.3\n")
    rows = read_bars(spark, str(tmp_path / "a.csv")).orderBy("timestamp").collect()
    assert [r["valid"] for r in rows] == [True, False] and [r["sentiment"] for r in rows] == [None, 0.3]
    (tmp_path / "b.csv").write_text("timestamp,symbol\n")
    for bad in ("b.csv", "c.txt"):
        with pytest.raises(ValueError):
            read_bars(spark, str(tmp_path / bad))
    for bad, text in (("10,8,9,10,5", "OHLC"), ("10,nan,9,10,5", "not finite"), ("10,11,9,10,-5", "negative"), ("x,11,9,10,5", "numbers")):
        (tmp_path / "d.csv").write_text(f"timestamp,symbol,open,high,low,close,volume\n2024-01-01,X,{bad}\n")
        with pytest.raises(ValueError, match=text):
            load_bars(spark, str(tmp_path / "d.csv"))
    (tmp_path / "e.csv").write_text("timestamp,symbol,open,high,low,close,volume\n" + "2024-01-01,X,1,2,0.5,1.5,10\n" * 2)
    with pytest.raises(ValueError, match="duplicate"):
        load_bars(spark, str(tmp_path / "e.csv"))
    df = spark.range(100).select("id", F.expr("timestamp_micros(id * 7919 % 50)").alias("ts"))
    parts = {r["id"]: r["part"] for r in chronological_split(df, "ts", "id").collect()}
    order = sorted(range(100), key=lambda i: (i * 7919 % 50, i))
    assert parts == {i: "train" if k < 80 else "test" for k, i in enumerate(order)}
    assert manifest(df, "s", ["id", "ts"]).first() == manifest(df.repartition(7), "s", ["id", "ts"]).first()


def test_orders_and_books(spark):
    from tickforge.operators import books

    orders = spark.createDataFrame(
        [(1, "buy", "market", 5.0, None, None, 10.1, 3.0), (2, "buy", "limit", 5.0, 10.0, None, 10.1, 9.0), (3, "sell", "limit", 5.0, None, None, 10.1, 9.0), (4, "sell", "stop", 0.0, None, None, 0.0, 9.0), (5, "sell", "limit", 5.0, 10.04, None, 10.1, 9.0), (6, "buy", "market", None, None, None, None, None)],
        "order_id int, side string, order_type string, quantity double, limit_price double, stop_price double, market_price double, liquidity double",
    )
    got = {r["order_id"]: r for r in books.executed(orders, min_size=1.0, tick=0.1).collect()}
    assert [got[i]["status"] for i in range(1, 7)] == ["partial", "pending", "rejected", "rejected", "filled", "rejected"]
    assert got[4]["reasons"] == "invalid_quantity,below_minimum_order_size,stop_price_required,invalid_market_price" and got[5]["fill_price"] == 10.0 and got[1]["filled_quantity"] == 3.0
    book = spark.createDataFrame([("m", "buy", 4.0, None, 0.0), ("big", "buy", 9.0, None, 0.0), ("l", "buy", 5.0, 101.0, 0.0), ("q", "sell", 2.0, 90.0, 4.0), ("no", "buy", 1.0, 100.0, 0.0)], "order_id string, side string, quantity double, limit_price double, queue_ahead double")
    side = lambda rows: F.array(*[F.struct(F.lit(p).alias("price"), F.lit(q).alias("quantity")) for p, q in rows])
    book = book.withColumns({"bids": side([(99.0, 5.0)]), "asks": side([(101.0, 2.0), (102.0, 3.0)])})
    market = {r["order_id"]: r for r in books.market_fills(book, temporary_bps=100.0).collect()}
    assert market["m"]["filled"] == 4 and market["m"]["average_price"] == 101.5 and market["big"]["status"] == "partial" and market["big"]["average_price"] > 101.6
    limit = {r["order_id"]: r for r in books.limit_fills(book, participation=1.0).collect()}
    assert (limit["l"]["filled"], limit["l"]["status"], limit["q"]["filled"], limit["no"]["status"]) == (2.0, "partial", 1.0, "unfilled")
    assert books.limit_fills(book.limit(0)).count() == 0
