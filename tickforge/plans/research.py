"""Queries of factor analytics, robustness, selection, portfolios and books over the test tables, with their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.compiler import evaluate
from tickforge.functions.expr import Primitive as P
from tickforge.operators import backtest as bt
from tickforge.operators import books, factor, pareto, pit, portfolio, research
from tickforge.operators.nested import flatten_records
from tickforge.plans.engine import CROSSOVER, FLAGSHIP, rounded
from tickforge.plans.engine_sql import BARS, FIXED, ROOT, curve_cte, metrics_sql, monte_carlo_sql, signal_cte
from tickforge.plans.problems import RECORDS
from tickforge.session import read
from tickforge.sources.bars import event_bars


def _pairs(spark: SparkSession, d: str, horizon: int = 1) -> DataFrame:
    df = evaluate(event_bars(spark, d), {"signal": P("ROC", 5)})
    return factor.forward_returns(df, horizon).select("symbol", "bar_idx", "signal", "fwd")


def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pairs(spark, d, 5))


def rank_ic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factor.rank_ic(_pairs(spark, d), "signal", "fwd"))


def quantile_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factor.quantile_spread(_pairs(spark, d), "signal", "fwd"), 8)


def rank_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factor.rank_autocorrelation(_pairs(spark, d), "signal"))


def _with_market(spark: SparkSession, d: str) -> DataFrame:
    df = evaluate(event_bars(spark, d), {"ret": P("ROC", 2), "mom": P("ROC", 10), "dev": P("PRICE_ZSCORE", 20)}).select("symbol", "bar_idx", "ret", "mom", "dev")
    market = df.groupBy("bar_idx").agg(F.avg("ret").alias("market"))
    return df.join(market, "bar_idx")


def neutralized(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factor.neutralized(_with_market(spark, d), "ret", "market").select("symbol", "bar_idx", "neutral"))


def orthogonalized(spark: SparkSession, d: str) -> DataFrame:
    full = _with_market(spark, d).dropna(subset=["ret", "mom", "dev"])
    return rounded(factor.orthogonalized(full, ["ret", "mom", "dev"]).select("symbol", "bar_idx", "orth_ret", "orth_mom", "orth_dev"))


def _strategy_returns(spark: SparkSession, d: str) -> DataFrame:
    return bt.backtest(event_bars(spark, d), CROSSOVER).select(F.col("symbol").alias("strategy"), "bar_idx", "ret")


def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = factor.correlations(_strategy_returns(spark, d))
    return rounded(pairs.withColumn("cov", F.col("cov") * 1e4))


def novelty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factor.novelty(factor.correlations(_strategy_returns(spark, d))))


def monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.monte_carlo(_strategy_returns(spark, d).filter("bar_idx > 0"), ["strategy"]))


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.bootstrap_interval(_strategy_returns(spark, d), ["strategy"]), 9)


def reality_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.reality_check(_strategy_returns(spark, d)), 9)


def _finite(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "strategies").filter("test_sharpe is not null and not isnan(test_sharpe) and abs(test_sharpe) < double('Infinity')")


def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.deflated_sharpe(_finite(spark, d), ["run_id", "generation"], "ingest_id", "test_sharpe"))


def overfit_proxy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.overfit_proxy(_finite(spark, d), ["run_id", "generation"], "test_sharpe"), 8)


def adjusted_p(spark: SparkSession, d: str) -> DataFrame:
    p = _finite(spark, d).withColumn("p", 1 / (1 + F.exp(F.col("test_sharpe"))))
    return rounded(research.adjusted_p(p, ["run_id"], "ingest_id", "p"), 8)


def regime_labels(spark: SparkSession, d: str) -> DataFrame:
    return research.regime_labels(event_bars(spark, d)).select("symbol", "bar_idx", "regime")


def best_per_strategy(spark: SparkSession, d: str) -> DataFrame:
    return research.best_per_strategy(read(spark, d, "strategies"))


def top_strategies(spark: SparkSession, d: str) -> DataFrame:
    return research.top_k(read(spark, d, "strategies"), 20).select("ingest_id", "strategy_id", "test_sharpe")


def population(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.population(read(spark, d, "strategies")))


def root_usage(spark: SparkSession, d: str) -> DataFrame:
    return research.root_usage(read(spark, d, "strategies"))


def robustness_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.robustness_score(flatten_records(read(spark, d, "strategy_records"))))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    keep = read(spark, d, "strategies").filter("complexity is not null and max_drawdown is not null and not isnan(max_drawdown) and test_sharpe is not null and not isnan(test_sharpe)")
    return keep.select("run_id", "ingest_id", "test_sharpe", "max_drawdown", "complexity")


def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return pareto.skyline(_candidates(spark, d), ["run_id"], "ingest_id", ["test_sharpe"], ["max_drawdown", "complexity"])


def pareto_layers(spark: SparkSession, d: str) -> DataFrame:
    return pareto.fronts(_candidates(spark, d), ["run_id"], "ingest_id", ["test_sharpe"], ["max_drawdown", "complexity"], most=3)


def pareto_fronts(spark: SparkSession, d: str) -> DataFrame:
    return pareto.fronts(_candidates(spark, d), ["run_id"], "ingest_id", ["test_sharpe"], ["max_drawdown", "complexity"])


def crowding_distance(spark: SparkSession, d: str) -> DataFrame:
    front = pareto_front(spark, d).join(_candidates(spark, d), ["run_id", "ingest_id"])
    return rounded(pareto.crowding(front, ["run_id"], "ingest_id", ["test_sharpe", "max_drawdown", "complexity"]).select("run_id", "ingest_id", "crowding"))


def survivors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pareto.survivors(_candidates(spark, d), ["run_id"], "ingest_id", ["test_sharpe"], ["max_drawdown", "complexity"], 10))


def ancestors(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "customer")
    return pareto.ancestors(n.select(F.col("c_custkey").alias("child"), F.expr("cast(c_custkey div 3 as bigint)").alias("parent")), "child", 127)


def ensemble_weights(spark: SparkSession, d: str) -> DataFrame:
    names, cov = portfolio.matrix(factor.correlations(_strategy_returns(spark, d)))
    rows = [(m, n, float(x)) for m, f in portfolio.METHODS.items() for n, x in zip(names, f(cov), strict=True)]
    return rounded(spark.createDataFrame(rows, "method string, strategy string, weight double"))


def inverse_variance_weights(spark: SparkSession, d: str) -> DataFrame:
    return ensemble_weights(spark, d).filter("method in ('inverse_variance', 'equal')")


def cpcv_splits(groups: int = 6, held: int = 2, n: int = 600, purge: int = 5, embargo: int = 3) -> list[tuple[int, int, str]]:
    """(split, row, role) of combinatorial purged cross-validation: rows just before a test group are purged, those just after embargoed."""
    size, out = n // groups, []
    bounds = [(g * size, (g + 1) * size if g < groups - 1 else n) for g in range(groups)]
    for s, chosen in enumerate(itertools.combinations(range(groups), held)):
        test = {i for g in chosen for i in range(*bounds[g])}
        banned = {i for g in chosen for a, b in [bounds[g]] for i in [*range(a - purge, a), *range(b, b + embargo)]}
        out += [(s, i, "test" if i in test else "train") for i in range(n) if i in test or i not in banned]
    return out


def cpcv(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(cpcv_splits(4, 2, 40, 2, 1), "split int, row int, role string")


def cpcv_bars(spark: SparkSession, d: str) -> DataFrame:
    return bt.cpcv_roles(event_bars(spark, d), 4, 2, 2, 1)


def synthetic_book(spark: SparkSession, d: str) -> DataFrame:
    b = books.synthetic_books(event_bars(spark, d))
    rows = b.select("symbol", "bar_idx", F.posexplode(F.arrays_zip("bids", "asks")).alias("level", "_l"))
    return rounded(rows.select("symbol", "bar_idx", "level", F.col("_l.bids.price").alias("bid"), F.col("_l.bids.quantity").alias("bid_quantity"), F.col("_l.asks.price").alias("ask")))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    b = books.synthetic_books(event_bars(spark, d)).withColumn("order_id", F.concat_ws("-", "symbol", F.col("bar_idx").cast("string")))
    buy = F.col("bar_idx") % 2 == 0
    return b.withColumns({"side": F.when(buy, "buy").otherwise("sell"), "quantity": F.col("volume") * (0.1 + 0.3 * (F.col("bar_idx") % 4)), "limit_price": F.when(buy, F.col("close") + 0.7 * (F.col("high") - F.col("close"))).otherwise(F.col("close") - 0.7 * (F.col("close") - F.col("low"))), "queue_ahead": F.col("volume") * 0.05})


def market_fills(spark: SparkSession, d: str) -> DataFrame:
    return rounded(books.market_fills(_orders(spark, d), fee_bps=2.0, half_spread_bps=1.0, temporary_bps=5.0, permanent_bps=2.0))


def limit_fills(spark: SparkSession, d: str) -> DataFrame:
    return rounded(books.limit_fills(_orders(spark, d), participation=0.4))


def venue_replay(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), (F.floor(F.col("o_totalprice") / 1000) / 4).alias("price"), (1.0 + F.col("o_custkey") % 50).alias("quantity"), F.when(F.col("o_orderstatus") == "O", "maker").otherwise("taker").alias("liquidity"))
    prints = read(spark, d, "lineitem").select((F.floor(F.col("l_extendedprice") / 1000) / 4).alias("price"), F.col("l_quantity").alias("quantity"))
    return rounded(books.replay(orders, prints, books.Venue(tick=0.25, lot=1.0, max_notional=1500.0)))


def stress_test(spark: SparkSession, d: str) -> DataFrame:
    b = event_bars(spark, d)
    return rounded(books.stress(bt.backtest(b, CROSSOVER), b))


def microstructure_gauntlet(spark: SparkSession, d: str) -> DataFrame:
    """The stress test of several genomes at once."""
    b, named = event_bars(spark, d), {"flagship": FLAGSHIP, "crossover": CROSSOVER}
    wide = evaluate(b, named, price_only=True)
    long = wide.select("symbol", "bar_idx", "close", F.explode(F.array(*[F.struct(F.lit(n).alias("genome"), F.col(n).alias("signal")) for n in named])).alias("_s")).select("symbol", "bar_idx", "close", "_s.*")
    return rounded(books.stress(bt.curve(long, ["symbol", "genome"]), b, keys=("symbol", "genome")))


def factor_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(factor.analyze(evaluate(event_bars(spark, d), {"signal": P("ROC", 5)}), "signal"))


def combinatorial_validation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.combinatorial_metrics(event_bars(spark, d), FLAGSHIP))


def gauntlet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.gauntlet(event_bars(spark, d), FLAGSHIP))


def full_gauntlet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.full_gauntlet(event_bars(spark, d), FLAGSHIP))


def factor_horizons(spark: SparkSession, d: str) -> DataFrame:
    base, out = evaluate(event_bars(spark, d), {"signal": P("ROC", 5)}), None
    for h in (1, 5, 10):
        one = factor.rank_ic(factor.forward_returns(base, h), "signal", "fwd").select("symbol", F.lit(h).alias("horizon"), "mean_ic", "positive_rate")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def optimized_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(books.optimized_weights(_finite(spark, d), ["run_id", "generation"], "ingest_id", "test_sharpe", "max_drawdown"), 8)


def order_execution(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    price = F.floor(F.col("o_totalprice")) / 128
    orders = read(spark, d, "orders").select(
        k.alias("order_id"), F.when(c % 2 == 0, "buy").otherwise("sell").alias("side"), F.when(c % 3 == 0, "market").when(c % 3 == 1, "limit").otherwise("stop").alias("order_type"), ((k % 7) - 1).cast("double").alias("quantity"),
        F.when(k % 5 != 0, price * (1 + (k % 3 - 1) / 64)).alias("limit_price"), F.when(k % 4 != 0, price).alias("stop_price"), price.alias("market_price"), (c % 5).cast("double").alias("liquidity"),
    )
    return rounded(books.executed(orders, min_size=2.0, tick=0.25))


def mark_to_market(spark: SparkSession, d: str) -> DataFrame:
    fills = read(spark, d, "fills").filter("symbol is not null").select("symbol", F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"))
    feed = read(spark, d, "feed").filter("symbol is not null and ts is not null and close_px is not null and not isnan(close_px)")
    last = feed.groupBy("symbol").agg(F.max_by("close_px", F.struct("ts", "row_id")).alias("price"))
    return rounded(pit.marked(fills.groupBy("symbol").agg(F.sum("quantity").alias("quantity")), last, 1_000_000.0), 3)


def risk_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("equity"))
    rows = rows.withColumns({"price": 1.0 + F.col("c_custkey") % 90, "wanted": (F.col("c_custkey") % 401 - 200).cast("double"), "margin": 500.0 + F.col("c_custkey") % 7000})
    return rounded(rows.select("c_custkey", books.risk_clamped(F.col("wanted"), F.col("equity"), F.col("price"), 0.5, 2.0).alias("units"), books.liquidated(F.col("equity"), F.col("margin")).alias("liquidated")))


QUERIES = {f.__name__: f for f in (
    combinatorial_validation, factor_analysis, microstructure_gauntlet, gauntlet, full_gauntlet, factor_horizons, optimized_weights, order_execution, mark_to_market, risk_limits,
    forward_returns, rank_ic, quantile_spread, rank_autocorrelation, neutralized, orthogonalized, correlation_matrix, novelty, monte_carlo, bootstrap_interval, reality_check, deflated_sharpe,
    overfit_proxy, adjusted_p, regime_labels, best_per_strategy, top_strategies, population, root_usage, robustness_scores, pareto_front, pareto_layers, pareto_fronts, crowding_distance, survivors, ancestors,
    ensemble_weights, inverse_variance_weights, cpcv, cpcv_bars, synthetic_book, market_fills, limit_fills, venue_replay, stress_test,
)}

_O = "(PARTITION BY symbol ORDER BY i)"
_SIG = f"s AS (SELECT symbol, i, close, close / lag(close, 5) OVER {_O} - 1 AS signal FROM b)"
_PAIRS = f"{BARS}, {_SIG}, p AS (SELECT symbol, i, signal, lead(close, 1) OVER {_O} / close - 1 AS fwd FROM s), c AS (SELECT *, row_number() OVER {_O} - 1 AS j, count(*) OVER (PARTITION BY symbol) AS n FROM p WHERE signal IS NOT NULL AND fwd IS NOT NULL)"


def _rank(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2e0)"


def _ic(source: str, part: str, a: str, b: str) -> str:
    return f"""(SELECT {part}, count(*) AS k, CASE WHEN count(*) < 3 THEN 0e0 ELSE greatest(-1e0, least(1e0, 1 - 6 * sum(dd * dd) / (count(*) * (count(*) * count(*) - 1)))) END AS ic
FROM (SELECT {part}, {_rank(a, part)} - {_rank(b, part)} AS dd FROM {source}) GROUP BY {part})"""


_STRAT = f"{BARS}, {signal_cte('crossover')}, {curve_cte('sig', 'symbol')}, r AS (SELECT symbol AS strategy, i, ret FROM cur)"
_MKT = f"""{BARS}, q AS (SELECT symbol, i, close / lag(close, 2) OVER {_O} - 1 AS ret, close / lag(close, 10) OVER {_O} - 1 AS mom,
 CASE WHEN i >= 19 THEN (close - avg(close) OVER w20) / CASE WHEN stddev_pop(close) OVER w20 = 0 THEN 1 ELSE stddev_pop(close) OVER w20 END END AS dev FROM b WINDOW w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, avg(ret) OVER (PARTITION BY i) AS market FROM q)"""
_CORR = """cc AS (SELECT x.strategy AS a, y.strategy AS b, count(*) AS n, coalesce(covar_samp(x.ret, y.ret), 0e0) AS cov, coalesce(covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0), 0e0) AS cr
 FROM r x JOIN r y ON x.i = y.i AND x.strategy <= y.strategy GROUP BY ALL)"""
_HEX = "CAST(concat('0x', substr(md5(concat_ws('|', {seed}, m.sim, d.i)), 1, 15)) AS BIGINT)"


def _boot(seed: int, sims: int) -> str:
    return f"""{_STRAT}, nn AS (SELECT strategy, count(*) AS n FROM r GROUP BY 1), m AS (SELECT unnest(range({sims})) AS sim),
dr AS (SELECT d.strategy, m.sim, {_HEX.format(seed=seed)} % nn.n AS i FROM r d JOIN nn USING (strategy), m), bm AS (SELECT dr.strategy, dr.sim, avg(r.ret) AS mean FROM dr JOIN r ON r.strategy = dr.strategy AND r.i = dr.i GROUP BY ALL)"""


_FIN = "f AS (SELECT * FROM strategies WHERE isfinite(test_sharpe))"
_CAND = "k AS (SELECT run_id, ingest_id, test_sharpe AS s, max_drawdown AS d, complexity AS c FROM strategies WHERE complexity IS NOT NULL AND max_drawdown IS NOT NULL AND NOT isnan(max_drawdown) AND test_sharpe IS NOT NULL AND NOT isnan(test_sharpe))"


def _front(source: str, name: str) -> str:
    return f"{name} AS (SELECT a.* FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE b.run_id = a.run_id AND b.s >= a.s AND b.d <= a.d AND b.c <= a.c AND (b.s > a.s OR b.d < a.d OR b.c < a.c)))"


def _gap(x: str) -> str:
    w = f"(PARTITION BY run_id ORDER BY {x}, ingest_id)"
    span = f"(max({x}) OVER (PARTITION BY run_id) - min({x}) OVER (PARTITION BY run_id))"
    return f"coalesce((lead({x}) OVER {w} - lag({x}) OVER {w}) / CASE WHEN {span} = 0 THEN 1e0 ELSE {span} END, CAST('inf' AS DOUBLE))"


_SHARPE = "TRY_CAST(json_extract(json_extract(j, '$.metrics'), '$.sharpe')->>'$' AS DOUBLE)"
_ROBUSTNESS = f"""WITH RECURSIVE {RECORDS}, a AS (SELECT record_id FROM node UNION SELECT record_id FROM fold UNION SELECT record_id FROM scenario UNION SELECT record_id FROM quantile UNION SELECT record_id FROM execution),
g AS (SELECT record_id, parent_path LIKE '%/cost_sensitivity' AS cost, CASE WHEN {_SHARPE} > 0 AND NOT isnan({_SHARPE}) THEN 1e0 ELSE 0e0 END AS ok FROM scenario),
p AS (SELECT record_id, avg(ok) FILTER (cost) AS c, avg(ok) FILTER (NOT cost) AS p FROM g GROUP BY 1), q AS (SELECT record_id, max(TRY_CAST(json_extract(j, '$.p05')->>'$' AS DOUBLE)) AS q FROM quantile WHERE node_path LIKE '%/total_return' GROUP BY 1)
SELECT record_id, round(50 * coalesce(c, 0) + 30 * coalesce(p, 0) + CASE WHEN coalesce(q, 0) > -1 AND NOT isnan(coalesce(q, 0)) THEN 20 ELSE 0 END, 6) + 0e0 AS robustness FROM a LEFT JOIN p USING (record_id) LEFT JOIN q USING (record_id)"""


def _survivors(size: int) -> str:
    """As many fronts as so many members can need, each from what is left; then the crowding within each front."""
    ctes, left = [_CAND], "k"
    for f in range(1, size + 1):
        ctes += [_front(left, f"f{f}"), f"k{f}_ AS MATERIALIZED (SELECT * FROM {left} ANTI JOIN f{f} USING (run_id, ingest_id))"]
        left = f"k{f}_"
    ctes.append("a AS (" + " UNION ALL ".join(f"SELECT *, {f} AS front FROM f{f}" for f in range(1, size + 1)) + ")")
    gap = " + ".join(_gap(x).replace("PARTITION BY run_id", "PARTITION BY run_id, front") for x in "sdc")
    return f"""WITH {", ".join(ctes).replace(" AS (SELECT a.*", " AS MATERIALIZED (SELECT a.*")}, c AS (SELECT *, {gap} AS crowding FROM a),
w AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY front, crowding DESC, ingest_id) AS place FROM c) SELECT run_id, ingest_id, front, round(crowding, 6) + 0e0 AS crowding FROM w WHERE place <= {size}"""


_CPCV_BARS = f"""WITH {BARS}, n AS (SELECT symbol, count(*) AS n, count(*) // 4 AS t FROM b GROUP BY 1), g AS (SELECT unnest(range(4)) AS g), sp AS (SELECT a.g AS x, b.g AS y, row_number() OVER (ORDER BY a.g, b.g) - 1 AS split FROM g a, g b WHERE a.g < b.g),
q AS (SELECT symbol, i, split, x, y, t, CASE WHEN x < 3 THEN (x + 1) * t ELSE n END AS xe, CASE WHEN y < 3 THEN (y + 1) * t ELSE n END AS ye FROM b JOIN n USING (symbol), sp),
z AS (SELECT *, (i >= x * t AND i < xe) OR (i >= y * t AND i < ye) AS test, (i >= x * t - 2 AND i < x * t) OR (i >= xe AND i < xe + 1) OR (i >= y * t - 2 AND i < y * t) OR (i >= ye AND i < ye + 1) AS near FROM q)
SELECT symbol, i AS bar_idx, CAST(split AS INTEGER) AS split, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM z WHERE test OR NOT near"""

_BOOK = """lv AS (SELECT unnest(range(5)) AS level), wt AS (SELECT sum(exp(-5e-1 * level)) AS t FROM lv),
bk AS (SELECT symbol, i, level, volume, close - (level + 1) * CASE WHEN close - low > 0 THEN (close - low) / 5 ELSE 1e-2 END AS bid, close + (level + 1) * CASE WHEN high - close > 0 THEN (high - close) / 5 ELSE 1e-2 END AS ask,
 volume * exp(-5e-1 * level) / (SELECT t FROM wt) AS q, i % 2 = 0 AS buy, volume * (1e-1 + 3e-1 * (i % 4)) AS want, CASE WHEN i % 2 = 0 THEN close + 7e-1 * (high - close) ELSE close - 7e-1 * (close - low) END AS lim FROM b, lv),
o AS (SELECT *, CASE WHEN buy THEN ask ELSE bid END AS px, coalesce(sum(q) OVER (PARTITION BY symbol, i ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM bk)"""

def _part_sql(cte: str, part: str, keys: str) -> str:
    return f"WITH {BARS}, {cte}, {signal_cte('flagship', part, 'fo')}, {curve_cte('sig', part)}, {metrics_sql('cur', part, keys)}"


_SPLITS = """g AS (SELECT unnest(range(4)) AS g), sp AS (SELECT a.g AS x, b.g AS y, row_number() OVER (ORDER BY a.g, b.g) - 1 AS split FROM g a, g b WHERE a.g < b.g), n AS (SELECT symbol, greatest(1, count(*) // 4) AS t FROM b GROUP BY 1),
fo AS (SELECT b.* EXCLUDE (i), split, row_number() OVER (PARTITION BY b.symbol, split ORDER BY b.i) - 1 AS i FROM b JOIN n USING (symbol) JOIN sp ON least(b.i // n.t, 3) IN (sp.x, sp.y))"""
_LATER = """n AS (SELECT symbol, greatest(1, CAST(floor(count(*) * 7e-1) AS BIGINT)) AS t FROM b GROUP BY 1),
fo AS (SELECT b.* EXCLUDE (i), b.i >= n.t AS half, CASE WHEN b.i >= n.t THEN b.i - n.t ELSE b.i END AS i FROM b JOIN n USING (symbol))"""
_HORIZON = """(WITH {bars}, {sig}, p AS (SELECT symbol, i, signal, lead(close, {h}) OVER {o} / close - 1 AS fwd FROM s), c AS (SELECT *, row_number() OVER {o} - 1 AS j, count(*) OVER (PARTITION BY symbol) AS n FROM p WHERE signal IS NOT NULL AND fwd IS NOT NULL),
u AS (SELECT *, unnest(CASE WHEN n < 20 THEN [0] ELSE list_filter(range(0, CAST((n - 20) // 10 + 1 AS BIGINT)), lambda q: q * 10 <= j AND j < q * 10 + 20) END) AS ch FROM c)
SELECT symbol, {h} AS horizon, round(avg(ic), 6) + 0e0 AS mean_ic, round(avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS positive_rate FROM {ic} GROUP BY symbol)"""

def _stress(kind: str) -> str:
    cur = f"{BARS}, {signal_cte(kind)}, {curve_cte('sig', 'symbol')}"
    base = f"WITH {cur}, {metrics_sql('cur', 'symbol', 'symbol', None)}"
    near = "least(turn, greatest(1e0, 25e-2 * volume))"
    book = f"""l AS (SELECT symbol, i, turn, 0e0 AS cost, CASE WHEN i = 0 THEN 0e0 ELSE held * mv - CASE WHEN turn > 0 THEN ({near} * 5e-5 + (turn - {near}) * 15e-5) / turn + 2e-4 ELSE 0 END END AS ret FROM cur),
mi AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY i) AS equity FROM l)"""
    micro = f"WITH {cur}, {book}, {metrics_sql('mi', 'symbol', 'symbol', None)}"
    return f"""SELECT symbol, round(a.sharpe, 6) + 0e0 AS baseline_sharpe, round(m.sharpe, 6) + 0e0 AS microstructure_sharpe, round(a.max_drawdown, 6) + 0e0 AS baseline_drawdown, round(m.max_drawdown, 6) + 0e0 AS microstructure_drawdown,
 a.trades AS trades_simulated, CASE WHEN a.trades > 0 THEN 1e0 ELSE 0e0 END AS fill_rate, m.sharpe > 0 AND m.max_drawdown <= greatest(1e-2, 15e-1 * a.max_drawdown) AS passed FROM ({base}) a JOIN ({micro}) m USING (symbol)"""


def _all_gates() -> str:
    """The gauntlet's five gates: both Sharpe ratios, drawdown over reshuffles, Sharpe ratio over reshuffled bars, and the later half against the earlier."""
    curves = f"{BARS}, {_LATER}, {signal_cte('flagship', 'symbol, half', 'fo')}, {curve_cte('sig', 'symbol, half')}"
    sides = f"WITH {curves}, {metrics_sql('cur', 'symbol, half', 'symbol, half', None)}"
    drawn = monte_carlo_sql(f"{curves}, r AS (SELECT symbol, i, ret FROM cur WHERE NOT half)", "symbol", 42, 100)
    shams = f"dr AS (SELECT fo.* EXCLUDE (i), t.draw, row_number() OVER (PARTITION BY symbol, t.draw ORDER BY md5(concat_ws('|', 'placebo', 42, t.draw, i)), i) - 1 AS i FROM fo, (SELECT unnest(range(50)) AS draw) t WHERE NOT half)"
    placebo = f"WITH {BARS}, {_LATER}, {shams}, {signal_cte('flagship', 'symbol, draw', 'dr')}, {curve_cte('sig', 'symbol, draw')}, {metrics_sql('cur', 'symbol, draw', 'symbol, draw', None)}"
    half = lambda side: f"coalesce({ROOT} * avg(ret) FILTER ({side}) / nullif(sqrt(CASE WHEN count(*) FILTER ({side}) > 1 THEN var_pop(ret) FILTER ({side}) ELSE 1e-12 END), 0), 0)"
    return f"""WITH s AS (SELECT symbol, max(sharpe) FILTER (NOT half) AS a, max(sharpe) FILTER (half) AS b, max(max_drawdown) FILTER (half) AS od FROM ({sides}) GROUP BY 1),
m AS (SELECT symbol, p05 AS mc FROM ({drawn}) WHERE metric = 'max_drawdown'), p AS (SELECT symbol, avg(sharpe) AS ps FROM ({placebo}) GROUP BY 1),
h AS (SELECT symbol, {half("i < n // 2")} AS f, {half("i >= n // 2")} AS g FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (WITH {curves} SELECT * FROM cur WHERE half)) GROUP BY 1)
SELECT symbol, round(a, 6) + 0e0 AS in_sharpe, round(b, 6) + 0e0 AS out_sharpe, round(od, 6) + 0e0 AS out_drawdown, round(mc, 6) + 0e0 AS mc_drawdown, round(ps, 6) + 0e0 AS placebo_sharpe, round(f, 6) + 0e0 AS first_sharpe, round(g, 6) + 0e0 AS second_sharpe,
 coalesce(a >= 1 AND b >= 5e-1 AND mc <= 3e-1 AND ps <= 5e-1 AND g >= f * 3e-1, false) AS passed FROM s LEFT JOIN m USING (symbol) LEFT JOIN p USING (symbol) LEFT JOIN h USING (symbol)"""


def _analysis() -> str:
    """The factor analysis of ROC 5, in rows."""
    parts = []
    long = lambda part, at, names: " UNION ALL ".join(f"SELECT symbol, '{part}' AS part, {at} AS at, '{n}' AS metric, round(CAST({n} AS DOUBLE), 6) + 0e0 AS value FROM f" for n in names)
    for h in (1, 5, 10):
        pairs = _PAIRS.replace("lead(close, 1)", f"lead(close, {h})")
        ic = f"""SELECT symbol, chunks, m AS mean_ic, sd AS std_ic, coalesce(m / nullif(sd, 0), 0) * sqrt(chunks) AS t_stat, coalesce(m / nullif(sd, 0), 0) * {ROOT} AS ir, pos AS positive_rate FROM g"""
        parts.append(f"WITH {pairs}, {_CHUNKS}, f AS ({ic}) {long('rank_ic', h, ('chunks', 'mean_ic', 'std_ic', 't_stat', 'ir', 'positive_rate'))}")
        parts.append(f"WITH {pairs}, {_BINS}, f AS ({_SPREAD}) {long('quantile_spread', h, ('spread', 'monotonicity'))}")
    parts.append(f"WITH {BARS}, {_SIG}, {_LAGGED} SELECT symbol, 'autocorrelation' AS part, CAST(lag AS INTEGER) AS at, 'autocorrelation' AS metric, round(ic, 6) + 0e0 AS value FROM {_ic('m', 'symbol, lag', 'was', 'signal')}")
    parts.append(f"WITH {BARS}, {_SIG} SELECT DISTINCT symbol, 'autocorrelation', 0, 'autocorrelation', 1e0 FROM s WHERE signal IS NOT NULL")
    return " UNION ALL ".join(f"({p})" for p in parts)


_CHUNKS = f"""u AS (SELECT *, unnest(CASE WHEN n < 20 THEN [0] ELSE list_filter(range(0, CAST((n - 20) // 10 + 1 AS BIGINT)), lambda q: q * 10 <= j AND j < q * 10 + 20) END) AS ch FROM c),
g AS (SELECT symbol, count(*) AS chunks, avg(ic) AS m, coalesce(stddev_samp(ic), 0e0) AS sd, avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END) AS pos FROM {_ic('u', 'symbol, ch', 'signal', 'fwd')} GROUP BY symbol)"""
_BINS = "z AS (SELECT *, least((row_number() OVER (PARTITION BY symbol ORDER BY signal, i) - 1) // (n // 5), 4) AS q FROM c WHERE n >= 10), a AS (SELECT symbol, q, avg(fwd) AS m FROM z GROUP BY ALL)"
_SPREAD = f"SELECT symbol, spread, ic AS monotonicity FROM (SELECT symbol, arg_max(m, q) - arg_min(m, q) AS spread FROM a GROUP BY 1) JOIN {_ic('a', 'symbol', 'q', 'm')} USING (symbol)"
_LAGGED = "c AS (SELECT symbol, i, signal FROM s WHERE signal IS NOT NULL), l AS (" + " UNION ALL ".join(f"SELECT symbol, {k} AS lag, signal, lag(signal, {k}) OVER {_O} AS was FROM c" for k in range(1, 6)) + "), m AS (SELECT * FROM l WHERE was IS NOT NULL)"

ORACLE = {
    "combinatorial_validation": _part_sql(_SPLITS, "symbol, split", "symbol, CAST(split AS INTEGER) AS split"),
    "gauntlet": "WITH f AS (" + _part_sql(_LATER, "symbol, half", "symbol, half") + "), p AS (SELECT symbol, max(sharpe) FILTER (NOT half) AS in_sharpe, max(sharpe) FILTER (half) AS out_sharpe, max(max_drawdown) FILTER (half) AS out_drawdown FROM f GROUP BY 1) SELECT *, in_sharpe >= 1 AND out_sharpe >= 5e-1 AS passed FROM p",
    "full_gauntlet": _all_gates(),
    "factor_horizons": " UNION ALL ".join(_HORIZON.format(bars=BARS.strip(), sig=_SIG, h=h, o=_O, ic=_ic("u", "symbol, ch", "signal", "fwd")) for h in (1, 5, 10)),
    "optimized_weights": f"""WITH {_FIN}, v AS (SELECT run_id, generation, ingest_id, test_sharpe / greatest(coalesce(max_drawdown, 1), 1e-12) AS v FROM f)
SELECT run_id, generation, ingest_id, round(CASE WHEN v > 0 THEN least(1e-1, v / (sum(v) FILTER (v > 0) OVER p) * 5e-1) WHEN v < 0 THEN greatest(-1e-1, v / (sum(-v) FILTER (v < 0) OVER p) * 5e-1) ELSE 0 END, 8) + 0e0 AS weight FROM v WINDOW p AS (PARTITION BY run_id, generation)""",
    "order_execution": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice) / 128 AS m FROM orders),
x AS (SELECT k, c % 2 = 0 AS buy, c % 3 AS kind, CAST(k % 7 - 1 AS DOUBLE) AS q, CASE WHEN k % 5 <> 0 THEN m * (1 + (k % 3 - 1) / 64e0) END AS lim, CASE WHEN k % 4 <> 0 THEN m END AS stop, m, CAST(c % 5 AS DOUBLE) AS liq FROM o),
y AS (SELECT *, concat_ws(',', CASE WHEN q <= 0 THEN 'invalid_quantity' END, CASE WHEN q < 2 THEN 'below_minimum_order_size' END, CASE WHEN kind = 1 AND lim IS NULL THEN 'limit_price_required' END, CASE WHEN kind = 2 AND stop IS NULL THEN 'stop_price_required' END, CASE WHEN m <= 0 THEN 'invalid_market_price' END) AS reasons, least(abs(q), liq) AS fill FROM x),
z AS (SELECT *, CASE WHEN reasons <> '' THEN 'rejected' WHEN kind = 1 AND CASE WHEN buy THEN m > lim + 1e-9 ELSE m < lim - 1e-9 END THEN 'pending' WHEN fill = abs(q) THEN 'filled' ELSE 'partial' END AS status FROM y)
SELECT k AS order_id, status, CASE WHEN status IN ('filled', 'partial') THEN fill ELSE 0 END AS filled_quantity, CASE WHEN status IN ('filled', 'partial') THEN round_even(CASE WHEN kind = 1 THEN lim ELSE m END * 4, 0) / 4 END AS fill_price, reasons FROM z""",
    "mark_to_market": """WITH p AS (SELECT symbol, sum(CASE WHEN side = 'sell' THEN -quantity ELSE quantity END) AS q FROM fills WHERE symbol IS NOT NULL GROUP BY 1),
l AS (SELECT symbol, close_px AS px FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, row_id DESC) AS r FROM feed WHERE symbol IS NOT NULL AND ts IS NOT NULL AND close_px IS NOT NULL AND NOT isnan(close_px)) WHERE r = 1)
SELECT round(1e6 + sum(q * px), 3) + 0e0 AS equity FROM p JOIN l USING (symbol)""",
    "risk_limits": """WITH r AS (SELECT c_custkey, c_acctbal AS e, CAST(1 + c_custkey % 90 AS DOUBLE) AS p, CAST(c_custkey % 401 - 200 AS DOUBLE) AS w, CAST(500 + c_custkey % 7000 AS DOUBLE) AS m FROM customer)
SELECT c_custkey, round(CASE WHEN e <= 0 THEN 0 ELSE greatest(-least(e / p, 1e9), least(least(e / p, 1e9), w)) END, 6) + 0e0 AS units, e <= 0 OR e / m < 5e-1 AS liquidated FROM r""",
    "forward_returns": f"WITH {BARS}, {_SIG} SELECT symbol, i AS bar_idx, round(signal, 6) + 0e0 AS signal, round(lead(close, 5) OVER {_O} / close - 1, 6) + 0e0 AS fwd FROM s",
    "rank_ic": f"""WITH {_PAIRS}, u AS (SELECT *, unnest(CASE WHEN n < 20 THEN [0] ELSE list_filter(range(0, CAST((n - 20) // 10 + 1 AS BIGINT)), lambda q: q * 10 <= j AND j < q * 10 + 20) END) AS ch FROM c),
g AS (SELECT symbol, count(*) AS chunks, avg(ic) AS m, coalesce(stddev_samp(ic), 0e0) AS sd, avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END) AS pos FROM {_ic('u', 'symbol, ch', 'signal', 'fwd')} GROUP BY symbol)
SELECT symbol, chunks, round(m, 6) + 0e0 AS mean_ic, round(sd, 6) + 0e0 AS std_ic, round(coalesce(m / nullif(sd, 0), 0) * sqrt(chunks), 6) + 0e0 AS t_stat, round(coalesce(m / nullif(sd, 0), 0) * {ROOT}, 6) + 0e0 AS ir, round(pos, 6) + 0e0 AS positive_rate FROM g""",
    "quantile_spread": f"""WITH {_PAIRS}, z AS (SELECT *, least((row_number() OVER (PARTITION BY symbol ORDER BY signal, i) - 1) // (n // 5), 4) AS q FROM c WHERE n >= 10), a AS (SELECT symbol, q, avg(fwd) AS m FROM z GROUP BY ALL)
SELECT symbol, round(spread, 8) + 0e0 AS spread, round(ic, 8) + 0e0 AS monotonicity FROM (SELECT symbol, arg_max(m, q) - arg_min(m, q) AS spread FROM a GROUP BY 1) JOIN {_ic('a', 'symbol', 'q', 'm')} USING (symbol)""",
    "rank_autocorrelation": f"""WITH {BARS}, {_SIG}, c AS (SELECT symbol, i, signal FROM s WHERE signal IS NOT NULL), l AS (""" + " UNION ALL ".join(f"SELECT symbol, {k} AS lag, signal, lag(signal, {k}) OVER {_O} AS was FROM c" for k in range(1, 6)) + f"), m AS (SELECT * FROM l WHERE was IS NOT NULL) SELECT symbol, lag, round(ic, 6) + 0e0 AS autocorrelation FROM {_ic('m', 'symbol, lag', 'was', 'signal')}",
    "neutralized": f"""WITH {_MKT}, y AS (SELECT *, CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN ret END AS u, CASE WHEN ret IS NOT NULL THEN market END AS v FROM x),
e AS (SELECT symbol, i, CASE WHEN u IS NULL THEN NULL ELSE u - avg(u) OVER p - covar_samp(u, v) OVER p / var_samp(v) OVER p * (v - avg(v) OVER p) END AS e FROM y WINDOW p AS (PARTITION BY symbol))
SELECT symbol, i AS bar_idx, round((e - avg(e) OVER p) / stddev_samp(e) OVER p, 6) + 0e0 AS neutral FROM e WINDOW p AS (PARTITION BY symbol)""",
    "orthogonalized": f"""WITH {_MKT}, y AS (SELECT * FROM x WHERE ret IS NOT NULL AND mom IS NOT NULL AND dev IS NOT NULL), a AS (SELECT *, mom - sum(mom * ret) OVER p / sum(ret * ret) OVER p * ret AS m1, dev - sum(dev * ret) OVER p / sum(ret * ret) OVER p * ret AS d1 FROM y WINDOW p AS (PARTITION BY symbol)),
c AS (SELECT *, d1 - sum(d1 * m1) OVER p / sum(m1 * m1) OVER p * m1 AS d2 FROM a WINDOW p AS (PARTITION BY symbol))
SELECT symbol, i AS bar_idx, """ + ", ".join(f"round(({x} - avg({x}) OVER p) / stddev_samp({x}) OVER p, 6) + 0e0 AS orth_{n}" for x, n in (("ret", "ret"), ("m1", "mom"), ("d2", "dev"))) + " FROM c WINDOW p AS (PARTITION BY symbol)",
    "correlation_matrix": f"WITH {_STRAT}, {_CORR} SELECT a, b, n, round(cov * 1e4, 6) + 0e0 AS cov, round(greatest(-1e0, least(1e0, cr)), 6) + 0e0 AS corr FROM cc",
    "novelty": f"WITH {_STRAT}, {_CORR} SELECT series, round(1 - max(abs(cr)), 6) + 0e0 AS novelty FROM (SELECT a AS series, cr FROM cc WHERE a <> b UNION ALL SELECT b, cr FROM cc WHERE a <> b) GROUP BY 1",
    "monte_carlo": monte_carlo_sql(_STRAT, "strategy", 42, 100),
    "bootstrap_interval": f"WITH {_boot(7, 1000)}, l AS (SELECT strategy, list_sort(list(mean)) AS l FROM bm GROUP BY 1) SELECT strategy, round(mean, 9) + 0e0 AS mean, round(l[26], 9) + 0e0 AS lower, round(l[975], 9) + 0e0 AS upper FROM l JOIN (SELECT strategy, avg(ret) AS mean FROM r GROUP BY 1) USING (strategy)",
    "reality_check": f"WITH {_boot(11, 500)}, t AS (SELECT sim, max(mean) AS top FROM bm GROUP BY 1), b2 AS (SELECT max(m) AS best FROM (SELECT avg(ret) AS m FROM r GROUP BY strategy)) SELECT round(any_value(best), 9) + 0e0 AS best_mean, round(avg(CASE WHEN top >= best THEN 1e0 ELSE 0e0 END), 9) + 0e0 AS p_value FROM t, b2",
    "deflated_sharpe": f"WITH {_FIN} SELECT run_id, generation, ingest_id, round(test_sharpe, 6) + 0e0 AS test_sharpe, round(test_sharpe - (avg(test_sharpe) OVER p + sqrt(coalesce(var_samp(test_sharpe) OVER p, 0) * 2 * ln(count(*) OVER p))), 6) + 0e0 AS deflated FROM f WINDOW p AS (PARTITION BY run_id, generation)",
    "overfit_proxy": f"WITH {_FIN} SELECT run_id, generation, count(*) AS n, round(avg(CASE WHEN test_sharpe <= 0 THEN 1e0 ELSE 0e0 END), 8) + 0e0 AS share_not_positive, round(max(test_sharpe), 8) + 0e0 AS best, round(median(test_sharpe), 8) + 0e0 AS median FROM f GROUP BY ALL",
    "adjusted_p": f"WITH {_FIN}, q AS (SELECT run_id, ingest_id, 1 / (1 + exp(test_sharpe)) AS p FROM f) SELECT run_id, ingest_id, round(p, 8) + 0e0 AS p, round(least(1e0, p * count(*) OVER (PARTITION BY run_id) / row_number() OVER (PARTITION BY run_id ORDER BY p, ingest_id)), 8) + 0e0 AS bh, round(least(1e0, p * count(*) OVER (PARTITION BY run_id)), 8) + 0e0 AS bonferroni FROM q",
    "regime_labels": f"WITH {BARS}, r AS (SELECT symbol, i, coalesce(close / lag(close) OVER {_O} - 1, 0e0) AS r FROM b), v AS (SELECT symbol, i, avg(r) OVER w AS m, stddev_pop(r) OVER w AS s FROM r WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, i AS bar_idx, CASE WHEN s > 2 * abs(m) THEN 'high_vol' WHEN m > 0 THEN 'uptrend' ELSE 'downtrend' END AS regime FROM v",
    "best_per_strategy": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY CASE WHEN isfinite(robustness_score) THEN robustness_score END DESC NULLS LAST, CASE WHEN isfinite(test_sharpe) THEN test_sharpe END DESC NULLS LAST, ingest_id DESC) AS k FROM strategies)
SELECT strategy_id, ingest_id, test_sharpe, robustness_score, complexity FROM r WHERE k = 1""",
    "top_strategies": "SELECT ingest_id, strategy_id, test_sharpe FROM strategies WHERE isfinite(test_sharpe) ORDER BY test_sharpe DESC, ingest_id LIMIT 20",
    "population": "WITH s AS (SELECT *, CASE WHEN isfinite(test_sharpe) THEN test_sharpe END AS t FROM strategies) SELECT run_id, count(*) AS candidates, count(DISTINCT strategy_id) AS strategies, count(DISTINCT generation) AS generations, round(avg(t), 6) + 0e0 AS mean_sharpe, count(*) FILTER (t > 0) AS positive, round(count(DISTINCT strategy_id) / count(*), 6) + 0e0 AS diversity FROM s GROUP BY run_id",
    "root_usage": r"""WITH t AS (SELECT run_id, trim(expression) AS e FROM strategies WHERE expression IS NOT NULL)
SELECT run_id, CASE WHEN e[1] = '(' THEN coalesce(nullif(regexp_extract(e, '^\((?:[A-Za-z0-9_]+(?:\([^()]*\))?|\(.*\)) ([-+*/]) ', 1), ''), '') ELSE split_part(e, '(', 1) END AS root, count(*) AS candidates FROM t GROUP BY ALL""",
    "pareto_front": f"WITH {_CAND}, {_front('k', 'p')} SELECT run_id, ingest_id FROM p",
    "pareto_layers": f"WITH {_CAND}, {_front('k', 'p')}, k2 AS (SELECT * FROM k ANTI JOIN p USING (run_id, ingest_id)), {_front('k2', 'p2')}, k3 AS (SELECT * FROM k2 ANTI JOIN p2 USING (run_id, ingest_id)), {_front('k3', 'p3')} SELECT run_id, ingest_id, 1 AS front FROM p UNION ALL SELECT run_id, ingest_id, 2 FROM p2 UNION ALL SELECT run_id, ingest_id, 3 FROM p3",
    "survivors": _survivors(10),
    "robustness_scores": _ROBUSTNESS,
    # a member's front is one more than the longest chain of members that dominate one another ahead of it
    "pareto_fronts": f"""WITH RECURSIVE {_CAND}, u AS (SELECT DISTINCT run_id, s, d, c FROM k), r AS (SELECT run_id, s, d, c, 1 AS f FROM u
 UNION SELECT b.run_id, b.s, b.d, b.c, r.f + 1 FROM r JOIN u b ON b.run_id = r.run_id AND r.s >= b.s AND r.d <= b.d AND r.c <= b.c AND (r.s > b.s OR r.d < b.d OR r.c < b.c))
SELECT k.run_id, k.ingest_id, CAST(m.f AS INTEGER) AS front FROM k JOIN (SELECT run_id, s, d, c, max(f) AS f FROM r GROUP BY ALL) m ON m.run_id = k.run_id AND m.s = k.s AND m.d = k.d AND m.c = k.c""",
    "cpcv_bars": _CPCV_BARS,
    "crowding_distance": f"WITH {_CAND}, {_front('k', 'p')} SELECT run_id, ingest_id, round({_gap('s')} + {_gap('d')} + {_gap('c')}, 6) + 0e0 AS crowding FROM p",
    "ancestors": "WITH RECURSIVE up(id) AS (SELECT CAST(127 AS BIGINT) UNION SELECT c.c_custkey // 3 FROM up JOIN customer c ON c.c_custkey = up.id) SELECT id FROM up WHERE id IN (SELECT c_custkey FROM customer)",
    "inverse_variance_weights": f"WITH {_STRAT}, v AS (SELECT strategy, var_samp(ret) AS v FROM r GROUP BY 1) SELECT 'inverse_variance' AS method, strategy, round(1 / v / (SELECT sum(1 / v) FROM v), 6) + 0e0 AS weight FROM v UNION ALL SELECT 'equal', strategy, round(1e0 / (SELECT count(*) FROM v), 6) FROM v",
    "cpcv": """WITH g AS (SELECT unnest(range(4)) AS g), p AS (SELECT a.g AS x, b.g AS y, row_number() OVER (ORDER BY a.g, b.g) - 1 AS split FROM g a, g b WHERE a.g < b.g), r AS (SELECT unnest(range(40)) AS row),
q AS (SELECT split, row, row // 10 IN (x, y) AS test, (row BETWEEN x * 10 - 2 AND x * 10 + 10) OR (row BETWEEN y * 10 - 2 AND y * 10 + 10) AS near FROM p, r)
SELECT CAST(split AS INTEGER) AS split, CAST(row AS INTEGER) AS row, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM q WHERE test OR NOT near""",
    "synthetic_book": f"WITH {BARS}, {_BOOK} SELECT symbol, i AS bar_idx, CAST(level AS INTEGER) AS level, round(bid, 6) + 0e0 AS bid, round(q, 6) + 0e0 AS bid_quantity, round(ask, 6) + 0e0 AS ask FROM bk",
    "market_fills": f"""WITH {BARS}, {_BOOK}, t AS (SELECT *, greatest(0e0, least(q, want - before)) AS take FROM o), g AS (SELECT symbol, i, buy, want, sum(take) AS f, sum(take * px) AS nt, sum(q) AS av FROM t GROUP BY ALL),
h AS (SELECT *, coalesce(nt / nullif(f, 0), 0) * (1 + CASE WHEN buy THEN 1 ELSE -1 END * CASE WHEN f < want THEN (1 + 5 * sqrt(f / av) + 2 * f / av) / 1e4 ELSE 0 END) AS p FROM g)
SELECT concat(symbol, '-', i) AS order_id, round(f, 6) + 0e0 AS filled, round(p, 6) + 0e0 AS average_price, round(p * f * 2e0 / 1e4, 6) + 0e0 AS fees, CASE WHEN f <= 0 THEN 'unfilled' WHEN f >= want THEN 'filled' ELSE 'partial' END AS status FROM h""",
    "limit_fills": f"""WITH {BARS}, {_BOOK}, a AS (SELECT *, bool_and(CASE WHEN buy THEN px <= lim ELSE px >= lim END) OVER (PARTITION BY symbol, i ORDER BY level) AS ok, sum(q) OVER (PARTITION BY symbol, i) * 4e-1 AS cap FROM o),
f AS (SELECT *, CASE WHEN ok THEN greatest(0e0, q - greatest(0e0, volume * 5e-2 - before)) ELSE 0e0 END AS free FROM a), u AS (SELECT *, coalesce(sum(free) OVER (PARTITION BY symbol, i ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS used FROM f),
g AS (SELECT symbol, i, want, sum(greatest(0e0, least(free, least(want, cap) - used))) AS fl, sum(greatest(0e0, least(free, least(want, cap) - used)) * px) AS nt FROM u GROUP BY ALL)
SELECT concat(symbol, '-', i) AS order_id, round(fl, 6) + 0e0 AS filled, round(coalesce(nt / nullif(fl, 0), 0), 6) + 0e0 AS average_price, CASE WHEN fl >= want THEN 'filled' WHEN fl > 0 THEN 'partial' ELSE 'unfilled' END AS status FROM g""",
    "venue_replay": """WITH o AS (SELECT o_orderkey AS order_id, floor(o_totalprice / 1000) / 4 AS price, CAST(1 + o_custkey % 50 AS DOUBLE) AS want, o_orderstatus = 'O' AS maker FROM orders),
p AS (SELECT floor(l_extendedprice / 1000) / 4 AS price, sum(l_quantity) AS v FROM lineitem GROUP BY 1), j AS (SELECT o.*, least(want, coalesce(v, 0)) AS f FROM o LEFT JOIN p USING (price)),
s AS (SELECT *, CASE WHEN want * price <= 0 THEN 'zero_notional' WHEN want * price > 1500 THEN 'max_order_notional' WHEN f <= 0 THEN 'insufficient_liquidity' WHEN f = want THEN 'filled' ELSE 'partial' END AS status FROM j)
SELECT order_id, CASE WHEN status IN ('filled', 'partial') THEN f ELSE 0 END AS quantity, price, round(CASE WHEN status IN ('filled', 'partial') THEN f * price * CASE WHEN maker THEN 1 ELSE 2 END / 1e4 ELSE 0 END, 6) + 0e0 AS fee, status FROM s""",
    "stress_test": _stress("crossover"),
    "microstructure_gauntlet": " UNION ALL ".join(f"SELECT *, '{k}' AS genome FROM ({_stress(k)})" for k in ("flagship", "crossover")),
    "factor_analysis": _analysis(),
}
