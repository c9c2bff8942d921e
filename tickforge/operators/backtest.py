"""Backtests as window plans: single series, cross-sectional, centrally cleared; metrics, costs and scenarios."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.compiler import evaluate
from tickforge.functions.expr import Node, shifted
from tickforge.operators.research import monte_carlo
from tickforge.operators.shards import TARGET_ROWS, assign_shards, carry, with_halo
from tickforge.session import broadcast_if_small, materialize

METRICS = ("sharpe", "sortino", "total_return", "max_drawdown", "turnover", "trades", "costs_paid")


@dataclass(frozen=True)
class Execution:
    """Costs in basis points of traded or held notional, and the delay of signals in bars."""

    commission_bps: float = 2.0
    spread_bps: float = 1.0
    slippage_bps: float = 2.0
    impact_bps: float = 0.0
    delay_bars: int = 1
    funding_bps: float = 0.0
    borrow_bps: float = 0.0

    def fixed(self) -> float:
        return (max(0.0, self.commission_bps) + self.spread_bps / 2 + max(0.0, self.slippage_bps)) / 1e4

    def cost(self, turnover: Column) -> Column:
        return (self.fixed() + self.impact_bps / 1e4) * F.abs(turnover)

    def carry(self, position: Column) -> Column:
        return (self.funding_bps + F.when(position < 0, self.borrow_bps).otherwise(0.0)) / 1e4 * F.abs(position)

    def scaled(self, m: float) -> Execution:
        return replace(self, commission_bps=self.commission_bps * m, spread_bps=self.spread_bps * m, slippage_bps=self.slippage_bps * m, impact_bps=self.impact_bps * m)


def discretized(signal: Column, threshold: float = 0.0) -> Column:
    """1 above the threshold, 0 at it or where the signal is missing, -1 below."""
    return F.when(signal.isNull() | F.isnan(signal), 0).when(signal > threshold, 1).when(F.abs(signal - threshold) < 1e-12, 0).otherwise(-1)


def with_equity(df: DataFrame, keys: list[str], order: str = "bar_idx") -> DataFrame:
    """df with equity, the running product of 1 + ret; over shards (a column _shard) with the product of those ahead carried in."""
    shards = ["_shard"] if "_shard" in df.columns else []
    df = df.withColumn("equity", F.product(1 + F.col("ret")).over(Window.partitionBy(*keys, *shards).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    if shards:
        ahead = carry(df, keys, {"_ahead": F.product(1 + F.col("ret"))}, F.product)
        df = df.join(broadcast_if_small(ahead, 10_000), [*keys, "_shard"], "left").withColumn("equity", F.col("equity") * F.coalesce("_ahead", F.lit(1.0))).drop("_ahead")
    return df


def curve(signals: DataFrame, keys: list[str], execution: Execution | None = None, threshold: float = 0.0, order: str = "bar_idx", target_rows: int = TARGET_ROWS) -> DataFrame:
    """signals (keys, order, close, signal) with raw, position, turn, ret, cost and equity per bar.

    The position follows the signal by the delay and earns from the bar after; costs fall on its change, carry on its size.
    Series longer than target_rows are cut into time shards, which then stay in the column _shard.
    """
    ex = execution or Execution()
    delay = max(1, ex.delay_bars)
    df, split = assign_shards(signals, keys, order, target_rows)
    df = with_halo(df, keys, [order], delay + 1, 0) if split else df.drop("_shard")
    w = Window.partitionBy(*keys, *["_shard"] * split).orderBy(order)
    df = df.withColumn("raw", discretized(F.col("signal"), threshold))
    df = df.withColumns({"position": F.coalesce(F.lag("raw", delay).over(w), F.lit(0)), "_move": F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))})
    df = df.withColumns({"_held": F.coalesce(F.lag("position").over(w), F.lit(0)), "_first": F.lag("close").over(w).isNull()})
    df = df.withColumn("turn", F.when(F.col("_first"), 0).otherwise(F.abs(F.col("position") - F.col("_held"))))
    df = df.withColumn("cost", F.when(F.col("_first"), 0.0).otherwise(ex.cost(F.col("turn")) + ex.carry(F.col("position"))))
    df = df.withColumn("ret", F.when(F.col("_first"), 0.0).otherwise(F.col("_held") * F.col("_move") - F.col("cost")))
    df = df.filter("not _halo").drop("_halo") if split else df
    return with_equity(df.drop("_move", "_held", "_first"), keys, order)


def metrics(curves: DataFrame, keys: list[str], order: str = "bar_idx") -> DataFrame:
    """One row per key: sharpe, sortino (infinite without a losing bar), total_return, max_drawdown, turnover, trades, costs_paid."""
    shards = ["_shard"] if "_shard" in curves.columns else []
    w = Window.partitionBy(*keys, *shards).orderBy(order)
    df = curves.withColumn("_peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.lag("equity").over(w).isNotNull()
    if shards:
        ahead = carry(curves, keys, {"_top": F.max("equity")}, F.max)
        df = df.join(broadcast_if_small(ahead, 10_000), [*keys, "_shard"], "left").withColumn("_peak", F.greatest("_peak", "_top"))
        later = later | F.col("_top").isNotNull()
    df = df.withColumn("_r", F.when(later, F.col("ret")))
    down = F.when(F.col("_r") < 0, F.col("_r"))
    out = df.groupBy(*keys).agg(
        F.count("_r").alias("_n"), F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std"), F.sum(down * down).alias("_dd"), F.count(down).alias("_nd"),
        F.count(F.lit(1)).alias("_bars"), F.max_by("equity", order).alias("_end"), F.min_by("equity", order).alias("_start"), F.min(F.col("equity") / F.col("_peak") - 1).alias("_low"),
        F.count_if(F.col("turn") > 0).alias("trades"), F.sum("cost").alias("costs_paid"),
    )
    root = math.sqrt(252)
    flat = (F.col("_n") < 2) | F.col("_std").isNull() | (F.col("_std") == 0)
    return out.select(
        *keys, F.when(flat, 0.0).otherwise(root * F.try_divide(F.col("_mean"), F.col("_std"))).alias("sharpe"),
        F.when(F.col("_nd") == 0, float("inf")).otherwise(root * F.try_divide(F.col("_mean"), F.sqrt(F.try_divide(F.col("_dd"), F.col("_nd"))))).alias("sortino"),
        (F.try_divide(F.col("_end"), F.col("_start")) - 1).alias("total_return"), F.abs("_low").alias("max_drawdown"),
        (F.col("trades") / F.greatest(F.lit(1), F.col("_bars") - 1)).alias("turnover"), "trades", "costs_paid",
    )


def backtest(bars: DataFrame, genome: Node, execution: Execution | None = None, threshold: float = 0.0, keys: tuple[str, ...] = ("symbol",), target_rows: int = TARGET_ROWS) -> DataFrame:
    """The curve of one expression over each series of bars; the expression sees close, high, low and volume."""
    signals = evaluate(bars, {"signal": genome}, keys, price_only=True, target_rows=target_rows).select(*keys, "bar_idx", "close", "signal")
    return curve(signals, list(keys), execution, threshold, target_rows=target_rows)


def cross_sectional(bars: DataFrame, genome: Node, execution: Execution | None = None, max_gross: float = 1.0, max_position: float = 0.2, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(bar_idx, gross, cost, trades, ret, equity): demeaned scores of all symbols as capped long and short weights.

    Symbols are aligned by bar number up to the shortest series. Weights follow scores by the delay, earn from the bar after;
    carry is charged on a unit position per symbol.
    """
    ex = execution or Execution()
    delay = max(1, ex.delay_bars)
    df = evaluate(bars, {"signal": genome}, price_only=True).select("symbol", "bar_idx", "close", "signal")
    shortest = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    w, bar = Window.partitionBy("symbol").orderBy("bar_idx"), Window.partitionBy("bar_idx")
    df = df.filter(F.col("bar_idx") < shortest).withColumns({"_score": F.coalesce(F.lag("signal", delay).over(w), F.lit(0.0)), "_move": F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))})
    df = df.withColumn("_d", F.col("_score") - F.avg("_score").over(bar))
    long, short = F.sum(F.greatest("_d", F.lit(0.0))).over(bar), F.sum(F.abs(F.least("_d", F.lit(0.0)))).over(bar)
    half = 0.5 * max_gross
    weight = F.when(F.col("_d") > 0, F.least(F.lit(max_position), F.try_divide(F.col("_d"), long) * half)).when(F.col("_d") < 0, F.greatest(F.lit(-max_position), F.try_divide(F.col("_d"), short) * half)).otherwise(0.0)
    df = df.withColumn("_w", F.when(F.col("bar_idx") >= delay, weight).otherwise(0.0)).withColumn("_was", F.coalesce(F.lag("_w").over(w), F.lit(0.0)))
    turn = F.abs(F.col("_w") - F.col("_was"))
    cost = ex.cost(turn) + ex.carry(F.signum("_w"))
    out = df.groupBy("bar_idx").agg(F.sum(F.col("_was") * F.col("_move")).alias("gross"), F.sum(cost).alias("cost"), F.count_if(turn > 1e-6).alias("trades"))
    live = F.col("bar_idx") > 0
    out = out.select("bar_idx", F.when(live, F.col("gross")).otherwise(0.0).alias("gross"), F.when(live, F.col("cost")).otherwise(0.0).alias("cost"), F.when(live, F.col("trades")).otherwise(0).alias("trades"))
    out = out.withColumns({"ret": F.col("gross") - F.col("cost"), "_all": F.lit(0)})
    out, split = assign_shards(out, ["_all"], "bar_idx", target_rows)  # one row per bar of the shortest series, which may be long
    return with_equity(out if split else out.drop("_shard"), ["_all"]).select("bar_idx", "gross", "cost", "trades", "ret", "equity")


def cleared(bars: DataFrame, strategies: list[Node], execution: Execution | None = None, threshold: float = 0.0, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(symbol, strategy, bar_idx, position, order, cost, ret, equity): strategies whose orders are netted bar by bar.

    The net order's cost is shared per unit of signed order, so that an opposite order earns a rebate; carry is each one's own. Series longer
    than target_rows are cut into time shards.
    """
    ex = execution or Execution()
    delay, names = max(1, ex.delay_bars), [f"strat_{i}" for i in range(len(strategies))]
    sig = evaluate(bars, dict(zip(names, strategies, strict=True)), price_only=True, target_rows=target_rows).select("symbol", "bar_idx", "close", *names)
    sig, split = assign_shards(sig, ["symbol"], "bar_idx", target_rows)
    sig = with_halo(sig, ["symbol"], ["bar_idx"], delay + 1, 0, split)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("signal")) for n in names])).alias("_s")
    long = sig.select("symbol", "_shard", "_halo", "bar_idx", "close", each).select("symbol", "_shard", "_halo", "bar_idx", "close", "_s.*")
    w = Window.partitionBy("symbol", "strategy", "_shard").orderBy("bar_idx")
    long = long.withColumn("position", F.coalesce(F.lag(discretized(F.col("signal"), threshold), delay).over(w), F.lit(0)))
    long = long.withColumns({"_held": F.coalesce(F.lag("position").over(w), F.lit(0)), "_move": F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))})
    long = long.filter("not _halo").withColumn("order", F.when(F.col("bar_idx") > 0, F.col("position") - F.col("_held")).otherwise(0))
    long = long.withColumn("_net", F.sum("order").over(Window.partitionBy("symbol", "bar_idx")))
    unit = F.coalesce(F.try_divide(ex.cost(F.col("_net")), F.col("_net")), F.lit(0.0))
    long = long.withColumn("cost", F.when(F.col("bar_idx") > 0, F.col("order") * unit + ex.carry(F.col("position"))).otherwise(0.0))
    long = long.withColumn("ret", F.when(F.col("bar_idx") > 0, F.col("_held") * F.col("_move") - F.col("cost")).otherwise(0.0))
    long = with_equity(long if split else long.drop("_shard"), ["symbol", "strategy"])
    return long.select("symbol", "strategy", "bar_idx", "position", "order", "cost", "ret", "equity")


MULTIPLIERS = (0.5, 1.0, 1.5, 2.0, 3.0)


def with_costs(curves: DataFrame, keys: list[str], execution: Execution | None = None, multipliers: tuple[float, ...] = MULTIPLIERS) -> DataFrame:
    """Metrics per key and cost multiplier of curves that were run with execution: what its costs on turnover change by is taken off their returns."""
    ex = execution or Execution()
    per = curves.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    extra = (F.col("multiplier") - 1) * (ex.fixed() + ex.impact_bps / 1e4) * F.col("turn")
    per = per.withColumns({"cost": F.col("cost") + extra, "ret": F.col("ret") - extra})
    keys = [*keys, "multiplier"]
    return metrics(with_equity(per, keys), keys)


def cost_sensitivity(bars: DataFrame, genome: Node, execution: Execution | None = None, multipliers: tuple[float, ...] = MULTIPLIERS) -> DataFrame:
    """Metrics per symbol and cost multiplier; the curve is calculated once and meets the scenarios afterwards."""
    return with_costs(backtest(bars, genome, execution), ["symbol"], execution, multipliers)


def parameter_sensitivity(bars: DataFrame, genome: Node, execution: Execution | None = None, deltas: tuple[int, ...] = (-3, -2, -1, 0, 1, 2, 3)) -> DataFrame:
    """Metrics per symbol and shift of all periods; the variants are columns of one plan."""
    named = {f"_d{i}": shifted(genome, d) for i, d in enumerate(deltas)}
    base = evaluate(bars, named, price_only=True)
    grid = base.select("symbol", "bar_idx", "close", F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.col(f"_d{i}").alias("signal")) for i, d in enumerate(deltas)])).alias("_s"))
    return metrics(curve(grid.select("symbol", "bar_idx", "close", "_s.*"), ["symbol", "delta"], execution), ["symbol", "delta"])


def fold_bars(bars: DataFrame, kind: str, folds: int = 3, test: float = 0.2, initial: float = 0.5, purge: int = 1, embargo: int = 1) -> DataFrame:
    """bars once per fold whose test window they are in, with fold and its bounds; bar_idx restarts in each."""
    n = F.col("_n")
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))  # joined back, so that no series is gathered in one task
    df = bars.join(broadcast_if_small(counts), "symbol")
    if kind == "walk_forward":
        size, start = F.greatest(F.lit(1), F.floor(n * test)), F.greatest(F.lit(1), F.floor(n * initial))
        fold = F.floor((F.col("bar_idx") - start) / size)
        df = df.withColumns({"fold": fold, "test_start": start + fold * size, "test_end": F.least(n, start + (fold + 1) * size)}).filter((F.col("bar_idx") >= start) & (F.col("fold") < folds))
        df = df.withColumns({"train_start": F.lit(0).cast("long"), "train_end": F.col("test_start")})
    else:
        size = F.greatest(F.lit(1), F.floor(n / folds))
        fold = F.least(F.floor(F.col("bar_idx") / size), F.lit(folds - 1))
        df = df.withColumns({"fold": fold, "test_start": fold * size, "test_end": F.when(fold == folds - 1, n).otherwise(F.least(n, (fold + 1) * size))})
        df = df.withColumn("train_end", F.greatest(F.lit(0), F.col("test_start") - purge))
        df = df.withColumn("train_start", F.when(F.col("test_end") + embargo < n, F.col("test_end") + embargo).otherwise(F.col("train_end")))
    return df.withColumn("bar_idx", F.col("bar_idx") - F.col("test_start")).withColumn("fold", F.col("fold").cast("int")).drop("_n")


BOUNDS = ("train_start", "train_end", "test_start", "test_end")


def fold_metrics(bars: DataFrame, genome: Node, kind: str = "walk_forward", folds: int = 3, execution: Execution | None = None, test: float = 0.2, initial: float = 0.5,
                 purge: int = 1, embargo: int = 1, bounds: bool = False) -> DataFrame:
    """Metrics per symbol and fold of walk-forward windows ('walk_forward') or contiguous folds ('purged'); indicators restart in each.

    bounds: also where train and test begin and end. Walk-forward trains on all bars ahead of the test; a purged fold's train_end is ``purge``
    bars ahead of its test and its train_start ``embargo`` bars behind it, or, where that is beyond the series, the same as train_end.
    """
    cut = fold_bars(bars, kind, folds, test, initial, purge, embargo)
    out = metrics(backtest(cut.drop(*BOUNDS), genome, execution, keys=("symbol", "fold")), ["symbol", "fold"])
    if not bounds:
        return out
    at = cut.groupBy("symbol", "fold").agg(*[F.min(c).cast("long").alias(c) for c in BOUNDS])
    return at.join(out, ["symbol", "fold"])


def combinatorial_metrics(bars: DataFrame, genome: Node, groups: int = 4, held: int = 2, execution: Execution | None = None) -> DataFrame:
    """Metrics per symbol and split of combinatorial cross-validation: the test groups of a split are concatenated and backtested as one series."""
    splits = list(itertools.combinations(range(groups), held))
    counts = broadcast_if_small(bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / groups))
    df = bars.join(counts, "symbol").withColumn("_g", F.least(F.floor(F.col("bar_idx") / size), F.lit(groups - 1)).cast("int"))
    member = F.element_at(F.array(*[F.array(*[F.lit(i) for i, s in enumerate(splits) if g in s]) for g in range(groups)]), F.col("_g") + 1)
    df = df.withColumn("split", F.explode(member)).drop("_g", "_n")
    df = df.withColumn("bar_idx", F.row_number().over(Window.partitionBy("symbol", "split").orderBy("bar_idx")).cast("long") - 1)
    return metrics(backtest(df, genome, execution, keys=("symbol", "split")), ["symbol", "split"])


def cpcv_roles(bars: DataFrame, groups: int = 6, held: int = 2, purge: int = 5, embargo: int = 3) -> DataFrame:
    """(symbol, bar_idx, split, role) of combinatorial purged cross-validation over each series of bars, numbered from 0.

    A split holds out some of the contiguous groups as test; bars just before one of them are purged, those just after embargoed, and neither is a row.
    """
    n, i = F.col("_n"), F.col("bar_idx")
    size = F.floor(n / groups)
    bounds = [(size * g, size * (g + 1) if g < groups - 1 else n) for g in range(groups)]

    def role(chosen: tuple[int, ...]) -> Column:
        inside = [(i >= bounds[g][0]) & (i < bounds[g][1]) for g in chosen]
        near = [((i >= bounds[g][0] - purge) & (i < bounds[g][0])) | ((i >= bounds[g][1]) & (i < bounds[g][1] + embargo)) for g in chosen]
        return F.when(reduce(or_, inside), "test").when(~reduce(or_, near), "train")

    splits = itertools.combinations(range(groups), held)
    per = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), role(chosen).alias("role")) for s, chosen in enumerate(splits)])).alias("_s")
    # the count is an aggregate joined back, so a long series is not gathered in one task
    counted = bars.select("symbol", "bar_idx").join(broadcast_if_small(bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))), "symbol")
    return counted.select("symbol", "bar_idx", per).select("symbol", "bar_idx", "_s.*").filter("role is not null")


def robustness_suite(bars: DataFrame, genome: Node, execution: Execution | None = None, sims: int = 100, seed: int = 7) -> DataFrame:
    """(symbol, method, scenario, metric, value): cost_sensitivity by multiplier, parameter_sensitivity by delta, and monte_carlo by quantile."""
    def long(df: DataFrame, method: str, scenario: Column, values: tuple[str, ...]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("_m")
        return df.select("symbol", F.lit(method).alias("method"), scenario.cast("string").alias("scenario"), each).select("symbol", "method", "scenario", "_m.*")

    drawn = monte_carlo(backtest(bars, genome, execution).filter("bar_idx > 0"), ["symbol"], sims, seed)
    quantiles = F.explode(F.array(*[F.struct(F.lit(q).alias("scenario"), F.col(q).alias("value")) for q in ("p05", "p50", "p95")])).alias("_q")
    drawn = drawn.select("symbol", F.lit("monte_carlo").alias("method"), F.col("metric"), quantiles).select("symbol", "method", "_q.scenario", "metric", "_q.value")
    costs = long(cost_sensitivity(bars, genome, execution), "cost_sensitivity", F.col("multiplier"), METRICS)
    return costs.unionByName(long(parameter_sensitivity(bars, genome, execution), "parameter_sensitivity", F.col("delta"), METRICS)).unionByName(drawn)


def split_parts(bars: DataFrame, train: float) -> DataFrame:
    """bars with later, false for the first share train of each symbol and true after; bar_idx restarts in each."""
    counts = broadcast_if_small(bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")))
    df = bars.join(counts, "symbol").withColumn("_cut", F.greatest(F.lit(1), F.floor(F.col("_n") * train))).withColumn("later", F.col("bar_idx") >= F.col("_cut"))
    return df.withColumn("bar_idx", F.when(F.col("later"), F.col("bar_idx") - F.col("_cut")).otherwise(F.col("bar_idx"))).drop("_cut", "_n")


def _sides(m: DataFrame) -> DataFrame:
    return m.groupBy("symbol").agg(F.max(F.when(~F.col("later"), F.col("sharpe"))).alias("in_sharpe"), F.max(F.when(F.col("later"), F.col("sharpe"))).alias("out_sharpe"), F.max(F.when(F.col("later"), F.col("max_drawdown"))).alias("out_drawdown"))


def gauntlet(bars: DataFrame, genome: Node, execution: Execution | None = None, train: float = 0.7, in_sample: float = 1.0, out_of_sample: float = 0.5) -> DataFrame:
    """(symbol, in_sharpe, out_sharpe, out_drawdown, passed): the two Sharpe gates on both parts of a chronological split, indicators restarting in each."""
    per = _sides(metrics(backtest(split_parts(bars, train), genome, execution, keys=("symbol", "later")), ["symbol", "later"]))
    return per.withColumn("passed", F.coalesce((F.col("in_sharpe") >= in_sample) & (F.col("out_sharpe") >= out_of_sample), F.lit(False)))


def full_gauntlet(
    bars: DataFrame, genome: Node, execution: Execution | None = None, train: float = 0.7, in_sample: float = 1.0, out_of_sample: float = 0.5,
    drawdown: float = 0.3, placebo: float = 0.5, persistence: float = 0.3, sims: int = 100, shuffles: int = 50, seed: int = 42,
) -> DataFrame:
    """gauntlet with all five gates: also mc_drawdown, placebo_sharpe, first_sharpe and second_sharpe; passed says that all hold.

    mc_drawdown is the 5th percentile of the drawdown over reshuffled in-sample returns, placebo_sharpe the mean over backtests of reshuffled
    in-sample bars, and the last two are of the halves of the out-of-sample returns. A gate without a value fails. Draws are hashes.
    """
    parts = split_parts(bars, train)
    curves = materialize(backtest(parts, genome, execution, keys=("symbol", "later")), "gauntlet")
    per = _sides(metrics(curves, ["symbol", "later"]))
    worst = monte_carlo(curves.filter("not later and bar_idx > 0"), ["symbol"], sims, seed).filter("metric = 'max_drawdown'").select("symbol", F.col("p05").alias("mc_drawdown"))
    draws = parts.filter("not later").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    place = F.row_number().over(Window.partitionBy("symbol", "draw").orderBy(F.md5(F.concat_ws("|", F.lit("placebo"), F.lit(seed), "draw", F.col("bar_idx").cast("string"))), "bar_idx"))
    draws = draws.withColumn("bar_idx", place.cast("long") - 1)
    sham = metrics(backtest(draws, genome, execution, keys=("symbol", "draw")), ["symbol", "draw"]).groupBy("symbol").agg(F.avg("sharpe").alias("placebo_sharpe"))
    half = F.floor(F.count(F.lit(1)).over(Window.partitionBy("symbol")) / 2)
    outside = curves.filter("later").withColumn("_second", F.col("bar_idx") >= half)

    def sharpe(side: Column) -> Column:
        r = F.when(side, F.col("ret"))
        spread = F.when(F.count(r) > 1, F.var_pop(r)).otherwise(1e-12)
        return F.coalesce(math.sqrt(252) * F.try_divide(F.avg(r), F.sqrt(spread)), F.lit(0.0))

    halves = outside.groupBy("symbol").agg(sharpe(~F.col("_second")).alias("first_sharpe"), sharpe(F.col("_second")).alias("second_sharpe"))
    out = per.join(worst, "symbol", "left").join(sham, "symbol", "left").join(halves, "symbol", "left")
    gates = (F.col("in_sharpe") >= in_sample) & (F.col("out_sharpe") >= out_of_sample) & (F.col("mc_drawdown") <= drawdown) & (F.col("placebo_sharpe") <= placebo)
    return out.withColumn("passed", F.coalesce(gates & (F.col("second_sharpe") >= F.col("first_sharpe") * persistence), F.lit(False)))
