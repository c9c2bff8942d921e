"""Expressions to Spark plans: shared window stages in the JVM, one Arrow pass for what is truly recursive.

Missing is NULL everywhere. One (primitive, period) of however many expressions is calculated once. All window stages
share the specification (keys, order), so that Spark sorts once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.expr import PLUGINS, RULES, Binary, Constant, Node, Primitive, Series, walk
from tickforge.functions.kernels import KERNELS
from tickforge.operators.shards import TARGET_ROWS, assign_shards, carry, with_halo
from tickforge.session import broadcast_if_small

TINY = 1e-12
YEAR = math.sqrt(252)
#: Rows after which the weight of an exponential average's start is below 1e-16, per unit of its period.
EMA_MEMORY = 18.5
CUMULATIVE = {"OBV", "AD_LINE", "CUM_RETURN"}
RECURSIVE = {"EMA", "MACD", "PPO", "DEMA", "TEMA", "TRIX", "TSI", "KST", "FORCE_INDEX", "KELTNER_MIDDLE", "KELTNER_UPPER", "KELTNER_LOWER", "ZLEMA"}


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def at_least(x: Column, floor: float = TINY) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(floor)))  # greatest alone would make null the floor


class Plan:
    """Columns to be calculated over bars, by the depth at which their inputs are there."""

    def __init__(self, columns: list[str], keys: list[str], order: str = "bar_idx", price_only: bool = False):
        self.have, self.keys, self.order = set(columns), keys, order
        self.w = Window.partitionBy(*keys).orderBy(order)
        self.stages: dict[int, dict[str, Column]] = {}
        self.folds: dict[int, list[tuple[str, str, str, int]]] = {}
        self.done: dict[tuple, tuple[str, int]] = {}
        self.price_only = price_only
        self.close = F.col("close")
        self.high = F.col("high") if "high" in self.have else self.close
        self.low = F.col("low") if "low" in self.have else self.close
        self.open = F.col("open") if "open" in self.have and not price_only else self.close
        self.volume = F.col("volume") if "volume" in self.have else F.lit(1.0)
        self.idx = F.col(order)

    def put(self, key: tuple, column: Column, depth: int) -> Column:
        """The column named for key, planned at depth unless it is already."""
        if key not in self.done:
            name = "_" + "_".join(map(str, key))
            self.stages.setdefault(depth, {})[name] = column
            self.done[key] = (name, depth)
        return F.col(self.done[key][0])

    def fold(self, kind: str, source: Column, period: int, depth: int) -> Column:
        """An exponential ('ema') or adaptive ('kama') average of a planned column, after the window stage of depth."""
        key = (kind, source._jc.toString(), period)
        if key not in self.done:
            name = f"_{kind}_{len(self.done)}_{period}"
            self.folds.setdefault(depth, []).append((name, source._jc.toString(), kind, period))
            self.done[key] = (name, depth)
        return F.col(self.done[key][0])

    def rows(self, p: int) -> object:
        return self.w.rowsBetween(-(p - 1), 0)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.w)

    def full(self, x: Column, p: int) -> Column:
        """x from the bar on that has p bars up to it."""
        return F.when(self.idx >= p - 1, x)

    def mean(self, x: Column, p: int) -> Column:
        return self.full(F.avg(x).over(self.rows(p)), p)

    def total(self, x: Column, p: int) -> Column:
        return self.full(F.sum(x).over(self.rows(p)), p)

    def std(self, x: Column, p: int) -> Column:
        return self.full(F.stddev_pop(x).over(self.rows(p)), p)

    def window(self, x: Column, p: int) -> Column:
        return F.collect_list(x).over(self.rows(p))

    def typical(self) -> Column:
        return (self.high + self.low + self.close) / 3

    def change(self, x: Column) -> Column:
        return F.coalesce(x - self.lag(x), F.lit(0.0))

    def true_range(self) -> Column:
        before = self.lag(self.close)
        return F.coalesce(F.when(before.isNotNull(), F.greatest(self.high - self.low, F.abs(self.high - before), F.abs(self.low - before))), F.lit(0.0))

    def weighted(self, x: Column, p: int) -> Column:
        """Linearly weighted mean of the last p values; null unless all are there."""
        items = self.window(x, p)
        acc = F.aggregate(F.sequence(F.lit(1), F.lit(p)), F.lit(0.0), lambda a, i: a + F.get(items, i - 1) * i)
        return F.when(F.size(items) == p, acc / (p * (p + 1) / 2))

    def primitive(self, name: str, period: int) -> Column:
        name, p = name.upper(), max(2, int(period))
        if f"_cum_{name}" in self.have:
            return F.col(f"_cum_{name}")
        if (name, p) in self.done:
            return F.col(self.done[name, p][0])
        column, depth = _PRIMITIVES[name](self, p) if name in _PRIMITIVES else self.shared_rule(name, p)
        return self.put((name, p), column, depth)

    def shared_rule(self, name: str, p: int) -> tuple[Column, int]:
        c, rule = self.close, RULES.get(name)
        if rule == "rank":
            return self.full(F.size(F.filter(self.window(c, p), lambda x: x < c)) / max(1, p - 1), p), 1
        if rule == "zscore":
            s = self.std(c, p)
            return (c - self.mean(c, p)) / F.when(s == 0, 1.0).otherwise(s), 1
        if rule == "slope":
            return self.full((c - self.lag(c, p - 1)) / max(1, p - 1), p), 1
        if rule == "flow":
            return self.mean(self.volume, p), 1
        if rule == "change":
            return self.full(c - self.lag(c, p - 1), p), 1
        raise ValueError(f"unknown primitive {name}")

    def column(self, node: Node) -> Column:
        """The column of an expression; its primitives are planned."""
        if isinstance(node, Series):
            return F.col(node.name)
        if isinstance(node, Constant):
            return F.lit(float(node.value))
        if isinstance(node, Primitive):
            return self.primitive(node.name, node.period)
        if isinstance(node, Binary):
            a, b = self.column(node.left), self.column(node.right)
            if node.op in "+-*" and len(node.op) == 1:
                return {"+": a + b, "-": a - b, "*": a * b}[node.op]
            if node.op == "/":
                return ratio(a, b)
        raise ValueError(f"unknown operator in {node}")

    def apply(self, df: DataFrame) -> DataFrame:
        for depth in sorted({*self.stages, *self.folds}):
            if depth in self.stages:
                df = df.withColumns(self.stages[depth])
            if depth in self.folds:
                df = _folded(df, self.keys, self.order, self.folds[depth])
        return df


def _kama(x: np.ndarray, p: int, idx: np.ndarray) -> np.ndarray:
    """Adaptive average: seeded at bar p - 1, then moved by the squared efficiency-scaled constant."""
    out = np.full(len(x), np.nan)
    first = np.searchsorted(idx, p - 1)
    if first >= len(x):
        return out
    fast, slow = 2 / 3, 2 / 31
    steps = np.abs(np.diff(x, prepend=x[:1]))
    vol = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(p - 1), steps]), p).sum(1)
    far = np.concatenate([np.full(min(p, len(x)), x[0]), x[:-p]]) if len(x) > p else np.full(len(x), x[0])
    with np.errstate(invalid="ignore", divide="ignore"):
        constant = (np.where(vol > 0, np.abs(x - far) / vol, 0.0) * (fast - slow) + slow) ** 2
    level = out[first] = x[first]
    for i in range(first + 1, len(x)):  # each step scales by another constant, so there is no closed form
        level += constant[i] * (x[i] - level)
        out[i] = level
    return out


def _folded(df: DataFrame, keys: list[str], order: str, folds: list[tuple[str, str, str, int]]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", `{n}` double" for n, *_ in folds)
    closures = {kind: CLOSURES[kind] for _, _, kind, _ in folds if kind in CLOSURES}  # sent along

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        for name, source, kind, p in folds:
            if kind == "ema":
                pdf[name] = pdf[source].astype(float).ewm(alpha=2 / (p + 1), adjust=False).mean()
            elif kind in closures:
                pdf[name] = pdf[source].astype(float).rolling(p, min_periods=p).apply(closures[kind], raw=True)
            else:
                pdf[name] = _kama(pdf[source].to_numpy(float), p, pdf[order].to_numpy())
        return pdf

    out = df.groupBy(*keys).applyInPandas(run, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, *_ in folds})


def _sma(pl, p):
    return pl.mean(pl.close, p), 1


def _hma(pl, p):
    root, half = max(2, math.isqrt(p)), max(2, p // 2)
    raw = pl.put(("hmaraw", p), 2 * F.when(pl.idx >= half - 1, pl.weighted(pl.close, half)) - F.when(pl.idx >= p - 1, pl.weighted(pl.close, p)), 1)
    return pl.weighted(raw, root), 2


def _gains(pl, p):
    step = pl.put(("step",), pl.close - pl.lag(pl.close), 1)
    up = F.sum(F.greatest(step, F.lit(0.0))).over(pl.rows(p))
    down = F.sum(F.greatest(-step, F.lit(0.0))).over(pl.rows(p))
    return up, down


def _rsi(pl, p):
    up, down = _gains(pl, p)
    return F.when(pl.idx >= p, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + ratio(up, down)))), 2


def _cmo(pl, p):
    up, down = _gains(pl, p)
    return F.when(pl.idx >= p, F.when(up + down == 0, 0.0).otherwise(100 * ratio(up - down, up + down))), 2


def _atr(pl, p):
    return pl.mean(pl.put(("tr",), pl.true_range(), 1), p), 2


def _returns(pl):
    before = pl.lag(pl.close)
    return pl.put(("ret",), F.coalesce(ratio(pl.close, before) - 1, F.lit(0.0)), 1)


def _bands(kind):
    def build(pl, p):
        m, s, c = pl.mean(pl.close, p), pl.std(pl.close, p), pl.close
        up, lo = m + 2 * s, m - 2 * s
        return {"upper": up, "middle": m, "lower": lo, "percent": F.when(up != lo, ratio(c - lo, up - lo)), "width": (up - lo) / at_least(m) * 100, "bandwidth": F.when(m != 0, ratio(4 * s, m))}[kind], 1

    return build


def _stochastic(pl, p):
    hi, lo = pl.full(F.max(pl.high).over(pl.rows(p)), p), pl.full(F.min(pl.low).over(pl.rows(p)), p)
    return F.when(hi != lo, ratio(pl.close - lo, hi - lo) * 100), 1


def _cci(pl, p):
    t = pl.put(("typical",), pl.typical(), 1)
    m = F.avg(t).over(pl.rows(p))
    mad = F.aggregate(pl.window(t, p), F.lit(0.0), lambda a, x: a + F.abs(x - pl.put(("ccim", p), m, 2))) / p
    return pl.full(F.when(mad == 0, 0.0).otherwise(ratio(t - F.col(f"_ccim_{p}"), 0.015 * mad)), p), 3


def _obv(pl, p):
    return F.sum(F.signum(pl.put(("step0",), pl.change(pl.close), 1)) * pl.volume).over(pl.w.rowsBetween(Window.unboundedPreceding, 0)), 2


def _flow(pl):
    h, lo, c = pl.high, pl.low, pl.close
    return F.when(h > lo, ((c - lo) - (h - c)) / at_least(h - lo) * pl.volume).otherwise(0.0)


def _mfi(pl, p):
    t = pl.typical()
    step = pl.put(("tstep",), pl.change(t), 1)
    up, down = pl.total(F.when(step > 0, t * pl.volume).otherwise(0.0), p), pl.total(F.when(step < 0, t * pl.volume).otherwise(0.0), p)
    return F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + ratio(up, down))), 2


def _log2(a, b):
    return F.pow(F.ln(at_least(a) / at_least(b)), F.lit(2.0))


def _range_vol(x):
    def build(pl, p):
        return F.sqrt(at_least(pl.mean(x(pl), p), 0.0)) * YEAR, 1

    return build


def _ease(pl, p):
    mid = (pl.high + pl.low) / 2
    x = pl.put(("ease",), F.coalesce((mid - pl.lag(mid)) / at_least(pl.volume / 10000 / at_least(pl.high - pl.low)), F.lit(0.0)), 1)
    return pl.mean(x, p), 2


def _trima(pl, p):
    half = max(2, (p + 1) // 2)
    return pl.mean(pl.put(("trima", half), F.coalesce(pl.mean(pl.close, half), F.lit(0.0)), 1), half), 2


def _ema(pl, p):
    return pl.fold("ema", pl.close, p, 1), 2


def _emas(pl, p):
    e1 = pl.fold("ema", pl.close, p, 1)
    e2 = pl.fold("ema", e1, p, 1)
    return e1, e2, pl.fold("ema", e2, p, 1)


def _fast_slow(pl, p):
    return pl.fold("ema", pl.close, max(2, p // 2), 1), pl.fold("ema", pl.close, p, 1)


def _trix(pl, p):
    e3 = _emas(pl, p)[2]
    before = pl.lag(e3)
    return F.when(pl.idx >= 1, F.when(before == 0, 0.0).otherwise(ratio(e3 - before, before) * 100)), 2


def _tsi(pl, p):
    step = pl.put(("step0",), pl.change(pl.close), 1)
    size = pl.put(("abs0",), F.abs(pl.change(pl.close)), 1)
    a, b = (pl.fold("ema", pl.fold("ema", x, p, 1), max(2, p // 2), 1) for x in (step, size))
    return 100 * a / at_least(b), 2


def _kst(pl, p):
    parts = []
    for weight, n, smooth in ((1, max(2, p // 2), max(2, p // 2)), (2, p, max(2, p // 2)), (3, int(p * 1.5), max(2, p // 2)), (4, p * 2, p)):
        first = pl.lag(pl.close, n - 1)
        x = pl.put(("rate", n), F.coalesce(pl.full((pl.close - first) / at_least(first), n), F.lit(0.0)), 1)
        parts.append(weight * pl.fold("ema", x, smooth, 1))
    return parts[0] + parts[1] + parts[2] + parts[3], 2


def _force(pl, p):
    return pl.fold("ema", pl.put(("force",), F.coalesce((pl.close - pl.lag(pl.close)) * pl.volume, F.lit(0.0)), 1), p, 1), 2


def _keltner(sign):
    def build(pl, p):
        mid = pl.fold("ema", pl.close, p, 1)
        return (mid + sign * 2 * _atr(pl, p)[0] if sign else mid), 2

    return build


def _zlema(pl, p):
    before = pl.lag(pl.close, max(1, (p - 1) // 2))
    return pl.fold("ema", pl.put(("zlema", p), F.coalesce(2 * pl.close - before, pl.close), 1), p, 1), 2


def _lagged(k, delta):
    return lambda pl, p: ((pl.close - pl.lag(pl.close, k)) if delta else pl.lag(pl.close, k), 1)


def _zscore_volume(pl, p):
    s = pl.std(pl.volume, p)
    return (pl.volume - pl.mean(pl.volume, p)) / F.when(s == 0, 1.0).otherwise(s), 1


def _moment(fn, least):
    def build(pl, p):
        flat = F.max(pl.close).over(pl.rows(p)) == F.min(pl.close).over(pl.rows(p))
        return pl.full(F.lit(0.0) if p < least else F.when(flat, 0.0).otherwise(F.coalesce(fn(pl.close).over(pl.rows(p)), F.lit(0.0))), p), 1

    return build


def _extreme(fn, x):
    return lambda pl, p: (pl.full(fn(x(pl)).over(pl.rows(p)), p), 1)


_HIGH, _LOW, _CLOSE = (lambda pl: pl.high), (lambda pl: pl.low), (lambda pl: pl.close)
_PRIMITIVES = {
    **dict.fromkeys(("SMA", "ROLLING_MEAN"), _sma),
    "WMA": lambda pl, p: (pl.full(pl.weighted(pl.close, p), p), 1),
    "HMA": _hma,
    **dict.fromkeys(("HIGH", "HIGHEST_HIGH", "DONCHIAN_UPPER"), _extreme(F.max, _HIGH)),
    **dict.fromkeys(("LOW", "LOWEST_LOW", "DONCHIAN_LOWER"), _extreme(F.min, _LOW)),
    "DONCHIAN_MIDDLE": lambda pl, p: ((_extreme(F.max, _HIGH)(pl, p)[0] + _extreme(F.min, _LOW)(pl, p)[0]) / 2, 1),
    "ROLLING_MIN": _extreme(F.min, _CLOSE),
    "ROLLING_MAX": _extreme(F.max, _CLOSE),
    "ROLLING_STD": lambda pl, p: (pl.std(pl.close, p), 1),
    "ROLLING_MEDIAN": lambda pl, p: (pl.full(F.get(F.sort_array(pl.window(pl.close, p)), F.lit(p // 2)), p), 1),
    "ROLLING_SKEW": _moment(F.skewness, 3),
    "ROLLING_KURTOSIS": _moment(F.kurtosis, 4),
    "MOMENTUM": lambda pl, p: (pl.close - pl.lag(pl.close, p), 1),
    "ROC": lambda pl, p: (ratio(pl.close, pl.lag(pl.close, p)) - 1, 1),
    **{f"LAG_{k}": _lagged(k, False) for k in (1, 2, 5)},
    **{f"DELTA_{k}": _lagged(k, True) for k in (1, 5)},
    "RSI": _rsi,
    "CMO": _cmo,
    **dict.fromkeys(("ATR", "TRUE_RANGE"), _atr),
    **dict.fromkeys(("VOLATILITY", "REALIZED_VOL"), lambda pl, p: (pl.std(_returns(pl), p) * YEAR, 2)),
    "BOLLINGER_BANDWIDTH": _bands("bandwidth"),
    "BB_UPPER": _bands("upper"),
    "BB_MIDDLE": _bands("middle"),
    "BB_LOWER": _bands("lower"),
    "BB_PERCENT": _bands("percent"),
    "BB_WIDTH": _bands("width"),
    "STOCHASTIC": _stochastic,
    "WILLIAMS_R": lambda pl, p: (_stochastic(pl, p)[0] - 100, 1),
    "CCI": _cci,
    "OBV": _obv,
    "DOLLAR_VOLUME": lambda pl, p: (pl.close * pl.volume, 1),
    "VOLUME_ZSCORE": _zscore_volume,
    "VOLUME_RATIO": lambda pl, p: (pl.volume / at_least(pl.mean(pl.volume, p)), 1),
    "VWAP": lambda pl, p: (pl.total(pl.typical() * pl.volume, p) / at_least(pl.total(pl.volume, p), 1.0), 1),
    "PARKINSON_VOL": _range_vol(lambda pl: _log2(pl.high, pl.low) / (4 * math.log(2))),
    "GK_VOL": _range_vol(lambda pl: 0.5 * _log2(pl.high, pl.low) - (2 * math.log(2) - 1) * _log2(pl.close, pl.open)),
    **dict.fromkeys(("CHAIKIN_MONEY_FLOW", "CMF"), lambda pl, p: (pl.total(_flow(pl), p) / at_least(pl.total(pl.volume, p)), 1)),
    **dict.fromkeys(("MONEY_FLOW_INDEX", "MFI"), _mfi),
    "RANGE_PCT": lambda pl, p: ((pl.high - pl.low) / at_least(pl.close) * 100, 1),
    "TRUE_RANGE_PCT": lambda pl, p: (_atr(pl, 2)[0] / at_least(pl.close) * 100, 2),
    "LOG_RETURN": lambda pl, p: (F.coalesce(F.ln(at_least(pl.close) / at_least(F.when(pl.lag(pl.close).isNotNull(), pl.lag(pl.close)).otherwise(pl.close))), F.lit(0.0)), 1),
    "CUM_RETURN": lambda pl, p: (ratio(pl.close, F.first(pl.close).over(pl.w.rowsBetween(Window.unboundedPreceding, 0))) - 1, 1),
    "AD_LINE": lambda pl, p: (F.sum(F.when(pl.idx > 0, _flow(pl)).otherwise(0.0)).over(pl.w.rowsBetween(Window.unboundedPreceding, 0)), 1),
    "EASE_OF_MOVEMENT": _ease,
    "TRIMA": _trima,
    "FUNDING_RATE": lambda pl, p: (F.col("funding_rate") if "funding_rate" in pl.have and not pl.price_only else F.lit(0.0), 1),
    "ORDERBOOK_IMBALANCE": lambda pl, p: (F.col("imbalance") if "imbalance" in pl.have and not pl.price_only else F.lit(0.0), 1),
    "EMA": _ema,
    "MACD": lambda pl, p: (_fast_slow(pl, p)[0] - _fast_slow(pl, p)[1], 2),
    "PPO": lambda pl, p: (ratio(_fast_slow(pl, p)[0] - _fast_slow(pl, p)[1], _fast_slow(pl, p)[1]), 2),
    "DEMA": lambda pl, p: (2 * _emas(pl, p)[0] - _emas(pl, p)[1], 2),
    "TEMA": lambda pl, p: (3 * _emas(pl, p)[0] - 3 * _emas(pl, p)[1] + _emas(pl, p)[2], 2),
    "TRIX": _trix,
    "TSI": _tsi,
    "KST": _kst,
    "FORCE_INDEX": _force,
    "KELTNER_MIDDLE": _keltner(0),
    "KELTNER_UPPER": _keltner(1),
    "KELTNER_LOWER": _keltner(-1),
    "ZLEMA": _zlema,
    "KAMA": lambda pl, p: (pl.fold("kama", pl.close, p, 1), 2),
}


def register_primitive(name: str, build) -> None:
    """Adds a primitive: build(plan, period) -> (Column, depth). Its name can then be used in any expression."""
    _PRIMITIVES[name.upper()] = build
    PLUGINS.add(name.upper())


#: What register_rolling added.
CLOSURES: dict = {}


def register_rolling(name: str, closure, source: str = "close") -> None:
    """Adds a primitive that is any function of the last ``period`` values of a column, an array of them: the same for plans, where it runs in Arrow
    batches, and for runners."""
    name = name.upper()
    CLOSURES[name] = closure
    register_primitive(name, lambda pl, p: (pl.fold(name, getattr(pl, source), p, 1), 2))
    KERNELS[name] = lambda b, p: pd.Series(b.columns.get(source, b.c)).rolling(p, min_periods=p).apply(closure, raw=True).to_numpy()


def lookback(node: Node) -> int:
    """Bars before a bar that its value can depend on (by more than one part in 1e16), but for what cumulative primitives carry."""
    if isinstance(node, Primitive):
        name, p = node.name.upper(), max(2, node.period)
        if name in CUMULATIVE:
            return 0
        if name == "KAMA":
            return p + 9000  # 36.8 over the smallest squared constant
        return math.ceil(3 * EMA_MEMORY * (p + 1)) + 2 * p if name in RECURSIVE else 2 * p + 6
    return max((lookback(c) for c in node.children()), default=0)


def _with_cumulative(bars: DataFrame, names: set[str], series: list[str], order: str, price_only: bool) -> DataFrame:
    """bars, cut into shards, with _cum_<name> of each cumulative primitive: its sum within the shard and, carried in, that of the shards ahead."""
    pl = Plan(bars.columns, [*series, "_shard"], order, price_only)
    steps = {"OBV": F.signum(pl.change(pl.close)) * pl.volume, "AD_LINE": F.when(pl.idx > 0, _flow(pl)).otherwise(0.0)}
    steps = {n: x for n, x in steps.items() if n in names}
    if steps:
        near = with_halo(bars, series, [order], 1, 0)
        near = near.withColumns({f"_step_{n}": x for n, x in steps.items()}).filter("not _halo").drop("_halo")
        run = near.withColumns({f"_cum_{n}": F.sum(f"_step_{n}").over(pl.w.rowsBetween(Window.unboundedPreceding, 0)) for n in steps})
        ahead = carry(near, series, {f"_ahead_{n}": F.sum(f"_step_{n}") for n in steps}, F.sum)
        run = run.join(broadcast_if_small(ahead, 10_000), [*series, "_shard"], "left")
        bars = run.withColumns({f"_cum_{n}": F.col(f"_cum_{n}") + F.coalesce(f"_ahead_{n}", F.lit(0.0)) for n in steps}).drop(*[f"{k}_{n}" for n in steps for k in ("_step", "_ahead")])
    if "CUM_RETURN" in names:
        first = bars.groupBy(*series).agg(F.min_by("close", order).alias("_first"))
        bars = bars.join(broadcast_if_small(first), series).withColumn("_cum_CUM_RETURN", ratio(F.col("close"), F.col("_first")) - 1).drop("_first")
    return bars


def evaluate(bars: DataFrame, expressions: dict[str, Node], keys: tuple[str, ...] = ("symbol",), order: str = "bar_idx", price_only: bool = False, target_rows: int = TARGET_ROWS) -> DataFrame:
    """bars with one column per named expression, null where it is not warmed up.

    bars has the keys, the 0-based number of the bar in its series (order), close and, if present, open, high, low, volume
    (else close and 1) and the alternative data columns. price_only gives expressions only close, high, low and volume.
    Series longer than target_rows are cut into time shards with halo bars as far as the expressions look back; cumulative primitives are carried over shards.
    """
    series, given = list(keys), bars.columns
    bars, split = assign_shards(bars, series, order, target_rows)
    if split:
        used = {n.name.upper() for e in expressions.values() for n in walk(e) if isinstance(n, Primitive)} & CUMULATIVE
        bars = with_halo(_with_cumulative(bars, used, series, order, price_only), series, [order], max(map(lookback, expressions.values()), default=0), 0)
    else:
        bars = bars.drop("_shard")
    plan = Plan(bars.columns, series + ["_shard"] * split, order, price_only)
    columns = {name: plan.column(node) for name, node in expressions.items()}
    out = plan.apply(bars)
    if split:
        out = out.filter("not _halo")
    return out.select(*given, *[c.cast("double").alias(n) for n, c in columns.items()])
