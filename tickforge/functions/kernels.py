"""The primitives over one short series in NumPy: what a runner evaluates on its buffer at every bar. Missing is NaN."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from tickforge.functions.expr import RULES, Binary, Constant, Node, Primitive, Series

TINY = 1e-12
YEAR = math.sqrt(252)


def div(a, b):
    """a / b, missing where b is 0."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.asarray(b) == 0, np.nan, np.asarray(a, float) / b)


class Bars:
    """Arrays of equal length by name, with what several primitives share."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = {k: np.asarray(x, float) for k, x in columns.items()}
        self.n = len(self.columns["close"])
        get = lambda k, other: self.columns.get(k, other)
        self.c = self.columns["close"]
        self.h, self.lo, self.o, self.v = get("high", self.c), get("low", self.c), get("open", self.c), get("volume", np.ones(self.n))
        self.typical = (self.h + self.lo + self.c) / 3

    def windows(self, x: np.ndarray, p: int) -> np.ndarray:
        """The p values up to each bar, missing ones ahead of the first."""
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(p - 1, np.nan), x]), p)

    def mean(self, x, p):
        return self.windows(x, p).mean(1)

    def total(self, x, p):
        return self.windows(x, p).sum(1)

    def std(self, x, p):
        return self.windows(x, p).std(1)

    def top(self, x, p):
        return self.windows(x, p).max(1)

    def low(self, x, p):
        return self.windows(x, p).min(1)

    def weighted(self, x, p):
        return self.windows(x, p) @ np.arange(1, p + 1) / (p * (p + 1) / 2)

    def lag(self, x, k=1):
        return np.concatenate([np.full(min(k, self.n), np.nan), x[: max(0, self.n - k)]])

    def ema(self, x, p):
        return pd.Series(x).ewm(alpha=2 / (p + 1), adjust=False).mean().to_numpy()

    def change(self, x):
        return np.nan_to_num(x - self.lag(x))

    def from_bar(self, k, x):
        return np.where(np.arange(self.n) >= k, x, np.nan)

    def true_range(self):
        b = self.lag(self.c)
        return np.nan_to_num(np.maximum(self.h - self.lo, np.maximum(np.abs(self.h - b), np.abs(self.lo - b))))

    def flow(self):
        return np.where(self.h > self.lo, ((self.c - self.lo) - (self.h - self.c)) / np.maximum(self.h - self.lo, TINY) * self.v, 0.0)

    def gains(self, p):
        step = self.c - self.lag(self.c)
        return (self.windows(np.nan_to_num(s), p).sum(1) for s in (np.maximum(step, 0), np.maximum(-step, 0)))


def _log2(a, b):
    return np.log(np.maximum(a, TINY) / np.maximum(b, TINY)) ** 2


def _moment(b: Bars, p: int, power: int, least: int, excess: float):
    w = b.windows(b.c, p)
    d = w - w.mean(1, keepdims=True)
    out = div((d**power).mean(1), (d**2).mean(1) ** (power / 2)) - excess
    flat = w.max(1) == w.min(1)
    return b.from_bar(p - 1, np.zeros(b.n) if p < least else np.where(flat, 0.0, np.nan_to_num(out)))


def _kama(b: Bars, p: int):
    out, x = np.full(b.n, np.nan), b.c
    steps = np.abs(b.change(x))
    for i in range(p - 1, b.n):
        if i == p - 1:
            out[i] = x[i]
            continue
        far = max(i - p, 0)
        vol = steps[far + 1 : i + 1].sum()
        constant = ((abs(x[i] - x[far]) / vol if vol > 0 else 0.0) * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        out[i] = out[i - 1] + constant * (x[i] - out[i - 1])
    return out


def _rsi(b, p):
    up, down = b.gains(p)
    return b.from_bar(p, np.where(down == 0, 100.0, 100 - 100 / (1 + div(up, down))))


def _cmo(b, p):
    up, down = b.gains(p)
    return b.from_bar(p, np.where(up + down == 0, 0.0, 100 * div(up - down, up + down)))


def _stochastic(b, p):
    return div(b.c - b.low(b.lo, p), b.top(b.h, p) - b.low(b.lo, p)) * 100


def _cci(b, p):
    w = b.windows(b.typical, p)
    mad = np.abs(w - w.mean(1, keepdims=True)).mean(1)
    return b.from_bar(p - 1, np.where(mad == 0, 0.0, div(b.typical - w.mean(1), 0.015 * mad)))


def _mfi(b, p):
    step = b.change(b.typical)
    up, down = b.total(np.where(step > 0, b.typical * b.v, 0.0), p), b.total(np.where(step < 0, b.typical * b.v, 0.0), p)
    return b.from_bar(p - 1, np.where(down == 0, 100.0, 100 - 100 / (1 + div(up, down))))


def _chain(b, p):
    e1 = b.ema(b.c, p)
    e2 = b.ema(e1, p)
    return e1, e2, b.ema(e2, p)


def _trix(b, p):
    e = _chain(b, p)[2]
    before = b.lag(e)
    return b.from_bar(1, np.where(before == 0, 0.0, div(e - before, before) * 100))


def _tsi(b, p):
    step, half = b.change(b.c), max(2, p // 2)
    return 100 * b.ema(b.ema(step, p), half) / np.maximum(b.ema(b.ema(np.abs(step), p), half), TINY)


def _kst(b, p):
    half, out = max(2, p // 2), 0.0
    for weight, n, smooth in ((1, half, half), (2, p, half), (3, int(p * 1.5), half), (4, 2 * p, p)):
        first = b.lag(b.c, n - 1)
        out = out + weight * b.ema(np.nan_to_num((b.c - first) / np.maximum(first, TINY)), smooth)
    return out


def _hma(b, p):
    half, root = max(2, p // 2), max(2, math.isqrt(p))
    return b.weighted(2 * b.weighted(b.c, half) - b.weighted(b.c, p), root)


def _ease(b, p):
    mid = (b.h + b.lo) / 2
    return b.mean(np.nan_to_num((mid - b.lag(mid)) / np.maximum(b.v / 10000 / np.maximum(b.h - b.lo, TINY), TINY)), p)


def _spread(b, p):
    fast, slow = b.ema(b.c, max(2, p // 2)), b.ema(b.c, p)
    return fast - slow, slow


def _zscore(b, x, p):
    s = b.std(x, p)
    return (x - b.mean(x, p)) / np.where(s == 0, 1.0, s)


def _trima(b, p):
    half = max(2, (p + 1) // 2)
    return b.mean(np.nan_to_num(b.mean(b.c, half)), half)


def _atr(b, p):
    return b.mean(b.true_range(), p)


def _both(names: str, kernel) -> dict:
    return dict.fromkeys(names.split(), kernel)


KERNELS = {
    **_both("SMA ROLLING_MEAN BB_MIDDLE", lambda b, p: b.mean(b.c, p)),
    "WMA": lambda b, p: b.weighted(b.c, p), "HMA": _hma, "TRIMA": _trima,
    **_both("HIGH HIGHEST_HIGH DONCHIAN_UPPER", lambda b, p: b.top(b.h, p)), **_both("LOW LOWEST_LOW DONCHIAN_LOWER", lambda b, p: b.low(b.lo, p)),
    "DONCHIAN_MIDDLE": lambda b, p: (b.top(b.h, p) + b.low(b.lo, p)) / 2, "ROLLING_MIN": lambda b, p: b.low(b.c, p), "ROLLING_MAX": lambda b, p: b.top(b.c, p),
    "ROLLING_STD": lambda b, p: b.std(b.c, p), "ROLLING_MEDIAN": lambda b, p: b.from_bar(p - 1, np.sort(b.windows(b.c, p), 1)[:, p // 2]),
    "ROLLING_SKEW": lambda b, p: _moment(b, p, 3, 3, 0.0), "ROLLING_KURTOSIS": lambda b, p: _moment(b, p, 4, 4, 3.0),
    "MOMENTUM": lambda b, p: b.c - b.lag(b.c, p), "ROC": lambda b, p: div(b.c, b.lag(b.c, p)) - 1,
    **{f"LAG_{k}": lambda b, p, k=k: b.lag(b.c, k) for k in (1, 2, 5)}, **{f"DELTA_{k}": lambda b, p, k=k: b.c - b.lag(b.c, k) for k in (1, 5)},
    "RSI": _rsi, "CMO": _cmo, **_both("ATR TRUE_RANGE", _atr), "STOCHASTIC": _stochastic, "WILLIAMS_R": lambda b, p: _stochastic(b, p) - 100, "CCI": _cci,
    **_both("VOLATILITY REALIZED_VOL", lambda b, p: b.std(np.nan_to_num(div(b.c, b.lag(b.c)) - 1), p) * YEAR),
    "BOLLINGER_BANDWIDTH": lambda b, p: div(4 * b.std(b.c, p), b.mean(b.c, p)), "BB_UPPER": lambda b, p: b.mean(b.c, p) + 2 * b.std(b.c, p), "BB_LOWER": lambda b, p: b.mean(b.c, p) - 2 * b.std(b.c, p),
    "BB_PERCENT": lambda b, p: div(b.c - b.mean(b.c, p) + 2 * b.std(b.c, p), 4 * b.std(b.c, p)), "BB_WIDTH": lambda b, p: 4 * b.std(b.c, p) / np.maximum(b.mean(b.c, p), TINY) * 100,
    "OBV": lambda b, p: np.cumsum(np.sign(b.change(b.c)) * b.v), "DOLLAR_VOLUME": lambda b, p: b.c * b.v, "VOLUME_ZSCORE": lambda b, p: _zscore(b, b.v, p),
    "VOLUME_RATIO": lambda b, p: b.v / np.maximum(b.mean(b.v, p), TINY), "VWAP": lambda b, p: b.total(b.typical * b.v, p) / np.maximum(b.total(b.v, p), 1.0),
    "PARKINSON_VOL": lambda b, p: np.sqrt(np.maximum(b.mean(_log2(b.h, b.lo) / (4 * math.log(2)), p), 0)) * YEAR,
    "GK_VOL": lambda b, p: np.sqrt(np.maximum(b.mean(0.5 * _log2(b.h, b.lo) - (2 * math.log(2) - 1) * _log2(b.c, b.o), p), 0)) * YEAR,
    **_both("CHAIKIN_MONEY_FLOW CMF", lambda b, p: b.total(b.flow(), p) / np.maximum(b.total(b.v, p), TINY)), **_both("MONEY_FLOW_INDEX MFI", _mfi),
    "RANGE_PCT": lambda b, p: (b.h - b.lo) / np.maximum(b.c, TINY) * 100, "TRUE_RANGE_PCT": lambda b, p: _atr(b, 2) / np.maximum(b.c, TINY) * 100,
    "LOG_RETURN": lambda b, p: np.nan_to_num(np.log(np.maximum(b.c, TINY) / np.maximum(b.lag(b.c), TINY))), "CUM_RETURN": lambda b, p: div(b.c, b.c[0]) - 1,
    "AD_LINE": lambda b, p: np.cumsum(np.where(np.arange(b.n) > 0, b.flow(), 0.0)), "EASE_OF_MOVEMENT": _ease,
    "FUNDING_RATE": lambda b, p: b.columns.get("funding_rate", np.zeros(b.n)), "ORDERBOOK_IMBALANCE": lambda b, p: b.columns.get("imbalance", np.zeros(b.n)),
    "EMA": lambda b, p: b.ema(b.c, p), "MACD": lambda b, p: _spread(b, p)[0], "PPO": lambda b, p: div(*_spread(b, p)),
    "DEMA": lambda b, p: 2 * _chain(b, p)[0] - _chain(b, p)[1], "TEMA": lambda b, p: 3 * _chain(b, p)[0] - 3 * _chain(b, p)[1] + _chain(b, p)[2], "TRIX": _trix, "TSI": _tsi, "KST": _kst,
    "FORCE_INDEX": lambda b, p: b.ema(b.change(b.c) * b.v, p), "ZLEMA": lambda b, p: b.ema(np.where(np.isnan(x := 2 * b.c - b.lag(b.c, max(1, (p - 1) // 2))), b.c, x), p),
    **{f"KELTNER_{n}": lambda b, p, k=k: b.ema(b.c, p) + (2 * k * _atr(b, p) if k else 0) for n, k in (("MIDDLE", 0), ("UPPER", 1), ("LOWER", -1))}, "KAMA": _kama,
}
SHARED = {
    "rank": lambda b, p: b.from_bar(p - 1, (b.windows(b.c, p) < b.c[:, None]).sum(1) / max(1, p - 1)), "zscore": lambda b, p: _zscore(b, b.c, p),
    "slope": lambda b, p: (b.c - b.lag(b.c, p - 1)) / max(1, p - 1), "flow": lambda b, p: b.mean(b.v, p), "change": lambda b, p: b.c - b.lag(b.c, p - 1),
}


def values(node: Node, b: Bars) -> np.ndarray:
    """The values of an expression at each bar; ValueError for an unknown operator or primitive."""
    if isinstance(node, Constant):
        return np.full(b.n, float(node.value))
    if isinstance(node, Series):
        return b.columns[node.name]
    if isinstance(node, Primitive):
        name = node.name.upper()
        kernel = KERNELS.get(name) or SHARED.get(RULES.get(name, ""))
        if kernel is None:
            raise ValueError(f"no kernel for {name}")
        with np.errstate(invalid="ignore", divide="ignore"):
            return kernel(b, max(2, int(node.period)))
    if isinstance(node, Binary) and node.op in ("+", "-", "*", "/"):
        x, y = values(node.left, b), values(node.right, b)
        return div(x, y) if node.op == "/" else x + y if node.op == "+" else x - y if node.op == "-" else x * y
    raise ValueError(f"unknown operator in {node}")
