"""A paper-trading runner: one stateful step per bar, as a stream with keyed state and as its batch twin."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tickforge.functions.expr import Node, from_dict, to_dict
from tickforge.functions.kernels import Bars, values

OUTPUT = "symbol string, bar_ts long, status string, signal double, position double, cash double, equity double"
STATE = "state string"


def latest_value(node: Node, buffer: dict[str, list[float]]) -> float:
    """The value of an expression at the last bar of a buffer, NaN where it is missing."""
    return float(values(node, Bars(buffer))[-1])


@dataclass
class Account:
    """State of one symbol: the last bars, cash, position, and why trading stopped, if it did."""

    genome: dict
    cash: float = 100_000.0
    position: float = 0.0
    commission_bps: float = 2.0
    buffer: int = 300
    min_order: float = 1e-6
    max_notional: float = 1e9
    fraction: float = 1.0
    halted: str = ""
    bars: dict = field(default_factory=lambda: {k: [] for k in ("close", "high", "low", "volume")})

    def step(self, bar: dict) -> tuple[str, float, float]:
        """(status, signal, equity) after a bar: buffer, warm-up, signal, sizing, limits, execution against half the bar's volume."""
        node = from_dict(self.genome)
        equity = self.cash + self.position * bar["close"]
        if self.halted:
            return "rejected", math.nan, equity
        for k in self.bars:
            self.bars[k] = [*self.bars[k], float(bar[k])][-self.buffer :]
        if len(self.bars["close"]) < max(2, node.warmup()):
            return "warming_up", math.nan, equity
        signal = latest_value(node, self.bars)
        signal = 0.0 if math.isnan(signal) else signal
        if equity <= 0:
            self.halted = "liquidated"
            return "liquidated", signal, equity
        price = bar["close"]
        most = min(equity * self.fraction / price, 1e9) if price > 0 else 0.0
        target = max(-most, min(most, (signal > 0) * most - (signal < 0) * most))
        delta = target - self.position
        if abs(delta) < self.min_order:
            return "no_change", signal, equity
        if abs(delta) * price > self.max_notional:
            return "gate_rejected", signal, equity
        fill = math.copysign(min(abs(delta), 0.5 * float(bar["volume"])), delta)
        if not fill:
            return "unfilled", signal, equity
        self.cash -= fill * price + abs(fill * price) * self.commission_bps / 1e4
        self.position += fill
        return "filled" if fill == delta else "partial", signal, self.cash + self.position * price


def _steps(account: Account, symbol, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for bar in pdf.sort_values("bar_ts", kind="stable").to_dict("records"):
        status, signal, equity = account.step(bar)
        out.append((symbol, int(bar["bar_ts"]), status, signal, account.position, account.cash, equity))
    return pd.DataFrame(out, columns=["symbol", "bar_ts", "status", "signal", "position", "cash", "equity"])


def run_stream(bars: DataFrame, genome: Node, **settings) -> DataFrame:
    """Steps of a stream of bars (symbol, bar_ts, close, high, low, volume) in order of arrival, with the account as keyed state."""
    start = {"genome": to_dict(genome), **settings}

    def advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        account = Account(**(json.loads(state.get[0]) if state.exists else start))
        for pdf in frames:
            yield _steps(account, key[0], pdf)
        state.update((json.dumps(account.__dict__),))

    return bars.groupBy("symbol").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_batch(bars: DataFrame, genome: Node, **settings) -> DataFrame:
    """The same steps over a batch of bars; inherently sequential per symbol."""
    start = {"genome": to_dict(genome), **settings}

    def advance(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _steps(Account(**start), key[0], pdf)

    return bars.groupBy("symbol").applyInPandas(advance, OUTPUT)
