"""Order books and venues: fills against book levels, synthetic books, replay of orders against trade prints, limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(a: str = "array<struct<price:double,quantity:double>>") -> Column:
    return F.array().cast(a)


def mid(bids: Column, asks: Column) -> Column:
    """Mean of the best prices; null for an empty side."""
    return (F.get(bids, F.lit(0))["price"] + F.get(asks, F.lit(0))["price"]) / 2


def _walk(df: DataFrame, ident: str, levels: Column) -> DataFrame:
    return df.select(ident, "side", "quantity", *[c for c in ("limit_price", "queue_ahead") if c in df.columns], F.posexplode_outer(levels).alias("lvl", "_l")).select("*", F.col("_l.price").alias("px"), F.col("_l.quantity").alias("qty")).drop("_l")


def market_fills(orders: DataFrame, ident: str = "order_id", fee_bps: float = 0.0, half_spread_bps: float = 0.0, temporary_bps: float = 0.0, permanent_bps: float = 0.0) -> DataFrame:
    """(ident, filled, average_price, fees, status) of market orders with the columns side, quantity, bids and asks (best level first).

    Levels are taken in order until the quantity is met; the impact curve moves the price only if the book runs out.
    """
    buy = F.lower("side") == "buy"
    rows = _walk(orders, ident, F.when(buy, F.col("asks")).otherwise(F.col("bids")))
    before = F.coalesce(F.sum("qty").over(Window.partitionBy(ident).orderBy("lvl").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("take", F.greatest(F.lit(0.0), F.least(F.coalesce("qty", F.lit(0.0)), F.col("quantity") - before)))
    per = rows.groupBy(ident).agg(F.first("side").alias("side"), F.first("quantity").alias("quantity"), F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("px")).alias("_notional"), F.sum("qty").alias("_there"))
    part = F.coalesce(F.try_divide(F.col("filled"), F.col("_there")), F.lit(0.0))
    impact = F.when(F.col("filled") < F.col("quantity"), (half_spread_bps + temporary_bps * F.sqrt(part) + permanent_bps * part) / 1e4).otherwise(0.0)
    price = F.coalesce(F.try_divide(F.col("_notional"), F.col("filled")), F.lit(0.0)) * F.when(F.lower("side") == "buy", 1 + impact).otherwise(1 - impact)
    status = F.when(F.col("filled") <= 0, "unfilled").when(F.col("filled") >= F.col("quantity"), "filled").otherwise("partial")
    return per.select(ident, "filled", price.alias("average_price"), (price * F.col("filled") * fee_bps / 1e4).alias("fees"), status.alias("status"))


def limit_fills(orders: DataFrame, ident: str = "order_id", participation: float = 0.1) -> DataFrame:
    """(ident, filled, average_price, status) of limit orders with side, quantity, limit_price, queue_ahead, bids and asks.

    The levels up to the first that the limit does not allow are taken in order; the queue ahead consumes from the front; at most
    ``participation`` of the whole side is filled.
    """
    buy = F.lower("side") == "buy"
    rows = _walk(orders, ident, F.when(buy, F.col("asks")).otherwise(F.col("bids")))
    w = Window.partitionBy(ident).orderBy("lvl")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    fits = F.coalesce(F.when(F.lower("side") == "buy", F.col("px") <= F.col("limit_price")).otherwise(F.col("px") >= F.col("limit_price")), F.lit(False))
    rows = rows.withColumns({"_ok": F.min(fits.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1, "_cum": F.coalesce(F.sum("qty").over(ahead), F.lit(0.0)), "_cap": F.sum("qty").over(Window.partitionBy(ident)) * participation})
    queue = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.coalesce("queue_ahead", F.lit(0.0))) - F.col("_cum"))
    rows = rows.withColumn("_free", F.when(F.col("_ok"), F.greatest(F.lit(0.0), F.col("qty") - queue)).otherwise(0.0))
    used = F.coalesce(F.sum("_free").over(ahead), F.lit(0.0))
    rows = rows.withColumn("take", F.greatest(F.lit(0.0), F.least(F.col("_free"), F.least(F.col("quantity"), F.coalesce("_cap", F.lit(0.0))) - used)))
    per = rows.groupBy(ident).agg(F.first("quantity").alias("quantity"), F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("px")).alias("_notional"))
    status = F.when(F.col("filled") >= F.col("quantity"), "filled").when(F.col("filled") > 0, "partial").otherwise("unfilled")
    return per.select(ident, "filled", F.coalesce(F.try_divide(F.col("_notional"), F.col("filled")), F.lit(0.0)).alias("average_price"), status.alias("status"))


def synthetic_books(bars: DataFrame, levels: int = 5, decay: float = 0.5) -> DataFrame:
    """bars with ``bids`` and ``asks``: level i at steps of (close - low) / levels and (high - close) / levels (0.01 if flat), volume by exp(-decay i)."""
    weight = F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.lit(0.0), lambda a, i: a + F.exp(-decay * i))
    down, up = F.col("close") - F.col("low"), F.col("high") - F.col("close")

    def side(gap: Column, sign: int) -> Column:
        step = F.when(gap > 0, gap / levels).otherwise(0.01)
        return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct((F.col("close") + sign * step * (i + 1)).alias("price"), (F.col("volume") * F.exp(-decay * i) / weight).alias("quantity")))

    return bars.withColumns({"bids": side(down, -1), "asks": side(up, 1)})


@dataclass(frozen=True)
class Venue:
    """Rules of a venue: price tick, lot, fees in basis points, the most an order may be worth, initial margin."""

    tick: float = 0.01
    lot: float = 0.1
    maker_bps: float = 1.0
    taker_bps: float = 2.0
    max_notional: float = 1e6
    margin: float = 1.0

    def price(self, x: Column) -> Column:
        return F.rint(x / self.tick) * self.tick

    def quantity(self, x: Column) -> Column:
        return F.floor(x / self.lot + 1e-9) * self.lot


def replay(orders: DataFrame, prints: DataFrame, venue: Venue | None = None) -> DataFrame:
    """(order_id, quantity, price, fee, status) of orders (order_id, price, quantity, liquidity) against prints (price, quantity).

    Prices go to the tick (half to even), quantities down to the lot; an order fills at most what was printed at its price. Prints
    are summed per tick before they meet orders. Rejected: no notional, too much, or nothing printed.
    """
    v = venue or Venue()
    units = lambda x: F.rint(F.col(x) / v.tick).cast("long")
    placed = orders.select("order_id", "liquidity", units("price").alias("_u"), v.quantity(F.col("quantity")).alias("quantity"))
    placed = placed.withColumn("price", F.col("_u") * v.tick)
    there = prints.filter(F.abs(F.col("price") / v.tick - F.rint(F.col("price") / v.tick)) * v.tick < 1e-9).groupBy(units("price").alias("_u")).agg(F.sum("quantity").alias("_v"))
    out = placed.join(there, "_u", "left").withColumn("_fill", F.least(F.col("quantity"), F.coalesce("_v", F.lit(0.0))))
    value = F.abs(F.col("quantity") * F.col("price"))
    status = F.when(value <= 0, "zero_notional").when(value > v.max_notional, "max_order_notional").when(F.col("_fill") <= 0, "insufficient_liquidity").when(F.col("_fill") == F.col("quantity"), "filled").otherwise("partial")
    out = out.withColumn("status", status)
    done = F.col("status").isin("filled", "partial")
    fee = F.abs(F.col("_fill") * F.col("price")) * F.when(F.col("liquidity") == "maker", v.maker_bps).otherwise(v.taker_bps) / 1e4
    return out.select("order_id", F.when(done, F.col("_fill")).otherwise(0.0).alias("quantity"), "price", F.when(done, fee).otherwise(0.0).alias("fee"), "status")


def order_faults(min_size: float = 0.0) -> Column:
    """The codes of the rules that an order (quantity, order_type, limit_price, stop_price, market_price) breaks."""
    q, kind = F.col("quantity"), F.col("order_type")
    codes = F.array(
        F.when(F.coalesce(q, F.lit(0.0)) <= 0, "invalid_quantity"), F.when(F.coalesce(q, F.lit(0.0)) < min_size, "below_minimum_order_size"),
        F.when((kind == "limit") & F.col("limit_price").isNull(), "limit_price_required"), F.when((kind == "stop") & F.col("stop_price").isNull(), "stop_price_required"),
        F.when(F.coalesce("market_price", F.lit(0.0)) <= 0, "invalid_market_price"),
    )
    return F.filter(codes, lambda x: x.isNotNull())


def executed(orders: DataFrame, min_size: float = 0.0, tick: float = 0.01) -> DataFrame:
    """(order_id, status, filled_quantity, fill_price, reasons) of orders with side, order_type, quantity, limit_price, stop_price, market_price, liquidity.

    Rejected with the codes of the broken rules; pending while a limit is not reached; else filled up to the liquidity at the
    limit or market price on the tick.
    """
    df = orders.withColumn("reasons", order_faults(min_size))
    limited = (F.col("order_type") == "limit") & F.col("limit_price").isNotNull()
    buy = F.lower("side") == "buy"
    waits = limited & F.when(buy, F.col("market_price") > F.col("limit_price") + 1e-9).otherwise(F.col("market_price") < F.col("limit_price") - 1e-9)
    fill = F.least(F.abs("quantity"), F.greatest(F.lit(0.0), F.coalesce("liquidity", F.lit(0.0))))
    price = F.when(limited & (F.col("limit_price") != 0), F.col("limit_price")).otherwise(F.col("market_price"))
    status = F.when(F.size("reasons") > 0, "rejected").when(waits, "pending").when(fill == F.abs("quantity"), "filled").otherwise("partial")
    df = df.withColumn("status", status)
    done = F.col("status").isin("filled", "partial")
    at = F.round(F.rint(price / tick) * tick, 10) if tick else price
    return df.select("order_id", "status", F.when(done, fill).otherwise(0.0).alias("filled_quantity"), F.when(done, at).alias("fill_price"), F.array_join("reasons", ",").alias("reasons"))


def optimized_weights(scores: DataFrame, keys: list[str], ident: str, score: str, volatility: str | None = None, max_gross: float = 1.0, max_position: float = 0.1) -> DataFrame:
    """(keys, ident, weight): scores over volatility as long and short halves of max_gross, each capped and not spread again."""
    v = F.greatest(F.coalesce(volatility, F.lit(1.0)), F.lit(1e-12)) if volatility else F.lit(1.0)
    df = scores.filter(F.col(score).isNotNull()).select(*keys, ident, (F.col(score) / v).alias("_v"))
    part = Window.partitionBy(*keys)
    long, short = F.sum(F.when(F.col("_v") > 0, F.col("_v"))).over(part), F.sum(F.when(F.col("_v") < 0, -F.col("_v"))).over(part)
    w = F.when(F.col("_v") > 0, F.least(F.lit(max_position), F.try_divide(F.col("_v"), long) * (max_gross / 2)))
    return df.select(*keys, ident, w.when(F.col("_v") < 0, F.greatest(F.lit(-max_position), F.try_divide(F.col("_v"), short) * (max_gross / 2))).otherwise(0.0).alias("weight"))


def risk_clamped(quantity: Column, equity: Column, price: Column, fraction: float = 1.0, leverage: float = 1.0, most: float = 1e9) -> Column:
    """quantity within what equity, leverage and the fraction at risk allow; 0 without equity."""
    cap = F.least(F.coalesce(F.try_divide(equity * fraction * leverage, price), F.lit(0.0)), F.lit(most))
    return F.when(equity <= 0, 0.0).otherwise(F.greatest(-cap, F.least(cap, quantity)))


def liquidated(equity: Column, margin: Column, threshold: float = 0.5) -> Column:
    return (equity <= 0) | F.coalesce(F.try_divide(equity, margin) < threshold, F.lit(False))


def stress(curves: DataFrame, bars: DataFrame, execution=None, keys: tuple[str, ...] = ("symbol",), order: str = "bar_idx") -> DataFrame:
    """(keys, baseline_sharpe, microstructure_sharpe, baseline_drawdown, microstructure_drawdown, trades_simulated, fill_rate, passed): a backtest
    whose position changes are filled against a synthetic book around each close.

    A side of the book has max(1, volume / 4) at half the execution's spread from the close and twice that at three halves. A bar's return is what
    the position held earned, less, where it changed, the distance of the fill's average price from the close and the commission. Changes are
    at most 2 units, which the two levels always hold, so every order fills. passed: a Sharpe ratio above 0 and a drawdown of at most one and a half times the baseline's, or 0.01.
    """
    from tickforge.operators.backtest import Execution, metrics, with_equity

    ex, keys = execution or Execution(), list(keys)
    j = curves.drop("volume").join(bars.select("symbol", order, "volume"), ["symbol", order])
    h, q = ex.spread_bps / 2e4, F.col("turn").cast("double")
    near = F.least(q, F.greatest(F.lit(1.0), 0.25 * F.col("volume")))
    slip = F.try_divide(near * h + (q - near) * 3 * h, q)
    traded = q > 0
    j = j.withColumn("_micro", F.when(F.col(order) > 0, F.col("ret") + F.col("cost") - F.when(traded, slip + ex.commission_bps / 1e4).otherwise(0.0)).otherwise(0.0))
    micro = with_equity(j.withColumns({"ret": F.col("_micro"), "cost": F.lit(0.0)}).drop("equity"), keys, order)
    name = lambda df, kind: metrics(df, keys, order).select(*keys, F.col("sharpe").alias(f"{kind}_sharpe"), F.col("max_drawdown").alias(f"{kind}_drawdown"), F.col("trades").alias(f"_{kind}"))
    out = name(curves, "baseline").join(name(micro, "microstructure"), keys)
    fine = (F.col("microstructure_sharpe") > 0) & (F.col("microstructure_drawdown") <= F.greatest(F.lit(0.01), 1.5 * F.col("baseline_drawdown")))
    return out.select(
        *keys, "baseline_sharpe", "microstructure_sharpe", "baseline_drawdown", "microstructure_drawdown", F.col("_baseline").alias("trades_simulated"),
        F.when(F.col("_baseline") > 0, 1.0).otherwise(0.0).alias("fill_rate"), fine.alias("passed"),
    )
