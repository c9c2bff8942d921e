"""Point-in-time views, universes, back-adjustment and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators.asof import as_of, versions
from tickforge.operators.shards import TARGET_ROWS, assign_shards, carry
from tickforge.session import broadcast_if_small, micros


def visible(rows: DataFrame, ts: str, available: str, as_of_time: str | None) -> DataFrame:
    """The rows known at as_of_time: available, or where that is null ts, is not after it. None: all rows. NaN, like null, is missing and comes out as null."""
    fine = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in rows.dtypes if t in ("double", "float")})
    return fine if as_of_time is None else fine.filter(F.coalesce(available, ts) <= F.lit(as_of_time).cast(rows.schema[ts].dataType))


def universe(members: DataFrame, dates: DataFrame, date: str = "as_of", key: str = "symbol", start: str = "included_at", end: str = "excluded_at") -> DataFrame:
    """(date, key): the memberships in force at each date, not de-duplicated; start <= date < end, null end open. Few dates, checked."""
    if dates.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 dates; join them by ranges of time")
    on = (F.col(start) <= F.col(date)) & (F.col(end).isNull() | (F.col(end) > F.col(date)))
    return members.select(key, start, end).join(F.broadcast(dates.select(date)), on).select(date, key)


def universe_faults(members: DataFrame, start: str = "included_at", end: str = "excluded_at") -> DataFrame:
    """The memberships that end no later than they start."""
    return members.filter(F.col(end) <= F.col(start))


def back_adjusted(rows: DataFrame, actions: DataFrame, prices: list[str], ident: str, key: str = "symbol", ts: str = "ts", effective: str = "effective_at",
                  action_id: str = "action_id", split: str = "split_factor", dividend: str = "cash_dividend", target_rows: int = TARGET_ROWS) -> DataFrame:
    """rows (those with key and ts) with each price adjusted for the actions after it: from the newest back, divided by the split, less the dividend.

    The composition of all actions after an instant is an affine map whose parts are prefix products and sums over the actions of
    the key, so a row needs only the number of the last action not after it: one as-of join, and no pairs. Null factors
    are 1, null dividends 0; NaN as null; actions of one instant apply from the largest id back.
    """
    fine = lambda c, d: F.when(F.col(c).isNull() | F.isnan(F.col(c)), d).otherwise(F.col(c))
    acts = actions.filter(F.col(key).isNotNull() & F.col(effective).isNotNull()).select(F.col(key).alias("_k"), F.col(effective).alias("_eff"), F.col(action_id).cast("long").alias("_aid"), fine(split, 1.0).alias("_s"), fine(dividend, 0.0).alias("_d"))
    w = Window.partitionBy("_k").orderBy("_eff", "_aid")
    up_to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    acts = acts.withColumns({"_P": F.product(1 / F.col("_s")).over(up_to), "_Pb": F.coalesce(F.product(1 / F.col("_s")).over(before), F.lit(1.0))})
    acts = acts.withColumn("_C", F.sum(F.col("_d") * F.col("_Pb")).over(up_to))
    whole = acts.groupBy("_k").agg(F.max_by("_P", F.struct("_eff", "_aid")).alias("_Pn"), F.sum(F.col("_d") * F.col("_Pb")).alias("_T"))
    past = as_of(rows, ident, F.col(key), ts, {"a": versions(acts, "_k", "_aid", "_eff", "_eff")}, target_rows).select(F.col(ident).alias("_row"), F.col("ref_id").alias("_aid"))
    past = past.join(broadcast_if_small(acts.select("_aid", "_P", "_C")), "_aid").select("_row", "_P", "_C")
    out = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).join(past, F.col(ident) == F.col("_row"), "left").join(broadcast_if_small(whole), F.col(key) == F.col("_k"), "left")
    pk, ck = F.coalesce("_P", F.lit(1.0)), F.coalesce("_C", F.lit(0.0))
    done = {p: F.when(F.col("_k").isNull(), F.col(p)).otherwise((F.col(p) * F.col("_Pn") - (F.col("_T") - ck)) / pk) for p in prices}
    return out.withColumns(done).select(rows.columns)


def reconcile(internal: DataFrame, external: DataFrame, key: str = "symbol", quantity: str = "quantity") -> DataFrame:
    """(key, internal, external, matched): positions of both sides in a full join; missing is 0; equal to 1e-6 relatively or 1e-8."""
    a = internal.groupBy(key).agg(F.sum(quantity).alias("internal"))
    b = external.groupBy(key).agg(F.sum(quantity).alias("external"))
    out = a.join(b, key, "full").select(key, F.coalesce("internal", F.lit(0.0)).alias("internal"), F.coalesce("external", F.lit(0.0)).alias("external"))
    gap = F.abs(F.col("internal") - F.col("external"))
    return out.withColumn("matched", gap <= F.greatest(1e-6 * F.greatest(F.abs("internal"), F.abs("external")), F.lit(1e-8)))


def marked(positions: DataFrame, prices: DataFrame, cash: float, key: str = "symbol", quantity: str = "quantity", price: str = "price") -> DataFrame:
    """(equity): cash and the value of the positions that have a price."""
    return positions.join(prices, key).agg((F.lit(cash) + F.coalesce(F.sum(F.col(quantity) * F.col(price)), F.lit(0.0))).alias("equity"))


def ledger(trades: DataFrame, ident: str = "fill_id", key: str = "symbol", ts: str = "ts", side: str = "side", price: str = "price", quantity: str = "quantity", fee: str = "fee", target_rows: int = TARGET_ROWS) -> DataFrame:
    """(ident, key, position, cash_flow): each trade's running position of its key, and what it pays or earns after its fee. Keys with more
    than target_rows trades are summed in shards, with the sum of those ahead carried in."""
    signed = F.when(F.col(side) == "sell", -F.col(quantity)).otherwise(F.col(quantity))
    rows = trades.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(ident, key, micros(ts).alias("_us"), F.coalesce(signed, F.lit(0.0)).alias("_q"), F.coalesce(F.col(price), F.lit(0.0)).alias("_p"), F.coalesce(F.col(fee), F.lit(0.0)).alias("_f"))
    rows, split = assign_shards(rows.withColumn("_tie", F.col(ident).cast("long")), [key], "_us", target_rows, "_tie")
    w = Window.partitionBy(key, "_shard").orderBy("_us", ident).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("position", F.sum("_q").over(w))
    if split:
        ahead = carry(rows, [key], {"_ahead": F.sum("_q")}, F.sum)
        rows = rows.join(broadcast_if_small(ahead, 10_000), [key, "_shard"], "left").withColumn("position", F.col("position") + F.coalesce("_ahead", F.lit(0.0)))
    return rows.select(ident, key, "position", (-(F.col("_q") * F.col("_p")) - F.col("_f")).alias("cash_flow"))
