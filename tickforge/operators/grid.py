"""Irregular readings onto a regular grid, with shape-preserving monotone cubic interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators.shards import TARGET_ROWS, assign_shards, with_halo
from tickforge.session import broadcast_if_small, micros

#: Periods generated from one row at a time, so that no array grows with the gap.
CHUNK = 4096


def _inner_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Slope at a knot between two pieces: 0 at an extremum, else the weighted harmonic mean of both secants."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Three-point slope at the first or last knot of a segment, limited so that the shape is kept."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(s) != F.signum(d0), F.lit(0.0)).when((F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def regular_grid(readings: DataFrame, specs: DataFrame, key: str = "symbol", ts: str = "ts", value: str = "close_px", tie: str = "row_id",
                 step: str = "bar_seconds", session: str = "session_kind", max_gap_s: int = 30 * 86400, max_fill: int = 1440, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(key, slot_s, status, value, run_periods): one row per period of each key between its first and last reading.

    Period k is [k*step, (k+1)*step) seconds since 1970 UTC and slot_s = k*step. A reading has key, ts and a finite value;
    several readings in a period: the latest by (ts, tie) stands. status: ``observed``; ``filled`` (interpolated over at most
    max_fill empty periods); ``marked`` (more of them: value null); ``closed`` (an empty period that starts on a Saturday or
    Sunday with session 'weekday'); ``long_gap`` (one row for all empty periods between readings more than max_gap_s apart,
    their number in run_periods, else 1). A long gap ends a segment, and no slope reaches across it.
    Keys that specs lacks, or whose step is null or not positive, have no period length and so no grid; of several steps the least counts. Null keys, times and
    values are no readings; empty tables give no rows; further columns are ignored.
    """  # noqa: E501
    steps = specs.select(F.col(key).alias("_k"), F.col(step).cast("long").alias("_step"), F.col(session).alias("_session")).filter("_k is not null and _step > 0")
    steps = steps.groupBy("_k").agg(F.min("_step").alias("_step"), F.min("_session").alias("_session"))
    base = readings.select(F.col(key).alias("_k"), micros(ts).alias("_us"), F.col(tie).alias("_tie"), F.col(value).cast("double").alias("_y"))
    base = base.filter("_k is not null and _us is not null and _y is not null and not isnan(_y) and abs(_y) < double('Infinity')").join(broadcast_if_small(steps), "_k")
    base = base.withColumn("_p", F.expr("(_us - pmod(_us, _step * 1000000)) div (_step * 1000000)"))
    base, split = assign_shards(base, ["_k"], "_p", target_rows)  # by readings, before they are combined
    rows = base.groupBy("_k", "_step", "_session", "_p", "_shard").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max(F.struct("_us", "_tie", "_y"))["_y"].alias("_y"))
    rows = with_halo(rows, ["_k"], ["_p"], before=1, after=2, split=split)
    w = Window.partitionBy("_k", "_shard").orderBy("_p")
    far = max_gap_s * 1_000_000
    rows = rows.withColumns({
        "_p0": F.lag("_p").over(w), "_y0": F.lag("_y").over(w), "_l0": F.lag("_last").over(w),
        "_p2": F.lead("_p").over(w), "_y2": F.lead("_y").over(w), "_f2": F.lead("_first").over(w), "_l2": F.lead("_last").over(w),
        "_p3": F.lead("_p", 2).over(w), "_y3": F.lead("_y", 2).over(w), "_f3": F.lead("_first", 2).over(w),
    }).filter("not _halo")
    rows = rows.withColumns({
        "_long": F.coalesce(F.col("_f2") - F.col("_last") > far, F.lit(False)),
        "_n": F.coalesce(F.col("_p2") - F.col("_p") - 1, F.lit(0)),
        "_left": (F.col("_first") - F.col("_l0")) <= far,
        "_right": (F.col("_f3") - F.col("_l2")) <= far,
    })
    h0, h1, h2 = (F.col("_p") - F.col("_p0")).cast("double"), (F.col("_p2") - F.col("_p")).cast("double"), (F.col("_p3") - F.col("_p2")).cast("double")
    d0, d1, d2 = (F.col("_y") - F.col("_y0")) / h0, (F.col("_y2") - F.col("_y")) / h1, (F.col("_y3") - F.col("_y2")) / h2
    left, right = F.coalesce("_left", F.lit(False)), F.coalesce("_right", F.lit(False))
    rows = rows.withColumns({
        "_s1": F.when(left, _inner_slope(h0, h1, d0, d1)).when(right, _end_slope(h1, h2, d1, d2)).otherwise(d1),
        "_s2": F.when(right, _inner_slope(h1, h2, d1, d2)).when(left, _end_slope(h1, h0, d1, d0)).otherwise(d1),
    })
    one = F.lit(1).cast("long")
    parts = F.when(F.col("_long") & (F.col("_n") > 0), F.array(F.struct((F.col("_p") + 1).alias("a"), F.col("_n").alias("n"))))
    parts = parts.when(F.col("_n") > 0, F.transform(F.sequence(F.col("_p") + 1, F.col("_p2") - 1, F.lit(CHUNK).cast("long")), lambda a: F.struct(a.alias("a"), F.least(F.lit(CHUNK).cast("long"), F.col("_p2") - a).alias("n"))))
    parts = F.concat(F.array(F.struct(F.col("_p").alias("a"), one.alias("n"))), F.coalesce(parts, F.array().cast("array<struct<a:bigint,n:bigint>>")))
    rows = rows.withColumn("_part", F.explode(parts))
    lone = F.col("_long") & (F.col("_part.a") > F.col("_p"))
    slots = rows.withColumn("_gap", lone).withColumn("_slot", F.explode(F.when(lone, F.array("_part.a")).otherwise(F.sequence(F.col("_part.a"), F.col("_part.a") + F.col("_part.n") - 1))))
    day = F.expr("pmod((_slot * _step - pmod(_slot * _step, 86400)) div 86400 + 4, 7)")  # 0 is Sunday
    status = (
        F.when(F.col("_slot") == F.col("_p"), "observed").when(F.col("_gap"), "long_gap")
        .when((F.col("_session") == "weekday") & day.isin(0, 6), "closed").when(F.col("_n") <= max_fill, "filled").otherwise("marked")
    )
    t = (F.col("_slot") - F.col("_p")) / h1
    cubic = F.col("_y") * (1 + 2 * t) * (1 - t) * (1 - t) + h1 * F.col("_s1") * t * (1 - t) * (1 - t) + F.col("_y2") * t * t * (3 - 2 * t) + h1 * F.col("_s2") * t * t * (t - 1)
    return slots.withColumn("status", status).select(
        F.col("_k").alias(key), (F.col("_slot") * F.col("_step")).alias("slot_s"), "status",
        F.when(F.col("status") == "observed", F.col("_y")).when(F.col("status") == "filled", cubic).alias("value"),
        F.when(F.col("status") == "long_gap", F.col("_n")).otherwise(one).alias("run_periods"),
    )
