"""Implausible readings: impossible, crossed, stuck and spiking values, relative to what is normal for their source and hour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from tickforge.operators.shards import SALTS, TARGET_ROWS, assign_shards, salted
from tickforge.session import BROADCAST_ROWS, materialize, micros

#: Usable values on either side that give the level around a value, and how far the nearest unsuspected value may be.
NEAR, REACH = 5, 8
#: Size parameter of the quantile sketches: about 0.7 % of error in rank.
SKETCH_K = 400
#: Values that an hour of a key needs for fences of its own; with fewer those over all hours stand.
LEAST = 20


def _level(v: np.ndarray, after: bool) -> np.ndarray:
    """Lower median of the up to NEAR values before (after) each position of v; NaN where there are none."""
    n = len(v)
    if not n:
        return v
    padded = np.concatenate([np.full(NEAR, np.nan), v, np.full(NEAR, np.nan)])
    view = np.lib.stride_tricks.sliding_window_view(padded, NEAR)
    near = np.sort(view[NEAR + 1 : NEAR + 1 + n] if after else view[:n], axis=1)  # NaN goes last
    have = np.minimum(np.arange(n)[::-1] if after else np.arange(n), NEAR)
    return near[np.arange(n), np.maximum((have - 1) // 2, 0)]


def _off(v: np.ndarray, p: np.ndarray, q: np.ndarray, up, down) -> np.ndarray:
    """Where v is off both p and q on the same side, by more than up above them or down below them, relatively."""
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = v / p - 1, v / q - 1
        return ((a > up) & (b > up)) | ((a < -down) & (b < -down))


def _jumps(v: np.ndarray, up: np.ndarray, down: np.ndarray, limit: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(suspects, jumps) among the positive values v: suspects lie outside the fences up and down around the medians of the values before and
    after; of these and the others, jumps are off the nearest unsuspected values on both sides by more than limit, for at most ``most``
    successive values. So two faults near each other, or one beside a lasting change of level, are each judged by true neighbours.
    """
    n = len(v)
    if not n or not np.isfinite(limit):
        return np.zeros(n, bool), np.zeros(n, bool)
    first = _off(v, _level(v, False), _level(v, True), up, down)
    at = np.arange(n)
    back = np.concatenate([[-1], np.maximum.accumulate(np.where(first, -1, at))[:-1]])
    ahead = np.concatenate([np.minimum.accumulate(np.where(first, n, at)[::-1])[::-1][1:], [n]])
    ends = np.append(v, np.nan)
    p = np.where((back >= 0) & (at - back <= REACH), ends[back], np.nan)
    q = np.where(ahead - at <= REACH, ends[ahead], np.nan)
    found = _off(v, p, q, limit, limit)
    return first, found & (_run_lengths(found) <= most)


def _run_lengths(x: np.ndarray) -> np.ndarray:
    """For each position the length of the run of equal successive values it belongs to (NaN equals nothing)."""
    if not len(x):
        return np.zeros(0, int)
    new = np.concatenate([[True], x[1:] != x[:-1]])
    run = np.cumsum(new) - 1
    return np.bincount(run)[run]


def _fences(stats: pd.DataFrame, field: str, hour: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) for each hour given: the quartiles of its hour, widened; of all hours where its own are few."""
    q1, q3 = np.full(24, np.nan), np.full(24, np.nan)
    if len(stats):
        row = stats.iloc[0]
        q1[:], q3[:] = row[f"_q1_{field}"], row[f"_q3_{field}"]
        for h in row["_hours"]:
            h = h if isinstance(h, dict) else h.asDict()
            if h[f"_n_{field}"] >= LEAST:
                q1[h["_hour"]], q3[h["_hour"]] = h[f"_q1_{field}"], h[f"_q3_{field}"]
    return (q1 - width * (q3 - q1))[hour], (q3 + width * (q3 - q1))[hour]


def _checker(prices: list[str], volume: str, factor: float, stuck: int, most: int, width: float):
    fields = [*prices, volume]

    def check(bars: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("_us", kind="stable")
        us, own = bars["_us"].to_numpy(), ~bars["_halo"].to_numpy(bool)
        ids, lone = bars["_rid"].to_numpy(), bars["_lone"].to_numpy(bool)
        hour = (us // 3_600_000_000) % 24
        out = []
        for f in fields:
            v, null = bars[f].to_numpy(float), bars[f"_null_{f}"].to_numpy(bool)
            still = ~null & (_run_lengths(v) >= stuck)
            mid = float(stats[f"_mid_{f}"].iloc[0]) if len(stats) and stats[f"_mid_{f}"].iloc[0] is not None else np.nan
            limit = factor * mid
            low, high = _fences(stats, f, hour, width)
            # fences may be tighter than the limit, but no looser, and where readings hardly vary no tighter than half of it
            upper = np.fmin(np.fmax(high, limit / 2), limit)
            if f == volume:
                top = bars["_top"].to_numpy(float)
                with np.errstate(invalid="ignore"):
                    beyond = (top > upper) | (v < low)
                    over = v > limit
                # a row of its own is judged here, those of a bar of several rows each by their own value
                beyond &= ~lone | (v < np.inf)
                found = {"stuck": (still, v), "volume": (beyond & (over | ~lone), np.full(len(v), limit)), "fence": (beyond & lone & ~over, v)}
            else:
                ok = np.flatnonzero(~null & np.isfinite(v) & (v > 0))
                lower = np.fmin(np.fmax(-low, limit / 2), limit)
                suspect, jump = np.zeros(len(v), bool), np.zeros(len(v), bool)
                suspect[ok], jump[ok] = _jumps(v[ok], upper[ok], lower[ok], limit, most)
                x = np.full(len(v), np.nan)
                x[ok[1:]] = v[ok[1:]] / v[ok[:-1]] - 1
                with np.errstate(invalid="ignore"):
                    beyond = suspect | (x > upper) | (x < -lower)
                found = {"stuck": (still, v), "jump": (jump & beyond, v), "fence": (beyond, v)}
            for reason, (at, value) in found.items():
                at = at & own
                if at.any():
                    out.append(pd.DataFrame({"_us": us[at], "field_name": f, "reason": reason, "_value": value[at], "_rid": ids[at], "_lone": lone[at]}))
        if not out:
            none = pd.DataFrame({"_k": [], "_us": [], "field_name": [], "reason": [], "_value": [], "_rid": [], "_lone": []}, dtype=object)
            return none.astype({"_us": "int64", "_value": float, "_rid": bars["_rid"].dtype, "_lone": bool})
        return pd.concat(out).assign(_k=bars["_k"].iloc[0]).astype({"_k": object, "field_name": object, "reason": object})

    return check


def _edges(fields: list[str], volume: str, reach: int, bars: int):
    """The bars of a shard that its neighbours may need: of each field the first and last ``reach`` usable ones, and the first and last ``bars`` of all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us", kind="stable")
        keep = np.zeros(len(pdf), bool)
        for f in (*fields, None):
            v = pdf[f].to_numpy(float) if f else None
            with np.errstate(invalid="ignore"):
                ok = np.flatnonzero(np.isfinite(v) & ((v > 0) | (f == volume))) if f else np.arange(len(pdf))
            n = reach if f else bars
            keep[ok[:n]] = keep[ok[max(0, len(ok) - n) :]] = True
        return pdf[keep]

    return run


def _spread(fields: list[str], volume: str, reach: int, bars: int):
    """From the edges of all shards of a key, the halo bars of each of its shards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us", kind="stable").reset_index(drop=True)
        shard, n = pdf["_shard"].to_numpy(), len(pdf)
        shards, start = np.unique(shard, return_index=True)
        end = np.append(start[1:], n)
        usable = []
        for f in (*fields, None):
            v = pdf[f].to_numpy(float) if f else None
            with np.errstate(invalid="ignore"):
                usable.append((np.flatnonzero(np.isfinite(v) & ((v > 0) | (f == volume))) if f else np.arange(n), reach if f else bars))
        parts = []
        for s, a, b in zip(shards, start, end, strict=True):
            near = set()
            for ok, m in usable:
                i, j = np.searchsorted(ok, [a, b])
                near.update(ok[max(0, i - m) : i], ok[j : j + m])
            parts.append(pdf.iloc[sorted(near)].assign(_shard=s))
        return pd.concat(parts).assign(_halo=True).astype({"_k": object})

    return run


def _with_halo(bars: DataFrame, fields: list[str], volume: str, reach: int, near: int) -> DataFrame:
    """With the bars of split keys once more as the halo of other shards: whatever lies between (missing values, bars delivered again), a shard sees
    ``reach`` usable values of every field and ``near`` bars beyond either end."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    edges = bars.filter("_shard > 0").drop("_halo").groupBy("_k", "_shard").applyInPandas(_edges(fields, volume, reach, near), ddl.replace(", `_halo` boolean", ""))
    return bars.unionByName(materialize(edges.groupBy("_k").applyInPandas(_spread(fields, volume, reach, near), ddl), "halo"))


def _stats(bars: DataFrame, prices: list[str], volume: str) -> DataFrame:
    """(_k, _hours, quartiles and usual sizes) from sketches per key, shard and hour, merged over shards and hours.

    For prices of the change from the last usable value, for the volume of its values (never above a bar's largest; asking for both columns, and for
    ``_last``, keeps the exchange the same as the check's). A key that is not cut lies in one task, which takes its quartiles at once: only the
    sketches of cut keys are sent on."""
    fields = [*prices, volume]
    w = Window.partitionBy("_k", "_shard").orderBy("_us").rowsBetween(Window.unboundedPreceding, -1)
    fine = lambda f, low: F.when(low & (F.col(f) < float("inf")) & ~F.isnan(f), F.col(f))
    before = {f"_b_{f}": F.last(fine(f, F.col(f) > 0), ignorenulls=True).over(w) for f in prices}
    change = {f"_x_{f}": F.try_divide(fine(f, F.col(f) > 0), F.col(f"_b_{f}")) - 1 for f in prices} | {f"_x_{volume}": fine(volume, (F.col(volume) >= 0) & (F.col("_top") >= F.col(volume)))}
    steps = bars.withColumns(before).withColumns(change).filter("not _halo").withColumn("_hour", F.expr("cast(pmod(_us - pmod(_us, 3600000000), 86400000000) div 3600000000 as int)"))
    k, last = F.lit(SKETCH_K), F.max("_last").alias("_last")
    sketch = steps.groupBy("_k", "_shard", "_hour").agg(
        *[F.kll_sketch_agg_double(F.col(f"_x_{f}"), k).alias(f"_c_{f}") for f in fields], *[F.kll_sketch_agg_double(F.abs(f"_x_{f}"), k).alias(f"_m_{f}") for f in prices], F.max(F.when(F.col("_lone"), F.col("_rid"))).alias("_last")
    )
    changes, sizes = [f"_c_{f}" for f in fields], [f"_m_{f}" for f in prices]

    def at(name: str, q: float):
        return F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_quantile_double(name, F.lit(q)))

    told = {f"_n_{f}": F.kll_sketch_get_n_double(f"_c_{f}") for f in fields} | {f"_q{i}_{f}": at(f"_c_{f}", q) for f in fields for i, q in ((1, 0.25), (3, 0.75))}
    usual = {f"_mid_{f}": at(f"_m_{f}" if f in prices else f"_c_{f}", 0.5) for f in fields}
    cut = F.col("_shard") > 0

    def part(hour: Column, whole: bool) -> Column:
        """An hour (-1: all of them) of a key and shard: of a cut key its sketches, else what they tell."""
        sent = [F.when(cut & F.lit(whole or c in changes), F.col(c)).alias(c) for c in (*changes, *sizes)]
        return F.struct(hour.cast("int").alias("_hour"), *sent, *[F.when(~cut, x).alias(n) for n, x in told.items()], *[F.when(~cut & F.lit(whole), x).alias(n) for n, x in usual.items()])

    merged = [F.kll_merge_agg_double(c).alias(c) for c in (*changes, *sizes)]
    local = sketch.groupBy("_k", "_shard").agg(F.collect_list(part(F.col("_hour"), False)).alias("_parts"), *merged, last)
    each = local.select("_k", "_last", F.inline(F.concat("_parts", F.array(part(F.lit(-1), True)))))
    hours = each.groupBy("_k", "_hour").agg(*merged, *[F.max(n).alias(n) for n in (*told, *usual)], last)
    hours = hours.select("_k", "_hour", "_last", *[F.coalesce(n, x).alias(n) for n, x in (told | usual).items()])
    whole = lambda n: F.max(F.when(F.col("_hour") < 0, F.col(n))).alias(n)
    return hours.groupBy("_k").agg(F.collect_list(F.when(F.col("_hour") >= 0, F.struct("_hour", *told))).alias("_hours"), *[whole(n) for n in (*told, *usual) if not n.startswith("_n_")], last)


def flag_implausible(df: DataFrame, key: str = "symbol", ts: str = "ts", row_id: str = "row_id", prices: tuple[str, ...] = ("open_px", "high_px", "low_px"),
                     volume: str = "volume", low: str = "low_px", high: str = "high_px", factor: float = 40.0, stuck: int = 8, most: int = 3,
                     fence: float = 12.0, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(row_id, field_name, reason): one row per reading and reason.

    Reasons: ``impossible`` (NaN, infinite, a price not above 0, a negative volume), ``crossed`` (high below low; both fields),
    ``stuck`` (the same value for ``stuck`` or more successive bars: no variance), ``jump`` (outside the fences, and off the level of the
    bars before and after, on the same side, by more than factor times the usual change, for at most ``most`` bars), ``volume`` (outside the
    fences and above factor times the usual volume) and ``fence`` (outside the fences but neither: advice, since it also marks lasting changes).

    The fences of a key and hour of day are the quartiles of the changes from the last usable value, or of the volumes, widened by
    ``fence`` interquartile ranges, from sketches per key, shard and hour that are merged over partitions; fences never pass the limit
    of the reason they serve, nor half of it where readings hardly vary. Rows with equal key and ts are one bar, whose value is that
    of its least row_id that is not null; they are combined before the shuffle. Null readings are never flagged and end a stuck run; rows without
    key or ts are left out; keys with too few bars for a usual change have no ``jump``; an empty table gives no rows. A key
    with more than target_rows rows is checked in time shards, each with as many usable values of its neighbours as its checks reach.
    """
    fields = [*prices, volume]
    rows = df.select(
        F.col(key).alias("_k"), micros(ts).alias("_us"), F.col(row_id).alias("_id"), *[F.col(f).cast("double").alias(f) for f in fields]
    ).filter("_k is not null and _us is not null")
    cut, split = assign_shards(rows, ["_k"], "_us", target_rows)
    finite = (F.col(volume) < float("inf")) & ~F.isnan(volume)
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_id"))).alias(f) for f in fields]
    # a bar of one row carries its row_id, so that what is found needs no join to be told of the row
    kind = rows.schema["_id"].dataType
    carried = isinstance(kind, (IntegralType, StringType))
    rid = F.coalesce(F.min("_id"), F.lit("0").cast(kind)) if carried else F.lit("")
    lone = (F.count(F.lit(1)) == 1) & (F.count("_id") == 1) & F.lit(carried)
    bars = cut.groupBy("_k", "_us", "_shard").agg(*first, F.max(F.when(finite, F.col(volume))).alias("_top"), rid.alias("_rid"), lone.alias("_lone")).withColumn("_halo", F.lit(False))
    if split:  # made once, for their halos and the check
        own = materialize(bars, "bars")
        bars = _with_halo(own, fields, volume, NEAR + REACH + most, stuck - 1)
    # one exchange that the sketches and the check share, for which both need the same filter
    bars = bars.filter("_k is not null and _shard is not null").repartition("_k", "_shard")
    stats = _stats(bars, list(prices), volume)
    seen = bars.withColumns({f"_null_{f}": F.isnull(f) for f in fields})
    if split:
        stats = own.select("_k", "_shard").distinct().join(stats, "_k")
    else:
        stats = stats.withColumn("_shard", F.lit(0))
    stats = stats.select(*[F.col(c).alias(c) for c in stats.columns])  # columns of their own, as both sides of the cogroup come from rows
    check = _checker(list(prices), volume, factor, stuck, most, fence)
    key_type = rows.schema["_k"].dataType.simpleString()
    found = seen.groupBy("_k", "_shard").cogroup(stats.groupBy("_k", "_shard")).applyInPandas(
        check, f"_k {key_type}, _us bigint, field_name string, reason string, _value double, _rid {bars.schema['_rid'].dataType.simpleString()}, _lone boolean"
    )
    found = materialize(found, "flagged")
    told = found.filter("_lone").select(F.col("_rid").cast(kind).alias("_id"), "field_name", "reason")
    # back to the rows of the flagged bars that have several
    found = found.filter("not _lone").drop("_rid", "_lone")
    value = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f)) for f in fields])
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hit = rows.join(F.broadcast(found), ["_k", "_us"])
    else:
        n = SALTS if split else 1
        hit = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")).join(salted(found, n), ["_k", "_us", "_salt"])
    over = (F.col("reason") == "volume") & finite & (value > F.col("_value"))
    same = (F.col("reason") != "volume") & (value == F.col("_value"))
    hit = hit.filter(value.isNotNull() & ((F.col("reason") == "volume") & finite | same))
    hit = hit.select("_id", "field_name", F.when(over | same, F.col("reason")).otherwise("fence").alias("reason"))
    wrong = lambda f: F.isnan(f) | (F.col(f) == float("inf")) | ((F.col(f) < 0) if f == volume else (F.col(f) <= 0))
    crossed = (F.col(high) < F.col(low)) & ~F.isnan(high) & ~F.isnan(low)
    plain = [*[F.when(F.col(f).isNotNull() & wrong(f), F.struct(F.lit(f).alias("field_name"), F.lit("impossible").alias("reason"))) for f in fields],
            *[F.when(crossed, F.struct(F.lit(f).alias("field_name"), F.lit("crossed").alias("reason"))) for f in (low, high)]]
    alone = rows.select("_id", F.explode(F.filter(F.array(*plain), lambda x: x.isNotNull())).alias("_t")).select("_id", "_t.*")
    return told.unionByName(hit).unionByName(alone).select(F.col("_id").alias(row_id), "field_name", "reason")
