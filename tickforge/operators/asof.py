"""Attributes as known at event time: bitemporal versions joined to events without anything that became known later."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators.shards import TARGET_ROWS, assign_shards, carry
from tickforge.session import broadcast_if_small, materialize, micros


def versions(df: DataFrame, key: str, ident: str, time: str, known: str, until: str | None = None) -> DataFrame:
    """(_k, _at, _t, _known, _until, _id): _at is the instant from which a version is both in force and known.

    Versions without key or time count for nothing; null known means known at its time.
    """
    t = micros(time)
    seen = F.coalesce(micros(known), t)
    end = F.coalesce(micros(until), F.lit(None).cast("long")) if until else F.lit(None).cast("long")
    out = df.select(F.col(key).alias("_k"), F.greatest(t, seen).alias("_at"), t.alias("_t"), seen.alias("_known"), end.alias("_until"), F.col(ident).alias("_id"))
    out = out.filter("_k is not null and _t is not null")
    return out.filter("_until is null or _until > _at") if until else out


def _best_over(starts: np.ndarray, ends: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions the largest rank of the spans [start, end) over it, 0 where there is none.

    A span goes to the at most two nodes per level of a binary tree that make it up; then every node hands its rank down.
    """
    width = 1 << max(1, int(n - 1).bit_length())
    tree = np.zeros(2 * width, np.int64)
    lo, hi = starts + width, ends + width
    while (open_ := lo < hi).any():
        for at, odd in ((lo, open_ & (lo & 1 == 1)), (hi - 1, open_ & (hi & 1 == 1))):
            np.maximum.at(tree, at[odd], rank[odd])
        lo, hi = (lo + 1) >> 1, hi >> 1
    level = 1
    while level < width:
        tree[2 * level : 4 * level] = np.maximum(tree[2 * level : 4 * level], np.repeat(tree[level : 2 * level], 2))
        level *= 2
    return tree[width : width + n]


def _swept(points: pa.Table) -> pa.RecordBatch:
    """Sorted endpoints of whole (key, shard) groups in, for each group the best live version after each instant out (null: none), where it changes."""
    keys = points.column("_k").combine_chunks()
    shard, when, t, known, ident = (points.column(c).to_numpy() for c in ("_shard", "_when", "_t", "_known", "_id"))
    begins, n = points.column("_starts").to_numpy(zero_copy_only=False), len(keys)
    other = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (shard[1:] != shard[:-1])
    group = np.concatenate([[0], np.cumsum(other)])
    close = np.append(np.flatnonzero(other) + 1, n)[group]  # where the group of a point ends
    # of each start the next end of the same version in its group
    by = np.lexsort((np.arange(n), ident, group))
    same = np.append((group[by][1:] == group[by][:-1]) & (ident[by][1:] == ident[by][:-1]), False)
    stop = np.where(begins[by], n, by)
    last = np.flatnonzero(~same)
    floor = np.searchsorted(last, np.arange(n)) * (n + 1)  # so that the minimum from behind never reaches into another version
    ahead = np.minimum.accumulate((stop + floor)[::-1])[::-1] - floor
    end = np.empty(n, np.int64)
    end[by] = ahead
    end = np.minimum(end, close)
    order = np.lexsort((ident, known, t))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(1, n + 1)
    best = _best_over(np.flatnonzero(begins), end[begins], rank[begins], n)
    told = np.flatnonzero(np.append(other | (when[1:] != when[:-1]), True))  # the last point of each instant
    best, of = best[told], group[told]
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (of[1:] != of[:-1])])
    told, best = told[new], best[new]
    found = pa.array(ident[order][np.maximum(best, 1) - 1], pa.int64(), mask=best == 0)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(told)), pa.array(shard[told]), pa.array(when[told]), found], ["_k", "_shard", "_at", "_id"])


def _sweep(batches):
    """_swept over the whole groups of a partition; what is held is a batch and a group."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        n = len(table)
        if not n:
            continue
        keys, shard = table.column("_k"), table.column("_shard").to_numpy()
        mine = (shard == shard[-1]) & pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~mine)[-1]) + 1 if not mine.all() else 0
        if cut:
            yield _swept(table.slice(0, cut).combine_chunks())
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield _swept(rest.combine_chunks())


#: Levels of the tree over shard numbers.
LEVELS = 31


def _segments(v: DataFrame, target_rows: int) -> DataFrame:
    """Versions that end, as versions that replace one another: (_k, _at, _id), _id null while none is live.

    Each version is an endpoint in the shard where it starts and in the one where it ends (there it also enters ahead
    of all); of those that cover a whole shard only the best is carried in: a version goes to the at most two nodes per level of a binary
    tree over shards that make up what it covers, and a shard asks the nodes above it.
    """
    ends = v.filter("_until is not null").select("*", F.col("_until").alias("_when"), F.lit(False).alias("_starts"))
    points = v.select("*", F.col("_at").alias("_when"), F.lit(True).alias("_starts")).unionByName(ends)
    points, split = assign_shards(points, ["_k"], "_when", target_rows)
    if split:
        last = points.groupBy("_k").agg(F.max("_shard").alias("_last")).filter("_last > 0")
        spans = points.join(broadcast_if_small(last), "_k").groupBy("_k", "_last", "_id", "_t", "_known").agg(F.min("_shard").alias("_a"), F.max("_shard").alias("_b"), F.bool_or(~F.col("_starts")).alias("_ends"))
        over = spans.withColumn("_b", F.when(F.col("_ends"), F.col("_b") - 1).otherwise(F.col("_last"))).filter("_b > _a")
        levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
        parts = F.expr(f"""flatten(transform(sequence(0, {LEVELS - 1}), l -> filter(array(
            named_struct('l', l, 'n', shiftright(_a + 1L + shiftleft(1L, l) - 1L, l), 'on', shiftright(_a + 1L + shiftleft(1L, l) - 1L, l) < shiftright(_b + 1L, l) and shiftright(_a + 1L + shiftleft(1L, l) - 1L, l) % 2 = 1),
            named_struct('l', l, 'n', shiftright(_b + 1L, l) - 1L, 'on', shiftright(_a + 1L + shiftleft(1L, l) - 1L, l) < shiftright(_b + 1L, l) and shiftright(_b + 1L, l) % 2 = 1)), x -> x.on)))""")
        nodes = over.withColumn("_p", F.explode(parts)).groupBy("_k", F.col("_p.l").alias("_l"), F.col("_p.n").alias("_n")).agg(F.max(F.struct("_t", "_known", "_id")).alias("_v"))
        asked = points.filter("_shard > 0").select("_k", "_shard").distinct().withColumn("_l", F.explode(levels)).withColumn("_n", F.expr("shiftright(cast(_shard as bigint), _l)"))
        best = asked.join(nodes, ["_k", "_l", "_n"]).groupBy("_k", "_shard").agg(F.max("_v").alias("_v"))
        first = points.groupBy("_k", "_shard").agg(F.min("_when").alias("_when"))
        enter = best.join(first, ["_k", "_shard"]).select("_k", "_shard", "_when", "_v.*", F.lit(True).alias("_starts"))
        late = points.filter("not _starts").join(first.withColumnRenamed("_when", "_lo"), ["_k", "_shard"]).filter("_at < _lo")
        enter = enter.unionByName(late.select("_k", "_shard", F.col("_lo").alias("_when"), "_t", "_known", "_id", F.lit(True).alias("_starts")))
        points = points.select(*enter.columns).unionByName(enter)
    points = points.select("_k", "_shard", "_when", "_starts", "_t", "_known", F.col("_id").cast("long").alias("_id"))
    # of the points of one instant ends come last, so that a version which enters and ends there is gone
    placed = points.repartition("_k", "_shard").sortWithinPartitions("_k", "_shard", "_when", F.col("_starts").desc())
    kind = v.schema["_k"].dataType.simpleString()
    return placed.mapInArrow(_sweep, f"_k {kind}, _shard int, _at bigint, _id bigint").select("_k", "_at", "_id")


def as_of(events: DataFrame, event_id: str, key: Column, ts: str, kinds: dict[str, DataFrame], target_rows: int = TARGET_ROWS) -> DataFrame:
    """(event_id, attr_kind, ref_id): for each event and kind the version in force and known at the event's time.

    kinds: by name the frames of ``versions``. Of the versions of the event's key with time <= ts, known <= ts and (if
    they end) until > ts, that of the latest time counts, then of the latest known, then of the largest id. Events without key or ts,
    and events without a version, give no row. Repeated events each get their rows. Empty tables give no rows.

    A version can be the answer from _at = max(time, known) on, so one pass per key in order of _at with a running maximum of
    (time, known, id) gives it; events sort behind versions of their instant. Hot keys are cut into time shards, and
    each shard gets the running maximum of those ahead as carry-in.
    """
    marks = events.select(key.alias("_k"), micros(ts).alias("_at"), F.col(event_id).alias("_event")).filter("_k is not null and _at is not null")
    empty = {"_t": F.lit(None).cast("long"), "_known": F.lit(None).cast("long"), "_id": F.lit(None).cast("long")}
    rows = marks.withColumns(empty | {"_kind": F.lit(len(kinds))})
    for i, v in enumerate(kinds.values()):
        if any(f.name == "_until" for f in v.schema) and v.schema["_until"].metadata.get("ends"):
            v = materialize(_segments(v, target_rows), "segments")  # small, and read by each pass below
            v = v.select("_k", "_at", F.col("_at").alias("_t"), F.lit(0).cast("long").alias("_known"), "_id")
        v = v.select("_k", "_at", "_t", "_known", F.col("_id").cast("long").alias("_id"))
        rows = rows.unionByName(v.withColumns({"_event": F.lit(None).cast(marks.schema["_event"].dataType), "_kind": F.lit(i)}))
    # events and versions of one instant may be parted: versions first, as in the order below
    tie = F.shiftleft(F.col("_kind").cast("long"), 58).bitwiseOR(F.xxhash64("_event", "_id").bitwiseAND(F.lit((1 << 58) - 1)))
    rows, split = assign_shards(rows.withColumn("_tie", tie), ["_k"], "_at", target_rows, "_tie")
    over = Window.partitionBy("_k", "_shard").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    best = lambda i: F.max(F.when(F.col("_kind") == i, F.struct("_t", "_known", "_id")))
    names = [f"_v{i}" for i in range(len(kinds))]
    out = rows.withColumns({n: best(i).over(over) for i, n in enumerate(names)}).filter(F.col("_kind") == len(kinds))
    if split:
        carried = carry(rows, ["_k"], {f"_c{i}": best(i) for i in range(len(kinds))}, F.max)
        out = out.join(broadcast_if_small(carried, 10_000), ["_k", "_shard"], "left")
        out = out.withColumns({n: F.greatest(n, f"_c{i}") for i, n in enumerate(names)})
    found = F.array(*[F.struct(F.lit(k).alias("attr_kind"), F.col(f"{n}._id").alias("ref_id")) for k, n in zip(kinds, names, strict=True)])
    return out.select(F.col("_event").alias(event_id), F.explode(F.filter(found, lambda x: x["ref_id"].isNotNull())).alias("_f")).select(event_id, "_f.*")


def ending(df: DataFrame) -> DataFrame:
    """Marks a frame of ``versions`` as one whose versions end at _until."""
    return df.withMetadata("_until", {"ends": True})
