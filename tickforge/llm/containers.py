"""Filling fixed-capacity containers: Karmarkar-Karp multiway differencing in blocks of bounded size, what is left over up a tree."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.session import materialize

#: Windows and items that a block holds at most, on average. Both bound its memory: a merge of two partitions keeps one small number per window.
WINDOWS, ITEMS = 512, 8192
#: Rounds of exchanges between the windows of a block.
ROUNDS = 8
#: Items of a window up to which it also gives and takes pairs; with more of them single ones nearly always fit.
MOST_PAIRED = 12
#: Part of the capacity that a window may lack and still be kept by a block below the root.
LACK = 1 / 512


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each item by the largest differencing method.

    Every item starts as a partition of its own: its size in one window, nothing in the others. The two partitions with the
    largest spread are merged with their windows in opposite order, so that their imbalances cancel, until one is left.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, int)
    if n <= k:
        return np.arange(n)
    small = np.int16 if k < 1 << 15 else np.int32
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def take(i: int) -> np.ndarray:
        found = sums.pop(i, None)
        if found is None:
            found = np.zeros(k, np.int64)
            found[-1] = sizes[i]
        return found

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = take(a) + take(b)[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        new = n + len(merges)
        merges.append((a, b, order.astype(small)))
        sums[new] = both
        heapq.heappush(heap, (-int(both[-1] - both[0]), new))
    # top down: which window each slot of each partition became
    slots: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(k, dtype=np.int32)}
    window = np.zeros(n, int)
    while merges:
        a, b, order = merges.pop()
        mine = slots.pop(n + len(merges))
        left = np.empty(k, np.int32)
        left[order] = mine
        for part, slot in ((a, left), (b, left[::-1])):
            if part < n:
                window[part] = slot[-1]
            else:
                slots[part] = slot
    return window


def exchange(sizes: np.ndarray, window: np.ndarray, load: np.ndarray, capacity: int, pairs: bool) -> None:
    """Trades items between the windows that are not full to the token: one after the other becomes as full as one trade can make it,
    and those that are still to come take what it gives or lacks. A trade gives up to one item for up to one, or, with pairs, up to two for up
    to two. Large items are traded before small ones, which fit in more places.
    """
    live = load != capacity
    largest = np.zeros(len(load), np.int64)
    np.maximum.at(largest, window, sizes)
    order = np.argsort(-largest, kind="stable")
    for w in order[live[order]]:
        live[w] = False
        need = capacity - load[w]
        theirs, mine = np.flatnonzero(live[window]), np.flatnonzero(window == w)
        if not len(theirs):
            return
        theirs, mine = (x[np.argsort(-sizes[x], kind="stable")] for x in (theirs, mine))
        give, get = np.append(sizes[mine], 0), np.append(sizes[theirs], 0)  # the last of each: nothing
        left = need + give[:, None] - get[None, :]
        left[left < 0] = 4 * capacity
        i, j = divmod(int(np.argmin(left)), len(get))
        best, out, back = left[i, j], [*mine[i : i + 1]], [*theirs[j : j + 1]]
        if pairs and best and len(mine) <= MOST_PAIRED:
            rising = get[::-1]
            options = [[x] for x in mine] + [[]] + [[x, y] for k, x in enumerate(mine) for y in mine[k + 1 :]]
            for gone in options:
                short = need + int(sizes[gone].sum()) - get  # after the first item that comes in, what a second may have
                at = np.searchsorted(rising, short, "right") - 1
                second = len(get) - 1 - at
                rest = np.where((at >= 0) & (second != np.arange(len(get))), short - rising[at], 4 * capacity)
                rest[-1] = short[-1] if short[-1] >= 0 else 4 * capacity
                k = int(np.argmin(rest))
                if rest[k] < best:
                    best, out, back = rest[k], gone, [theirs[x] for x in {k, int(second[k]) if k < len(theirs) else k} if x < len(theirs)]
                if not best:
                    break
        if best >= 4 * capacity or 0 <= need <= best:
            continue
        to = int(window[back[0]]) if back else int(np.flatnonzero(live)[np.argmin(load[live])])
        for x in back:
            load[window[x]] -= sizes[x]
            load[w] += sizes[x]
            window[x] = w
        for x in out:
            load[w] -= sizes[x]
            load[to] += sizes[x]
            window[x] = to


def _place(sizes: np.ndarray, window: np.ndarray, load: np.ndarray, homeless, capacity: int) -> np.ndarray:
    """Finds windows for items, the largest first: the fullest with room, or one that a smaller item leaves, so that it is filled better, or
    a new one. Returns the loads."""
    waiting = [(-int(sizes[i]), int(i)) for i in homeless]
    heapq.heapify(waiting)
    while waiting:
        s, i = heapq.heappop(waiting)
        s = -s
        room = np.where(load > 0, capacity - load, 0)
        fits = np.flatnonzero(room >= s)
        if len(fits) and s:
            w = int(fits[np.argmin(room[fits])])
        else:
            left = np.where((window >= 0) & (sizes < s), room[window] + sizes - s, -1)
            left[left < 0] = capacity
            j = int(np.argmin(left))
            if left[j] < capacity:
                w = int(window[j])
                window[j] = -1
                load[w] -= sizes[j]
                heapq.heappush(waiting, (-int(sizes[j]), j))
            elif s == 0 and len(load):
                w = 0
            else:
                empty = np.flatnonzero(load == 0)
                w = int(empty[0]) if len(empty) else len(load)
                load = load if len(empty) else np.append(load, 0)
        window[i] = w
        load[w] += s
    return load


def spread(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, loads) after differencing over as few windows as the sizes allow, and exchanges; some may exceed capacity."""
    k = max(1, math.ceil(int(sizes.sum()) / capacity), int((2 * sizes > capacity).sum()))
    window = difference(sizes, k)
    load = np.bincount(window, sizes, minlength=k).astype(np.int64)
    for r in range(ROUNDS):
        exchange(sizes, window, load, capacity, r >= ROUNDS // 2)
    return window, load


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item (none larger than capacity) so that no window exceeds capacity.

    Items are spread over as few windows as the sizes allow; what still overfills a window finds room elsewhere, and the number of windows
    rises by one whenever an item finds none. Then the emptiest windows are dissolved as long as that lowers the number again.
    """
    if len(sizes) == 0:
        return np.zeros(0, int)
    window, load = spread(sizes, capacity)
    homeless = []
    for w in np.flatnonzero(load > capacity):
        mine = np.flatnonzero(window == w)
        for i in mine[np.argsort(sizes[mine], kind="stable")]:
            if load[w] <= capacity:
                break
            load[w] -= sizes[i]
            window[i] = -1
            homeless.append(i)
    load = _place(sizes, window, load, homeless, capacity)
    least, tried, best = max(1, math.ceil(int(sizes.sum()) / capacity)), 0, (len(load) + 1, 0)
    while (load > 0).sum() > least and tried < 8:
        order = np.argsort(np.where(load > 0, load, capacity + 1), kind="stable")
        w = order[tried % len(order)]
        mine = np.flatnonzero(window == w)
        window[mine], load[w] = -1, 0
        load = _place(sizes, window, load, mine, capacity)
        now = int((load > 0).sum()), int(load[load > 0].min())
        tried, best = (0, now) if now < best else (tried + 1, best)
    return np.unique(window, return_inverse=True)[1]


def _solve(level: int, root: bool):
    """Packs one block: the rows get the number of their window, or -1 if they go up to the next level."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_row", "_no"], kind="stable")
        c, part = int(pdf["c"].iloc[0]), pdf["_part"].to_numpy(np.int64)
        if root:
            window = fill(part, c)
        else:
            window, load = spread(part, c)
            window = np.where(((load <= c) & (load >= c - c * LACK))[window], window, -1)
        return pdf.assign(_window=window, _level=level)

    return run


def pack(items: DataFrame, containers: DataFrame, ident: str = "doc_id", size: str = "n_tokens", kind: str = "container_kind", capacity: str = "capacity_tokens",
         windows: int = WINDOWS, most_items: int = ITEMS) -> DataFrame:
    """(container_kind, container_id STRING, ident, piece_no, start, size): every item assigned once per kind of container.

    An item larger than the capacity is split into pieces of the capacity, each a full container (made in the JVM), and the rest, which is
    packed like an item. Items are dealt by a hash of the row into blocks of about ``windows`` containers or ``most_items`` items, whichever is
    fewer, so tasks are bounded whatever the sizes and however often an item is repeated. A block keeps its full windows; the items of the
    others go up and are dealt again with those of other blocks, until one block is left or going up helps no more. Items of size 0 are placed too; items
    with a null or negative size are none. Equal and repeated items are each placed; container kinds with a null name or no positive
    capacity are left out; empty tables give no rows.
    """
    kinds = [(r[0], int(r[1])) for r in containers.select(kind, capacity).distinct().limit(1001).collect() if r[0] is not None and r[1] is not None and r[1] > 0]
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    spark = items.sparkSession
    key = items.schema[ident].dataType.simpleString()
    out = f"{kind} string, container_id string, {ident} {key}, piece_no int, start long, {size} long"
    if not kinds:
        return spark.createDataFrame([], out)
    rows = items.filter(F.col(size) >= 0).select(F.col(ident).alias("_id"), F.col(size).cast("long").alias("_size"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "items")  # numbered once, so that repeated items stay apart
    each = rows.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).cast("long").alias("c")) for k, c in kinds]))).select("_id", "_row", "_size", "_k.*")
    full = F.expr("_size div c")
    whole = each.filter(full > 0).withColumn("_no", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)))
    done = whole.select("k", F.concat(F.lit("w"), "_row", F.lit("."), "_no").alias("container_id"), "_id", F.col("_no").cast("int").alias("_no"), (F.col("_no") * F.col("c")).alias("_start"), F.col("c").alias("_part"))
    left = each.filter((F.col("_size") % F.col("c") > 0) | (F.col("_size") == 0))
    left = left.select("k", "c", "_id", "_row", full.cast("int").alias("_no"), (full * F.col("c")).alias("_start"), (F.col("_size") % F.col("c")).alias("_part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields) + ", b bigint, _window bigint, _level int"
    parts, level, before = [done], 0, None
    while True:
        totals = {r["k"]: r for r in left.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("_part").alias("t")).collect()}  # a row per kind
        blocks = {k: max(1, math.ceil(r["t"] / (r["c"] * windows)), math.ceil(r["n"] / most_items)) for k, r in totals.items()}
        count = sum(r["n"] for r in totals.values())
        root = all(b == 1 for b in blocks.values()) or (before is not None and 2 * count > before)
        deal = F.lit(1).cast("long")
        for k, b in blocks.items():
            deal = F.when(F.col("k") == k, F.lit(b)).otherwise(deal)
        dealt = left.withColumn("b", F.pmod(F.xxhash64("_row", F.lit(level)), deal))
        solved = materialize(dealt.groupBy("k", "b").applyInPandas(_solve(level, root), schema), "packed")
        kept = solved if root else solved.filter("_window >= 0")
        parts.append(kept.select("k", F.concat_ws(".", "_level", "b", "_window").alias("container_id"), "_id", "_no", "_start", "_part"))
        if root:
            break
        left, level, before = solved.filter("_window < 0").select(*left.columns), level + 1, count
    packed = parts[0]
    for p in parts[1:]:
        packed = packed.unionByName(p)
    return packed.select(F.col("k").alias(kind), "container_id", F.col("_id").alias(ident), F.col("_no").alias("piece_no"), F.col("_start").alias("start"), F.col("_part").alias(size))


def fill_report(packed: DataFrame, containers: DataFrame, size: str = "n_tokens", kind: str = "container_kind", capacity: str = "capacity_tokens") -> DataFrame:
    """(container_kind, capacity, containers, tokens, utilisation, fullest): how well each kind was filled."""
    per = packed.groupBy(kind, "container_id").agg(F.sum(size).alias("_load"))
    total = per.groupBy(kind).agg(F.count(F.lit(1)).alias("containers"), F.sum("_load").alias("tokens"), F.max("_load").alias("fullest"))
    return total.join(containers.select(kind, capacity).distinct(), kind).select(kind, capacity, "containers", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col(capacity))).alias("utilisation"))
