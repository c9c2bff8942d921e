"""Mixing sources to target weights: fractional copy counts made whole by pivotal dependent rounding."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.session import broadcast_if_small, materialize

#: Documents or residuals that one rounding group takes; the reduction tree's fan-in.
FAN_IN = 4096
#: Below this a probability is 0, above 1 minus this it is 1.
EPS = 1e-9
SOURCES = 100_000
#: Copies of a row that are numbered from one array.
CHUNK = 65_536


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fractional copy probabilities with all but at most one made 0 or 1, keeping sum(p * size) and each expectation.

    One fractional item is carried; with the next one, mass (p * size) moves one way or the other until one of the two is
    integral, the way drawn so that neither's expectation changes; the one that is still fractional is carried on.
    """
    p = p.copy()
    draw = rng.random(len(p))
    carried = -1
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        if size[i] <= 0:  # moves no mass
            p[i] = float(draw[i] < p[i])
            continue
        if carried < 0:
            carried = i
            continue
        c, sc, si = carried, size[carried], size[i]
        give, get = min(p[c] * sc, (1 - p[i]) * si), min(p[i] * si, (1 - p[c]) * sc)
        moved = -give if draw[i] * (give + get) < get else get
        p[c], p[i] = p[c] + moved / sc, p[i] - moved / si
        open_c, open_i = EPS < p[c] < 1 - EPS, EPS < p[i] < 1 - EPS
        if not open_c:
            p[c] = round(p[c])
        if not open_i:
            p[i] = round(p[i])
        carried = c if open_c else i if open_i else -1
    return p


def budgets(targets: dict[str, tuple[float, int]], sizes: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of each source: its share of total, where max_repeats allows; what others then lack is shared by those that have
    room, in proportion to their shares, so that the total is kept as far as any source can."""
    most = {s: sizes.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    share = {s: max(0.0, w) for s, (w, _) in targets.items()}
    out, free, left = {}, {s for s in targets if share[s] > 0}, total
    while free:
        weight = sum(share[s] for s in free)
        full = {s for s in free if share[s] / weight * left >= most[s]}
        if not full:
            return out | {s: share[s] / weight * left for s in free} | {s: 0.0 for s in targets if share[s] <= 0}
        for s in full:
            out[s] = float(most[s])
            left -= most[s]
        free -= full
    return {s: out.get(s, 0.0) for s in targets}


def reachable(targets: dict[str, tuple[float, int]], sizes: dict[str, int]) -> float:
    """The largest total at which every source that has tokens and a share meets that share within its repeats."""
    weight = sum(max(0.0, w) for w, _ in targets.values())
    return min([sizes[s] * r * weight / w for s, (w, r) in targets.items() if w > 0 and sizes.get(s, 0) * r > 0], default=0.0)


def thin(p: float, size: np.ndarray, rng: np.random.Generator, root: bool = False) -> np.ndarray:
    """pivot for items of one common probability, so that at most one is left fractional, and nearly always a small one.

    The largest item forms the pair with the pool of all smaller ones: mass moves one way or the other until the item is integral, the way drawn
    so that neither its expectation nor that of any item of the pool changes (their probabilities move by the same amount). Then the next one.
    Where the pool cannot take or give so much, it becomes integral in the item's place. At the root, where no other group can make up for
    that, the item instead takes the outcome that the pool can balance: the only step that changes expectations, for the sake of the budget.
    """
    out = np.zeros(len(size))
    if EPS < p < 1 - EPS:
        none = size <= 0  # moves no mass
        out[none] = rng.random(int(none.sum())) < p
    else:
        out[:] = round(p)
        return out
    order = np.lexsort((np.arange(len(size)), -size))[: int((size > 0).sum())]
    rest = np.append(np.cumsum(size[order][::-1])[::-1][1:], 0.0)
    draw = rng.random(len(order))
    for k, i in enumerate(order):
        if p <= EPS or p >= 1 - EPS:
            out[order[k:]] = round(p)
            break
        s, pool = size[i], rest[k]
        if root:
            left = p * (s + pool)
            short = [max(0.0, left - pool), max(0.0, s - left)]  # what the pool lacks or has too much of without and with the item
            if max(short) > EPS * left:
                out[i] = float(short[1] < short[0])
                p = min(1.0, max(0.0, (left - out[i] * s) / pool)) if pool > 0 else p
                continue
        if pool <= 0:
            out[i] = p
            break
        give, get = min(p * s, (1 - p) * pool), min((1 - p) * s, p * pool)
        moved = -give if draw[k] * (give + get) < get else get
        mine, p = p + moved / s, p - moved / pool
        if EPS < mine < 1 - EPS:
            out[i] = mine
        else:
            out[i] = round(mine)
    return out


def _rounded(seed: int, level: int, ident: str, root: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ident, "_size", "_copy"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{level}/{pdf['_source'].iloc[0]}/{pdf['_block'].iloc[0]}".encode()))
        p, size = pdf["_p"].to_numpy(float), pdf["_size"].to_numpy(float)
        p = thin(p[0], size, rng, root) if level == 0 else pivot(p, size, rng)
        if root:
            p = (rng.random(len(p)) < p).astype(float)  # at most one that is not integral yet
        return pdf.assign(_p=p)

    return run


def mix(items: DataFrame, targets: DataFrame, total: float | None = None, all_met: bool = False, seed: int = 7, fan_in: int = FAN_IN, ident: str = "doc_id", source: str = "source",
        size: str = "n_tokens", share: str = "target_share", repeats: str = "max_repeats") -> tuple[DataFrame, DataFrame]:
    """(selection, report). selection: (ident, source, size, copies >= 1); report: one row per source of targets with the target
    and the reached share, tokens, documents, most copies and whether max_repeats held the source back.

    Each item of a source gets the same ratio of copies, budget / tokens: its whole part in any case, its fraction as a
    probability. Probabilities are made whole per source in groups of about fan_in items; the at most one residual of each
    group, mostly one of its smallest items, goes up a reduction tree with the same fan-in, and what is left at the root is drawn with its
    probability. Items keep their expectations but for those of a source's only group that the smaller ones cannot balance (say one larger than
    the whole budget): they give way to the share. So a source meets its budget to within one item. Draws depend on seed, source
    and group alone, so a retried task repeats them. total: tokens wanted, by default as many as the listed sources have; with all_met the
    largest total at which every source with tokens meets its share. Items with null source, an unlisted source or null size are not used; of targets
    given twice the largest share and repeats count; null or negative shares count as 0, null repeats as 0. Items of size 0 count no tokens.
    Repeated items are each an item; they are dealt to groups by a hash of the row, so that copies do not gather. Empty tables give no rows.
    """
    spark = items.sparkSession
    plan = targets.filter(F.col(source).isNotNull()).groupBy(source).agg(F.max(F.coalesce(share, F.lit(0.0))).alias("_w"), F.max(F.coalesce(repeats, F.lit(0))).alias("_r"))
    listed = plan.limit(SOURCES + 1).collect()
    if len(listed) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    wanted = {r[source]: (float(r["_w"]), int(r["_r"])) for r in listed}
    used = items.filter(F.col(size) >= 0).select(F.col(ident), F.col(source).alias("_source"), F.col(size).cast("double").alias("_size"))
    used = used.join(broadcast_if_small(plan.select(F.col(source).alias("_source")), SOURCES), "_source", "left_semi")
    sizes = {r["_source"]: (int(r["_t"] or 0), r["_n"]) for r in used.groupBy("_source").agg(F.sum("_size").alias("_t"), F.count(F.lit(1)).alias("_n")).collect()}
    tokens = {s: t for s, (t, _) in sizes.items()}
    want = budgets(wanted, tokens, float(reachable(wanted, tokens) if all_met else sum(tokens.values()) if total is None else total))
    ratio = [(s, min(want[s] / t, wanted[s][1]) if t else 0.0, max(1, math.ceil(n / fan_in))) for s, (t, n) in sizes.items()]
    ratios = spark.createDataFrame(ratio, "_source string, _ratio double, _blocks long")
    # copies of a row are counted before the shuffle and then numbered, so that they are dealt to different groups, the same ones each time
    once = used.groupBy(ident, "_source", "_size").agg(F.count(F.lit(1)).alias("_m"))
    each = once.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(CHUNK).cast("long"))))
    each = each.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, F.col("_m")) - 1))).drop("_m", "_from")
    rows = each.join(F.broadcast(ratios), "_source").withColumn("_block", F.pmod(F.xxhash64(ident, "_size", "_copy"), F.col("_blocks")))
    rows = rows.withColumn("_base", F.floor(F.col("_ratio") + EPS)).select(ident, "_source", "_size", "_copy", "_block", "_base", F.greatest(F.col("_ratio") - F.col("_base"), F.lit(0.0)).alias("_p"))
    schema = rows.schema
    level, blocks = 0, max([b for _, _, b in ratio], default=1)
    parts = []
    while True:
        root = blocks <= 1
        done = materialize(rows.groupBy("_source", "_block").applyInPandas(_rounded(seed, level, ident, root), schema), f"mix-{level}")
        parts.append(done if root else done.filter(f"_p <= {EPS} or _p >= {1 - EPS}"))
        if root:
            break
        level, blocks = level + 1, math.ceil(blocks / fan_in)
        rows = done.filter(f"_p > {EPS} and _p < {1 - EPS}").withColumn("_block", F.expr(f"_block div {fan_in}"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = whole.withColumn("copies", (F.col("_base") + F.round("_p")).cast("int"))
    selection = whole.filter("copies > 0").select(ident, F.col("_source").alias(source), F.col("_size").cast("long").alias(size), "copies")
    reached = whole.groupBy("_source").agg(F.sum(F.col("_size") * F.col("copies")).cast("long").alias("tokens"), F.count_if(F.col("copies") > 0).alias("documents"), F.max("copies").alias("most_copies"))
    asked = spark.createDataFrame([(s, w, r, bool(want[s] + 1e-6 < w / max(sum(x for x, _ in wanted.values()), 1e-12) * sum(want.values()))) for s, (w, r) in wanted.items()], "_source string, target_share double, max_repeats int, held_back boolean")
    report = asked.join(reached, "_source", "left").withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # at most SOURCES rows
    report = report.select(
        F.col("_source").alias(source), "target_share", (F.coalesce("tokens", F.lit(0)) / F.greatest(F.coalesce("_all", F.lit(0)), F.lit(1))).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", "held_back",
    )
    return selection, report
