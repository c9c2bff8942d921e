"""Multi-objective selection and lineage: dominance, fronts, crowding, survivors, ancestors."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.session import broadcast_if_small, materialize

#: Distinct points of a group that one task compares, and parts that are merged at a time.
PART, MERGED = 50_000, 8


def _goals(df: DataFrame, keys: list[str], ident: str, maximise: list[str], minimise: list[str]) -> tuple[DataFrame, list[str]]:
    goals = [*[F.col(c) for c in maximise], *[-F.col(c) for c in minimise]]
    names = [f"_g{i}" for i in range(len(goals))]
    return df.select(*keys, ident, *[g.cast("double").alias(n) for g, n in zip(goals, names, strict=True)]).dropna(subset=names), names


def _thinned(points: DataFrame, keys: list[str], names: list[str], most: int, part: int) -> DataFrame:
    """points without those that cannot be in the first ``most`` fronts of their group: large groups are cut into parts by a hash, as many as their
    size asks for, each part keeps its own first fronts, and the parts are merged in a tree. What is left follows the fronts, not the group."""
    counts = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    parts = counts.agg(F.max("_parts")).first()[0] or 1
    if parts <= 1:
        return points
    salted = points.join(broadcast_if_small(counts), keys) if keys else points.withColumn("_parts", F.lit(parts))
    salted = salted.withColumn("_s", F.pmod(F.xxhash64(*names), F.col("_parts")).cast("int")).drop("_parts")
    while parts > 1:
        salted = _layered(salted, [*keys, "_s"], names, most, None).drop("front").withColumn("_s", F.expr(f"_s div {MERGED}").cast("int"))
        parts = math.ceil(parts / MERGED)
    return salted.drop("_s")


def skyline(df: DataFrame, keys: list[str], ident: str, maximise: list[str], minimise: list[str], part: int = PART) -> DataFrame:
    """(keys, ident): the members no other dominates (at least as good everywhere, better somewhere), without comparing all pairs.

    Equal members are folded first, and large groups thinned in parts. Members with a missing objective take no part.
    """
    return fronts(df, keys, ident, maximise, minimise, most=1, part=part).drop("front")


def fronts(df: DataFrame, keys: list[str], ident: str, maximise: list[str], minimise: list[str], most: int | None = None, enough: int | None = None, part: int = PART) -> DataFrame:
    """(keys, ident, front): front 1 is the skyline, front k that of what is left, until nothing remains.

    Equal members are folded first. most: only the first so many fronts; enough: only the fronts that begin before a group has so many members (so
    no more than ``enough`` of them). With either, groups of more than ``part`` distinct members are thinned in parts, since a member of front k of its group is in front k of its
    part at the latest. What is left of a group, with neither all of it, is sorted in one pass of one task. Members with a missing objective take no part.
    """
    df, names = _goals(df, keys, ident, maximise, minimise)
    points = df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    bounds = [x for x in (most, enough) if x is not None]
    if bounds:
        points = _thinned(points, keys, names, min(bounds), part)
    layered = _layered(points, keys, names, most, enough)
    return df.join(layered.drop("_n"), [*keys, *names]).select(*keys, ident, "front")


def _layered(points: DataFrame, keys: list[str], names: list[str], most: int | None, enough: int | None) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[names].to_numpy(float)
        order = np.lexsort(tuple(-x[:, i] for i in range(x.shape[1] - 1, -1, -1)))
        front = np.zeros(len(x), dtype=np.int32)
        front[order] = front_numbers(x[order], most)
        pdf = pdf.assign(front=front)
        if enough is not None:
            members = np.bincount(front, weights=pdf["_n"].to_numpy())
            pdf = pdf[(np.cumsum(members) - members)[front] < enough]
        return pdf if most is None else pdf[pdf["front"] <= most]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", front int"
    return points.groupBy(*keys).applyInPandas(run, schema) if keys else points.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: run(pdf.drop(columns="_all")), schema)


def front_numbers(x: np.ndarray, most: int | None = None) -> list[int]:
    """The front of each row of x (more is better), whose rows differ and fall lexicographically; beyond ``most`` it is most + 1.

    Only earlier rows dominate a row, and a row that front k dominates is dominated by all fronts ahead of k, so its front is found by bisection.
    """
    wide, out = x.shape[1] > 3, []
    steps: list[tuple[list, list]] = []  # per front the rows that no other covers beyond the first goal: falling second, rising third goal
    for row in x.tolist():
        second, third = (*row[1:3], 0.0, 0.0)[:2]

        def covered(k: int, row=row, second=second, third=third) -> bool:
            if wide:
                return any((np.array(held) >= row).all(1).any() for held in _blocks(steps[k][0]))
            i = bisect_right(steps[k][0], -second)
            return i > 0 and steps[k][1][i - 1] >= third

        low, high = 0, len(steps)
        if most is not None and high >= most and covered(most - 1):
            out.append(most + 1)
            continue
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if covered(mid) else (low, mid)
        if low == len(steps):
            steps.append(([], []))
        seconds, thirds = steps[low]
        if wide:
            seconds.append(row)
        else:
            start = end = bisect_left(seconds, -second)
            while end < len(thirds) and thirds[end] <= third:
                end += 1
            seconds[start:end], thirds[start:end] = [-second], [third]
        out.append(low + 1)
    return out


def _blocks(rows: list, size: int = 4096):
    return (rows[i : i + size] for i in range(0, len(rows), size))


def crowding(df: DataFrame, keys: list[str], ident: str, objectives: list[str]) -> DataFrame:
    """df with ``crowding``: the sum over objectives of the distance between a member's neighbours, over the span; infinite at the ends."""
    total = F.lit(0.0)
    for c in objectives:
        w, part = Window.partitionBy(*keys).orderBy(c, ident), Window.partitionBy(*keys)
        span = F.max(c).over(part) - F.min(c).over(part)
        gap = F.lead(c).over(w) - F.lag(c).over(w)
        total = total + F.when(gap.isNull(), float("inf")).otherwise(gap / F.when(span == 0, 1.0).otherwise(span))
    return df.withColumn("crowding", total)


def survivors(df: DataFrame, keys: list[str], ident: str, maximise: list[str], minimise: list[str], size: int) -> DataFrame:
    """(keys, ident, front, crowding): the ``size`` members that fill up by fronts, the last front by falling crowding distance."""
    layered = fronts(df, keys, ident, maximise, minimise, enough=size).join(df.select(*keys, ident, *maximise, *minimise), [*keys, ident])
    spread = crowding(layered, [*keys, "front"], ident, [*maximise, *minimise])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("front", F.col("crowding").desc(), ident))
    return spread.withColumn("_r", place).filter(F.col("_r") <= size).select(*keys, ident, "front", "crowding")


def ancestors(edges: DataFrame, child: str, start) -> DataFrame:
    """(id): the members of a lineage (child, parent) from which start descends, start included, as far as they have an edge row.

    The lineage is walked in doubling steps: with the ancestors of fewer than n generations, and the jumps over n generations, a round has those of
    fewer than 2n, so any depth takes as many rounds as it has binary digits, and cycles end when a round adds nothing. Edges from a member to
    itself are left out.
    """
    parent = next(c for c in edges.columns if c != child)
    own = edges.select(F.col(child).alias("id")).distinct()
    hops = materialize(edges.filter(F.col(child) != F.col(parent)).select(F.col(child).alias("_c"), F.col(parent).alias("_p")).distinct(), "hops")
    found = materialize(own.filter(F.col("id") == F.lit(start)), "ancestors")
    size = found.count()
    while size:
        more = found.join(hops, F.col("id") == F.col("_c")).select(F.col("_p").alias("id"))
        found = materialize(found.unionByName(more).distinct(), "ancestors")
        was, size = size, found.count()
        if size == was:
            break
        hops = materialize(hops.alias("a").join(hops.alias("b"), F.expr("a._p = b._c")).select("a._c", "b._p").distinct(), "hops")
    return found.join(own, "id", "left_semi")
