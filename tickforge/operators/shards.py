"""Splitting hot keys along an order column, without changing what a per-key scan computes.

A key with more than ``target_rows`` rows is cut into shards of about equal numbers of rows: merged quantile sketches per hot
key give the cuts, so neither outliers nor bursts make a shard large. A scan then runs per (key, shard); what it needs from the
neighbouring shards comes as halo rows (``with_halo``) or as a carried aggregate (``carry``). Cold keys have the
shard 0, hot ones shards from 1 on; where no key is hot one counting pass is all that is paid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.session import broadcast_if_small, materialize

TARGET_ROWS = 200_000
#: Shards that one round of sketches cuts a key into, at most; larger keys are cut coarsely first and each part again.
MOST_PARTS = 512
#: Ranks asked of a sketch; MOST_PARTS of them are at most an eighth of a shard off.
RANKS = 2048
#: Numbers that the finer shards of a coarse one take.
FINER = 1 << 16
#: Hot keys up to which the table of their cuts is broadcast; beyond it the join is shuffled, with SALTS parts of each key.
HOT_KEYS, SALTS = 1000, 64
LEAST = -(1 << 63)


def salted(small: DataFrame, parts: int = SALTS) -> DataFrame:
    """small once for each of the parts, in ``_salt``, for a shuffled join. The hint is needed: the planner takes the rows repeated here for as few
    bytes as the file they come from, and would broadcast them all."""
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).hint("merge")


def joined_hot(df: DataFrame, small: DataFrame, keys: list[str], few: bool, salt: list[str], how: str = "left") -> DataFrame:
    """df joined with one row per hot key: broadcast if few, else shuffled with each key of df in SALTS parts and small repeated for each."""
    if few:
        return df.join(F.broadcast(small), keys, how)
    parts = salted(small)
    return df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")).join(parts, [*keys, "_salt"], how).drop("_salt")


def _sketch_size(parts: int) -> int:
    """The sketch parameter at which a quantile is off by no more than a quarter of a part in rank."""
    return min(65_535, max(400, math.ceil((9.2 * parts) ** 1.1085)))


def _quantiles(rows: DataFrame, keys: list[str], value: str, target_rows: int, parts: int) -> DataFrame:
    """(keys, _q): per key the values that cut its rows into parts of about target_rows, ascending; a frequent value more than once."""
    ranks = F.lit([i / RANKS for i in range(1, RANKS)])
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_bigint(value, F.lit(_sketch_size(parts))).alias("_sk"))
    cut = per.select(*keys, F.ceil(F.col("_n") / target_rows).alias("_m"), F.kll_sketch_get_quantile_bigint("_sk", ranks).alias("_all"))
    at = F.transform(F.sequence(F.lit(1), F.col("_m") - 1), lambda i: F.round(i * RANKS / F.col("_m")).cast("int"))
    return cut.filter("_m > 1").select(*keys, F.transform(at, lambda i: F.element_at("_all", i)).alias("_q"))


def assign_shards(df: DataFrame, keys: list[str], order: str, target_rows: int = TARGET_ROWS, tie: str | None = None) -> tuple[DataFrame, bool]:
    """(df with ``_shard`` INT, whether any key was split). Keys and order (a BIGINT) must not be null.

    Shards ascend with (order, tie); without tie (another BIGINT) all rows of equal key and order stay together, with it a value of
    order that fills shards by itself is cut along tie. A shard holds no more than about 1.5 times target_rows, or, where equal
    (order, tie) are more than that, the rows of one such value beside them.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows)
    listed = counted.limit(HOT_KEYS + 1).collect()
    if not listed:
        return df.withColumn("_shard", F.lit(0)), False
    few = len(listed) <= HOT_KEYS
    most = max(r["_n"] for r in listed) if few else counted.agg(F.max("_n")).first()[0]
    parts = math.ceil(most / target_rows)
    if parts > MOST_PARTS:
        coarse, _ = assign_shards(df, keys, order, target_rows * (MOST_PARTS // 2), tie)
        fine, _ = assign_shards(coarse.withColumnRenamed("_shard", "_coarse"), [*keys, "_coarse"], order, target_rows, tie)
        return fine.withColumn("_shard", (F.col("_coarse") * FINER + F.col("_shard")).cast("int")).drop("_coarse"), True
    hot = df.sparkSession.createDataFrame(listed, counted.schema) if few else counted
    row = [*keys, order, *([tie] if tie else [])]
    rows = joined_hot(df.select(*row), hot.select(*keys), keys, few, row, "left_semi")
    found = materialize(_quantiles(rows, keys, order, target_rows, parts), "cuts")
    edge = lambda o, t: F.struct(o.cast("long").alias("o"), t.cast("long").alias("t"))
    flat = found.select(*keys, F.explode("_q").alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    edges = flat.select(*keys, F.explode(F.when((F.col("_c") > 1) & F.lit(bool(tie)), F.array(edge(F.col("_v"), F.lit(LEAST)), edge(F.col("_v") + 1, F.lit(LEAST)))).otherwise(F.array(edge(F.col("_v"), F.lit(LEAST))))).alias("_e"))
    heavy = flat.filter("_c > 1")
    if tie and heavy.limit(1).count():
        same = rows.join(broadcast_if_small(heavy.select(*keys, F.col("_v").alias(order))), [*keys, order])
        inner = _quantiles(same, [*keys, order], tie, target_rows, parts)
        edges = edges.unionByName(inner.select(*keys, F.explode("_q").alias("_t"), order).select(*keys, edge(F.col(order), F.col("_t")).alias("_e")))
    cuts = edges.groupBy(*keys).agg(F.array_sort(F.collect_set("_e")).alias("_cuts"))
    cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema) if few else materialize(cuts, "cuts")
    here = edge(F.col(order), F.col(tie) if tie else F.lit(0))
    steps = F.array(*[F.lit(1 << b) for b in range((4 * MOST_PARTS).bit_length() - 1, -1, -1)])
    place = F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= F.size("_cuts")) & (here >= F.get("_cuts", i + s - 1)), i + s).otherwise(i))
    out = joined_hot(df, cuts, keys, few, row)
    return out.select(*df.columns, F.when(F.col("_cuts").isNull(), 0).otherwise(place + 1).alias("_shard")), True


def with_halo(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, split: bool = True) -> DataFrame:
    """df with ``_halo`` BOOLEAN: to each shard the last ``before`` rows of the shards ahead of it and the first
    ``after`` rows of those behind it are added (marked true). Exact even where a shard has fewer rows than the halo."""
    own = df.withColumn("_halo", F.lit(False))
    if not split or before + after == 0:
        return own
    hot, part = materialize(df.filter("_shard > 0"), "hot"), Window.partitionBy(*keys, "_shard")  # read three times
    row = F.struct(*order, *[c for c in df.columns if c not in {*keys, "_shard", *order}])
    # how many shards a halo may reach into: small ones are rare, but then it is several
    least = hot.groupBy(*keys, "_shard").agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n")).first()[0] or 1

    def side(n: int, by: list[Column], behind: bool) -> DataFrame:
        near = hot.withColumn("_r", F.row_number().over(part.orderBy(*by))).filter(F.col("_r") <= n)
        edges = near.groupBy(*keys, "_shard").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        reach = min(n, math.ceil(n / least))
        over = Window.partitionBy(*keys).orderBy("_shard")
        got = F.flatten(F.collect_list("_rows").over(over.rowsBetween(1, reach) if behind else over.rowsBetween(-reach, -1)))
        start = F.lit(1) if behind else F.greatest(F.size("_got") - n + 1, F.lit(1))
        near = edges.withColumn("_got", got).select(*keys, "_shard", F.explode(F.slice("_got", start, F.lit(n))).alias("_row"))
        return near.select(*keys, "_shard", "_row.*", F.lit(True).alias("_halo"))

    if before:
        own = own.unionByName(side(before, [F.col(c).desc() for c in order], False))
    if after:
        own = own.unionByName(side(after, [F.col(c).asc() for c in order], True))
    return own


def carry(df: DataFrame, keys: list[str], sums: dict[str, Column], merge, backwards: bool = False) -> DataFrame:
    """One row per (key, shard) of the split keys with, under each name of ``sums``, the merged aggregate of all shards
    ahead of it (behind it, if backwards); null where there are none."""
    per = df.filter("_shard > 0").groupBy(*keys, "_shard").agg(*[c.alias(n) for n, c in sums.items()])
    over = Window.partitionBy(*keys).orderBy("_shard")
    over = over.rowsBetween(1, Window.unboundedFollowing) if backwards else over.rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "_shard", *[merge(n).over(over).alias(n) for n in sums])
