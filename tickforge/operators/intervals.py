"""Overlapping and gapped intervals: merged periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators.shards import TARGET_ROWS, assign_shards, carry
from tickforge.session import micros

#: Stands for an end that is never reached; later than any timestamp.
NEVER = 9_000_000_000_000_000_000


def _islands(df: DataFrame, key: str, start: str, end: str, target_rows: int) -> tuple[DataFrame, bool]:
    """Rows (key, _s, _e, _prev, _new, _shard): _prev is the running maximum of the ends ahead of the row."""
    windows = (
        df.select(F.col(key).alias("_k"), micros(start).alias("_s"), F.coalesce(micros(end), F.when(F.col(end).isNull(), F.lit(NEVER))).alias("_e"))
        .filter("_k is not null and _s is not null and _e > _s")
        .groupBy("_k", "_s").agg(F.max("_e").alias("_e"))
    )
    rows, split = assign_shards(windows, ["_k"], "_s", target_rows)
    ahead = Window.partitionBy("_k", "_shard").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    running = F.max("_e").over(ahead)
    if split:
        carried = carry(rows, ["_k"], {"_carry": F.max("_e")}, F.max)
        rows = rows.join(F.broadcast(carried) if carried.limit(10_001).count() <= 10_000 else carried, ["_k", "_shard"], "left")
        running = F.greatest(running, F.col("_carry"))
    rows = rows.withColumn("_prev", running)
    return rows.withColumn("_new", F.col("_prev").isNull() | (F.col("_s") > F.col("_prev"))), split


def interval_gaps(df: DataFrame, key: str, start: str, end: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(key, gap_start_us, gap_end_us): the holes between the merged half-open [start, end) of each key.

    Null end: never ends. Rows with null key, null start or end not after start count for nothing; repeated rows
    count once; touching intervals leave no gap; an empty table gives no rows. Other columns are ignored.
    """
    rows, _ = _islands(df, key, start, end, target_rows)
    return rows.filter("_new and _prev is not null").select(F.col("_k").alias(key), F.col("_prev").alias("gap_start_us"), F.col("_s").alias("gap_end_us"))


def merge_intervals(df: DataFrame, key: str, start: str, end: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(key, period_start_us, period_end_us): the merged periods; a null end never ends. Cases as for interval_gaps.

    A period is labelled by cumulating the island starts per shard; the pieces of an island that crosses shards
    share the label through the carried number of islands ahead.
    """
    rows, split = _islands(df, key, start, end, target_rows)
    rows = rows.withColumn("_one", F.col("_new").cast("long"))
    island = F.sum("_one").over(Window.partitionBy("_k", "_shard").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    if split:
        ahead = carry(rows, ["_k"], {"_ahead": F.sum("_one")}, F.sum)
        rows = rows.join(F.broadcast(ahead) if ahead.limit(10_001).count() <= 10_000 else ahead, ["_k", "_shard"], "left")
        island = island + F.coalesce("_ahead", F.lit(0))
    periods = rows.withColumn("_island", island).groupBy("_k", "_island").agg(F.min("_s").alias("period_start_us"), F.max("_e").alias("_e"))
    return periods.select(F.col("_k").alias(key), "period_start_us", F.when(F.col("_e") < NEVER, F.col("_e")).alias("period_end_us"))
