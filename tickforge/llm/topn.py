"""The N best rows of every group, by one global range-partitioned sort and prefix-summed group counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _changed(column: pa.Array) -> np.ndarray:
    """For each row but the first, whether its value differs from that of the row before; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def _positions(groups: list[str], n: int):
    def run(batches):
        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(g) for g in groups]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= _changed(k)
            first = tuple(k[0].as_py() for k in keys)
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, 0))
            place = at - start + 1 + np.where(start == 0, seen if first == last else 0, 0)
            last, seen = tuple(k[-1].as_py() for k in keys), int(place[-1])
            keep = pa.array(place <= n)
            kept = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(place[place <= n], pa.int64()), pa.array(np.full(kept.num_rows, pid), pa.int32())], [*batch.schema.names, "_pos", "_pid"])

    return run


def top_n(df: DataFrame, groups: list[str], order: list[Column], ident: list[str], n: int) -> DataFrame:
    """(groups, place, ident): places 1 to n of each group in the given order, which must end with what tells rows of a group apart.

    A global sort over (groups, order) cuts groups of any size over range partitions. Within a partition a row's position in its
    group is counted; rows past n there cannot reach place n and go at once. The counts that are left, at most n per group and
    partition, are prefix-summed over the partitions of the group, which makes the positions exact. Null is a group of its own;
    rows that tie in the whole order take successive places in no fixed order; an empty table gives no rows; other columns go.
    """
    cols = [*groups, *[c for c in ident if c not in groups]]
    keyed = df.select(*cols, *[c.alias(f"_o{i}") for i, c in enumerate(_bare(order))])
    by = [F.col(g).asc() for g in groups] + [_like(c, f"_o{i}") for i, c in enumerate(order)]
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*cols)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    near = ranged.mapInArrow(_positions(groups, n), f"{ddl}, _pos bigint, _pid int")
    parts = near.groupBy(*groups, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct("_pos", *[c for c in cols if c not in groups])).alias("_rows"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("_ahead", ahead).filter(F.col("_ahead") < n).select(*groups, "_ahead", F.explode("_rows").alias("_row"))
    placed = placed.select(*groups, (F.col("_ahead") + F.col("_row._pos")).cast("int").alias("place"), *[F.col(f"_row.{c}").alias(c) for c in cols if c not in groups])
    return placed.filter(F.col("place") <= n)


class Desc:
    """A descending sort key with nulls last; plain columns sort ascending with nulls first."""

    def __init__(self, column: Column):
        self.column = column


def _bare(order: list) -> list[Column]:
    return [c.column if isinstance(c, Desc) else c for c in order]


def _like(c, name: str) -> Column:
    return F.col(name).desc_nulls_last() if isinstance(c, Desc) else F.col(name).asc()


def latest(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """(keys, version, values) of the row with the largest version per keys; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max(version).alias(version), *[F.max_by(v, version).alias(v) for v in values])
