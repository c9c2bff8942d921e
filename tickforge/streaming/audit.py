"""Hash-chained audit logs: each digest covers the event and the digest before it."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def digest(before: str, actor: str, action: str, payload: str) -> str:
    return hashlib.sha256("|".join((before, actor, action, payload)).encode()).hexdigest()


def chained(events: DataFrame, log: str = "log", order: str = "seq") -> DataFrame:
    """events (log, seq, actor, action, payload) with ``previous`` and ``digest``, folded in order within each log."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, before, rows = pdf.sort_values(order, kind="stable"), "", []
        for a, b, c in zip(pdf["actor"], pdf["action"], pdf["payload"], strict=True):
            now = digest(before, a or "", b or "", c or "")
            rows.append((before, now))
            before = now
        return pdf.assign(previous=[r[0] for r in rows], digest=[r[1] for r in rows])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.groupBy(log).applyInPandas(run, f"{schema}, previous string, digest string")


def verified(chain: DataFrame, log: str = "log", order: str = "seq") -> DataFrame:
    """(log, events, intact): whether all links and digests of a log agree; checked in the JVM, each event by itself."""
    w = Window.partitionBy(log).orderBy(order)
    again = F.sha2(F.concat_ws("|", "previous", F.coalesce("actor", F.lit("")), F.coalesce("action", F.lit("")), F.coalesce("payload", F.lit(""))), 256)
    ok = (F.col("previous") == F.coalesce(F.lag("digest").over(w), F.lit(""))) & (F.col("digest") == again)
    return chain.withColumn("_ok", ok).groupBy(log).agg(F.count(F.lit(1)).alias("events"), F.min(F.col("_ok").cast("int")).cast("boolean").alias("intact"))
