"""Queries of streams and models over the test tables: rows only, since SQL has no counterpart; tests hold them to their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.expr import Primitive as P
from tickforge.operators.learning import meta_predictions, mixture_regimes
from tickforge.plans.engine import rounded
from tickforge.plans.engine_sql import BARS
from tickforge.session import read
from tickforge.sources.bars import event_bars, synthetic_bars
from tickforge.streaming import audit
from tickforge.streaming.bars import session_bars, window_bars
from tickforge.streaming.runner import run_batch


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").filter("event_type is not null and ts is not null and value is not null")
    return e.select(F.col("event_type").alias("symbol"), "ts", (100.0 + 0.02 * F.col("value")).alias("px"))


def stream_tumbling_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(window_bars(_events(spark, d), "6 hours").withColumn("start", F.unix_micros("start")))


def stream_sliding_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(window_bars(_events(spark, d), "12 hours", "6 hours").withColumn("start", F.unix_micros("start")))


def stream_session_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(session_bars(_events(spark, d), "20 minutes").withColumns({c: F.unix_micros(c) for c in ("start", "end")}))


def paper_runner(spark: SparkSession, d: str) -> DataFrame:
    bars = event_bars(spark, d).selectExpr("symbol", "bar_idx as bar_ts", "close", "high", "low", "volume * 10000 as volume")
    return rounded(run_batch(bars, P("SMA", 5) - P("SMA", 20), buffer=60))


def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    fills = read(spark, d, "fills").filter("symbol is not null and ts is not null")
    log = fills.select(F.col("symbol").alias("log"), F.col("fill_id").alias("seq"), F.lit("runner").alias("actor"), F.coalesce("side", F.lit("")).alias("action"), F.col("exec_ref").cast("string").alias("payload"))
    return audit.verified(audit.chained(log))


def synthetic_feed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(synthetic_bars(spark, 5000).select("symbol", "bar_idx", "open", "high", "low", "close", "volume"))


def regime_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture_regimes(event_bars(spark, d))


def meta_learner(spark: SparkSession, d: str) -> DataFrame:
    return meta_predictions(event_bars(spark, d), {"roc": P("ROC", 5), "z": P("PRICE_ZSCORE", 20), "rsi": P("RSI", 14)}, rounds=5)


QUERIES = {f.__name__: f for f in (stream_tumbling_bars, stream_sliding_bars, stream_session_bars, paper_runner, audit_chain, synthetic_feed, regime_mixture, meta_learner)}

_EV = "ev AS (SELECT event_type AS symbol, epoch_us(ts) AS us, 100e0 + 2e-2 * value AS px FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)"
_OHLC = "round(arg_min(px, us), 6) + 0e0 AS open, round(max(px), 6) + 0e0 AS high, round(min(px), 6) + 0e0 AS low, round(arg_max(px, us), 6) + 0e0 AS close, CAST(count(*) AS DOUBLE) AS volume"

#: The runner step by step: one recursion per bar.
_RUNNER = f"""WITH RECURSIVE {BARS}, s AS (SELECT symbol, i, close, volume * 10000 AS volume, coalesce(CASE WHEN i >= 4 THEN avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END - CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 0e0) AS sg FROM b),
r AS (SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS i, CAST('' AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS signal, CAST(0 AS DOUBLE) AS position, CAST(100000 AS DOUBLE) AS cash, CAST(100000 AS DOUBLE) AS equity FROM s
 UNION ALL SELECT symbol, i, status, CASE WHEN status <> 'warming_up' THEN sg END, pos + fill, cash - fill * close - abs(fill * close) * 2e-4, cash - fill * close - abs(fill * close) * 2e-4 + (pos + fill) * close FROM (
  SELECT *, CASE WHEN i + 1 < 20 THEN 'warming_up' WHEN eq <= 0 THEN 'liquidated' WHEN abs(delta) < 1e-6 THEN 'no_change' WHEN abs(delta) * close > 1e9 THEN 'gate_rejected' WHEN most = 0 THEN 'unfilled' WHEN most = abs(delta) THEN 'filled' ELSE 'partial' END AS status,
   CASE WHEN i + 1 < 20 OR eq <= 0 OR abs(delta) < 1e-6 OR abs(delta) * close > 1e9 THEN 0e0 ELSE sign(delta) * most END AS fill FROM (
   SELECT *, least(abs(delta), 5e-1 * volume) AS most FROM (
    SELECT symbol, s.i, s.close, s.volume, s.sg, r.position AS pos, r.cash, r.cash + r.position * s.close AS eq, CASE WHEN s.sg > 0 THEN 1 WHEN s.sg < 0 THEN -1 ELSE 0 END * least((r.cash + r.position * s.close) / s.close, 1e9) - r.position AS delta FROM r JOIN s USING (symbol) WHERE s.i = r.i + 1))))
SELECT symbol, i AS bar_ts, status, round(signal, 6) + 0e0 AS signal, round(position, 6) + 0e0 AS position, round(cash, 6) + 0e0 AS cash, round(equity, 6) + 0e0 AS equity FROM r WHERE i >= 0"""

ORACLE = {
    "paper_runner": _RUNNER,
    "stream_tumbling_bars": f"WITH {_EV} SELECT symbol, us // 21600000000 * 21600000000 AS start, {_OHLC} FROM ev GROUP BY ALL",
    "stream_sliding_bars": f"WITH {_EV}, s AS (SELECT *, us // 21600000000 * 21600000000 - unnest([0, 21600000000]) AS start FROM ev) SELECT symbol, start, {_OHLC} FROM s GROUP BY ALL",
    "stream_session_bars": f"""WITH {_EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY symbol ORDER BY us) < 1200000000 THEN 0 ELSE 1 END AS new FROM ev),
s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT symbol, min(us) AS start, max(us) + 1200000000 AS "end", round(arg_min(px, us), 6) + 0e0 AS open, round(arg_max(px, us), 6) + 0e0 AS close, CAST(count(*) AS DOUBLE) AS volume FROM s GROUP BY symbol, k""",
    "audit_chain": "SELECT symbol AS log, count(*) AS events, true AS intact FROM fills WHERE symbol IS NOT NULL AND ts IS NOT NULL GROUP BY 1",
    "synthetic_feed": """WITH b AS (SELECT 'SYN' AS symbol, unnest(range(5000)) AS i), c AS (SELECT *, 100 + 4e-2 * i + 25e-1 * sin(i / 9e0) + 12e-1 * sin(i / 31e0) AS close, 100 + 4e-2 * (i - 1) + 25e-1 * sin((i - 1) / 9e0) + 12e-1 * sin((i - 1) / 31e0) AS was FROM b),
o AS (SELECT *, CASE WHEN i = 0 THEN close ELSE was END AS open FROM c)
SELECT symbol, i AS bar_idx, round(open, 6) + 0e0 AS open, round(greatest(open, close) + 5e-1 + 1e-1 * abs(sin(i)), 6) + 0e0 AS high, round(least(open, close) - 5e-1 - 1e-1 * abs(cos(i)), 6) + 0e0 AS low, round(close, 6) + 0e0 AS close, round(1000 + 100 * abs(sin(i / 13e0)) + 10 * (i % 7), 6) + 0e0 AS volume FROM o""",
}
