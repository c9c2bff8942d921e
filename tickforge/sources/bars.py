"""Bars from event streams and trade lines, and readers of bar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators.shards import TARGET_ROWS, assign_shards, carry, with_halo
from tickforge.session import broadcast_if_small, materialize, micros, read

REQUIRED = ("timestamp", "symbol", "open", "high", "low", "close", "volume")
ALTERNATIVE = ("funding_rate", "imbalance", "sentiment", "options_skew")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in (*REQUIRED, *ALTERNATIVE)])


def numbered(bars: DataFrame, order: str = "bucket", target_rows: int = TARGET_ROWS) -> DataFrame:
    """bars with bar_idx, the 0-based number of the bar of its symbol in time; long series are numbered in shards if order is a BIGINT."""
    split = False
    if bars.schema[order].dataType.simpleString() == "bigint":
        bars, split = assign_shards(bars, ["symbol"], order, target_rows)
    number = F.row_number().over(Window.partitionBy("symbol", *["_shard"] * split).orderBy(order)).cast("long") - 1
    if split:
        ahead = carry(bars, ["symbol"], {"_ahead": F.count(F.lit(1))}, F.sum)
        bars, number = bars.join(broadcast_if_small(ahead, 10_000), ["symbol", "_shard"], "left"), number + F.coalesce("_ahead", F.lit(0))
    return bars.withColumn("bar_idx", number).drop("_shard", "_ahead")


def event_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the events: one symbol per type, price 100 + value / 50, volume the number of events."""
    e = read(spark, d, "events").filter("event_type is not null and ts is not null and value is not null")
    e = e.select(F.col("event_type").alias("symbol"), micros("ts").alias("us"), (100.0 + 0.02 * F.col("value")).alias("px"))
    bars = e.groupBy("symbol", F.expr("us div 3600000000").alias("bucket")).agg(
        F.min_by("px", "us").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "us").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return numbered(bars)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from a .csv, .parquet, .json or .jsonl path by its suffix (ValueError for others), with REQUIRED as they are and checked casts.

    ValueError if a required column is missing. Numbers that do not parse become null in the alternative columns; in the price
    columns and volume they make ``valid`` false.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif suffix in ("parquet", "pq"):
        raw = spark.read.parquet(path)
    elif suffix in ("json", "jsonl"):
        raw = spark.read.json(path)
    else:
        raise ValueError(f"no reader for {path}")
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    prices = REQUIRED[2:]
    out = raw.select(
        F.col("timestamp").cast("string").alias("timestamp"), F.col("symbol").cast("string").alias("symbol"), *[F.col(c).try_cast("double").alias(c) for c in prices],
        *[F.col(c).try_cast("double").alias(c) for c in ALTERNATIVE if c in raw.columns],
    )
    ok = F.lit(True)
    for c in prices:
        ok = ok & F.col(c).isNotNull()
    return out.withColumn("valid", ok)


def load_bars(spark: SparkSession, path: str) -> DataFrame:
    """read_bars, refused with ValueError where a price or volume is no number, or where the quality report finds inconsistent prices, values that
    are not finite, negative volumes or a symbol's timestamp twice."""
    rows = read_bars(spark, path)
    numbered_rows = rows.withColumns({"_ts": F.col("timestamp").try_cast("timestamp_ntz"), "_n": F.monotonically_increasing_id()})
    bad = rows.filter("not valid").count()
    found = quality_report(numbered_rows.filter("valid"), "symbol", "_ts", "_n", "open", "high", "low", "close", "volume").first().asDict()
    found |= {"no numbers": bad}
    names = {"no numbers": "no numbers", "inconsistent": "OHLC inconsistent", "not_finite": "not finite", "negative_volume": "negative volume", "duplicates": "duplicate timestamps"}
    if errors := [f"{found[k]} rows: {text}" for k, text in names.items() if found[k]]:
        raise ValueError("; ".join(errors))
    return rows.drop("valid")


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Bars from rows in memory; nothing is checked."""
    return spark.createDataFrame(rows)


def synthetic_bars(spark: SparkSession, n: int, price: float = 100.0, symbol: str = "SYN") -> DataFrame:
    """n bars of a trend with two sine waves: made in the JVM, of any length."""
    i = F.col("bar_idx").cast("double")
    at = lambda x: price + 0.04 * x + 2.5 * F.sin(x / 9) + 1.2 * F.sin(x / 31)
    df = spark.range(n).withColumnRenamed("id", "bar_idx").withColumn("symbol", F.lit(symbol))
    df = df.withColumn("close", at(i)).withColumn("open", F.when(F.col("bar_idx") == 0, F.col("close")).otherwise(at(i - 1)))
    return df.withColumns({
        "high": F.greatest("open", "close") + 0.5 + 0.1 * F.abs(F.sin(i)), "low": F.least("open", "close") - 0.5 - 0.1 * F.abs(F.cos(i)),
        "volume": 1000 + 100 * F.abs(F.sin(i / 13)) + 10 * F.pmod(F.col("bar_idx"), F.lit(7)),
    })


def quality_report(rows: DataFrame, symbol: str = "symbol", ts: str = "ts", arrival: str = "row_id", o: str = "open_px", h: str = "high_px", lo: str = "low_px", c: str = "close_px", v: str = "volume", target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row of counts: rows, symbols, duplicates (rows less distinct symbol and ts), inconsistent prices, values that are not finite,
    negative volumes, and rows whose time is before that of the row of their symbol which arrived just before."""
    px = [F.col(x) for x in (o, h, lo, c)]
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    any_odd = odd(px[0]) | odd(px[1]) | odd(px[2]) | odd(px[3]) | odd(F.col(v))
    wrong = (F.col(h) < F.greatest(o, c)) | (F.col(lo) > F.least(o, c)) | (F.col(h) < F.col(lo))
    flags = rows.select(symbol, micros(ts).alias("_us"), any_odd.alias("_odd"), (wrong & ~any_odd).alias("_wrong"), (F.col(v) < 0).alias("_neg"))
    per = flags.groupBy(symbol, "_us").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(x) for x in ("_odd", "_wrong", "_neg")])
    counts = per.agg(
        F.sum("n").alias("rows"), F.countDistinct(symbol).alias("symbols"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.sum("_wrong").alias("inconsistent"),
        F.sum("_odd").alias("not_finite"), F.sum("_neg").alias("negative_volume"),
    )
    line, split = assign_shards(rows.filter(F.col(symbol).isNotNull()).select(symbol, F.col(arrival).cast("long").alias("_n"), micros(ts).alias("_us")).filter("_n is not null"), [symbol], "_n", target_rows)
    line = with_halo(line, [symbol], ["_n"], 1, 0, split)
    back = F.lag("_us").over(Window.partitionBy(symbol, "_shard").orderBy("_n")) > F.col("_us")
    late = line.withColumn("_back", F.coalesce(back, F.lit(False))).filter("not _halo").agg(F.count_if(F.col("_back")).alias("out_of_order"))
    return counts.withColumn("_one", F.lit(1)).join(late.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def chronological_split(rows: DataFrame, ts: str, arrival: str, fraction: float = 0.2) -> DataFrame:
    """rows with ``part``: the first max(1, int(n * (1 - fraction))) rows by (ts, arrival) are 'train', the others 'test'.

    The cut is found by a global sort's ranges: the rows are never numbered in one task.
    """
    n = rows.count()
    cut = max(1, int(n * (1 - fraction)))
    by = [F.col(ts).asc_nulls_first(), F.col(arrival).asc()]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = materialize(ranged.select(arrival, ts, F.spark_partition_id().alias("_pid")), "split")
    sizes = {r["_pid"]: r["n"] for r in kept.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = 0
    for pid in sorted(sizes):
        if before + sizes[pid] >= cut:
            inside = Window.orderBy(*by)
            last = kept.filter(F.col("_pid") == pid).withColumn("_r", F.row_number().over(inside)).filter(F.col("_r") == cut - before).select(F.col(ts).alias("_ts"), F.col(arrival).alias("_a")).first()
            break
        before += sizes[pid]
    else:
        return rows.withColumn("part", F.lit("train"))
    t, a = F.col(ts), F.col(arrival)
    edge = F.lit(last["_ts"]).cast(rows.schema[ts].dataType)
    first = (t.isNull() & F.lit(last["_ts"] is not None)) | (t < edge) | (t.eqNullSafe(edge) & (a <= F.lit(last["_a"])))
    return rows.withColumn("part", F.when(F.coalesce(first, F.lit(False)), "train").otherwise("test"))


def manifest(rows: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """(source, rows, digest): a digest of the rows that does not depend on their order, combined before the shuffle."""
    text = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 256)
    part = F.conv(F.substring(text, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(part.alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.sum("p").alias("s")).select(F.lit(source).alias("source"), "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("s").cast("string")), 256).alias("digest"))
