"""Factor analytics: forward returns, rank correlation, quantile spreads, autocorrelation, neutral and orthogonal signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators.shards import TARGET_ROWS, assign_shards, with_halo


def forward_returns(df: DataFrame, horizon: int, price: str = "close", key: str = "symbol", order: str = "bar_idx", target_rows: int = TARGET_ROWS) -> DataFrame:
    """df with ``fwd``, the return to the close ``horizon`` bars on; null at the end and where the price is not positive. Long series are cut into
    time shards that see so many bars ahead."""
    rows, split = assign_shards(df, [key], order, target_rows)
    rows = with_halo(rows, [key], [order], 0, horizon, split)
    ahead = F.lead(price, horizon).over(Window.partitionBy(key, "_shard").orderBy(order))
    rows = rows.withColumn("fwd", F.when(F.col(price) > 0, F.try_divide(ahead, F.col(price)) - 1))
    return rows.filter("not _halo").select(*df.columns, "fwd")


def _with(df: DataFrame, key: str, **totals: Column) -> DataFrame:
    """df with aggregates of its key, combined before they are shuffled and joined back, so that no key is gathered in one task. Whether the aggregates
    are broadcast is left to adaptive execution, which knows their size without another pass over a long chain of them."""
    found = df.groupBy(F.col(key).alias("_key")).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(found, df[key].eqNullSafe(found["_key"])).drop("_key")


def _scored(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """df with out, the column as a z-score within its key; where it does not vary, less its mean."""
    df = _with(df, key, _mean=F.avg(column), _sd=F.stddev_samp(column))
    return df.withColumn(out, (F.col(column) - F.col("_mean")) / F.when(F.coalesce("_sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_sd"))).drop("_mean", "_sd")


def clean_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(fine(a) & fine(b))


def average_rank(value: str, part: list[str]) -> Column:
    """Rank of a value in its part, ties at the mean of their places."""
    tied = F.count(F.lit(1)).over(Window.partitionBy(*part, value))
    return F.rank().over(Window.partitionBy(*part).orderBy(value)) + (tied - 1) / 2


def spearman(df: DataFrame, part: list[str], a: str, b: str) -> DataFrame:
    """(part, n, ic): 1 - 6 sum(d^2) / (n (n^2 - 1)) of the average ranks, 0 below three pairs, within [-1, 1]."""
    ranks = df.withColumn("_d", average_rank(a, part) - average_rank(b, part))
    per = ranks.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_q"))
    raw = 1 - 6 * F.col("_q") / (F.col("n") * (F.col("n") * F.col("n") - 1)).cast("double")
    return per.select(*part, "n", F.when(F.col("n") < 3, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(F.col("n") >= 3, raw)))).alias("ic"))


def rank_ic(pairs: DataFrame, signal: str, ret: str, key: str = "symbol", order: str = "bar_idx", chunk: int = 20, step: int = 10) -> DataFrame:
    """(key, chunks, mean_ic, std_ic, t_stat, ir, positive_rate) over sliding chunks of the clean pairs in time; one chunk if there are few."""
    w = Window.partitionBy(key).orderBy(order)
    df = clean_pairs(pairs, signal, ret).select(key, order, signal, ret).withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    last = F.greatest(F.floor((F.col("_n") - chunk) / step), F.lit(0))
    low = F.greatest(F.ceil((F.col("_i") - chunk + 1) / step), F.lit(0))
    high = F.least(F.floor(F.col("_i") / step), last)
    whole = F.col("_n") < chunk
    df = df.withColumn("_c", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    ics = spearman(df, [key, "_c"], signal, ret)
    per = ics.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.avg("ic").alias("mean_ic"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"))
    ratio = F.coalesce(F.try_divide(F.col("mean_ic"), F.col("std_ic")), F.lit(0.0))
    return per.select(key, "chunks", "mean_ic", "std_ic", (ratio * F.sqrt(F.col("chunks").cast("double"))).alias("t_stat"), (ratio * math.sqrt(252)).alias("ir"), "positive_rate")


def quantile_returns(pairs: DataFrame, signal: str, ret: str, quantiles: int = 5, key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """(key, quantile, n, mean_ret): bins of n div quantiles pairs by signal, the last takes the rest; none below 2 pairs a bin."""
    w = Window.partitionBy(key).orderBy(signal, order)
    df = clean_pairs(pairs, signal, ret).withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(key))}).filter(F.col("_n") >= 2 * quantiles)
    df = df.withColumn("quantile", F.least(F.floor(F.col("_r") / F.floor(F.col("_n") / quantiles)), F.lit(quantiles - 1)).cast("int"))
    return df.groupBy(key, "quantile").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_ret"))


def quantile_spread(pairs: DataFrame, signal: str, ret: str, quantiles: int = 5, key: str = "symbol") -> DataFrame:
    """(key, spread, monotonicity): mean return of the top bin less that of the bottom, and the rank correlation of bins and means."""
    bins = quantile_returns(pairs, signal, ret, quantiles, key)
    edge = bins.groupBy(key).agg((F.max_by("mean_ret", "quantile") - F.min_by("mean_ret", "quantile")).alias("spread"))
    return edge.join(spearman(bins, [key], "quantile", "mean_ret").select(key, F.col("ic").alias("monotonicity")), key)


def rank_autocorrelation(df: DataFrame, signal: str, lags: int = 5, key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """(key, lag, autocorrelation) of the signal without its missing values."""
    w = Window.partitionBy(key).orderBy(order)
    clean = clean_pairs(df, signal, signal).select(key, order, signal)
    lagged = clean.withColumn("_p", F.explode(F.array(*[F.lit(k) for k in range(1, lags + 1)]))).withColumnRenamed("_p", "lag")
    cols = clean.select(key, signal, *[F.lag(signal, k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    lagged = cols.select(key, signal, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("_before")) for k in range(1, lags + 1)])).alias("_s")).select(key, signal, "_s.*").filter("_before is not null")
    return spearman(lagged, [key, "lag"], "_before", signal).select(key, "lag", F.col("ic").alias("autocorrelation"))


def analyze(df: DataFrame, signal: str, horizons: tuple[int, ...] = (1, 5, 10), quantiles: int = 5, lags: int = 5, key: str = "symbol") -> DataFrame:
    """(key, part, at, metric, value): of bars with a signal, part 'rank_ic' and 'quantile_spread' at each horizon, and 'autocorrelation' at each lag (1 at lag 0)."""
    def long(found: DataFrame, part: str, at, values: tuple[str, ...]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("_m")
        return found.select(key, F.lit(part).alias("part"), at.cast("int").alias("at"), each).select(key, "part", "at", "_m.*")

    out = long(rank_autocorrelation(df, signal, lags, key), "autocorrelation", F.col("lag"), ("autocorrelation",))
    out = out.unionByName(long(clean_pairs(df, signal, signal).select(key).distinct().withColumn("autocorrelation", F.lit(1.0)), "autocorrelation", F.lit(0), ("autocorrelation",)))
    for h in horizons:
        pairs = forward_returns(df, h, key=key)
        out = out.unionByName(long(rank_ic(pairs, signal, "fwd", key), "rank_ic", F.lit(h), ("chunks", "mean_ic", "std_ic", "t_stat", "ir", "positive_rate")))
        out = out.unionByName(long(quantile_spread(pairs, signal, "fwd", quantiles, key), "quantile_spread", F.lit(h), ("spread", "monotonicity")))
    return out


def neutralized(df: DataFrame, signal: str, market: str, key: str = "symbol") -> DataFrame:
    """df with ``neutral``: the signal's least-squares residual on the market over the clean pairs of its key, as a z-score.

    Below three pairs or with a constant market the signal itself is scored. Rows that are no clean pair have null.
    """
    fine = F.col(signal).isNotNull() & F.col(market).isNotNull() & ~F.isnan(signal) & ~F.isnan(market)
    x, y = F.when(fine, F.col(market)), F.when(fine, F.col(signal))
    df = _with(df, key, _n=F.count(x), _mx=F.avg(x), _my=F.avg(y), _v=F.var_samp(x), _c=F.covar_samp(x, y))
    beta = F.when((F.col("_n") >= 3) & (F.col("_v") > 1e-12), F.col("_c") / F.when(F.col("_v") > 1e-12, F.col("_v")))
    df = df.withColumn("_res", F.when(fine, F.when(beta.isNull(), F.col(signal)).otherwise(F.col(signal) - F.col("_my") - beta * (F.col(market) - F.col("_mx")))))
    return _scored(df, key, "_res", "neutral").drop("_n", "_mx", "_my", "_v", "_c", "_res")


def orthogonalized(df: DataFrame, signals: list[str], key: str = "symbol") -> DataFrame:
    """df with each signal less its uncentred projections on the ones before it (Gram-Schmidt), as z-scores under the names orth_*.

    The projections need only the products of every two signals, summed per key over the rows that have all signals, so one aggregate gives
    each signal's weights on the ones before it, whatever the number of signals; a second one gives the scores. Other rows come out null.
    """
    k, whole = len(signals), F.lit(True)
    for s in signals:
        whole = whole & F.col(s).isNotNull()
    found = df.groupBy(F.col(key).alias("_key")).agg(*[F.sum(F.when(whole, F.col(signals[i]) * F.col(signals[j]))).alias(f"_d{i}_{j}") for i in range(k) for j in range(i, k)])
    product = lambda p, q: F.col(f"_d{min(p, q)}_{max(p, q)}")
    for i in range(k):
        found = found.withColumns({f"_a{i}_{j}": F.lit(float(i == j)) for j in range(i + 1)})
        for b in range(i):
            dot = sum((F.col(f"_a{i}_{p}") * F.col(f"_a{b}_{q}") * product(p, q) for p in range(i + 1) for q in range(b + 1)), F.lit(0.0))
            size = sum((F.col(f"_a{b}_{p}") * F.col(f"_a{b}_{q}") * product(p, q) for p in range(b + 1) for q in range(b + 1)), F.lit(0.0))
            found = found.withColumn("_c", F.coalesce(F.try_divide(dot, size), F.lit(0.0)))
            found = found.withColumns({f"_a{i}_{j}": F.col(f"_a{i}_{j}") - F.col("_c") * F.col(f"_a{b}_{j}") for j in range(b + 1)})
    weights = [f"_a{i}_{j}" for i in range(k) for j in range(i + 1)]
    df = df.join(found.select("_key", *weights), df[key].eqNullSafe(found["_key"])).drop("_key")
    df = df.withColumns({f"_g{i}": F.when(whole, sum((F.col(f"_a{i}_{j}") * F.col(signals[j]) for j in range(i + 1)), F.lit(0.0))) for i in range(k)}).drop(*weights)
    df = _with(df, key, **{f"_m{i}": F.avg(f"_g{i}") for i in range(k)}, **{f"_s{i}": F.stddev_samp(f"_g{i}") for i in range(k)})
    scores = {f"orth_{s}": (F.col(f"_g{i}") - F.col(f"_m{i}")) / F.when(F.coalesce(f"_s{i}", F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s{i}")) for i, s in enumerate(signals)}
    return df.withColumns(scores).drop(*[f"_{x}{i}" for x in "gms" for i in range(k)])


def correlations(df: DataFrame, series: str = "strategy", at: list[str] | None = None, value: str = "ret") -> DataFrame:
    """(a, b, n, cov, corr) of every two of a small, checked number of series, aligned by ``at``."""
    at = at or ["bar_idx"]
    if (n := df.select(series).distinct().limit(1001).count()) > 1000:
        raise ValueError("more than 1000 series")
    x, y = df.select(*at, F.col(series).alias("a"), F.col(value).alias("_x")), df.select(*at, F.col(series).alias("b"), F.col(value).alias("_y"))
    pairs = x.join(y, at).filter("a <= b") if n else x.join(y, at)
    per = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("_x", "_y").alias("cov"), F.stddev_samp("_x").alias("_s"), F.stddev_samp("_y").alias("_t"))
    r = F.coalesce(F.try_divide(F.col("cov"), F.col("_s") * F.col("_t")), F.lit(0.0))
    return per.select("a", "b", "n", F.coalesce("cov", F.lit(0.0)).alias("cov"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("corr"))


def novelty(corr: DataFrame) -> DataFrame:
    """(series, novelty): 1 less the largest absolute correlation with any other series."""
    both = corr.filter("a <> b").select(F.explode(F.array("a", "b")).alias("series"), F.abs("corr").alias("_r"))
    return both.groupBy("series").agg((1 - F.max("_r")).alias("novelty"))
