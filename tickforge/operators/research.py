"""Robustness and selection statistics: reshuffles, bootstraps, reality check, p-values, regimes, comparison of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.session import broadcast_if_small


def _draw(*parts: Column) -> Column:
    """A number in [0, 2**60) that depends on the parts alone, the same in every engine: the first 15 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def nearest_rank(values: Column, n: Column, p: float) -> Column:
    """sorted[int((n - 1) * p)] of an array."""
    return F.get(F.sort_array(values), F.floor((n - 1) * p).cast("int"))


def monte_carlo(returns: DataFrame, keys: list[str], sims: int = 100, seed: int = 42, order: str = "bar_idx", ret: str = "ret") -> DataFrame:
    """(keys, metric, p05, p50, p95) of total_return, sharpe and max_drawdown over reshuffles of each key's returns.

    Each simulation orders the returns by a hash of (seed, simulation, bar); sims is a parameter, so the per-key list of results is bounded.
    """
    grid = returns.select(*keys, order, ret).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    grid = grid.withColumn("_o", F.md5(F.concat_ws("|", F.lit(seed), F.col("sim"), F.col(order).cast("string"))))
    w = Window.partitionBy(*keys, "sim").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("_e", F.product(1 + F.col(ret)).over(w)).withColumn("_dd", F.col("_e") / F.greatest(F.lit(1.0), F.max("_e").over(w)) - 1)
    sharpe = math.sqrt(252) * F.try_divide(F.avg(ret), F.stddev_samp(ret))
    per = grid.groupBy(*keys, "sim").agg((F.product(1 + F.col(ret)) - 1).alias("total_return"), F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), F.abs(F.least(F.min("_dd"), F.lit(0.0))).alias("max_drawdown"))
    long = per.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("total_return", "sharpe", "max_drawdown")])).alias("_m")).select(*keys, "_m.*")
    out = long.groupBy(*keys, "metric").agg(F.collect_list("v").alias("_v"), F.count(F.lit(1)).alias("_n"))
    return out.select(*keys, "metric", *[nearest_rank(F.col("_v"), F.col("_n"), p).alias(f"p{int(p * 100):02d}") for p in (0.05, 0.5, 0.95)])


def _resampled(returns: DataFrame, keys: list[str], sims: int, seed: int, order: str, ret: str) -> DataFrame:
    """(keys, sim, mean) of bootstrap resamples: row j of a resample is the one numbered by a hash of (seed, sim, j)."""
    n = returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draws = returns.select(*keys, F.col(order).alias("_j")).join(n, keys).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    draws = draws.withColumn("_i", F.pmod(_draw(F.lit(seed), F.col("sim"), F.col("_j")), F.col("_n")))
    base = returns.select(*keys, F.col(order).alias("_i"), F.col(ret).alias("_r"))
    return draws.join(broadcast_if_small(base), [*keys, "_i"]).groupBy(*keys, "sim").agg(F.avg("_r").alias("mean"))  # means are combined before they are shuffled


def bootstrap_interval(returns: DataFrame, keys: list[str], sims: int = 1000, seed: int = 7, order: str = "bar_idx", ret: str = "ret") -> DataFrame:
    """(keys, mean, lower, upper): the mean return and the 95 % interval of its resampled means. order must number the rows from 0."""
    means = _resampled(returns, keys, sims, seed, order, ret).groupBy(*keys).agg(F.sort_array(F.collect_list("mean")).alias("_m"))
    base = returns.groupBy(*keys).agg(F.avg(ret).alias("mean"))
    return base.join(means, keys).select(*keys, "mean", F.get("_m", F.lit(int(0.025 * sims))).alias("lower"), F.get("_m", F.lit(int(0.975 * sims) - 1)).alias("upper"))


def reality_check(returns: DataFrame, series: str = "strategy", sims: int = 500, seed: int = 11, order: str = "bar_idx", ret: str = "ret") -> DataFrame:
    """(best_mean, p_value): the best mean of any series against the best of uncentred resamples."""
    null = _resampled(returns, [series], sims, seed, order, ret).groupBy("sim").agg(F.max("mean").alias("top"))
    best = returns.groupBy(series).agg(F.avg(ret).alias("m")).agg(F.max("m").alias("best_mean")).first()[0]
    return null.agg(F.lit(best).alias("best_mean"), F.avg((F.col("top") >= F.lit(best)).cast("double")).alias("p_value"))


def deflated_sharpe(scores: DataFrame, keys: list[str], ident: str, sharpe: str) -> DataFrame:
    """(keys, ident, sharpe, deflated): a Sharpe ratio less the mean and sqrt(2 var ln trials) of its group's."""
    part = Window.partitionBy(*keys)
    n = F.count(sharpe).over(part)
    bar = F.avg(sharpe).over(part) + F.sqrt(F.coalesce(F.var_samp(sharpe).over(part), F.lit(0.0)) * 2 * F.ln(F.greatest(n, F.lit(1)).cast("double")))
    return scores.filter(F.col(sharpe).isNotNull()).select(*keys, ident, sharpe, (F.col(sharpe) - bar).alias("deflated"))


def overfit_proxy(scores: DataFrame, keys: list[str], sharpe: str) -> DataFrame:
    """(keys, n, share_not_positive, best, median)."""
    return scores.filter(F.col(sharpe).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(sharpe) <= 0).cast("double")).alias("share_not_positive"), F.max(sharpe).alias("best"), F.percentile(sharpe, 0.5).alias("median"))


def adjusted_p(df: DataFrame, keys: list[str], ident: str, p: str) -> DataFrame:
    """(keys, ident, p, bh, bonferroni): min(1, p n / rank) without a monotone step, and min(1, p n)."""
    n = F.count(p).over(Window.partitionBy(*keys))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(p, ident))
    return df.filter(F.col(p).isNotNull()).select(*keys, ident, p, F.least(F.lit(1.0), F.col(p) * n / r).alias("bh"), F.least(F.lit(1.0), F.col(p) * n).alias("bonferroni"))


def regime_labels(bars: DataFrame, window: int = 20, key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """bars with ``regime``: high_vol if the returns of the last ``window`` bars vary by more than twice their mean's size, else by its sign."""
    w = Window.partitionBy(key).orderBy(order)
    df = bars.withColumn("_r", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
    part = w.rowsBetween(-(window - 1), 0)
    m, s = F.avg("_r").over(part), F.stddev_pop("_r").over(part)
    return df.withColumn("regime", F.when(s > 2 * F.abs(m), "high_vol").when(m > 0, "uptrend").otherwise("downtrend")).drop("_r")


def best_per_strategy(rows: DataFrame) -> DataFrame:
    """One row per strategy_id: the best by robustness score, then test Sharpe, then the latest ingest; missing scores last."""
    fine = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c))
    key = F.struct(F.coalesce(fine("robustness_score"), F.lit(-math.inf)).alias("a"), F.coalesce(fine("test_sharpe"), F.lit(-math.inf)).alias("b"), F.col("ingest_id").alias("c"))
    return rows.groupBy("strategy_id").agg(F.max_by(F.struct("ingest_id", "test_sharpe", "robustness_score", "complexity"), key).alias("_b")).select("strategy_id", "_b.*")


def top_k(rows: DataFrame, k: int, by: str = "test_sharpe", ident: str = "ingest_id") -> DataFrame:
    """The k rows with the largest finite ``by``; ties by ident."""
    return rows.filter(F.col(by).isNotNull() & ~F.isnan(by) & (F.abs(by) < float("inf"))).orderBy(F.col(by).desc(), F.col(ident)).limit(k)


def population(rows: DataFrame) -> DataFrame:
    """One row per run: candidates, distinct strategies and generations, mean test Sharpe, positive ones, diversity."""
    fine = F.when(~F.isnan("test_sharpe") & (F.abs("test_sharpe") < float("inf")), F.col("test_sharpe"))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.countDistinct("strategy_id").alias("strategies"), F.countDistinct("generation").alias("generations"), F.avg(fine).alias("mean_sharpe"),
        F.count_if(fine > 0).alias("positive"), (F.countDistinct("strategy_id") / F.count(F.lit(1))).alias("diversity"),
    )


def root_usage(rows: DataFrame, expression: str = "expression") -> DataFrame:
    """(run_id, root, candidates): how often each operator or primitive is the root of a run's expressions: the operator between the two sides of an
    infix text in brackets, else the name ahead of the bracket, else the text. Null expressions are left out."""
    text = F.trim(expression)
    depth = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("d"), F.lit("").alias("op"), F.lit(" ").alias("last")), lambda a, c: F.struct(
        (a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), F.when((a["d"] == 1) & (a["last"] == " ") & c.isin("+", "-", "*", "/") & (a["op"] == ""), c).otherwise(a["op"]).alias("op"), c.alias("last")))["op"]
    root = F.when(text.startswith("("), depth).otherwise(F.substring_index(text, "(", 1))
    return rows.filter(F.col(expression).isNotNull()).groupBy("run_id", root.alias("root")).agg(F.count(F.lit(1)).alias("candidates"))


def robustness_score(flat: DataFrame, ident: str = "record_id") -> DataFrame:
    """(ident, robustness) of parsed records: 50 times the share of cost scenarios with a positive Sharpe ratio, 30 times that of
    parameter scenarios, and 20 unless the lower quantile of the simulated total return is -1 or less. A missing ratio is not
    positive, a missing quantile counts as 0; records without any row have no score."""
    value = lambda k: F.try_element_at("fields", F.lit(k)).try_cast("double")
    good = lambda x: F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)).cast("double")
    share = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, good(value("metrics/sharpe")))), F.lit(0.0))
    low = F.max(F.when((F.col("kind") == "quantile") & F.col("node_path").endswith("/total_return"), value("p05")))
    per = flat.groupBy(ident).agg(share("cost_scenario").alias("_c"), share("parameter_scenario").alias("_p"), F.coalesce(low, F.lit(0.0)).alias("_q"))
    alive = (F.col("_q") > -1) & ~F.isnan("_q")
    return per.select(ident, (50 * F.col("_c") + 30 * F.col("_p") + F.when(alive, 20.0).otherwise(0.0)).alias("robustness"))
