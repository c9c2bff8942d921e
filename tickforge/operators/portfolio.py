"""Weights over a few strategies from their covariance; the matrices come from Spark, the algebra on K x K runs on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators.backtest import with_equity
from tickforge.operators.factor import correlations
from tickforge.operators.shards import assign_shards, carry
from tickforge.session import materialize


def matrix(pairs: DataFrame, value: str = "cov") -> tuple[list[str], np.ndarray]:
    """(names, symmetric matrix) of a (a, b, value) frame of at most 1000 series."""
    rows = pairs.select("a", "b", value).limit(1_000_001).collect()
    names = sorted({x for r in rows for x in (r["a"], r["b"])})
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r[value] or 0.0
    return names, out


def _normal(w: np.ndarray) -> np.ndarray:
    total = w.sum()
    return w / total if total > 0 else np.full(len(w), 1 / max(1, len(w)))


def equal_weight(cov: np.ndarray) -> np.ndarray:
    return np.full(len(cov), 1 / max(1, len(cov)))


def inverse_variance(cov: np.ndarray) -> np.ndarray:
    return _normal(1 / np.maximum(np.diag(cov), 1e-12))


def min_variance(cov: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Row sums of the ridged inverse, without short positions."""
    return _normal(np.maximum(np.linalg.inv(cov + ridge * np.eye(len(cov))).sum(1), 0))


def risk_parity(cov: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Inverse volatilities, then ``rounds`` times each weight over its marginal risk, normalised."""
    w = _normal(1 / np.sqrt(np.maximum(np.diag(cov), 1e-12)))
    for _ in range(rounds):
        w = _normal(w / np.maximum(cov @ w, 1e-12))
    return w


def _leaves(corr: np.ndarray) -> list[int]:
    """Leaf order of the single-linkage tree over the distances sqrt((1 - corr) / 2)."""
    n = len(corr)
    d = np.sqrt(np.maximum(0, (1 - corr) / 2))
    groups = {i: [i] for i in range(n)}
    edges = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    of = list(range(n))
    for _, i, j in edges:
        a, b = of[i], of[j]
        if a != b:
            groups[a] = groups[a] + groups.pop(b)
            for x in groups[a]:
                of[x] = a
    return next(iter(groups.values()), [])


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: bisect the leaf order, and split weight by the variances of the halves' inverse-variance portfolios."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    order = _leaves(np.clip(cov / np.outer(sd, sd), -1, 1))
    w, todo = np.ones(len(cov)), [order]

    def variance(part: list[int]) -> float:
        c = cov[np.ix_(part, part)]
        v = inverse_variance(c)
        return float(v @ c @ v)

    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        a, b = part[: len(part) // 2], part[len(part) // 2 :]
        va, vb = variance(a), variance(b)
        share = 1 - va / (va + vb) if va + vb > 0 else 0.5
        w[a] *= share
        w[b] *= 1 - share
        todo += [a, b]
    return _normal(w)


METHODS = {"equal": equal_weight, "inverse_variance": inverse_variance, "min_variance": min_variance, "risk_parity": risk_parity, "hrp": hierarchical}


def prune(names: list[str], corr: np.ndarray, sharpe: dict[str, float], limit: float = 0.65) -> list[str]:
    """Names by falling Sharpe ratio, each kept unless it correlates beyond limit with one kept before."""
    at, kept = {n: i for i, n in enumerate(names)}, []
    for n in sorted(names, key=lambda n: (-sharpe.get(n, 0.0), n)):
        if all(abs(corr[at[n], at[k]]) <= limit for k in kept):
            kept.append(n)
    return kept


def ensemble(returns: DataFrame, scores: dict[str, float], method: str = "risk_parity", limit: float = 0.65) -> dict:
    """{kept, weights, metrics} of strategies given as (strategy, bar_idx, ret): pruned by correlation from the best score down, weighted by the
    covariance of the rest, and combined. metrics: sharpe, max_drawdown and total_return of the combined returns (bar 0 left out), how many
    strategies there were and are, and the diversification ratio."""
    pairs = materialize(correlations(returns), "pairs")
    names, corr = matrix(pairs, "corr")
    kept = prune(names, corr, scores, limit)
    _, cov = matrix(pairs, "cov")
    part = [names.index(k) for k in kept]
    c = cov[np.ix_(part, part)]
    weights = dict(zip(kept, METHODS[method](c).tolist(), strict=True))
    spark = returns.sparkSession
    w = spark.createDataFrame(list(weights.items()) or [("", 0.0)], "strategy string, _w double")
    total = returns.join(F.broadcast(w), "strategy").groupBy("bar_idx").agg(F.sum(F.col("ret") * F.col("_w")).alias("ret"))
    total = materialize(combined(total), "ensemble")
    m = total.agg(F.avg(F.when(F.col("bar_idx") > 0, F.col("ret"))).alias("m"), F.stddev_samp(F.when(F.col("bar_idx") > 0, F.col("ret"))).alias("s"), F.max_by("equity", "bar_idx").alias("e"), F.min("_low").alias("low")).first()
    sd, vol = m["s"] or 0.0, float(np.array(list(weights.values())) @ np.sqrt(np.maximum(np.diag(c), 1e-12))) if kept else 0.0
    metrics = {
        "sharpe": math.sqrt(252) * m["m"] / sd if sd > 0 else 0.0, "max_drawdown": abs(m["low"] or 0.0), "total_return": (m["e"] or 1.0) - 1,
        "selected": len(kept), "given": len(names), "diversification_ratio": vol / sd if sd > 0 else 1.0,
    }
    return {"kept": kept, "weights": weights, "metrics": metrics}


def combined(returns: DataFrame) -> DataFrame:
    """(bar_idx, ret, equity, _low) of one series of returns: its equity, in shards if it is long, and how far it is below its peak."""
    rows, split = assign_shards(returns.select(F.lit(0).alias("_all"), "bar_idx", "ret"), ["_all"], "bar_idx")
    rows = with_equity(rows if split else rows.drop("_shard"), ["_all"])
    shards = ["_shard"] if split else []
    peak = F.max("equity").over(Window.partitionBy("_all", *shards).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_peak", peak)
    if split:
        rows = rows.join(F.broadcast(carry(rows, ["_all"], {"_top": F.max("equity")}, F.max)), ["_all", "_shard"], "left").withColumn("_peak", F.greatest("_peak", "_top"))
    return rows.select("bar_idx", "ret", "equity", (F.col("equity") / F.greatest("_peak", F.lit(1.0)) - 1).alias("_low"))
