"""Queries of the research engine over the test tables: bars, indicators, backtests, point-in-time data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.compiler import evaluate
from tickforge.functions.expr import REGISTERED, Node, Primitive, example, registry
from tickforge.operators import backtest as bt
from tickforge.operators import pit
from tickforge.plans.engine_sql import ORACLE
from tickforge.session import read
from tickforge.sources import bars as src

P = Primitive
FLAGSHIP = example()
#: Changes position far more often than the flagship.
CROSSOVER = (P("SMA", 5) - P("SMA", 20)) / P("ATR", 14)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that engines that sum in another order agree; no negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(src.event_bars(spark, d).drop("bucket"))


GROUPS = {
    "averages": {"SMA": 20, "ROLLING_MEAN": 7, "WMA": 10, "HMA": 16, "TRIMA": 10, "VWAP": 14},
    "extremes": {"HIGH": 9, "HIGHEST_HIGH": 14, "LOW": 9, "LOWEST_LOW": 14, "ROLLING_MIN": 5, "ROLLING_MAX": 5, "DONCHIAN_UPPER": 20, "DONCHIAN_LOWER": 20, "DONCHIAN_MIDDLE": 20, "ROLLING_MEDIAN": 8},
    "moments": {"ROLLING_STD": 12, "ROLLING_SKEW": 12, "ROLLING_KURTOSIS": 12, "VOLATILITY": 10, "REALIZED_VOL": 21, "PARKINSON_VOL": 14, "GK_VOL": 14},
    "momentum": {"MOMENTUM": 10, "ROC": 12, "LAG_1": 14, "LAG_2": 14, "LAG_5": 14, "DELTA_1": 14, "DELTA_5": 14, "RSI": 17, "CMO": 14, "LOG_RETURN": 14, "CUM_RETURN": 14},
    "bands": {"BOLLINGER_BANDWIDTH": 20, "BB_UPPER": 20, "BB_MIDDLE": 20, "BB_LOWER": 20, "BB_PERCENT": 20, "BB_WIDTH": 20, "STOCHASTIC": 14, "WILLIAMS_R": 14, "CCI": 20},
    "ranges": {"ATR": 14, "TRUE_RANGE": 3, "TRUE_RANGE_PCT": 9, "RANGE_PCT": 14},
    "volumes": {"OBV": 14, "DOLLAR_VOLUME": 14, "VOLUME_ZSCORE": 20, "VOLUME_RATIO": 10, "CHAIKIN_MONEY_FLOW": 14, "CMF": 5, "MONEY_FLOW_INDEX": 14, "MFI": 6, "AD_LINE": 14, "EASE_OF_MOVEMENT": 10},
    "shared_rules": {"PRICE_RANK": 10, "PRICE_ZSCORE": 20, "PRICE_SLOPE": 10, "VOLUME_SMA": 8, "ALMA": 9, "FUNDING_RATE": 14, "ORDERBOOK_IMBALANCE": 14},
    "exponential": {"EMA": 10, "MACD": 26, "PPO": 20, "FORCE_INDEX": 13, "ZLEMA": 12, "KELTNER_MIDDLE": 20, "KELTNER_UPPER": 20, "KELTNER_LOWER": 20},
    "chained": {"DEMA": 9, "TEMA": 9, "TRIX": 9, "TSI": 12, "KST": 10},
    "adaptive": {"KAMA": 10},
}


def _primitives(group: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        names = GROUPS[group]
        out = evaluate(src.event_bars(spark, d), {f"x_{n}": P(n, p) for n, p in names.items()})
        # means of prices of few places would often end on a 5 at six places
        return rounded(out.select("symbol", "bar_idx", *[F.col(f"x_{n}").alias(n.lower()) for n in names]), 9 if group == "averages" else 6)

    return query


def primitive_registry(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(registry())


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return src.quality_report(read(spark, d, "feed"))


def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return src.chronological_split(read(spark, d, "feed"), "ts", "row_id").select("row_id", "part")


def pit_visible(spark: SparkSession, d: str) -> DataFrame:
    return pit.visible(read(spark, d, "feed"), "ts", "available_at", "2024-06-01 00:00:00").select("row_id", "symbol", "close_px")


def corporate_actions_adjusted(spark: SparkSession, d: str) -> DataFrame:
    prices = ["open_px", "high_px", "low_px", "close_px"]
    rows = read(spark, d, "feed").select("row_id", "symbol", "ts", *prices)
    out = pit.back_adjusted(rows, read(spark, d, "corporate_actions"), prices, "row_id").drop("ts")
    return out.withColumns({p: F.col(p).cast("float") for p in prices})  # two engines agree on as many places, in whatever order they multiply


def universe_asof(spark: SparkSession, d: str) -> DataFrame:
    dates = spark.sql("SELECT explode(sequence(timestamp_ntz'2018-01-01', timestamp_ntz'2025-01-01', interval 3 months)) AS as_of")
    return pit.universe(read(spark, d, "memberships"), dates)


def universe_faults(spark: SparkSession, d: str) -> DataFrame:
    return pit.universe_faults(read(spark, d, "memberships")).select("membership_id", "symbol")


def reconcile_positions(spark: SparkSession, d: str) -> DataFrame:
    fills = read(spark, d, "fills").filter("symbol is not null").withColumn("quantity", F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity")))
    once = fills.groupBy("exec_ref").agg(F.min_by("symbol", "fill_id").alias("symbol"), F.min_by("quantity", "fill_id").alias("quantity"))
    return rounded(pit.reconcile(fills, once))


def ledger_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pit.ledger(read(spark, d, "fills")), 4)


def _of(operator, genome: Node):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return rounded(operator(src.event_bars(spark, d), genome))

    return query


def _curve(bars: DataFrame, genome: Node) -> DataFrame:
    return bt.backtest(bars, genome).select("symbol", "bar_idx", F.col("raw").cast("int").alias("raw"), F.col("position").cast("int").alias("position"), "ret", "equity")


def _metrics(bars: DataFrame, genome: Node) -> DataFrame:
    return bt.metrics(bt.backtest(bars, genome), ["symbol"])


def _folds(kind: str, mean: bool = False):
    def folds(bars: DataFrame, genome: Node) -> DataFrame:
        per = bt.fold_metrics(bars, genome, kind, bounds=not mean)
        return per.groupBy("symbol").agg(*[F.avg(m).alias(m) for m in bt.METRICS]) if mean else per

    return folds


backtest_metrics = _of(_metrics, FLAGSHIP)


def cross_sectional_backtest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.cross_sectional(src.event_bars(spark, d), P("ROC", 10)))


def central_clearing(spark: SparkSession, d: str) -> DataFrame:
    out = bt.cleared(src.event_bars(spark, d), [P("MOMENTUM", 5), P("MOMENTUM", 20), P("SMA", 10) - P("SMA", 30)])
    return rounded(out.select("symbol", "strategy", "bar_idx", F.col("position").cast("int").alias("position"), F.col("order").cast("int").alias("order"), "cost", "ret", "equity"))


def robustness_suite(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.robustness_suite(src.event_bars(spark, d), CROSSOVER, sims=20))


QUERIES = {
    "backtest_metrics": backtest_metrics, "backtest_curve": _of(_curve, FLAGSHIP), "crossover_metrics": _of(_metrics, CROSSOVER), "crossover_curve": _of(_curve, CROSSOVER), "bars": bars, **{f"prim_{g}": _primitives(g) for g in GROUPS}, "primitive_registry": primitive_registry,
    "quality_report": quality_report, "chronological_split": chronological_split, "pit_visible": pit_visible, "corporate_actions_adjusted": corporate_actions_adjusted,
    "universe_asof": universe_asof, "universe_faults": universe_faults, "reconcile_positions": reconcile_positions, "ledger_positions": ledger_positions,
    "cross_sectional_backtest": cross_sectional_backtest, "central_clearing": central_clearing, "cost_sensitivity": _of(bt.cost_sensitivity, FLAGSHIP), "parameter_sensitivity": _of(bt.parameter_sensitivity, FLAGSHIP),
    "crossover_costs": _of(bt.cost_sensitivity, CROSSOVER), "crossover_parameters": _of(bt.parameter_sensitivity, CROSSOVER), "robustness_suite": robustness_suite,
    "walk_forward": _of(_folds("walk_forward"), FLAGSHIP), "purged_cross_validation": _of(_folds("purged"), FLAGSHIP), "crossover_walk_forward": _of(_folds("walk_forward"), CROSSOVER), "crossover_purged": _of(_folds("purged"), CROSSOVER),
    "walk_forward_mean": _of(_folds("walk_forward", True), CROSSOVER), "purged_mean": _of(_folds("purged", True), CROSSOVER),
}

ORACLE["primitive_registry"] = "SELECT name, 'series' AS output, CAST(14 AS BIGINT) AS warmup, true AS online_safe, true AS lookahead_safe FROM (VALUES " + ", ".join(f"('{n}')" for n in REGISTERED) + ") t(name)"
