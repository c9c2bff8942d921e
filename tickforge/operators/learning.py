"""Models over bars: regimes by Gaussian mixtures and a boosted-tree meta-learner over expressions."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.compiler import evaluate
from tickforge.functions.expr import Node
from tickforge.session import materialize


def mixture_regimes(bars: DataFrame, regimes: int = 3, window: int = 20, seed: int = 42) -> DataFrame:
    """(symbol, bar_idx, regime) by a mixture over (return, volatility); regime 0 is the one of least volatility."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    df = bars.withColumn("_r", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
    df = df.withColumn("_v", F.coalesce(F.stddev_pop("_r").over(w.rowsBetween(-(window - 1), 0)), F.lit(0.0))).select("symbol", "bar_idx", "_r", "_v")
    data = VectorAssembler(inputCols=["_r", "_v"], outputCol="_x").transform(df)
    data = materialize(data.withColumn("_x", vector_to_array("_x")), "regimes").withColumn("_x", array_to_vector("_x"))  # the fit reads it again and again
    model = GaussianMixture(featuresCol="_x", k=regimes, seed=seed, maxIter=30).fit(data)
    order = sorted(range(regimes), key=lambda i: float(model.gaussians[i].mean[1]))
    named = F.element_at(F.create_map(*[F.lit(x) for i, g in enumerate(order) for x in (g, i)]), F.col("prediction"))
    return model.transform(data).select("symbol", "bar_idx", named.alias("regime"))


def meta_predictions(bars: DataFrame, expressions: dict[str, Node], horizon: int = 1, train: float = 0.7, seed: int = 42, rounds: int = 10) -> DataFrame:
    """(symbol, bar_idx, predicted, actual): forward log returns by boosted trees over expressions, fitted on the first bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    df = evaluate(bars, expressions).withColumn("actual", F.ln(F.try_divide(F.lead("close", horizon).over(w), F.col("close"))))
    df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter("actual is not null")
    names = list(expressions)
    early = df.filter(F.col("bar_idx") < F.col("_n") * train - horizon)
    filled = Imputer(inputCols=names, outputCols=[f"_f_{n}" for n in names]).fit(early)
    shape = VectorAssembler(inputCols=[f"_f_{n}" for n in names], outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol="actual", predictionCol="predicted", maxIter=rounds, maxDepth=3, seed=seed).fit(shape.transform(filled.transform(early)))
    return model.transform(shape.transform(filled.transform(df.filter(F.col("bar_idx") >= F.col("_n") * train)))).select("symbol", "bar_idx", "predicted", "actual")
