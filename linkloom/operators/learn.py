"""Scorers of pairs, temperature scaling and model gates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class PairScorer(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame:
        """pairs with p."""


class TreeScorer:
    """Gradient-boosted trees over named feature columns."""

    def __init__(self, features: list[str], label: str = "label", trees: int = 50, depth: int = 5, rate: float = 0.05, seed: int = 13):
        self.features, self.label, self.model = features, label, None
        self.options = {"maxIter": trees, "maxDepth": depth, "stepSize": rate, "seed": seed}

    def _with(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep").transform(df)

    def fit(self, pairs: DataFrame) -> "TreeScorer":
        from pyspark.ml.classification import GBTClassifier

        self.model = GBTClassifier(featuresCol="_features", labelCol=self.label, **self.options).fit(self._with(pairs))
        return self

    def score(self, pairs: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self._with(pairs))
        return out.withColumn("p", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def external(load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]):
    """A UDF of two texts for a model outside Spark, loaded once a task."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield model(a, b)

    return run


def probability(logit: Column, temperature: float) -> Column:
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit / temperature))
    return 1 / (1 + F.exp(-z))


def nll(logit: Column, label: Column, temperature: float) -> Column:
    """Log loss of a pair at a temperature, without overflow."""
    z = logit / temperature
    return F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))


def temperature_losses(rows: DataFrame, grid: list[float], logit: str = "logit", label: str = "label") -> DataFrame:
    """temperature and mean log loss, all of the grid in one pass."""
    one = rows.agg(*[F.avg(nll(F.col(logit), F.col(label), t)).alias(f"t{i}") for i, t in enumerate(grid)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.round(F.col(f"t{i}"), 6).alias("nll")) for i, t in enumerate(grid)])).alias("x")).select("x.*")


def fit_temperature(rows: DataFrame, logit: str = "logit", label: str = "label", passes: int = 4, points: int = 16) -> float:
    """The temperature in [0.001, 100] of least loss: each pass over the rows tries a finer grid of logarithms."""
    low, high = math.log(1e-3), math.log(100.0)
    for _ in range(passes):
        at = [low + (high - low) * k / (points - 1) for k in range(points)]
        losses = rows.agg(*[F.avg(nll(F.col(logit), F.col(label), math.exp(x))).alias(f"t{i}") for i, x in enumerate(at)]).first()
        best = min(range(points), key=lambda i: (losses[i] if losses[i] is not None else math.inf, i))
        low, high = at[max(best - 1, 0)], at[min(best + 1, points - 1)]
    return math.exp((low + high) / 2)


def merge_scores(pairs: DataFrame, old: DataFrame, score: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """pairs with the score of `old` where there is one; only the others are scored."""
    new = score(pairs.join(old.select(*keys), keys, "left_anti")).select(*keys, "score")
    return pairs.join(old.select(*keys, "score").unionByName(new), keys, "left")


def splice(rows: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with `column` replaced at new's keys."""
    return rows.join(new.select(*keys, F.col(column).alias("_new")), keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


#: Gates of model choice.
SHIP_F05, PLUGIN_GAIN, PLUGIN_PRECISION, PLUGIN_SINGLETONS = 0.953, 0.001, 0.993, 0.978


def ships(f05: float) -> bool:
    return f05 >= SHIP_F05


def plugin_passes(old: dict, new: dict) -> bool:
    return new["macro_f05"] >= old["macro_f05"] + PLUGIN_GAIN and new["macro_precision"] >= PLUGIN_PRECISION and new["singleton_accuracy"] >= PLUGIN_SINGLETONS
