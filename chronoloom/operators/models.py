"""Forecasters behind the walk-forward. Complete cases only; nothing is imputed.

A learner is anything with a name and fit(train, features, target), which gives a function from test rows to the same rows
with `pred`. Folds are cut per series, but a learner that pools series must not see what lies after a fold's first test date in any of
them: its training rows end before that date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.evaluate import with_roles
from chronoloom.session import cut

Predict = Callable[[DataFrame], DataFrame]


class Learner(Protocol):
    name: str

    def fit(self, train: DataFrame, features: Sequence[str], target: str) -> Predict: ...


def fold_rows(df: DataFrame, target: str, folds: int = 5, time: str = "date", embargo: int = 0) -> DataFrame:
    """Each row with a target once per fold that may use it (eval_fold, role), training rows only from before the fold's first test date.

    embargo: of each series so many rows before a fold are left out of its training too (rows numbered by rn). A missing target column is an error.
    """
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    rows = with_roles(df, folds)
    begins = rows.where("role = 'test'").groupBy("eval_fold").agg(F.min(time).alias("__begin"), F.min("rn").alias("__rn"))  # a row per fold
    rows = rows.where(F.col(target).isNotNull()).join(begins, "eval_fold")
    early = F.col(time) < F.col("__begin")
    if embargo:
        early = early & (F.col("rn") < F.col("__rn") - embargo)
    return rows.where((F.col("role") == "test") | early).drop("__begin", "__rn")


def walk_forward(df: DataFrame, learner: Learner, features: Sequence[str], target: str = "target_rv5", folds: int = 5, embargo: int = 0) -> DataFrame:
    """The test rows of each fold with `actual`, `model` (the learner's name) and `pred` by what was learned before the fold.

    Only complete cases are learned from and predicted; a fold without any to learn from has null predictions. What a learner sees of a test row are its
    features, not its target.
    """
    rows = cut(fold_rows(df, target, folds, embargo=embargo).na.drop(subset=list(features)), "fold_rows")  # read by each fit
    out = None
    for k in range(1, folds + 1):
        mine = rows.where(F.col("eval_fold") == k)
        train, test = mine.where("role = 'train'"), mine.where("role = 'test'").withColumn("__actual", F.col(target)).drop(target)
        one = test.withColumn("pred", F.lit(None).cast("double")) if train.isEmpty() else learner.fit(train, features, target)(test)
        one = one.select("ticker", "date", "fold", "returns", "ret_lag_1", F.col("__actual").alias("actual"), F.lit(learner.name).alias("model"), "pred")
        out = one if out is None else out.unionByName(one)
    return out


class Persistence:
    """Today's value."""

    name = "persistence"

    def __init__(self, column: str = "realized_vol_5d") -> None:
        self.column = column

    def fit(self, train: DataFrame, features: Sequence[str], target: str) -> Predict:
        return lambda test: test.withColumn("pred", F.col(self.column))


class Trees:
    """Boosted trees on absolute errors, pooled over the series."""

    name = "gbt"

    def __init__(self, **params: object) -> None:
        self.params = params

    def fit(self, train: DataFrame, features: Sequence[str], target: str) -> Predict:
        return _trees(features, target, **self.params).fit(train).transform


class Linear:
    """Least squares with an intercept, pooled over the series."""

    name = "linear"

    def fit(self, train: DataFrame, features: Sequence[str], target: str) -> Predict:
        found = solve(moments(train.withColumn("eval_fold", F.lit(0)), {"all": features}, target))
        return lambda test: test.withColumn("pred", _linear(found["all", 0], features))


def _trees(features: Sequence[str], target: str, **params: object) -> Pipeline:
    settings = {"lossType": "absolute", "maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 0} | params
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), GBTRegressor(labelCol=target, featuresCol="features", predictionCol="pred", **settings)])


def gbt_forecasts(df: DataFrame, features: Sequence[str], target: str = "target_rv5", folds: int = 5, **params: object) -> DataFrame:
    """walk_forward with boosted trees."""
    return walk_forward(df, Trees(**params), features, target, folds)


def importance(df: DataFrame, features: Sequence[str], target: str = "target_rv5", **params: object) -> DataFrame:
    """(feature, gain), largest first: normalised importances of trees fitted to all complete cases."""
    model = _trees(features, target, **params).fit(cut(df.na.drop(subset=[*features, target]), "training")).stages[-1]
    rows = list(zip(features, model.featureImportances.toArray().tolist(), strict=True))
    return df.sparkSession.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")


#: Sums of a set's moments are added up in so many parts before they come to the driver.
PARTS = 16


def moments(rows: DataFrame, sets: Mapping[str, Sequence[str]], target: str) -> dict[tuple[str, int], tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """For each feature set and eval_fold the sums of products of (1, features, target) over its complete cases, in one reading.

    Features are centred and scaled first (by all rows, which changes no prediction), so that the sums keep their digits. A task gives one matrix per set
    and fold; PARTS of each come to the driver.
    """
    names = sorted({c for s in sets.values() for c in s} | {target})
    about = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    shift = {c: (about[f"m_{c}"] or 0.0) if c != target else 0.0 for c in names}
    scale = {c: (about[f"s_{c}"] or 1.0) if c != target else 1.0 for c in names}
    order = {n: [*s, target] for n, s in sets.items()}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            z = {c: (pdf[c].to_numpy(float, na_value=np.nan) - shift[c]) / scale[c] for c in names}
            fold = pdf["eval_fold"].to_numpy()
            for n, cols in order.items():
                x = np.stack([np.ones(len(pdf)), *[z[c] for c in cols]], 1)
                whole = np.isfinite(x).all(axis=1)
                for k in np.unique(fold[whole]).tolist():
                    mine = x[whole & (fold == k)]
                    total[n, k] = total.get((n, k), 0) + mine.T @ mine
        if total:
            yield pd.DataFrame([(n, k, m.ravel().tolist()) for (n, k), m in total.items()], columns=["name", "fold", "m"])

    each = rows.select("eval_fold", *names).mapInPandas(add, "name string, fold int, m array<double>")
    each = each.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).select("name", "fold", "part", F.posexplode("m"))
    sums = each.groupBy("name", "fold", "part", "pos").agg(F.sum("col").alias("v")).groupBy("name", "fold", "pos").agg(F.sum("v").alias("v"))
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in sums.collect():  # sets x folds x (features + 2) squared numbers
        size = len(order[r["name"]]) + 1
        out.setdefault((r["name"], r["fold"]), np.zeros(size * size))[r["pos"]] = r["v"]
    return {(n, k): (order[n][:-1], m.reshape(len(order[n]) + 1, -1), np.array([shift[c] for c in order[n][:-1]]), np.array([scale[c] for c in order[n][:-1]])) for (n, k), m in out.items()}


def solve(sums: dict) -> dict[tuple[str, int], np.ndarray]:
    """Intercept and coefficients for each set and fold; of collinear features the least coefficients."""
    out = {}
    for key, (_, m, shift, scale) in sums.items():
        b = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=1e-12)[0]
        slope = b[1:] / scale
        out[key] = np.r_[b[0] - slope @ shift, slope]
    return out


def _linear(coefficients: np.ndarray, features: Sequence[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(c) for b, c in zip(coefficients[1:], features, strict=True)), F.lit(float(coefficients[0])))


def linear_sets(df: DataFrame, sets: Mapping[str, Sequence[str]], target: str = "target_rv5", folds: int = 5) -> DataFrame:
    """walk_forward with least squares for several feature sets at once (`model` is the set's name): the training rows of all sets and folds are read
    once, the test rows once. A set's rows are its complete cases; one without training rows has null predictions."""
    rows = fold_rows(df, target, folds)
    found = solve(moments(rows.where("role = 'train'"), sets, target))
    test = rows.where("role = 'test'")
    each = []
    for n, s in sets.items():
        pred = F.lit(None).cast("double")
        for k in range(1, folds + 1):
            if (n, k) in found:
                pred = F.when(F.col("eval_fold") == k, _linear(found[n, k], s)).otherwise(pred)
        whole = F.lit(True)
        for c in s:
            whole = whole & F.col(c).isNotNull()
        each.append(F.struct(F.lit(n).alias("model"), F.when(whole, pred).alias("pred"), whole.alias("whole")))
    out = test.select("ticker", "date", "fold", "returns", "ret_lag_1", F.col(target).alias("actual"), F.inline(F.array(*each)))
    return out.where("whole").drop("whole")
