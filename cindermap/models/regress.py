"""Regression models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.functions.values import col
from cindermap.models.moments import Moments, fold_moments
from cindermap.operators.prep import feature_vector
from cindermap.operators.sample import with_fold


def forest_regressor(features: Sequence[str], label: str, trees: int = 100, depth: int = 10, seed: int = 12, out: str = "pred_rf") -> Pipeline:
    """M1: bootstrap forest, a third of the features per split."""
    forest = RandomForestRegressor(
        labelCol=label, predictionCol=out, numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed
    )
    return Pipeline(stages=[feature_vector(features), forest])


def least_squares(features: Sequence[str], label: str, weight: str | None = None, out: str = "prediction") -> Pipeline:
    """M2, M4: unpenalized (weighted) least squares by its normal equations.

    The optimum itself, instead of one order-dependent descent run towards it.
    """
    linear = LinearRegression(labelCol=label, predictionCol=out, regParam=0.0, solver="auto")
    if weight is not None:
        linear = linear.setWeightCol(weight)
    return Pipeline(stages=[feature_vector(features), linear])


def coefficients(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """One row per term, the intercept included (bounded by the number of features)."""
    fitted = model.stages[-1]
    rows = [("(intercept)", float(fitted.intercept))]
    rows += [(name, float(value)) for name, value in zip(features, fitted.coefficients.toArray())]
    return spark.createDataFrame(rows, "term string, coefficient double")


def penalty_path(df: DataFrame, features: Sequence[str], label: str, points: int = 20, ratio: float = 1e-4) -> list[float]:
    """M3: log-spaced penalties from the smallest that clears the model down to ``ratio`` times it.

    The largest is ``max |cor(x, y)| * sd(y)``, from one distributed correlation pass.
    """
    columns = [*features, label]
    vectors = feature_vector(columns, "__all").transform(df.select(*columns)).select("__all")
    last = Correlation.corr(vectors, "__all").first()[0].toArray()[-1][:-1]
    strongest = max((abs(v) for v in last if v == v), default=0.0)
    stats = df.agg(F.stddev_pop(label).alias("sd")).first()
    top = strongest * (stats["sd"] or 0.0)
    if top <= 0.0:
        return [0.0]
    return [top * ratio ** (i / (points - 1)) for i in range(points)]


@dataclass
class LassoFit:
    model: PipelineModel
    best: float
    errors: list[tuple[float, float]]  # (penalty, mean squared error over the folds)


def lasso_path_of(moments: Moments, penalties: Sequence[float], tolerance: float = 1e-9, rounds: int = 10_000) -> list[tuple[np.ndarray, float]]:
    """(weights, intercept) for every penalty, by coordinate descent on the cross products of features and label (the last column).

    Penalties apply to standardized features; each starts from the solution of the one before, so give them in descending order.
    """
    p = len(moments.mean) - 1
    sd = np.sqrt(np.maximum(np.diag(moments.products) / max(moments.n, 1), 0.0))
    scale = np.where(sd[:p] > 0, 1.0 / np.where(sd[:p] > 0, sd[:p], 1.0), 0.0)
    gram = moments.products[:p, :p] / max(moments.n, 1) * np.outer(scale, scale)
    target = moments.products[:p, p] / max(moments.n, 1) * scale
    used = np.flatnonzero(np.diag(gram) > 0)
    beta, fit, out = np.zeros(p), np.zeros(p), []
    for penalty in penalties:
        for _ in range(rounds):
            largest = 0.0
            for j in used:
                old = beta[j]
                free = target[j] - fit[j] + gram[j, j] * old
                beta[j] = math.copysign(max(abs(free) - penalty, 0.0), free) / gram[j, j]
                if beta[j] != old:
                    fit += gram[:, j] * (beta[j] - old)
                    largest = max(largest, abs(beta[j] - old))
            if largest <= tolerance * max(1.0, sd[p]):
                break
        weights = beta * scale
        out.append((weights, float(moments.mean[p] - moments.mean[:p] @ weights)))
    return out


def lasso_cv(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    points: int = 20,
    folds: int = 10,
    seed: int = 12,
    out: str = "pred_lasso",
    ratio: float = 1e-4,
) -> LassoFit:
    """M3: LASSO with the penalty of least cross-validated squared error.

    One scan takes the cross products of each fold; the whole penalty path of every fold and its errors on the rows left out
    follow from them on the driver (features x features numbers). The model of the chosen penalty is then fitted once.
    """
    penalties = penalty_path(df, features, label, points, ratio)
    parts = fold_moments(with_fold(df, keys, folds, seed, "__fold"), [*features, label], "__fold")
    whole = reduce(Moments.__add__, parts.values())
    marks = np.zeros(len(penalties))
    for part in parts.values():
        marks += [part.squared_error(*line) / part.n for line in lasso_path_of(whole - part, penalties)]
    errors = list(zip(penalties, (marks / max(len(parts), 1)).tolist()))
    best = min(errors, key=lambda e: e[1])[0]
    lasso = LinearRegression(labelCol=label, predictionCol=out, elasticNetParam=1.0, regParam=best)
    return LassoFit(Pipeline(stages=[feature_vector(features), lasso]).fit(df), best, errors)


def lasso_coefficients(df: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float]) -> DataFrame:
    """M3: coefficient table by penalty."""
    ready = feature_vector(features).transform(df).select("features", label).persist()
    try:
        rows = []
        for penalty in penalties:
            m = LinearRegression(labelCol=label, elasticNetParam=1.0, regParam=penalty).fit(ready)
            rows += [(float(penalty), f, float(v)) for f, v in zip(features, m.coefficients.toArray())]
    finally:
        ready.unpersist()
    return df.sparkSession.createDataFrame(rows, "penalty double, term string, coefficient double")


def rmse(actual: str, predicted: str):
    """M12 (aggregate)."""
    return F.sqrt(F.avg(F.pow(col(actual) - col(predicted), F.lit(2.0))))


def probability_of(column: str, index: int):
    return vector_to_array(F.col(column))[index]
