"""Partial least squares classification (M9).

Centring and scaling, the products X'X and X'Y of predictors and class indicators
come from one scan of the rows; what is left is a solve over
features x features numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.models.moments import Moments, fold_moments


@dataclass
class PlsModel:
    features: list[str]
    classes: list[str]
    intercepts: list[float]
    weights: np.ndarray  # features x classes, on the original scale

    def scores(self) -> list[Column]:
        values = F.array(*[F.col(f"`{f}`") for f in self.features])
        out = []
        for k, start in enumerate(self.intercepts):
            products = F.zip_with(values, F.lit([float(w) for w in self.weights[:, k]]), lambda x, w: x * w)
            out.append(F.aggregate(products, F.lit(float(start)), lambda s, t: s + t))
        return out

    def transform(self, df: DataFrame, out: str = "predicted_class") -> DataFrame:
        """Label of the largest class score, ties to the first class."""
        ranked = F.array(
            *[F.struct(s.alias("score"), F.lit(-k).alias("order"), F.lit(c).alias("label"))
              for k, (s, c) in enumerate(zip(self.scores(), self.classes))]
        )
        return df.withColumn(out, F.array_max(ranked).getField("label"))


def with_indicators(df: DataFrame, features: Sequence[str], target: str) -> tuple[list[str], DataFrame, list[str]]:
    """(classes, features and class indicators with the other columns, their names)."""
    classes = sorted(r[0] for r in df.select(target).distinct().collect())  # class list
    dummies = [f"__y{k}" for k in range(len(classes))]
    return classes, df.withColumns({d: (F.col(target) == c).cast("double") for c, d in zip(classes, dummies)}), [*features, *dummies]


def pls_models(moments: Moments, features: Sequence[str], classes: Sequence[str], components: Sequence[int]) -> list[PlsModel]:
    """One model per number of components, all from the same cross products of predictors and class indicators."""
    p = len(features)
    sd = np.sqrt(np.maximum(np.diag(moments.products) / max(moments.n - 1, 1), 0.0))
    inverse = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
    corr = moments.products / max(moments.n - 1, 1) * np.outer(inverse, inverse)
    steps = _kernel_pls(corr[:p, :p], corr[:p, p:] * sd[p:], min(max(components), p))
    models = []
    for c in components:
        original = steps[min(c, len(steps) - 1)] * inverse[:p, None]
        models.append(PlsModel(list(features), list(classes), list(moments.mean[p:] - moments.mean[:p] @ original), original))
    return models


def fit_pls(df: DataFrame, features: Sequence[str], target: str, components: int = 2) -> PlsModel:
    classes, wide, columns = with_indicators(df, features, target)
    (moments,) = fold_moments(wide, columns).values()
    return pls_models(moments, features, classes, [components])[0]


def _kernel_pls(xx: np.ndarray, xy: np.ndarray, components: int) -> list[np.ndarray]:
    """Coefficients for standardized predictors after 0, 1, 2 ... components, from the cross products (kernel form of the published algorithm)."""
    left, rotations, loads = xy.copy(), [], []
    out = np.zeros_like(xy)
    steps = [out]
    for _ in range(components):
        u, s, _v = np.linalg.svd(left, full_matrices=False)
        if s[0] < 1e-12:
            break
        w = u[:, 0]
        r = w - sum((load @ w) * rot for load, rot in zip(loads, rotations)) if rotations else w
        size = r @ xx @ r
        if size < 1e-12:
            break
        load, q = xx @ r / size, r @ left / size
        left = left - size * np.outer(load, q)
        rotations.append(r)
        loads.append(load)
        out = out + np.outer(r, q)
        steps.append(out)
    return steps
