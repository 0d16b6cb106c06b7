"""Confusion matrix, accuracy and Kappa."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.values import safe_ratio


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of every (actual, predicted) pair that occurs."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def agreement(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: rows, accuracy and Kappa, from the confusion matrix.

    The matrix (at most classes squared cells) is gathered in one array; the
    chance agreement adds up, over all classes, row total times column total.
    """
    cells = confusion(df, actual, predicted).filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    cell = F.struct(
        F.col("actual").cast("string").alias("a"),
        F.col("predicted").cast("string").alias("p"),
        F.col("n").cast("double").alias("n"),
    )
    one = cells.agg(F.sum("n").alias("n"), F.collect_list(cell).alias("c"))

    def total(array: Column, weight: Callable[[Column], Column]) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda s, x: s + weight(x))

    def chance(x: Column) -> Column:
        same = F.filter("c", lambda y: y["p"] == x["a"])
        return x["n"] * total(same, lambda y: y["n"])

    hits = total(F.filter("c", lambda x: x["a"] == x["p"]), lambda x: x["n"])
    n = F.col("n").cast("double")
    rated = one.select(
        "n", safe_ratio(hits, n).alias("accuracy"), safe_ratio(total(F.col("c"), chance), n * n).alias("__pe")
    )
    return rated.select(
        "n", "accuracy", safe_ratio(F.col("accuracy") - F.col("__pe"), F.lit(1.0) - F.col("__pe")).alias("kappa")
    )


class AgreementEvaluator(Evaluator):
    """``accuracy`` or ``kappa`` for cross-validation."""

    def __init__(self, metric: str = "kappa", label: str = "label", prediction: str = "prediction") -> None:
        super().__init__()
        if metric not in ("accuracy", "kappa"):
            raise ValueError(metric)
        self.metric, self.label, self.prediction = metric, label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        row = agreement(dataset, self.label, self.prediction).first()
        value = row[self.metric]
        return float(value) if value is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True
