"""Row-wise score arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from cindermap.functions.values import clamp, col, nan_to_null, safe_ratio


def logistic(z: Column | str) -> Column:
    """X3."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def rate_per(count: Column | str, base: Column | str, per: float = 1000.0) -> Column:
    """Events per ``per`` units; NULL for an empty base."""
    return safe_ratio(count, base) * F.lit(per)


def stabilized_rate(count: Column | str, base: Column | str, offset: float = 1.0, per: float = 1000.0) -> Column:
    """The base is raised by a small offset so that tiny bases do not explode."""
    return safe_ratio(count, col(base) + F.lit(offset)) * F.lit(per)


def damped_rate(count: Column | str, base: Column | str, offset: float = 100.0, per: float = 1000.0) -> Column:
    """Stabilized rate weighted by the log of the base."""
    return stabilized_rate(count, base, offset, per) * F.log1p(col(base).cast("double"))


def prior_corrected(p: Column | str, prior: Column | float, sampled_share: float = 0.5) -> Column:
    """Bring a probability learnt on a balanced sample back to the real class share."""
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    return col(p) * prior / F.lit(float(sampled_share))


def mean_of_known(*cols: Column | str) -> Column:
    """Row mean over the non-missing values; NULL when all are missing."""
    values = [nan_to_null(c) for c in cols]
    total = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values])
    known = reduce(add, [v.isNotNull().cast("int") for v in values])
    return safe_ratio(total, known)


def mean_strict(*cols: Column | str) -> Column:
    """Row mean that is NULL as soon as one value is missing."""
    values = [nan_to_null(c) for c in cols]
    return reduce(add, values) / F.lit(float(len(values)))


def capped_mean(*cols: Column | str, upper: float = 1.0) -> Column:
    """Strict mean of several predictions, bounded from above."""
    return clamp(mean_strict(*cols), upper=upper)


def complement_of_mean(*cols: Column | str) -> Column:
    """X11: ``1 - mean`` for predictions of the non-event."""
    return F.lit(1.0) - mean_strict(*cols)
