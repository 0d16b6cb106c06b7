"""Cleaning and conditional expressions (P5, P7-P11, K7-K9; NULL and NaN rules)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN and NULL are both "missing"; aggregates only skip NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def blank_to_null(c: Column | str) -> Column:
    """K9: text that is empty after trimming is missing."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def blank_to_null_all(df: DataFrame) -> DataFrame:
    """K9 on every text column."""
    return df.select(
        *[
            blank_to_null(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """A zero denominator gives NULL instead of an error, Inf or NaN."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def number_from_text(c: Column | str) -> Column:
    """K7: ``"1,234"`` becomes 1234.0; ``.`` and other non-numbers become NULL."""
    return F.translate(col(c), ',"', "").try_cast("double")


def strip_ticks(c: Column | str) -> Column:
    """K8: ``'1'`` becomes ``1``."""
    return F.translate(col(c), "'", "")


def later_rule_wins(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Apply ``(condition, value)`` rules in order, each overriding the ones before.

    A condition that is NULL does not fire.
    """
    if not rules:
        return F.lit(default)
    chain = None
    for condition, value in reversed(rules):
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(F.lit(default))


def presence_flag(detector: Column | str, detector_type: Column | str) -> Column:
    """Detector codes collapsed to TRUE / FALSE / unknown; a smoke-alarm type outranks ``detector = 'N'``."""
    return later_rule_wins(
        [
            (col(detector) == "N", F.lit(False)),
            (col(detector_type).isin(*NO_SMOKE_ALARM_TYPES), F.lit(False)),
            (col(detector_type).isin(*SMOKE_ALARM_TYPES), F.lit(True)),
        ]
    ).cast("boolean")


def first_known(*candidates: Column | str, default: object = None) -> Column:
    """The first non-missing candidate, then the default."""
    parts = [col(c) for c in candidates]
    return F.coalesce(*parts, F.lit(default)) if default is not None else F.coalesce(*parts)


def clamp(c: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a score on one or both sides, NULL stays NULL (``least`` alone would skip it)."""
    c = col(c)
    out = c
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    return F.when(c.isNotNull(), out)


def threshold_label(c: Column | str, above: str, otherwise: str, cut: float = 0.5) -> Column:
    """P10: label by ``c > cut``; a missing score has no label."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None)).when(c > cut, above).otherwise(otherwise)


def any_of(c: Column | str, codes: Iterable[str]) -> Column:
    return col(c).isin(*list(codes))


# Detector type codes as published in the incident coding manual.
SMOKE_ALARM_TYPES = ("1", "5")
NO_SMOKE_ALARM_TYPES = ("2", "4", "0")
