"""Row filters (F1-F11). A condition that is NULL drops the row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.values import col

# Incident coding manual (mixed use, property use, incident type) and case categories.
RESIDENTIAL_MIXED_USE = ("40", "58")
UNMIXED_USE = ("NN", "00")
RESIDENTIAL_PROPERTY_USE = ("400", "419", "429", "439", "449", "459", "460", "462", "464")
DWELLING_FIRE_TYPES = ("120", "121", "122", "123", "136", "137")
HOME_FIRE_EVENTS = ("Fire", "Fire : Multi-Family", "Fire : Single Family")
OUTSIDE_MAINLAND = ("02", "15", "72")
BUILDING_FIRE = "111"


def residential(
    mixed_use: Column | str,
    property_use: Column | str,
    incident_type: Column | str,
    mixed_codes: Sequence[str] = RESIDENTIAL_MIXED_USE,
    unmixed_codes: Sequence[str] = UNMIXED_USE,
    property_codes: Sequence[str] = RESIDENTIAL_PROPERTY_USE,
    type_codes: Sequence[str] = DWELLING_FIRE_TYPES,
) -> Column:
    """residential by mixed use, or unmixed with a dwelling property use, or by incident type."""
    mixed, prop, kind = col(mixed_use), col(property_use), col(incident_type)
    by_property = mixed.isin(*unmixed_codes) & prop.isin(*property_codes)
    return mixed.isin(*mixed_codes) | by_property | kind.isin(*type_codes)


def home_fire(event: Column | str, events: Sequence[str] = HOME_FIRE_EVENTS) -> Column:
    """F2."""
    return col(event).isin(*events)


def known(c: Column | str) -> Column:
    """present and not blank."""
    c = col(c)
    return c.isNotNull() & (F.trim(c) != "")


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows without a missing value (NULL or NaN) in ``columns``."""
    chosen = list(columns) if columns is not None else df.columns
    kinds = dict(df.dtypes)
    keep = F.lit(True)
    for name in chosen:
        c = F.col(f"`{name}`")
        keep = keep & c.isNotNull()
        if kinds[name] in ("double", "float"):
            keep = keep & ~F.isnan(c)
    return df.filter(keep)


def containing(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """the pattern occurs anywhere in the text."""
    return df.filter(F.col(column).rlike(pattern))


def good_geocode(rating: Column | str = "rating", tract: Column | str = "tractid", below: int = 21) -> Column:
    """usable geocode: rating in ``[0, below)`` and a tract."""
    return (col(rating) >= 0) & (col(rating) < below) & (col(tract) != "")


def where_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """F8, F9."""
    return df.filter(F.col(column) == F.lit(value))


def excluding(df: DataFrame, column: str, codes: Iterable[str]) -> DataFrame:
    """rows whose code is not in the list; rows without a code stay."""
    c = F.col(column)
    return df.filter(c.isNull() | ~c.isin(*list(codes)))


def share_passing(condition: Column) -> Column:
    """F11 (aggregate): share of all rows that meet the condition, unknown counting as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
