"""Geographic and incident keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.values import blank_to_null, col

INCIDENT_KEY = ("STATE", "FDID", "INC_DATE", "INC_NO", "EXP_NO")

# Summary-level prefixes of census identifiers.
COUNTY_LEVEL = "05000"
TRACT_LEVEL = "14000"


def state_of(geoid: Column | str) -> Column:
    return F.substring(col(geoid), 1, 2)


def county_of(geoid: Column | str) -> Column:
    return F.substring(col(geoid), 3, 3)


def tract_of(geoid: Column | str) -> Column:
    return F.substring(col(geoid), 6, 6)


def block_of(geoid: Column | str) -> Column:
    return F.substring(col(geoid), 12, 1)


def county_fips_of(geoid: Column | str) -> Column:
    return F.substring(col(geoid), 1, 5)


def with_geo_parts(df: DataFrame, geoid: str, block: bool = False) -> DataFrame:
    """K1: state, county, tract (and block) cut out of a geoid by position."""
    parts = {"state": state_of(geoid), "cnty": county_of(geoid), "tract": tract_of(geoid)}
    if block:
        parts["block"] = block_of(geoid)
    return df.withColumns(parts)


def drop_right(c: Column | str, n: int) -> Column:
    """K2: the text without its last ``n`` characters (unchanged when shorter than ``n``)."""
    return F.regexp_replace(col(c), f".{{{int(n)}}}$", "")


def take_right(c: Column | str, n: int) -> Column:
    """K2: the last ``n`` characters."""
    return F.right(col(c), F.lit(int(n)))


def pad_left(c: Column | str, width: int, fill: str = "0") -> Column:
    """K4: left pad that never shortens (``lpad`` alone truncates longer text)."""
    c = col(c).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, fill)).otherwise(c)


def restore_leading_zero(c: Column | str, short_length: int = 10) -> Column:
    """K5: give back the zero an id lost when it was stored as a number."""
    c = col(c)
    return F.when(F.length(c) == short_length, F.concat(F.lit("0"), c)).otherwise(c)


def compose(*parts: Column | str) -> Column:
    """K3: concatenate id parts; a missing part makes the id missing."""
    return F.concat(*[col(p) for p in parts])


def prefixed(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix), col(c))


def summary_level(geoid: Column | str) -> Column:
    """K6: the part before ``US``."""
    return F.try_element_at(F.split(col(geoid), "US"), F.lit(1))


def summary_id(geoid: Column | str) -> Column:
    """K6: the part after ``US``; NULL when there is none."""
    return F.try_element_at(F.split(col(geoid), "US"), F.lit(2))


def payload_value(xml: Column | str, path: Sequence[str], failure: str | None = "error") -> Column:
    """One value of a captured XML answer, ``path`` naming the elements below the root.

    A last step that starts with ``_`` is an attribute. Malformed or incomplete
    answers get the failure tag instead of failing the job.
    """
    schema = "string"
    for step in reversed(path):
        schema = f"struct<`{step}`:{schema}>"
    parsed = F.from_xml(col(xml), schema[len("struct<") : -1].replace(":", " ", 1), {"mode": "PERMISSIVE"})
    for step in path:
        parsed = parsed.getField(step)
    return F.coalesce(blank_to_null(parsed), F.lit(failure))


def formatted(pattern: str, *parts: Column | str) -> Column:
    """Printf-style text from columns."""
    return F.format_string(pattern, *[col(p) for p in parts])


def normalize_incident_key(df: DataFrame, key: tuple[str, ...] = INCIDENT_KEY) -> DataFrame:
    """One text form of the incident key for all years and both join sides.

    Years differ in key types (numbers in some files, text in others), so parts
    are trimmed text and the date is padded to its 8 digits.
    """
    fixed = {}
    for part in key:
        text = blank_to_null(F.col(part).cast("string"))
        fixed[part] = pad_left(text, 8) if part.upper() == "INC_DATE" else text
    return df.withColumns(fixed)
