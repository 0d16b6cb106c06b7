"""Incident tables: yearly blend, residential incidents by tract, geocoded outcomes (PL-BLEND, PL-3A-F, PL-3A-D part 1)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.keys import INCIDENT_KEY, normalize_incident_key
from cindermap.operators.aggregate import first_per_key, stack
from cindermap.operators.columns import tag
from cindermap.operators.filters import known, residential
from cindermap.operators.relate import hot_keys, keyed_join, skew_join

BLEND_COLUMNS = {
    "basic": ["INC_TYPE", "ALARM", "FF_DEATH", "OTH_DEATH", "DET_ALERT"],
    "address": ["CITY", "ZIP5"],
    "fire": ["NUM_UNIT", "NOT_RES", "DETECTOR", "DET_TYPE", "DET_POWER", "DET_OPERAT", "DET_EFFECT", "DET_FAIL"],
    "formatted": ["row_seq", "input_address"],
    "geocoded": ["row_seq", "rating", "lon", "lat", "tabblock_id", "county", "tractid", "geomout", "output_address"],
}


def _keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return normalize_incident_key(df.select(*INCIDENT_KEY, *columns))


def _chain(tables: Mapping[str, DataFrame], join, null_safe: bool) -> DataFrame:
    key = list(INCIDENT_KEY)
    facts = join(tables["basic"], tables["address"], key, "left", null_safe)
    return join(join(tables["fire"], facts, key, "left", null_safe), tables["located"], key, "left", null_safe)


def blend(tables: Mapping[str, DataFrame], null_safe: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """PL-BLEND: every fire incident with its basic facts, address and geocode.

    A missing key part matches a missing key part unless ``null_safe`` is off; an incident with no key part at all
    matches nothing (:func:`keyless_rows` counts them). ``by`` names columns of the fire table to keep, such as the year.

    The four keyed tables meet on one key, so each is dealt once. Keys that are hot in one of them are looked for in all four by one job;
    only their rows take the way of :func:`skew_join`.
    """
    key = list(INCIDENT_KEY)
    geocoded = tables["geocoded"].select(*BLEND_COLUMNS["geocoded"])
    keyed = {name: _keyed(tables[name], [*BLEND_COLUMNS[name], *(by if name == "fire" else ())]) for name in ("basic", "address", "fire", "formatted")}
    with_key = {name: df.filter(_has_key()) for name, df in keyed.items()}
    hot = sorted({h for found in hot_keys(*with_key.values(), on=key) for h in found})

    def chain(part: Callable[[DataFrame], DataFrame], join) -> DataFrame:
        chosen = {name: part(df) for name, df in with_key.items()}
        chosen["located"] = keyed_join(chosen.pop("formatted"), geocoded, "row_seq", "left")
        return _chain(chosen, join, null_safe)

    if not hot:
        blended = chain(lambda df: df, keyed_join)
    else:
        is_hot = F.xxhash64(*key).isin(hot)  # at most four times the number of partitions
        blended = chain(lambda df: df.filter(~is_hot), keyed_join).unionByName(chain(lambda df: df.filter(is_hot), skew_join))
    return blended.unionByName(keyed["fire"].filter(~_has_key()), allowMissingColumns=True)


def _has_key() -> Column:
    return reduce(or_, [F.col(k).isNotNull() for k in INCIDENT_KEY])


def keyless_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_keyless): rows of the keyed tables of a blend, and those of them with no key part."""
    counts = [
        _keyed(tables[name], []).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.count_if(~_has_key()).alias("n_keyless"))
        for name in ("basic", "address", "fire", "formatted")
    ]
    return reduce(DataFrame.unionByName, counts)


def blend_year(tables: Mapping[str, DataFrame], year: str, null_safe: bool = True) -> DataFrame:
    """PL-BLEND for the tables of one year."""
    return tag(blend(tables, null_safe), "year", year)


def blend_years(years: Mapping[str, Mapping[str, DataFrame]], null_safe: bool = True) -> DataFrame:
    """PL-BLEND: the yearly blends under each other.

    Every row of a blend follows from one fire incident, so years that share all other tables (the same DataFrames) are one blend of their
    tagged fire tables, and the shared tables are read and dealt once.
    """
    shared: dict[tuple[int, ...], dict[str, Mapping[str, DataFrame]]] = {}
    for year, tables in sorted(years.items()):
        shared.setdefault(tuple(id(tables[name]) for name in BLEND_COLUMNS if name != "fire"), {})[year] = tables
    blends = []
    for part in shared.values():
        if len(part) == 1:
            blends += [blend_year(tables, year, null_safe) for year, tables in part.items()]
            continue
        # keys first take one form, since years differ in their types
        fires = stack(*[tag(_keyed(tables["fire"], BLEND_COLUMNS["fire"]), "year", year) for year, tables in part.items()])
        blended = blend({**next(iter(part.values())), "fire": fires}, null_safe, ["year"])
        blends.append(blended.select(*[c for c in blended.columns if c != "year"], "year"))
    return stack(*blends)


def residential_by_tract(
    basic: DataFrame, address: DataFrame, zcta_tract: DataFrame, key: Sequence[str] = INCIDENT_KEY
) -> DataFrame:
    """PL-3A-F: residential incidents with every tract their ZIP code touches.

    A ZIP code on several tracts yields one row per tract; an incident without
    address, or with a ZIP code on no tract, keeps one row without tract. ZIP codes
    with very many incidents are spread over several tasks.
    """
    key = list(key)
    kept = normalize_incident_key(
        basic.filter(residential("MIXED_USE", "PROP_USE", "INC_TYPE")).select(
            *key, "FF_DEATH", "OTH_DEATH", "FF_INJ", "OTH_INJ", "MIXED_USE", "PROP_USE", "INC_TYPE"
        ),
        tuple(key),
    )
    zips = normalize_incident_key(address.select(*key, F.col("ZIP5").alias("zcta5")), tuple(key))
    # Only addresses of residential incidents get as far as the ZIP relation.
    addressed = skew_join(kept, zips, key, "left", null_safe=True)
    relation = zcta_tract.select("zcta5", "state", "county", "tract", "geoid")
    return skew_join(addressed, relation, "zcta5", "left", probe=zips)


def geocoded_outcomes(
    basic: DataFrame, formatted: DataFrame, geocoded: DataFrame, incident_order: Sequence[str], order_by: Sequence[str] = ("row_seq",)
) -> DataFrame:
    """PL-3A-D, first step: incidents with casualties and the tract of their first geocoded address.

    Of an incident listed more than once the row that comes first by ``incident_order`` counts: columns of
    ``basic`` outside the key that follow the file, such as a row number.
    """
    key = list(INCIDENT_KEY)
    places = keyed_join(
        _keyed(formatted, ["row_seq"]), geocoded.select("row_seq", "tabblock_id", "county", "tractid"), "row_seq", "left"
    )
    casualties = ["FF_DEATH", "OTH_DEATH", "FF_INJ", "OTH_INJ"]

    def by_key(df: DataFrame) -> DataFrame:
        """The key as one struct, whose missing parts equal missing parts: ranking and join then need one shuffle and one order."""
        return df.withColumn("__key", F.struct(*key)).drop(*key)

    located = by_key(places.filter(known("tractid")))
    rest = [c for c in located.columns if c != "__key" and c not in order_by]
    # One row per key on both sides first: the first of all pairs is the pair of the firsts.
    facts = first_per_key(by_key(_keyed(basic, [*casualties, *incident_order])), "__key", [*incident_order, *casualties]).drop(*incident_order)
    joined = keyed_join(facts, first_per_key(located, "__key", [*order_by, *rest]), "__key", "inner")
    return joined.select(*[F.col("__key")[k].alias(k) for k in key], *[c for c in joined.columns if c != "__key"])
