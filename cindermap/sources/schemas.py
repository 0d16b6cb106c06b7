"""Column layouts of the input tables. Identifiers are text whatever the file holds.

Fixed values: these are the column names of the published source files.
"""

from __future__ import annotations

from pyspark.sql import types as T


def layout(text: str = "", whole: str = "", real: str = "") -> T.StructType:
    """Schema from blank-separated names of text, whole-number and real columns."""
    kinds = ((text, T.StringType()), (whole, T.LongType()), (real, T.DoubleType()))
    return T.StructType([T.StructField(n, kind) for names, kind in kinds for n in names.split()])


INCIDENT_KEY_COLUMNS = "STATE FDID INC_DATE INC_NO EXP_NO"

BASIC_INCIDENT = layout(
    f"{INCIDENT_KEY_COLUMNS} INC_TYPE ALARM DET_ALERT MIXED_USE PROP_USE", "FF_DEATH OTH_DEATH FF_INJ OTH_INJ"
)
INCIDENT_ADDRESS = layout(f"{INCIDENT_KEY_COLUMNS} CITY ZIP5")
FIRE_INCIDENT = layout(
    f"{INCIDENT_KEY_COLUMNS} NOT_RES DETECTOR DET_TYPE DET_POWER DET_OPERAT DET_EFFECT DET_FAIL", "NUM_UNIT"
)
FORMATTED_ADDRESS = layout(f"{INCIDENT_KEY_COLUMNS} input_address", "row_seq")
GEOCODED_ADDRESS = layout("tabblock_id county tractid geomout output_address", "row_seq rating", "lon lat")
ZCTA_TRACT = layout("zcta5 state county tract geoid")
GEOCODE_PARTS = layout("id Latitude Longitude block_group")
CHAPTER_CROSSWALK = layout("county_fips region_code region_name chapter_code chapter_name county_name_long")
SCORES_1A = layout("state cnty tract geoid2", "", "risk_1a")
SCORES_1B = layout("tractid", "", "weighted_linear_pred")
BLOCK_SCORES = layout("bg_geoid", "bg_pop", "smoke_alarm_risk")
SCORES_3A = layout("geoid", "", "risk_3a")
YEARLY_RATE = layout("tractid id", "N population", "fire_per_1000")
FIRES_PER_TRACT = layout("x", "freq")
TRACT_POPULATION = layout("tract_geoid", "P0010001")
