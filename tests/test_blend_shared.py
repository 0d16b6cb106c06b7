from conftest import rows
from test_jobs import year  # noqa: F401

from cindermap.plans import incidents


def test_years_that_share_tables_are_one_blend(spark, year):  # noqa: F811
    late = {**year, "fire": year["fire"].filter("INC_NO <> '1'")}
    one = incidents.blend_years({"2011": year, "2012": late})
    apart = incidents.blend_years({"2011": year, "2012": {k: df.select("*") for k, df in late.items()}})

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")

    assert one.columns == apart.columns and rows(one) == rows(apart) and one.count() == 6
    assert 0 < joins(one) < joins(apart)
