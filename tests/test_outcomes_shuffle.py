from pyspark.sql import functions as F

from cindermap.plans.incidents import geocoded_outcomes


def test_outcomes_rank_and_join_in_one_order(spark):
    key = "STATE string, FDID string, INC_DATE string, INC_NO string, EXP_NO string"
    k1, k2, k3 = (None, "1", "01052011", "7", "0"), ("WA", "1", None, "7", "0"), ("WA", "1", "01052011", "8", "0")
    basic = spark.createDataFrame([(*k1, 0, 1, 0, 0, "b"), (*k1, 0, 9, 0, 9, "c"), (*k2, 0, 0, 0, 2, "a"), (*k3, 0, 3, 0, 0, "a")],
                                  f"{key}, FF_DEATH long, OTH_DEATH long, FF_INJ long, OTH_INJ long, seq string")
    formatted = spark.createDataFrame([(*k1, 1), (*k1, 2), (*k2, 3), (("OR"), "1", "01052011", "8", "0", 4)], f"{key}, row_seq long")
    geocoded = spark.createDataFrame([(1, "", "c", ""), (2, "b2", "c", "t2"), (3, "b3", "c", "t3"), (4, "b4", "c", "t4")],
                                     "row_seq long, tabblock_id string, county string, tractid string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = geocoded_outcomes(basic, formatted, geocoded, ["seq"])
        plan = out._jdf.queryExecution().sparkPlan().toString(), out._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in out.select("STATE", "INC_DATE", "INC_NO", "OTH_DEATH", "OTH_INJ", "tractid").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(None, "01052011", "7", 1, 0, "t2"), ("WA", None, "7", 0, 2, "t3")}
    assert out.columns[:5] == ["STATE", "FDID", "INC_DATE", "INC_NO", "EXP_NO"]
    # one shuffle per side by the key; the join adds none
    assert plan[1].count("Exchange hashpartitioning(__key") == 2 and plan[1].count("Exchange hashpartitioning") == 4
