"""Exact-count sampling and splits. What is compared is what does not depend on the hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import table
from cindermap.operators.sample import downsample, hash_split, sample_per_band, stratified_split, upsample_where, with_fold

_TARGET_SQL = "CASE WHEN o_totalprice > 480000 THEN 'death' WHEN o_totalprice > 400000 THEN 'inj' ELSE 'no_inj' END"


def _incidents(spark, folder):
    price = F.col("o_totalprice")
    target = F.when(price > 480000, "death").when(price > 400000, "inj").otherwise("no_inj")
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice", target.alias("target"))


@query(f"""
WITH s AS (SELECT {_TARGET_SQL} AS target, COUNT(*) AS n FROM orders GROUP BY 1), d AS (SELECT n FROM s WHERE target = 'death')
SELECT s.target, CASE WHEN s.target = 'death' THEN d.n
  ELSE CAST(floor(CASE s.target WHEN 'inj' THEN 0.25 ELSE 0.5 END * ceil(d.n / 0.25::DOUBLE)) AS BIGINT) END AS n,
  TRUE AS all_from_class FROM s, d""")
def balanced_bootstrap(spark, folder):
    """Three classes at .25 / .25 / .50, with replacement."""
    s = downsample(_incidents(spark, folder), "target", ["death", "inj", "no_inj"], [0.25, 0.25, 0.5], ["o_orderkey"])
    price = F.col("o_totalprice")
    same = F.when(price > 480000, "death").when(price > 400000, "inj").otherwise("no_inj") == F.col("target")
    return s.groupBy("target").agg(F.count_distinct("draw_id").alias("n"), F.every(same).alias("all_from_class"))


@query(f"""
WITH s AS (SELECT {_TARGET_SQL} AS target, COUNT(*) AS n FROM orders GROUP BY 1), d AS (SELECT n FROM s WHERE target = 'death'),
w AS (SELECT s.target, CASE s.target WHEN 'death' THEN d.n WHEN 'inj' THEN CAST(2 * d.n AS BIGINT) * 3 // 10 ELSE CAST(2 * d.n AS BIGINT) * 2 // 10 END AS n FROM s, d)
SELECT target, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS n_distinct FROM w""")
def balanced_subset(spark, folder):
    """R1 without replacement: three classes at .5 / .3 / .2."""
    s = downsample(_incidents(spark, folder), "target", ["death", "inj", "no_inj"], [0.5, 0.3, 0.2], ["o_orderkey"], replace=False)
    return s.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"))


@query("""
SELECT quality, COUNT(*) AS n, CAST(ceil(0.8 * COUNT(*)) AS BIGINT) AS n_train FROM labels GROUP BY quality""")
def class_split(spark, folder):
    """80 % of every class."""
    s = stratified_split(table(spark, folder, "labels"), "quality", ["doc_id"], 0.8)
    return s.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("n_train"))


@query("""
SELECT COUNT(DISTINCT l_orderkey) AS n_keys, COUNT(*) AS n_rows, 0::BIGINT AS keys_on_both_sides, TRUE AS share_is_near FROM lineitem""")
def key_split(spark, folder):
    """A key is on one side only, and about a tenth of the keys are test keys."""
    s = hash_split(table(spark, folder, "lineitem").select("l_orderkey"), ["l_orderkey"], 0.1)
    per_key = s.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("is_test").alias("hi"), F.min("is_test").alias("lo"))
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"), F.count_if(F.col("hi") != F.col("lo")).alias("keys_on_both_sides"),
        F.avg(F.col("hi").cast("double")).between(0.08, 0.12).alias("share_is_near"),
    )


@query("SELECT COUNT(*) AS n_rows, 10::BIGINT AS n_folds, TRUE AS even FROM orders")
def fold_numbers(spark, folder):
    """Ten folds of about equal size."""
    f = with_fold(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 10)
    sizes = f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_folds"),
        (F.max("n") < F.min("n") * 1.3).alias("even"),
    )


@query("""
SELECT COUNT(*) + 1000 AS n_rows, 1000::BIGINT AS n_drawn, TRUE AS all_large FROM orders""")
def threshold_upsample(spark, folder):
    """1,000 extra draws among the large incidents."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    up = upsample_where(rows, F.col("o_totalprice") >= 300000, 1000, ["o_orderkey"])
    return up.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("draw_id").alias("n_drawn"),
        F.every(F.col("draw_id").isNull() | (F.col("o_totalprice") >= 300000)).alias("all_large"),
    )


@query("""
SELECT l_returnflag, least(COUNT(*), 100) AS n FROM lineitem GROUP BY l_returnflag""")
def rows_per_band(spark, folder):
    """100 rows per band."""
    l = table(spark, folder, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = sample_per_band(l, "l_returnflag", 100, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


_SHARES = (0.07, 0.29, 0.55, 0.57, 0.8, 0.9)


@query(f"""
WITH c AS (SELECT o_orderpriority AS band, COUNT(*) AS n FROM orders GROUP BY 1),
s AS (SELECT unnest([{", ".join(f"{round(x * 100)}" for x in _SHARES)}]) AS percent)
SELECT band, CAST(percent AS INTEGER) AS percent, n, (n * percent + 99) // 100 AS n_train FROM c, s""")
def exact_shares(spark, folder):
    """R4 at shares that a double holds only nearly: the training rows of every class are ceil(share * n), counted in whole numbers."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("band"))
    out = None
    for share in _SHARES:
        split = stratified_split(orders, "band", ["o_orderkey"], share)
        part = split.groupBy("band").agg(F.lit(round(share * 100)).alias("percent"), F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("n_train"))
        out = part if out is None else out.union(part)
    return out
