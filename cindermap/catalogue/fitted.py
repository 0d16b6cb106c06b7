"""Models. Closed-form fits are compared with SQL; the others are checked by property in the tests."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from cindermap.catalogue.incidents import _tables
from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import TRACT_SQL, table, tracts
from cindermap.functions.keys import prefixed
from cindermap.models.evaluate import agreement, confusion
from cindermap.models.regress import coefficients, lasso_coefficients, lasso_cv, least_squares, rmse
from cindermap.operators.aggregate import stack
from cindermap.plans import alarms, casualty, installs
from cindermap.plans.compare import compare_models
from cindermap.plans.incidents import geocoded_outcomes
from cindermap.session import materialize, scratch_path


@query("""
WITH m AS (SELECT SUM(w) AS s, SUM(w * a) / SUM(w) AS ma, SUM(w * b) / SUM(w) AS mb, SUM(w * y) / SUM(w) AS my
  FROM (SELECT l_tax + 0.01 AS w, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem)),
c AS (SELECT MIN(ma) AS ma, MIN(mb) AS mb, MIN(my) AS my, SUM(w * (a - ma) ^ 2) AS aa, SUM(w * (b - mb) ^ 2) AS bb,
  SUM(w * (a - ma) * (b - mb)) AS ab, SUM(w * (a - ma) * (y - my)) AS ay, SUM(w * (b - mb) * (y - my)) AS by_
  FROM (SELECT l_tax + 0.01 AS w, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem), m),
s AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ka, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS kb, ma, mb, my FROM c)
SELECT 'l_quantity' AS term, round(ka, 3) AS coefficient FROM s UNION ALL SELECT 'l_discount', round(kb, 3) FROM s
UNION ALL SELECT '(intercept)', round(my - ka * ma - kb * mb, 3) FROM s""")
def weighted_linear_fit(spark, folder):
    """M4, M2: weighted least squares by the normal equations."""
    l = table(spark, folder, "lineitem").withColumn("w", F.col("l_tax") + 0.01)
    features = ["l_quantity", "l_discount"]
    model = least_squares(features, "l_extendedprice", "w").fit(l)
    out = coefficients(model, features, spark)
    return out.withColumn("coefficient", F.round("coefficient", 3))


@query("""
WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS k, regr_intercept(o_totalprice, o_custkey) AS b FROM orders)
SELECT o_orderstatus, COUNT(*) AS n, round(sqrt(AVG((o_totalprice - (b + k * o_custkey)) ^ 2)), 3) AS rmse FROM orders, m GROUP BY 1""")
def stored_model(spark, folder):
    """A fitted model saved, loaded and used."""
    o = table(spark, folder, "orders")
    path = scratch_path(spark, "model")
    least_squares(["o_custkey"], "o_totalprice").fit(o).write().save(path)
    scored = PipelineModel.load(path).transform(o)
    return scored.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(rmse("o_totalprice", "prediction"), 3).alias("rmse")
    )


@query("""
WITH s AS (SELECT quality, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS predicted FROM labels),
c AS (SELECT COUNT(*) AS n, AVG(CASE WHEN quality = predicted THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
  (AVG(quality::DOUBLE) * AVG(predicted::DOUBLE) + (1 - AVG(quality::DOUBLE)) * (1 - AVG(predicted::DOUBLE))) AS pe FROM s)
SELECT n, round(accuracy, 6) AS accuracy, round((accuracy - pe) / (1 - pe), 6) AS kappa FROM c""")
def confusion_kappa(spark, folder):
    """M13."""
    rows = table(spark, folder, "labels").withColumn("predicted", F.when(F.col("toxic") == 1, 0).otherwise(1))
    out = agreement(rows, "quality", "predicted")
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


@query("""
SELECT quality AS actual, toxic AS predicted, COUNT(*) AS n FROM labels GROUP BY 1, 2""")
def confusion_matrix(spark, folder):
    """M13, A12."""
    return confusion(table(spark, folder, "labels"), "quality", "toxic")


_PENALTIES = (0.0, 1.0, 5.0, 12.0)


@query("""
WITH s AS (SELECT corr(l_quantity, l_extendedprice) * stddev_samp(l_extendedprice) AS b, stddev_samp(l_quantity) AS sx FROM lineitem)
""" + " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS penalty, 'l_quantity' AS term, round(sign(b) * greatest(abs(b) - {p}, 0) / sx, 3) AS coefficient FROM s"
    for p in _PENALTIES
))
def lasso_path(spark, folder):
    """M3: coefficients by penalty; with one feature the solution is a soft threshold."""
    out = lasso_coefficients(table(spark, folder, "lineitem"), ["l_quantity"], "l_extendedprice", _PENALTIES)
    return out.withColumn("coefficient", F.round("coefficient", 3))


@query("""
WITH s AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice + 2000 * l_quantity AS y FROM lineitem),
t AS (SELECT greatest(abs(corr(a, y)), abs(corr(b, y)), abs(corr(c, y))) * stddev_pop(y) AS top FROM s)
SELECT CAST(i AS INTEGER) AS step, round(top * pow(0.0001, i / 19.0::DOUBLE), 2) AS penalty, TRUE AS no_worse_than_none FROM t, range(20) r(i)""")
def lasso_search(spark, folder):
    """The path of penalties; no penalty of it does worse on left-out rows than the one that clears the model."""
    l = table(spark, folder, "lineitem").withColumn("signal", F.col("l_extendedprice") + 2000 * F.col("l_quantity"))
    features = ["l_quantity", "l_discount", "l_tax"]
    fit = lasso_cv(l, features, "signal", ["l_orderkey", "l_linenumber"])
    none = fit.errors[0][1]
    rows = [(i, round(float(p), 2), bool(min(e for _, e in fit.errors) <= e <= none * 1.0001)) for i, (p, e) in enumerate(fit.errors)]
    return spark.createDataFrame(rows, "step int, penalty double, no_worse_than_none boolean")


def _tract_table(spark, folder):
    """Tract features with gaps."""
    t = tracts(spark, folder)
    spend = table(spark, folder, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("spend"))
    return t.join(spend, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("geoid").alias("tractid"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        F.col("n_nationkey").cast("double").alias("county"), F.col("population").cast("double").alias("population"), "spend",
    )


def _profile(spark, folder):
    """Mixed-level profile table: county and tract rows with prefixed ids."""
    t = _tract_table(spark, folder)
    tract = t.select(prefixed("14000US", "tractid").alias("geoid"), F.col("population").alias("tenure_renter_occupied"),
                     F.col("spend").alias("income"), F.col("county").alias("hdsb_yes"))
    county = t.groupBy(F.substring("tractid", 1, 5).alias("f")).agg(
        F.avg("population").alias("tenure_renter_occupied"), F.avg("spend").alias("income"), F.max("county").alias("hdsb_yes"))
    return stack(county.select(prefixed("05000US", "f").alias("geoid"), "tenure_renter_occupied", "income", "hdsb_yes"), tract)


@query(f"""
WITH t AS ({TRACT_SQL})
SELECT substring(geoid, 1, 2) AS state, substring(geoid, 3, 3) AS cnty, substring(geoid, 6) AS tract, geoid AS geoid2, TRUE AS is_share
FROM t WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def install_risk(spark, folder):
    """PL-1A: forest and LASSO trained on counties, scored on every tract with all features; no score is above 1."""
    # an order is a visit, so that every county has enough of them
    orders = table(spark, folder, "orders").join(tracts(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
    visits = orders.select(
        F.substring("geoid", 1, 5).alias("fips"), F.col("n_name").alias("state"), F.col("c_mktsegment").alias("city"),
        F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("alarms_ins"))
    models = installs.install_risk(visits, _profile(spark, folder))
    return models.tracts.select("state", "cnty", "tract", "geoid2", (F.col("risk_1a") <= 1.0).alias("is_share"))


@query(f"""
WITH t AS ({TRACT_SQL})
SELECT geoid AS tractid, c_custkey IN (SELECT o_custkey FROM orders) AS scored FROM t""")
def alarm_model(spark, folder):
    """PL-1B-M: weighted linear model on the presence target, scored for every tract with all features; the weights of a fit leave the
    weighted mean of the training rows in place, so errors on the tracts with fires stay below the spread of the target."""
    totals = alarms.presence_totals(alarms.presence_counts(*_tables(spark, folder), by=["year"]))
    # no tract of these data has more than five fires, so the default support of 25 leaves none
    fit = alarms.weighted_linear(totals, _profile(spark, folder), support=1)
    errors = fit.full_rmse.withColumn("sd", totals.agg(F.stddev_pop("ratio_no_alarm_in_all")).scalar())
    scored = fit.all_tracts.select("tractid", F.col("weighted_linear_pred").isNotNull().alias("scored"))
    wrong = errors.filter(~(F.col("rmse") <= F.col("sd") * 1.1)).select(F.lit("error above the spread").alias("tractid"), F.lit(False).alias("scored"))
    return scored.union(wrong)


_EVERY_TRACT = f"""
WITH t AS ({TRACT_SQL})
SELECT geoid AS tractid, TRUE AS in_range, TRUE AS is_mean FROM t"""


def _proper(scores, both):
    ranges = [F.col(c).between(0.0, 1.0) for c in ("death_prob", "injury_prob", both)]
    mean = (F.col("death_prob") + F.col("injury_prob")) / 2.0
    return scores.select("tractid", (ranges[0] & ranges[1] & ranges[2]).alias("in_range"), (F.abs(F.col(both) - mean) < 1e-12).alias("is_mean"))


def _casualty_data(spark, folder):
    basic, _, formatted, geocoded = _tables(spark, folder)
    outcomes = materialize(geocoded_outcomes(basic, formatted, geocoded, ["ALARM"]), "outcomes")
    features = materialize(_tract_table(spark, folder), "features")
    data = {e: casualty.binary_dataset(outcomes, features, e, c, n=None) for e, c in (("death", "OTH_DEATH"), ("injury", "OTH_INJ"))}
    return data, features


@query(_EVERY_TRACT)
def logistic_risk(spark, folder):
    """PL-3A-L: M5, X11: every tract with both event probabilities and their mean."""
    data, features = _casualty_data(spark, folder)
    return _proper(casualty.logistic_risk(data["death"], data["injury"], features).scores, "death_injury_risk_prob")


@query(_EVERY_TRACT)
def forest_risk(spark, folder):
    """PL-3A-R: M6, M15, A16: every tract with both forest probabilities and their mean."""
    data, features = _casualty_data(spark, folder)
    return _proper(casualty.forest_risk(data["death"], data["injury"], features).scores, "death_injury_rf_risk_prob")


def _casualty_profile(spark, folder):
    t = _tract_table(spark, folder)
    return t.select(
        F.col("tractid").alias("geoid"), F.lit("g").alias("gov"), F.col("county").alias("base_county"),
        F.when(F.col("population") < 100, ".").otherwise(F.format_number("population", 0)).alias("tractpopulation2010"),
        "balance", "spend", F.col("county").alias("civic"),
    )


def _casualty_fit(spark, folder):
    basic, _, formatted, geocoded = _tables(spark, folder)
    outcomes = materialize(geocoded_outcomes(basic, formatted, geocoded, ["ALARM"]).withColumnRenamed("tractid", "geoid"), "outcomes")
    profile = materialize(_casualty_profile(spark, folder), "profile")
    keys = ["STATE", "FDID", "INC_DATE", "INC_NO", "EXP_NO"]
    training, _audit = casualty.casualty_training(outcomes, profile, keys, "civic")
    features = ["tractpopulation2010", "balance", "spend", "civic"]
    return casualty.fit_casualty_forest(training, features), features, outcomes, profile


@query(f"""
WITH t AS ({TRACT_SQL}),
p AS (SELECT AVG(CASE WHEN o_totalprice > 400000 THEN 1.0::DOUBLE ELSE 0 END) AS prior FROM orders JOIN t ON o_custkey = c_custkey WHERE c_acctbal >= 0)
SELECT COUNT(*) AS n, COUNT(*) AS n_in_range, round(MIN(prior) / 0.5, 6) AS correction FROM t, p""")
def prior_corrected_risk(spark, folder):
    """PL-3A-S: R2, M6, S10, M15, X9, A19: forest probabilities of all tracts, and the factor that brings them to the real class share."""
    model, features, outcomes, profile = _casualty_fit(spark, folder)
    path = scratch_path(spark, "forest")
    model.write().save(path)
    scores = casualty.prior_corrected_scores(PipelineModel.load(path), features, outcomes, profile)
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob_death_or_inj").between(0.0, 1.0)).alias("n_in_range"),
        F.round(F.sum("risk_3a") / F.sum("prob_death_or_inj"), 6).alias("correction"),
    )


@query("""
SELECT unnest(['tractpopulation2010', 'balance', 'spend', 'civic']) AS variable, TRUE AS is_share, TRUE AS adds_up""")
def feature_importance(spark, folder):
    """The importance of every feature is a share, and the shares add up."""
    from cindermap.models.classify import importance_table

    model, features, _, _ = _casualty_fit(spark, folder)
    weights = importance_table(model, features, spark)
    total = weights.agg(F.sum("importance")).scalar()
    return weights.select("variable", F.col("importance").between(0.0, 1.0).alias("is_share"), (F.abs(total - 1.0) < 1e-9).alias("adds_up"))


@query("""
WITH c AS (SELECT CASE WHEN label < 3 THEN 'death' WHEN label < 6 THEN 'inj' ELSE 'no_inj' END AS target, COUNT(*) AS n FROM embeddings GROUP BY 1),
v AS (SELECT CAST(SUM(n - (4 * n + 4) // 5) AS BIGINT) AS n_validation FROM c)
SELECT unnest(['boosting', 'forest', 'forest_kappa', 'network', 'pls']) AS model, n_validation, TRUE AS in_range FROM v""")
def model_comparison(spark, folder):
    """PL-3A-T: M7-M10, R4, R5 on the embedding features, three classes, full grids."""
    size = 64
    e = table(spark, folder, "embeddings")
    kind = F.when(F.col("label") < 3, "death").when(F.col("label") < 6, "inj").otherwise("no_inj")
    features = [f"e{i}" for i in range(size)]
    wide = e.select("vec_id", kind.alias("target"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)])
    rated = compare_models(wide, features, "target", ["vec_id"])
    fine = F.col("accuracy").between(0.0, 1.0) & F.col("cv_metric").between(-1.0, 1.0) & F.col("kappa").between(-1.0, 1.0) & (F.col("settings") != "")
    return rated.select("model", "n_validation", fine.alias("in_range"))
