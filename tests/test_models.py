import numpy as np
import pytest
from conftest import rows
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from cindermap.models import classify as C
from cindermap.models import evaluate as E
from cindermap.models import regress as R
from cindermap.models.pls import fit_pls
from cindermap.models.tune import forest_grid
from cindermap.operators.prep import feature_vector, label_indexer
from cindermap.plans import alarms, casualty, installs
from cindermap.plans.compare import compare_models

FEATURES = ["a", "b", "c"]


def data(n=400, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 10.0, 1.0]
    y = 2.0 * x[:, 0] - 0.5 * x[:, 1] + r.normal(scale=0.1, size=n) + 3.0
    label = np.where(x[:, 0] > 0.7, "high", np.where(x[:, 0] < -0.7, "low", "mid"))
    return x, y, label


@pytest.fixture(scope="module")
def frame(spark):
    x, y, label = data()
    return spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), str(label[i]), float(1 + i % 3)) for i in range(len(y))],
                                 "id long, a double, b double, c double, y double, kind string, w double").repartition(2).cache()


def test_weighted_least_squares_is_the_optimum(spark, frame):
    x, y, _ = data()
    w = np.array([1 + i % 3 for i in range(len(y))])
    design = np.column_stack([np.ones(len(y)), x])
    want = np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * y))
    model = R.least_squares(FEATURES, "y", "w").fit(frame)
    got = dict(rows(R.coefficients(model, FEATURES, spark)))
    assert [got[k] for k in ("(intercept)", *FEATURES)] == pytest.approx(list(want), abs=1e-6)
    assert model.transform(frame).agg(R.rmse("y", "prediction")).first()[0] < 0.15


def test_lasso_path_and_choice(spark, frame):
    path = R.penalty_path(frame, FEATURES, "y", 6)
    assert path == sorted(path, reverse=True) and path[-1] == pytest.approx(path[0] * 1e-4)
    table = R.lasso_coefficients(frame, FEATURES, "y", [path[0] * 1.01, path[2]])
    assert all(abs(r["coefficient"]) < 1e-6 for r in table.filter(F.col("penalty") > path[0]).collect())
    assert {r["term"]: abs(r["coefficient"]) > 0 for r in table.filter(F.col("penalty") < path[0]).collect()}["b"]
    fit = R.lasso_cv(frame, FEATURES, "y", ["id"], points=4, folds=3)
    assert fit.best == min(fit.errors, key=lambda e: e[1])[0]
    assert fit.model.transform(frame).agg(R.rmse("y", "pred_lasso")).first()[0] < 0.5


def test_agreement_by_hand(spark):
    pairs = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [("b", None)]
    df = spark.createDataFrame(pairs, "t string, p string")
    assert rows(E.confusion(df, "t", "p")) == [("a", "a", 20), ("a", "b", 5), ("b", None, 1), ("b", "a", 10), ("b", "b", 15)]
    got = E.agreement(df, "t", "p").first()
    assert (got["n"], got["accuracy"], got["kappa"]) == (50, pytest.approx(0.7), pytest.approx(0.4))
    one = spark.createDataFrame([(1.0, 1.0)], "label double, prediction double")
    assert E.AgreementEvaluator("accuracy").evaluate(one) == 1.0 and E.AgreementEvaluator("kappa").evaluate(one) == 0.0


def test_logistic_models_the_event(frame):
    df = frame.withColumn("target", F.when(F.col("a") > 0, "death").otherwise("other"))
    model = C.logistic_model(["a"], "target", "death", 20).fit(df.filter("abs(a) > 0.1 OR id % 2 = 0"))
    out = C.score(model, df.drop("target"), ["id", "a"], p=C.class_probability(model)).collect()
    assert all((r["p"] > 0.5) == (r["a"] > 0) for r in out if abs(r["a"]) > 0.3)
    assert all(0 <= r["p"] <= 1 for r in out)


def test_forest_scores_importance_and_storage(spark, frame, tmp_path):
    model = C.forest_classifier(FEATURES, "kind", trees=10, depth=4).fit(frame)
    assert C.class_names(model) == ["high", "low", "mid"]
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    scored = C.score(again, frame.drop("kind"), ["id", "a"], p=C.class_probability(again, "high"), l=C.class_label(again))
    assert scored.filter((F.col("l") == "high") != (F.col("a") > 0.7)).count() < 40
    sums = C.score(again, frame, ["id"], **{c: C.class_probability(again, c) for c in C.class_names(again)})
    assert sums.filter(F.abs(F.col("high") + F.col("low") + F.col("mid") - 1) > 1e-9).count() == 0
    top = [tuple(r) for r in C.importance_table(again, FEATURES, spark, 2).collect()]
    assert len(top) == 2 and top[-1][0] == "a" and top[0][1] <= top[1][1]


def test_pls_with_all_components_is_least_squares(frame):
    x, _, label = data()
    model = fit_pls(frame, FEATURES, "kind", components=3)
    design = np.column_stack([np.ones(len(x)), x])
    for k, c in enumerate(model.classes):
        want = np.linalg.lstsq(design, (label == c).astype(float), rcond=None)[0]
        assert [model.intercepts[k], *model.weights[:, k]] == pytest.approx(list(want), abs=1e-6)
    best = design @ np.column_stack([np.r_[model.intercepts[k], model.weights[:, k]] for k in range(3)])
    got = {r["id"]: r["p"] for r in model.transform(frame, "p").select("id", "p").collect()}
    assert [got[i] for i in range(len(x))] == [model.classes[j] for j in best.argmax(axis=1)]


def test_grid_keeps_the_best(frame):
    df = label_indexer("kind").fit(frame).transform(feature_vector(FEATURES).transform(frame)).select("id", "features", "label")
    searched = forest_grid(df, ["id"], per_split=(1, 3), trees=5, depth=3)
    assert len(searched.counts) == 4 and all(0 <= m <= 1 for _, m in searched.results("accuracy"))
    tuned = searched.tuned("kappa")
    assert len(tuned.results) == 2 and tuned.best[1] == max(m for _, m in tuned.results) and tuned.best[1] > 0.3


def test_model_comparison_families(frame):
    out = {r["model"]: r for r in compare_models(frame, FEATURES, "kind", ["id"], {
        "boosting": {"depths": (2,), "min_rows": (10,), "trees": 2}, "pls": {"components": (1,)}, "network": {"sizes": (3,), "max_iter": 10}}).collect()}
    assert set(out) == {"boosting", "pls", "network"}
    assert all(0 <= r["accuracy"] <= 1 and r["n_validation"] == out["pls"]["n_validation"] for r in out.values())
    assert out["boosting"]["accuracy"] > 0.8
    with pytest.raises(ValueError):
        compare_models(frame, FEATURES, "kind", ["id"], {"svm": {}})


def tract_table(spark, n=300):
    r = np.random.default_rng(1)
    return spark.createDataFrame([(f"{i:011d}", float(v) if i % 9 else None, float(u)) for i, (v, u) in enumerate(r.normal(size=(n, 2)))],
                                 "tractid string, f1 double, f2 double")


def test_casualty_route(spark):
    tracts = tract_table(spark).cache()
    outcomes = tracts.select(F.lit("WA").alias("STATE"), F.lit("1").alias("FDID"), F.lit("01052011").alias("INC_DATE"), F.col("tractid").alias("INC_NO"),
                             F.lit("0").alias("EXP_NO"), "tractid", (F.coalesce("f1", F.lit(0)) > 1).cast("long").alias("OTH_DEATH"),
                             (F.col("f2") > 1).cast("long").alias("OTH_INJ"))
    deaths = casualty.binary_dataset(outcomes, tracts, "death", "OTH_DEATH", n=100)
    assert rows(deaths.groupBy("target").count()) == [("death", 100), ("other", 100)]
    assert deaths.filter("f1 IS NULL OR f2 IS NULL").count() == 0
    injuries = casualty.binary_dataset(outcomes, tracts, "injury", "OTH_INJ", n=100)
    forest = casualty.forest_risk(deaths, injuries, tracts, trees=5, depth=3)
    scores = forest.scores.join(tracts.withColumnRenamed("f1", "x"), "tractid")
    assert scores.count() == 300 and scores.filter("death_injury_rf_risk_prob NOT BETWEEN 0 AND 1").count() == 0
    assert scores.agg(F.corr("death_prob", F.coalesce("x", F.lit(0)))).first()[0] > 0.4
    assert casualty.risk_importance(forest, spark).count() == 4
    logit = casualty.logistic_risk(deaths, injuries, tracts)
    assert logit.scores.columns == ["tractid", "death_prob", "injury_prob", "death_injury_risk_prob"] and logit.scores.count() == 300


def test_prior_corrected_scores(spark):
    profile = tract_table(spark).select(F.col("tractid").alias("geoid"), "f1", F.lit("x").alias("gov"), F.lit(1).alias("base1"),
                                        F.when(F.col("f2") > 1, ".").otherwise("1,200").alias("tractpopulation2010"), F.lit(1.0).alias("civic"))
    incidents = profile.select("geoid", (F.col("f1") > 1).cast("long").alias("OTH_DEATH"), (F.col("f1") < -1).cast("long").alias("OTH_INJ"),
                               F.col("geoid").alias("INC_NO"))
    incidents = incidents.unionByName(incidents.filter("OTH_DEATH = 0").limit(3).withColumn("geoid", F.lit("nowhere")).withColumn("INC_NO", F.concat("INC_NO", F.lit("x"))))
    training, audit = casualty.casualty_training(incidents, profile, ["INC_NO"], "civic")
    assert "gov" not in training.columns and "base1" not in training.columns
    n = audit.first()
    assert training.count() == n["n_rows"] - n["n_unmatched"]
    model = casualty.fit_casualty_forest(training, ["f1", "tractpopulation2010"], trees=5, depth=3)
    out = casualty.prior_corrected_scores(model, ["f1", "tractpopulation2010"], incidents, profile)
    prior = incidents.agg(F.avg(((F.coalesce("OTH_DEATH", F.lit(0)) > 0) | (F.coalesce("OTH_INJ", F.lit(0)) > 0)).cast("double"))).first()[0]
    assert out.count() == 300
    assert all(r["risk_3a"] == pytest.approx(r["prob_death_or_inj"] * prior / 0.5) for r in out.collect())


def test_alarm_and_install_models(spark):
    tracts = tract_table(spark)
    acs = tracts.select(F.concat(F.lit("14000US"), "tractid").alias("geoid"), F.col("f1").alias("tenure_renter_occupied"), F.col("f2").alias("hdsb_yes"))
    counties = spark.createDataFrame([(f"05000US{i:05d}", float(i % 7), float(i % 3)) for i in range(30)], "geoid string, tenure_renter_occupied double, hdsb_yes double")
    totals = tracts.select("tractid", (F.lit(26) + F.abs(F.col("f2")).cast("long")).alias("all_fire_all_years"), F.lit(0).cast("long").alias("alarm_unknown_all_years"),
                           F.lit(1).cast("long").alias("alarm_presented_all_years"), F.lit(1).cast("long").alias("alarm_not_presented_all_years"),
                           (F.col("f2") * 0.1 + 0.5).alias("ratio_no_alarm_in_all"), F.lit(0.5).alias("ratio_no_alarm_in_all_known"))
    fit = alarms.weighted_linear(totals, acs)
    assert fit.all_tracts.count() == 300 and fit.holdout_rmse.first()["rmse"] < 1e-6 and fit.full_rmse.first()["rmse"] < 1e-6
    first = fit.tracts_with_fires.first()
    assert first["all_fire_all_years"] == totals.agg(F.max("all_fire_all_years")).first()[0]
    visits = spark.createDataFrame([(str(i), "S", "C", int(j < 4 * (i % 7))) for i in range(29) for j in range(26)] + [("29", "S", "C", 1)] * 25,
                                   "fips string, state string, city string, alarms_ins long")
    share = installs.install_share(visits)
    assert share.count() == 29 and share.filter("fips = '00003'").first()["alarm_ins_pct"] == pytest.approx(12 / 26)
    models = installs.install_risk(visits, counties.unionByName(acs.na.fill(0.0)), trees=5, folds=2, penalties=3)
    assert models.tracts.columns == ["risk_1a", "state", "cnty", "tract", "geoid2"] and models.tracts.count() == 300
    assert models.tracts.filter("risk_1a > 1").count() == 0 and models.counties.count() == 30


def test_fold_moments_equal_numpy(spark, frame):
    from cindermap.models.moments import Moments, fold_moments

    x, y, _ = data()
    parts = fold_moments(frame.withColumn("f", F.col("id") % 3), [*FEATURES, "y"], "f")
    z = np.column_stack([x, y])
    whole = parts[0] + parts[1] + parts[2]
    for got, want in ((parts[1], z[1::3]), (whole, z), (whole - parts[1], np.delete(z, np.s_[1::3], axis=0))):
        assert got.n == len(want) and np.allclose(got.mean, want.mean(axis=0))
        assert np.allclose(got.products, (want - want.mean(axis=0)).T @ (want - want.mean(axis=0)), atol=1e-6)
    line = np.array([1.0, -0.5, 0.2])
    assert whole.squared_error(line, 3.0) == pytest.approx(((y - x @ line - 3.0) ** 2).sum())
    assert isinstance(whole - whole, Moments) and (whole - whole).n == 0


def test_lasso_descent_meets_the_optimality_conditions(spark, frame):
    from cindermap.models.moments import fold_moments

    x, y, _ = data()
    (m,) = fold_moments(frame, [*FEATURES, "y"]).values()
    penalties = [3.0, 1.0, 0.1, 0.001, 0.0]
    for penalty, (weights, intercept) in zip(penalties, R.lasso_path_of(m, penalties)):
        slope = x.T @ (y - x @ weights - intercept) / len(y) / x.std(axis=0)
        for w, g in zip(weights, slope):
            assert abs(g - np.sign(w) * penalty) < 1e-6 if w else abs(g) <= penalty + 1e-6
    want = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    assert [intercept, *weights] == pytest.approx(list(want), abs=1e-5)


def test_lasso_errors_equal_fits_of_each_fold(spark, frame):
    from cindermap.operators.sample import with_fold

    x, y, _ = data()
    fit = R.lasso_cv(frame, FEATURES, "y", ["id"], points=5, folds=3)
    fold = np.array([r["f"] for r in with_fold(frame, ["id"], 3, 12, "f").orderBy("id").collect()])
    for penalty, error in fit.errors:
        marks = []
        for k in range(3):
            tx, ty = x[fold != k], y[fold != k]
            sd, b = tx.std(axis=0), np.zeros(3)
            s = (tx - tx.mean(axis=0)) / sd
            for _ in range(400):
                for j in range(3):
                    rest = s[:, j] @ (ty - ty.mean() - s @ b + s[:, j] * b[j]) / len(ty)
                    b[j] = np.sign(rest) * max(abs(rest) - penalty, 0)
            w = b / sd
            marks.append(np.mean((y[fold == k] - ty.mean() - (x[fold == k] - tx.mean(axis=0)) @ w) ** 2))
        assert error == pytest.approx(np.mean(marks), rel=1e-6)


def test_component_counts_come_from_one_set_of_products(frame):
    from cindermap.models.tune import pls_grid

    model, results = pls_grid(frame, ["id"], FEATURES, "kind", components=(1, 2, 3))
    assert [s for s, _ in results] == ["components=1", "components=2", "components=3"]
    best = int(max(results, key=lambda r: r[1])[0].split("=")[1])
    again = fit_pls(frame, FEATURES, "kind", best)
    assert np.allclose(model.weights, again.weights) and np.allclose(model.intercepts, again.intercepts)
