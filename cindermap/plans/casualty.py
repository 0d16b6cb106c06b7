"""Casualty given fire (PL-3A-D, PL-3A-L, PL-3A-R, PL-3A-S)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.keys import INCIDENT_KEY
from cindermap.functions.scores import mean_strict, prior_corrected
from cindermap.functions.values import later_rule_wins, number_from_text
from cindermap.models.classify import (
    class_probability,
    fit_forest,
    importance_table,
    logistic_model,
    score,
)
from cindermap.models.fit import fit_cached
from cindermap.operators.aggregate import share_where
from cindermap.operators.columns import drop_matching, numeric_columns
from cindermap.operators.filters import known
from cindermap.operators.prep import central_impute
from cindermap.operators.relate import match_audit, skew_join
from cindermap.operators.sample import downsample
from cindermap.session import materialize

# Columns of the tract profile that are not features, and those stored as formatted text.
PROFILE_IDS = ("county_fip", "county_fip_full", "state", "statecountyfipscode", "tract_fip", "gov")
PROFILE_GROUPS = ("base", "member", "select")
PROFILE_TEXT_NUMBERS = ("populationdensitypersquaremile20", "tractpopulation2010", "landareasquaremiles2010")

NO_CASUALTY, INJURY, DEATH = "no_inj", "inj", "death"


def binary_target(event: str, column: str) -> Column:
    """``event`` where the count is at least 1, else ``other``."""
    return later_rule_wins([(F.col(column) >= 1, event)], "other")


def casualty_target(injuries: str = "OTH_INJ", deaths: str = "OTH_DEATH") -> Column:
    """Three classes, a death outranking an injury."""
    return later_rule_wins([(F.col(injuries) > 0, INJURY), (F.col(deaths) > 0, DEATH)], NO_CASUALTY)


def class_prior(incidents: DataFrame, target: str = "target") -> Column:
    """Share of incidents with a casualty, as a scalar."""
    return incidents.agg(share_where(F.col(target) != NO_CASUALTY)).scalar()


def binary_dataset(
    outcomes: DataFrame,
    features: DataFrame,
    event: str,
    column: str,
    n: int | None = 20_000,
    keys: Sequence[str] = INCIDENT_KEY,
    seed: int = 12,
) -> DataFrame:
    """PL-3A-D: a balanced bootstrap of incidents (event against other) with tract features, gaps filled.

    ``keys`` must identify an incident (several years together: add the year).
    ``draw_id`` tells repeated draws of one incident apart.
    """
    labelled = outcomes.filter(known("tractid")).select(*keys, "tractid", binary_target(event, column).alias("target"))
    # Read by the class counts and by the draws, so the incident joins run once.
    labelled = materialize(labelled, "labelled")
    drawn = downsample(labelled, "target", [event, "other"], [0.5, 0.5], list(keys), True, n, seed)
    drawn = materialize(drawn.select("draw_id", "target", "tractid"), "draws")
    joined = materialize(skew_join(drawn, features, "tractid", "left"), "training")
    return central_impute(joined, numeric=numeric_columns(features), nominal=[])


@dataclass
class RiskModels:
    death: PipelineModel
    injury: PipelineModel
    features: list[str]
    scores: DataFrame


def logistic_risk(deaths: DataFrame, injuries: DataFrame, tracts: DataFrame) -> RiskModels:
    """PL-3A-L: mean of the two event probabilities per tract.

    The event is class 1 here. Modelling ``other`` and taking one minus the mean gives the same number.
    """
    features = numeric_columns(tracts)
    death, injury = (fit_cached(logistic_model(features, "target", event), rows) for event, rows in (("death", deaths), ("injury", injuries)))
    filled = central_impute(tracts, numeric=features, nominal=[])
    first = score(death, filled, ["tractid", *features], death_prob=class_probability(death))
    both = score(injury, first, ["tractid", "death_prob"], injury_prob=class_probability(injury))
    scores = both.withColumn("death_injury_risk_prob", mean_strict("death_prob", "injury_prob"))
    return RiskModels(death, injury, features, scores)


def forest_risk(
    deaths: DataFrame, injuries: DataFrame, tracts: DataFrame, trees: int = 250, depth: int = 10, seed: int = 12
) -> RiskModels:
    """PL-3A-R: the same with two forests."""
    features = numeric_columns(tracts)
    death, injury = (fit_forest(rows, features, "target", trees, depth, seed) for rows in (deaths, injuries))
    filled = central_impute(tracts, numeric=features, nominal=[])
    first = score(death, filled, ["tractid", *features], death_prob=class_probability(death, "death"))
    both = score(injury, first, ["tractid", "death_prob"], injury_prob=class_probability(injury, "injury"))
    scores = both.withColumn("death_injury_rf_risk_prob", mean_strict("death_prob", "injury_prob"))
    return RiskModels(death, injury, features, scores)


def risk_importance(models: RiskModels, spark, k: int = 50) -> DataFrame:
    """M14 for both forests."""
    tables = [
        importance_table(m, models.features, spark, k).withColumn("model", F.lit(name))
        for name, m in (("death", models.death), ("injury", models.injury))
    ]
    return tables[0].unionByName(tables[1])


def profile_features(profile: DataFrame, also_drop: Sequence[str] = ()) -> DataFrame:
    """The tract profile without id and bookkeeping columns, text numbers turned into numbers."""
    trimmed = drop_matching(profile, [*PROFILE_IDS, *also_drop], PROFILE_GROUPS)
    return trimmed.withColumns({c: number_from_text(c) for c in PROFILE_TEXT_NUMBERS if c in trimmed.columns})


def casualty_training(
    incidents: DataFrame,
    profile: DataFrame,
    keys: Sequence[str],
    witness: str,
    shares: Sequence[float] = (0.25, 0.25, 0.50),
    seed: int = 12,
) -> tuple[DataFrame, DataFrame]:
    """PL-3A-T input: three-class sample with profile features, and the audit of incidents without a profile.

    ``witness`` is a profile column that is never missing; rows without it found no profile.
    """
    labelled = incidents.filter(F.col("geoid").isNotNull()).select(*keys, "geoid", casualty_target().alias("target"))
    labelled = materialize(labelled, "labelled")
    drawn = downsample(labelled, "target", [DEATH, INJURY, NO_CASUALTY], list(shares), list(keys), seed=seed)
    drawn = materialize(drawn.select("draw_id", "target", "geoid"), "draws")
    features = profile_features(profile)
    joined = materialize(skew_join(drawn, features, "geoid", "inner").filter(F.col(witness).isNotNull()), "training")
    filled = central_impute(joined.drop("geoid"), nominal=[], numeric=numeric_columns(joined, ["draw_id"]))
    return filled, match_audit(drawn, features, "geoid")


def prior_corrected_scores(
    model: PipelineModel,
    features: Sequence[str],
    incidents: DataFrame,
    profile: DataFrame,
    event: str = "casualty",
    sampled_share: float = 0.5,
) -> DataFrame:
    """PL-3A-S: casualty probability per tract, brought back to the real class share.

    The feature list is the one the model was trained on.
    """
    labelled = incidents.filter(F.col("geoid").isNotNull()).select(casualty_target().alias("target"))
    prior = class_prior(labelled)
    ready = central_impute(profile_features(profile.filter(F.col("geoid").isNotNull())), numeric=list(features), nominal=[])
    scored = score(model, ready, ["geoid"], prob_death_or_inj=class_probability(model, event))
    return scored.withColumn("risk_3a", prior_corrected("prob_death_or_inj", prior, sampled_share))


def fit_casualty_forest(training: DataFrame, features: Sequence[str], trees: int = 150, depth: int = 10, seed: int = 12) -> PipelineModel:
    """M6: casualty against none, saved with ``model.write().save(path)`` and read back with ``PipelineModel.load``."""
    two = training.withColumn("target", F.when(F.col("target") == NO_CASUALTY, "none").otherwise("casualty"))
    return fit_forest(two, features, "target", trees, depth, seed)
