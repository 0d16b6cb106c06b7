"""Model comparison on a stratified split (PL-3A-T)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.models.evaluate import agreement
from cindermap.models.tune import boosting_grid, forest_grid, network_grid, pls_grid
from cindermap.operators.prep import feature_vector, label_indexer, vector_scaler
from cindermap.operators.sample import stratified_split


def compare_models(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keys: Sequence[str],
    settings: Mapping[str, Mapping[str, object]] | None = None,
    train_share: float = 0.8,
    seed: int = 12,
) -> DataFrame:
    """Tune each model family by 2-fold cross-validation and rate its best model on the validation rows.

    ``settings`` names the families to run (``boosting``, ``forest``,
    ``forest_kappa``, ``network``, ``pls``) with their grid arguments; default is
    all with their full grids.
    """
    settings = settings if settings is not None else {k: {} for k in ("boosting", "forest", "forest_kappa", "network", "pls")}
    split = stratified_split(df, target, keys, train_share, seed)
    raw = feature_vector(features, "raw")
    prepared = PipelineModel(stages=[label_indexer(target).fit(df), raw]).transform(split)
    scaler = vector_scaler("raw", "scaled").fit(prepared.filter("is_train"))
    data = scaler.transform(prepared).select(*keys, target, "label", "raw", "scaled", *features, "is_train").persist()
    n_classes = data.select("label").distinct().count()

    def side(train: bool, column: str) -> DataFrame:
        return data.filter(F.col("is_train") if train else ~F.col("is_train")).withColumnRenamed(column, "features")

    rows, forests = [], {}
    try:
        for name, args in settings.items():
            args = dict(args)
            if name == "pls":
                model, results = pls_grid(data.filter("is_train"), keys, features, target, seed=seed, **args)
                held = model.transform(data.filter("NOT is_train"), "__pred")
                rated = agreement(held, target, "__pred").first()
                best = max(results, key=lambda r: r[1])
            else:
                column = "scaled" if name == "network" else "raw"
                train = side(True, column).select(*keys, "features", "label")
                if name == "boosting":
                    tuned = boosting_grid(train, keys, seed=seed, **args)
                elif name in ("forest", "forest_kappa"):
                    # one search serves both metrics
                    grid = repr(sorted(args.items()))
                    forests[grid] = forests.get(grid) or forest_grid(train, keys, seed=seed, **args)
                    tuned = forests[grid].tuned("kappa" if name == "forest_kappa" else "accuracy")
                elif name == "network":
                    tuned = network_grid(train, keys, len(features), n_classes, seed=seed, **args)
                else:
                    raise ValueError(f"unknown model family {name!r}")
                rated = agreement(tuned.model.transform(side(False, column)), "label", "prediction").first()
                best = tuned.best
            rows.append((name, best[0], float(best[1]), rated["n"], rated["accuracy"], rated["kappa"]))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "model string, settings string, cv_metric double, n_validation long, accuracy double, kappa double"
    )
