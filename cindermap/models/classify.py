"""Classification models and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.values import nan_to_null
from cindermap.operators.aggregate import top
from cindermap.operators.prep import feature_vector, label_indexer

BINS = 32  # values of a feature that a forest tells apart, as many as Spark ML's forests take
UNITS = 1 << 18  # rows up to which every row is drawn by itself into the bootstrap of a tree


def logistic_model(features: Sequence[str], target: str, event: str, max_iter: int = 100) -> Pipeline:
    """M5: binomial logistic regression; the event is class 1, so the score is P(event) directly."""
    from pyspark.ml.feature import SQLTransformer

    quoted = event.replace("'", "''")
    label = SQLTransformer(statement=f"SELECT *, CAST(`{target}` = '{quoted}' AS DOUBLE) AS label FROM __THIS__")
    logistic = LogisticRegression(labelCol="label", maxIter=max_iter, regParam=0.0)
    return Pipeline(stages=[label, feature_vector(features), logistic])


def forest_classifier(
    features: Sequence[str], target: str, trees: int = 150, depth: int = 10, seed: int = 12, per_split: str = "sqrt"
) -> Pipeline:
    """M6: bootstrap forest; classes are indexed in alphabetical order."""
    forest = RandomForestClassifier(
        labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy=per_split, seed=seed
    )
    return Pipeline(stages=[label_indexer(target), feature_vector(features), forest])


def bin_splits(df: DataFrame, features: Sequence[str], bins: int = BINS, accuracy: int = 10_000) -> list[list[float]]:
    """Splits for at most ``bins`` bins per feature: all values if there are few, else quantiles.

    Places that a frequent value takes from the quantiles go to quantiles of the other values, so rare values
    beside a frequent one keep bins of their own. One pass of sketches for features without such values.
    """
    found: dict[str, set[float]] = {c: set() for c in features}
    left = list(features)
    while left:
        asked = []
        for c in left:
            x, free = nan_to_null(F.col(f"`{c}`").cast("double")), bins - 1 - len(found[c])
            rest = F.when(~x.isin(sorted(found[c])), x) if found[c] else x
            asked.append(F.percentile_approx(rest, [i / (free + 1) for i in range(1, free + 1)], accuracy))
        before = {c: len(found[c]) for c in left}
        for c, values in zip(left, df.agg(*[a.alias(f"q{i}") for i, a in enumerate(asked)]).first()):
            found[c] |= set(values or ())
        left = [c for c in left if before[c] < len(found[c]) < bins - 1]
    return [[float("-inf"), *(sorted(found[c]) or [0.0]), float("inf")] for c in features]


def bootstrap_units(df: DataFrame, columns: Sequence[str], units: int = UNITS) -> DataFrame:
    """Equal rows put together into weighted ones, ``__weight`` rows each; the weights add up to the number of rows.

    Up to ``units`` rows, each stays a row of weight 1. Beyond, rows equal in ``columns`` share a weight of at most
    ``rows / units``, so there are at most ``units`` rows more than different ones, however many rows there are.
    """
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).persist()
    try:
        most = -(-(groups.agg(F.sum("__n")).first()[0] or 0) // units) or 1
        pieces = F.ceil(F.col("__n") / F.lit(most)).cast("int")
        dealt = groups.select(*columns, F.explode(F.array_repeat(F.col("__n") / pieces, pieces)).alias("__weight"))
        # few rows and much work for each: as many tasks as there are cores, whatever their bytes
        out = dealt.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
        out.count()
        return out
    finally:
        groups.unpersist()


def fit_forest(
    df: DataFrame, features: Sequence[str], target: str, trees: int = 150, depth: int = 10, seed: int = 12, per_split: str = "sqrt", units: int = UNITS
) -> PipelineModel:
    """M6 for any number of rows: the forest learns from bins, and rows equal in all bins and the class are weighted rows.

    A forest of Spark ML sees no more than the bins of a feature either, but meets every row again on each level of each tree. Here
    the bins are a stage of the model, so that rows can be counted by them first. All rows count in full; the bootstrap of a tree draws the
    rows of ``bootstrap_units``.
    """
    rows = df.select(target, *features).persist()
    try:
        label = label_indexer(target).fit(rows)
        binned = [f"__bin_{c}" for c in features]
        bins = Bucketizer(splitsArray=bin_splits(rows, features), inputCols=list(features), outputCols=binned, handleInvalid="error")
        vector = feature_vector(binned)
        # bins are numbers in order; as the categories that their column says they are they would be split in any order
        coded = bins.transform(label.transform(rows)).select("label", *[(F.col(b) + 0.0).alias(b) for b in binned])
        drawn = bootstrap_units(coded, ["label", *binned], units)
    finally:
        rows.unpersist()
    try:
        forest = RandomForestClassifier(
            labelCol="label", weightCol="__weight", numTrees=trees, maxDepth=depth, maxBins=BINS, featureSubsetStrategy=per_split, seed=seed
        )
        return PipelineModel(stages=[label, bins, vector, forest.fit(vector.transform(drawn))])
    finally:
        drawn.unpersist()


def scorer(model: PipelineModel) -> PipelineModel:
    """The fitted pipeline without its label steps, for rows that have no target."""
    from pyspark.ml.feature import SQLTransformer

    kept = [s for s in model.stages if not isinstance(s, (StringIndexerModel, SQLTransformer))]
    return PipelineModel(stages=kept)


def class_names(model: PipelineModel) -> list[str]:
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            return list(stage.labelsArray[0])
    raise ValueError("the pipeline has no label index")


def class_probability(model: PipelineModel, name: str | None = None) -> Column:
    """Probability of the named class, or of the event of a logistic model."""
    index = 1 if name is None else class_names(model).index(name)
    return vector_to_array(F.col("probability"))[index]


def class_label(model: PipelineModel) -> Column:
    """Predicted class name."""
    names = F.array(*[F.lit(n) for n in class_names(model)])
    return F.get(names, F.col("prediction").cast("int"))


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], **outputs: Column) -> DataFrame:
    """Score rows, keeping their keys through the transform; rows of few bytes are dealt over all tasks, since a model takes long for each."""
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = scorer(model).transform(spread)
    return scored.select(*keep, *[c.alias(n) for n, c in outputs.items()])


def importance_table(model: PipelineModel, features: Sequence[str], spark, k: int = 50) -> DataFrame:
    """The ``k`` most important features, in ascending order (one row per feature)."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(features, weights)]
    table = spark.createDataFrame(rows, "variable string, importance double")
    return top(table, "importance", ["variable"], k).orderBy("importance", F.desc("variable"))
