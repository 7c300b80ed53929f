"""Training and evaluation with Spark ML over the written feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.plans.prior import totals_before


#: Settings of the model families.
CLASSIFIERS = {
    "logistic_regression": (LogisticRegression, {"maxIter": 120, "regParam": 0.08, "elasticNetParam": 0.0}),
    "random_forest": (RandomForestClassifier, {"numTrees": 220, "maxDepth": 7, "minInstancesPerNode": 4, "seed": 42}),
    "decision_tree": (DecisionTreeClassifier, {"maxDepth": 5, "minInstancesPerNode": 6, "seed": 42}),
    "naive_bayes": (NaiveBayes, {"modelType": "gaussian"}),
}
REGRESSORS = {
    "linear": (LinearRegression, {"maxIter": 100}),
    "ridge": (LinearRegression, {"maxIter": 100, "elasticNetParam": 0.0, "standardization": False}),
    "lasso": (LinearRegression, {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 1.0, "standardization": False}),
    "boosted_trees": (GBTRegressor, {"maxIter": 180, "stepSize": 0.045, "maxDepth": 5, "seed": 42}),
    "random_forest": (RandomForestRegressor, {"numTrees": 320, "maxDepth": 8, "minInstancesPerNode": 8, "seed": 42}),
}


def classifier(family: str, **params):
    """Weighted classifier of a family; the weight column is ``weight``."""
    kind, settings = CLASSIFIERS[family]
    return kind(weightCol="weight", **{**settings, **params})


def regressor(family: str, rows: int, alpha: float = 1.0, **params):
    """Ridge uses lambda = alpha / n, lasso alpha, both without standardisation of their own."""
    kind, settings = REGRESSORS[family]
    own = {"regParam": alpha / max(rows, 1)} if family == "ridge" else {}
    return kind(**{**settings, **own, **params})


def gapped(rows: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that miss a value in some row: no others need a median."""
    flags = [F.max(F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0)).alias(c) for c in features]
    found = rows.agg(*flags).first()
    return [c for c, gap in zip(features, found, strict=True) if gap]


def preparation(features: Sequence[str], gaps: Sequence[str] | None = None) -> list:
    """Median imputation, assembly, standardisation to mean 0 and deviation 1.

    ``gaps`` names the features that may miss values (all of them by default); the others are taken as they are, which
    gives the same vectors without a summary of each column.
    """
    gaps = list(features) if gaps is None else list(gaps)
    filled = [f"_f_{c}" if c in set(gaps) else c for c in features]
    imputer = [Imputer(strategy="median", inputCols=gaps, outputCols=[f"_f_{c}" for c in gaps])] if gaps else []
    return [
        *imputer,
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def assembled(rows: DataFrame, features: Sequence[str], gaps: Sequence[str], *keep: str) -> tuple[DataFrame, list]:
    """Rows for several fits that each scale anew, and their stages: the features as one vector where none has gaps.

    A vector is read in one go, where each pass over a hundred columns puts every row together again.
    """
    if gaps:
        return rows.select(*keep, *features), preparation(features, gaps)
    first, scaler = preparation(features, gaps)
    return first.transform(rows).select(*keep, "_raw"), [scaler]


def class_stages(features: Sequence[str], label: str = "ftr", gaps: Sequence[str] | None = None) -> list:
    """What all classifiers share: the index of the label, then the preparation."""
    index = StringIndexer(inputCol=label, outputCol="label", handleInvalid="error", stringOrderType="alphabetAsc")
    return [index, *preparation(features, gaps)]


def class_pipeline(features: Sequence[str], family: str, label: str = "ftr", gaps: Sequence[str] | None = None, **params) -> Pipeline:
    return Pipeline(stages=[*class_stages(features, label, gaps), classifier(family, **params)])


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def fit_or_fallback(prepared: PipelineModel, ready: DataFrame, family: str) -> tuple[PipelineModel, str]:
    """Fit the family on prepared rows, or logistic regression where Spark ML rejects the data (as naive Bayes does with
    constant columns), and the family that was fitted."""
    try:
        return PipelineModel([*prepared.stages, classifier(family).fit(ready)]), family
    except PySparkException:
        return PipelineModel([*prepared.stages, classifier("logistic_regression").fit(ready)]), "logistic_regression"


def score(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predicted label and probabilities; constants .4/.3/.3 where there is no probability."""
    labels = model.stages[0].labels
    predicted = model.transform(rows)
    probs = vector_to_array("probability")
    named = F.array(*[F.lit(x) for x in labels])
    default = {"H": 0.4, "D": 0.3, "A": 0.3}
    return predicted.select(
        *keep, F.get(named, F.col("prediction").cast("int")).alias("predicted"),
        *[F.coalesce(F.get(probs, F.lit(i)), F.lit(default.get(x, 0.0))).alias(f"p_{x.lower()}") for i, x in enumerate(labels)],
    )


def regression_pipeline(features: Sequence[str], label: str, model, gaps: Sequence[str] | None = None) -> Pipeline:
    return Pipeline(stages=[*preparation(features, gaps), model.setParams(labelCol=label)])


def coefficients(model, features: Sequence[str]) -> DataFrame:
    """Feature and weight rows of a fitted linear model (as many rows as features)."""
    from pyspark.sql import SparkSession

    values = [(f, float(v)) for f, v in zip(features, model.coefficients)]
    return SparkSession.getActiveSession().createDataFrame(values, "feature string, weight double")


def recursive_elimination(ready: DataFrame, features: Sequence[str], label: str, keep: int, step: int, **params) -> dict[str, float]:
    """Drop the least important features of a forest until ``keep`` are left; these with their importance in the last fit.

    ``ready`` has the prepared vector ``features``: medians and scales of a feature do not depend on the others, so
    each fit takes its places of the one vector.
    """
    at, left = {f: k for k, f in enumerate(features)}, list(features)
    while True:
        some = VectorSlicer(inputCol="features", outputCol="_left", indices=[at[f] for f in left])
        model = regressor("random_forest", 0, featuresCol="_left", labelCol=label, **params).fit(some.transform(ready))
        found = model.featureImportances.toArray().tolist()
        if len(left) <= keep:
            return dict(zip(left, found, strict=True))
        order = sorted(range(len(left)), key=found.__getitem__)
        gone = {left[i] for i in order[: min(step, len(left) - keep)]}
        left = [f for f in left if f not in gone]


def shuffled(df: DataFrame, key: str, columns: Sequence[str], seed: int) -> DataFrame:
    """Replace the columns of each row by those of another row, a seeded permutation.

    Rows are numbered in two pseudo-random orders and matched by number; the numbering is cut by
    the leading bits of the hash, so no task sees all rows.
    """

    def order(salt: int, picked: Sequence[str]) -> DataFrame:
        h = F.xxhash64(F.col(key), F.lit(salt))
        cut = df.select(key, *picked).withColumn("_h", h).withColumn("_cell", F.shiftright("_h", 56))
        return totals_before(cut, [], ["_cell"], ["_h", key], {"_at": F.lit(1).cast("bigint")})

    rows = order(seed, []).select(key, "_at")
    values = order(seed + 1, columns).select("_at", *columns)
    return df.drop(*columns).join(rows.join(values, "_at").drop("_at"), key)


def rmse(model: PipelineModel, rows: DataFrame, label: str) -> float:
    return RegressionEvaluator(labelCol=label, metricName="rmse").evaluate(model.transform(rows))


def tuned(train: DataFrame, features: Sequence[str], label: str, grid: Mapping[str, Sequence[float]], gaps: Sequence[str] | None = None):
    """Search over a parameter grid with a held-out part of the training rows."""
    model = LinearRegression(labelCol=label, maxIter=20)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(model, name), list(values))
    search = TrainValidationSplit(
        estimator=model, estimatorParamMaps=builder.build(), trainRatio=0.8, seed=42, parallelism=4,
        evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"),
    )
    prepared = Pipeline(stages=preparation(features, gaps)).fit(train).transform(train).select("features", label)
    return search.fit(prepared)


def whitened_svm(features: str, k: int) -> Pipeline:
    """PCA to k components, whitening, one linear separator per class."""
    return Pipeline(stages=[
        PCA(k=k, inputCol=features, outputCol="_pca"),
        StandardScaler(inputCol="_pca", outputCol="features", withMean=True, withStd=True),
        OneVsRest(classifier=LinearSVC(maxIter=5), labelCol="label", featuresCol="features"),
    ])


def experiment_grid(seasons: DataFrame) -> DataFrame:
    """All configurations: trailing season windows x model x half-life.

    ``seasons`` has one row per season with its first date (``first``) and its match count; the windows nest, so the
    training rows of each come from one running sum. The latest first date is the current season, whatever the label.
    """
    from pyspark.sql import Window

    ranked = seasons.withColumn("age", F.row_number().over(Window.orderBy(F.desc("first"), F.desc("season"))))
    windows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("wanted")) for n, k in WINDOWS.items()])).alias("w")
    sized = ranked.select("season", "n", "age", windows).select("season", "n", "age", "w.*").filter("age <= wanted")
    per_window = sized.groupBy("name").agg(F.count("*").alias("seasons"), F.sum("n").alias("train_rows"))
    models = F.explode(F.array(*[F.lit(m) for m in ("logistic_regression_l2", "random_forest_regularized")])).alias("model")
    halves = F.expr("explode(CASE WHEN seasons >= 8 THEN array(0D, 1D, 2D, 4D, 8D) WHEN seasons >= 4 THEN array(0D, 1D, 2D, 4D) ELSE array(0D) END)")
    return per_window.select("name", "seasons", "train_rows", models).select("*", halves.alias("half_life")).select(
        F.concat_ws("_", "name", "model", F.when(F.col("half_life") > 0, F.concat(F.lit("recency_"), F.col("half_life").cast("int")))).alias("experiment"),
        "seasons", "train_rows", F.nullif("half_life", F.lit(0.0)).alias("half_life"),
    )


WINDOWS = {"current_only": 1, "last_2": 2, "last_4": 4, "last_6": 6, "last_8": 8, "last_10": 10, "last_12": 12, "all": 1000}
"""Fixed values: trailing season windows."""
