"""Model fits over the written feature table. Fits have no SQL twin; their tables of rows do."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from matchspark.operators import evaluate as E
from matchspark.operators import experiments as X
from matchspark.operators import labels as L
from matchspark.operators import models as M
from matchspark.operators import ratings as R
from matchspark.operators import splits as S
from matchspark.operators import windows as W
from matchspark.queries.registry import query, rounded
from matchspark.queries.source_queries import fresh
from matchspark.queries.sql_parts import fx_sql
from matchspark.session import CLEANED, scratch_dir, settings
from matchspark.sources.fixtures import contests
from matchspark.sources.tables import table

FEATURES = R.feature_columns()
TREES = {"numTrees": 20, "maxDepth": 5}
"""Forests of the recursive elimination."""
_WRITTEN: dict[tuple[str, str], str] = {}


def feature_table(spark, folder):
    """The assembled feature rows; what they follow from is written once per session, not cut by season, for which all wide
    rows would be sorted."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _WRITTEN:
        path = scratch_dir(spark, "features", folder.strip("/").replace("/", "-"))
        matches = contests(spark, folder)
        dealt = W.OF_DAY if R.one_day_ids(matches) else ()
        with settings(spark, {**R.CO_LOCATED, **CLEANED}):
            R.feature_parts(matches, dealt).write.mode("overwrite").option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    df = R.from_parts(spark.read.parquet(_WRITTEN[key]))
    return L.recency_weights(M.as_double(df, FEATURES), 4.0).withColumnRenamed("recency_weight", "weight")


_GAPS: dict[tuple[str, str], list[str]] = {}


def feature_gaps(spark, folder):
    """Features that miss a value somewhere in the table, found once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _GAPS:
        _GAPS[key] = M.gapped(feature_table(spark, folder), FEATURES)
    return _GAPS[key]


def stored(spark, df):
    """Rows that several fits read, in the shared folder instead of memory."""
    path = fresh(spark, "fit-rows")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def prepared(spark, train, stages, *keep):
    """The fitted preparation, and the training rows with its vectors, made once for all fits of a query."""
    model = Pipeline(stages=stages).fit(train)
    return model, stored(spark, model.transform(train).select("features", *keep))


def parts(spark, folder):
    df = feature_table(spark, folder)
    return df.filter("match_date < DATE '2000-01-01'"), df.filter("match_date >= DATE '2000-01-01'")


@query(
    "experiment_grid",
    fx_sql(
        """SELECT concat_ws('_', name, model, CASE WHEN h > 0 THEN concat('recency_', CAST(h AS INT)) END) AS experiment,
        seasons, train_rows, NULLIF(h, 0.0e0) AS half_life FROM (
        SELECT name, count(*) AS seasons, CAST(sum(n) AS BIGINT) AS train_rows FROM (SELECT season, count(*) AS n,
          row_number() OVER (ORDER BY season DESC) AS age FROM m GROUP BY season),
          (VALUES ('current_only', 1), ('last_2', 2), ('last_4', 4), ('last_6', 6), ('last_8', 8), ('last_10', 10), ('last_12', 12),
           ('all', 1000)) v(name, k) WHERE age <= k GROUP BY name),
        (VALUES ('logistic_regression_l2'), ('random_forest_regularized')) mv(model),
        (VALUES (0.0e0), (1.0e0), (2.0e0), (4.0e0), (8.0e0)) hv(h) WHERE h = 0 OR (seasons >= 4 AND h < 8) OR seasons >= 8"""
    ),
)
def experiment_grid(spark, folder):
    return M.experiment_grid(contests(spark, folder).groupBy("season").agg(F.count("*").alias("n"), F.min("match_date").alias("first")))


@query("experiment_results")
def experiment_results(spark, folder):
    """Every configuration of the grid, fitted on all features and measured on the current season."""
    matches, columns = contests(spark, folder), R.feature_columns()
    seasons = X.in_order(matches)
    rows = X.marked(M.as_double(feature_table(spark, folder), columns).drop("weight"), matches, seasons[-1])
    found = X.run(rows, columns, X.configurations(seasons), fresh(spark, "experiments"), parallel=8)
    return rounded(found)


def _fit_table(spark, folder, families):
    train, test = parts(spark, folder)
    model, ready = prepared(spark, train, M.class_stages(FEATURES, gaps=feature_gaps(spark, folder)), "label", "weight")
    out = []
    for family in families:
        fit, fitted = M.fit_or_fallback(model, ready, family)
        rows = M.score(fit, test, ["match_id", "ftr"])
        metrics = E.class_metrics(rows, [], "ftr", "predicted")
        loss = E.log_loss(rows, [], F.expr("CASE ftr WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END"))
        out.append(metrics.withColumn("log_loss", loss.scalar()).withColumn("model", F.lit(fitted)))
    return rounded(reduce(lambda a, b: a.unionByName(b), out))


@query("fit_pipeline")
def fit_pipeline(spark, folder):
    return _fit_table(spark, folder, ["logistic_regression", "random_forest", "decision_tree"])


@query("fit_nb")
def fit_nb(spark, folder):
    return _fit_table(spark, folder, ["naive_bayes"])


@query("batch_score")
def batch_score(spark, folder):
    train, test = parts(spark, folder)
    model = M.class_pipeline(FEATURES, "logistic_regression", gaps=feature_gaps(spark, folder)).fit(train)
    rows = M.score(model, test, ["match_id", "match_date", "home_team", "away_team", "ftr"])
    return rounded(rows.withColumn("correct", F.col("ftr") == F.col("predicted")))


@query("model_roundtrip")
def model_roundtrip(spark, folder):
    train, test = parts(spark, folder)
    model = M.class_pipeline(FEATURES, "decision_tree", gaps=feature_gaps(spark, folder)).fit(train)
    path = fresh(spark, "model")
    model.write().overwrite().save(path)
    again = M.score(PipelineModel.load(path), test, ["match_id"]).withColumnRenamed("predicted", "loaded")
    both = M.score(model, test, ["match_id"]).select("match_id", "predicted").join(again.select("match_id", "loaded"), "match_id")
    return both.groupBy((F.col("predicted") == F.col("loaded")).alias("same")).agg(F.count("*").alias("rows"))


@query("fit_regressors")
def fit_regressors(spark, folder):
    train, test = parts(spark, folder)
    stages = M.preparation(FEATURES, feature_gaps(spark, folder))
    model, ready = prepared(spark, M.as_double(train, ["fthg"]), stages, "fthg")
    ahead = stored(spark, model.transform(test).select("features", "fthg"))
    n = ready.count()
    out = []
    for family in ("linear", "ridge", "lasso", "boosted_trees", "random_forest"):
        rows = M.regressor(family, n, labelCol="fthg").fit(ready).transform(ahead).select("fthg", "prediction")
        out.append(E.regression_metrics(rows, [], "fthg", "prediction").withColumn("model", F.lit(family)))
    return rounded(reduce(lambda a, b: a.unionByName(b), out))


@query("feature_select")
def feature_select(spark, folder):
    """Features chosen by lasso, ridge, L1 logistic regression and recursive elimination."""
    train = M.as_double(parts(spark, folder)[0], ["fthg"]).withColumn("y", F.when(F.col("ftr") == "H", 1.0).otherwise(0.0))
    _, ready = prepared(spark, train, M.preparation(FEATURES, feature_gaps(spark, folder)), "fthg", "y", "weight")
    n = ready.count()

    def linear(family):
        return M.coefficients(M.regressor(family, n, labelCol="fthg").fit(ready), FEATURES)

    ridge = linear("ridge")
    spread = ridge.agg(F.stddev_pop("weight")).scalar()
    l1 = M.LogisticRegression(maxIter=30, regParam=0.01, elasticNetParam=1.0, weightCol="weight", labelCol="y")
    logistic = M.coefficients(l1.fit(ready), FEATURES)
    lasso = linear("lasso")
    kept = M.recursive_elimination(ready, FEATURES, "fthg", len(FEATURES) // 2, 12, **TREES)
    eliminated = spark.createDataFrame(list(kept.items()), "feature string, weight double")
    chosen = [
        lasso.filter(F.abs("weight") > 1e-5).withColumn("method", F.lit("lasso")),
        ridge.filter(F.abs("weight") > 0.1 * spread).withColumn("method", F.lit("ridge")),
        logistic.filter("weight <> 0").withColumn("method", F.lit("l1_logistic")),
        eliminated.withColumn("method", F.lit("elimination")),
    ]
    return rounded(reduce(lambda a, b: a.unionByName(b), chosen))


@query("cv_metrics")
def cv_metrics(spark, folder):
    """Five expanding time-series folds: fit on the blocks before, measure on the block."""
    df = M.as_double(feature_table(spark, folder), ["fthg"])
    rows = S.with_ts_fold(df, S.ts_fold_starts(contests(spark, folder), 5))
    rows, stages = M.assembled(rows, FEATURES, feature_gaps(spark, folder), "fthg", "fold")
    rows = stored(spark, rows)
    out = []
    for k in range(1, 6):
        model = Pipeline(stages=[*stages, M.regressor("linear", 0, labelCol="fthg")]).fit(rows.filter(F.col("fold") < k))
        said = model.transform(rows.filter(F.col("fold") == k)).select("fthg", "prediction")
        metrics = E.regression_metrics(said, [], "fthg", "prediction").withColumn("r2", F.greatest("r2", F.lit(0.0)))
        out.append(metrics.withColumn("fold", F.lit(k)))
    return rounded(reduce(lambda a, b: a.unionByName(b), out))


@query("tune")
def tune(spark, folder):
    train = M.as_double(parts(spark, folder)[0], ["fthg"])
    found = M.tuned(train, FEATURES, "fthg", {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 1.0]}, feature_gaps(spark, folder))
    rows = [(str({p.name: v for p, v in m.items()}), float(x)) for m, x in zip(found.getEstimatorParamMaps(), found.validationMetrics)]
    return rounded(spark.createDataFrame(rows, "params string, rmse double"))


@query("pca_project")
def pca_project(spark, folder):
    """Whitened projection of the embeddings and a linear separator per label."""
    df = table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("raw")
    )
    scored = M.whitened_svm("raw", 8).fit(df).transform(df)
    return scored.groupBy("label").agg(F.count("*").alias("rows"), F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"))
