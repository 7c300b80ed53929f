"""Evaluation of the market's implied forecast as a model: its favourite is the prediction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchspark.operators import evaluate as E
from matchspark.operators.market import with_market
from matchspark.operators.team_view import team_view
from matchspark.queries.market_queries import MARKET_CTE
from matchspark.queries.registry import query, rounded
from matchspark.queries.sql_parts import TV, fx_sql, r
from matchspark.sources.fixtures import contests

SCORED_CTE = """sc0 AS (SELECT match_id, league, season, match_date, home_team, away_team, fthg, ftag, ftr AS actual,
  round(market_home_prob, 9) AS ph, round(market_draw_prob, 9) AS pd, round(market_away_prob, 9) AS pa,
  CASE WHEN ftr = 'H' THEN 1 ELSE 0 END AS y FROM mk),
sc AS (SELECT *, CASE WHEN ph >= pd AND ph >= pa THEN 'H' WHEN pa >= pd THEN 'A' ELSE 'D' END AS predicted FROM sc0)"""


def scored(spark, folder):
    df = with_market(contests(spark, folder)).select(
        "match_id", "league", "season", "match_date", "home_team", "away_team", "fthg", "ftag", F.col("ftr").alias("actual"),
        F.round("market_home_prob", 9).alias("ph"), F.round("market_draw_prob", 9).alias("pd"),
        F.round("market_away_prob", 9).alias("pa"), F.when(F.col("ftr") == "H", 1).otherwise(0).alias("y"),
    )
    h, d, a = F.col("ph"), F.col("pd"), F.col("pa")
    return df.withColumn("predicted", F.when((h >= d) & (h >= a), "H").when(a >= d, "A").otherwise("D"))


def sc_sql(body, *ctes):
    return fx_sql(body, MARKET_CTE, SCORED_CTE, *ctes)


@query("confusion_matrix", sc_sql("SELECT actual, predicted, count(*) AS n FROM sc GROUP BY ALL"))
def confusion_matrix(spark, folder):
    return E.confusion(scored(spark, folder), [], "actual", "predicted")


METRIC_CTE = """lab AS (SELECT * FROM (SELECT DISTINCT league, season FROM sc), (VALUES ('H'), ('D'), ('A')) v(label)),
per AS (SELECT l.league, l.season, l.label, count(*) FILTER (WHERE actual = label) AS sup,
  count(*) FILTER (WHERE predicted = label) AS said, count(*) FILTER (WHERE actual = label AND predicted = label) AS hit,
  count(*) AS n FROM lab l JOIN sc USING (league, season) GROUP BY ALL),
met AS (SELECT league, season, CAST(max(n) AS BIGINT) AS rows, sum(hit) / max(n) AS accuracy,
  sum(sup / n * CASE WHEN said > 0 THEN hit / said ELSE 0 END) AS precision_weighted,
  sum(sup / n * CASE WHEN sup > 0 THEN hit / sup ELSE 0 END) AS recall_weighted,
  sum(sup / n * CASE WHEN sup + said > 0 THEN 2 * hit / (sup + said) ELSE 0 END) AS f1_weighted,
  avg(CASE WHEN sup > 0 THEN hit / sup END) AS balanced_accuracy FROM per GROUP BY ALL)"""
METRICS = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "balanced_accuracy"]


@query("classification_metrics", sc_sql("SELECT league, season, rows, " + ", ".join(f"{r(m)} AS {m}" for m in METRICS) + " FROM met", METRIC_CTE))
def classification_metrics(spark, folder):
    return rounded(E.class_metrics(scored(spark, folder), ["league", "season"], "actual", "predicted"))


TRUE_P = "CASE actual WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END"


@query("log_loss", sc_sql(f"SELECT league, {r(f'avg(-ln(greatest({TRUE_P}, 1e-15)))')} AS log_loss FROM sc GROUP BY league"))
def log_loss(spark, folder):
    return rounded(E.log_loss(scored(spark, folder), ["league"], F.expr(TRUE_P)))


AUC_CTE = """auc AS (SELECT league, CASE WHEN sum(y) * sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2)
  / (sum(y) * sum(1 - y)) END AS roc_auc FROM (SELECT league, y, rank() OVER w + (count(*) OVER (PARTITION BY league, ph) - 1) / 2.0e0 AS rk
  FROM sc WINDOW w AS (PARTITION BY league ORDER BY ph)) GROUP BY league)"""


@query("roc_auc", sc_sql(f"SELECT league, {r('roc_auc')} AS roc_auc FROM auc", AUC_CTE))
def roc_auc(spark, folder):
    return rounded(E.roc_auc(scored(spark, folder), ["league"], "y", "ph"))


OVR_CTE = """rest AS (SELECT league, c, CASE WHEN actual = c THEN 1 ELSE 0 END AS y, CASE c WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END AS p
  FROM sc, (VALUES ('H'), ('D'), ('A')) v(c)),
ovr AS (SELECT league, c, avg(y) AS share, CASE WHEN sum(y) * sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN rk END)
  - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc FROM (SELECT league, c, y,
  rank() OVER w + (count(*) OVER (PARTITION BY league, c, p) - 1) / 2.0e0 AS rk FROM rest WINDOW w AS (PARTITION BY league, c ORDER BY p)) GROUP BY ALL)"""


@query("roc_auc_ovr", sc_sql(f"SELECT league, CASE WHEN count(auc) = 3 THEN {r('sum(auc * share) / sum(share)')} END AS roc_auc_ovr FROM ovr GROUP BY league", OVR_CTE))
def roc_auc_ovr(spark, folder):
    return rounded(E.roc_auc_ovr(scored(spark, folder), ["league"], "actual", {c: F.col(f"p{c.lower()}") for c in "HDA"}))


SWEEP_CTE = """sw0 AS (SELECT league, i, sum(y) AS ap, sum(1 - y) AS an, sum(CASE WHEN ph >= 0.05e0 + i * 0.01e0 THEN y ELSE 0 END) AS tp,
  sum(CASE WHEN ph >= 0.05e0 + i * 0.01e0 THEN 1 - y ELSE 0 END) AS fp FROM sc, range(91) t(i) GROUP BY league, i),
sw1 AS (SELECT league, i, (tp / ap + (an - fp) / an) / 2 AS balanced,
  (ap * COALESCE(2 * tp / NULLIF(2 * tp + fp + ap - tp, 0), 0)
   + an * COALESCE(2 * (an - fp) / NULLIF(2 * (an - fp) + fp + ap - tp, 0), 0)) / (ap + an) AS f1 FROM sw0),
sw AS (SELECT *, balanced * 0.65 + f1 * 0.35 AS score FROM sw1)"""


@query(
    "threshold_sweep",
    sc_sql(f"SELECT league, CAST(i AS INT) AS i, {r('balanced')} AS balanced, {r('f1')} AS f1, {r('score')} AS score FROM sw", SWEEP_CTE),
)
def threshold_sweep(spark, folder):
    return rounded(E.threshold_sweep(scored(spark, folder), ["league"], "y", "ph").drop("threshold"))


@query(
    "best_threshold",
    sc_sql(
        f"""SELECT league, {r('0.05e0 + i * 0.01e0')} AS threshold, {r('score')} AS score FROM (SELECT *, row_number() OVER (
        PARTITION BY league ORDER BY round(score, 12) DESC, i) AS rn FROM sw) WHERE rn = 1""",
        SWEEP_CTE,
    ),
)
def best_threshold(spark, folder):
    return rounded(E.best_threshold(E.threshold_sweep(scored(spark, folder), ["league"], "y", "ph"), ["league"]))


@query(
    "selection_record",
    sc_sql(
        f"""SELECT league, n AS test_rows, {r('brier')} AS brier_score, {r('ll')} AS log_loss, {r('roc_auc')} AS roc_auc,
        {r('balanced')} AS balanced_accuracy, {r('f1')} AS f1_weighted, {r('acc')} AS accuracy, CAST(mc AS BIGINT) AS minority_count,
        {r('mc / n')} AS minority_rate, {r('1 - mc / n')} AS majority_rate, {r('acc - (1 - mc / n)')} AS baseline_delta,
        mc / n < 0.2 AS imbalance_flag, mc / n >= 0.08 AND mc >= 12 AS actionable,
        {r('''(balanced * 0.55 + COALESCE(roc_auc, balanced) * 0.30 + f1 * 0.15)
          * CASE WHEN mc / n >= 0.08 AND mc >= 12 THEN 1 ELSE 0.85 END''')} AS selection_metric,
        concat_ws('; ', CASE WHEN mc / n < 0.2 THEN 'imbalanced' END,
          CASE WHEN NOT (mc / n >= 0.08 AND mc >= 12) THEN 'audit only' END,
          CASE WHEN acc - (1 - mc / n) <= 0 THEN 'no gain over majority' END) AS notes
        FROM (SELECT league, count(*) AS n, avg((ph - y) ** 2) AS brier,
          avg(-ln(greatest(CASE WHEN y = 1 THEN ph ELSE 1 - ph END, 1e-15))) AS ll,
          avg(CASE WHEN (ph >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS acc, least(sum(y), sum(1 - y)) AS mc FROM sc GROUP BY league)
        JOIN auc USING (league) JOIN (SELECT league, balanced, f1 FROM sw WHERE i = 45) USING (league)""",
        AUC_CTE, SWEEP_CTE,
    ),
)
def selection_record(spark, folder):
    return rounded(E.selection_record(scored(spark, folder), ["league"], "y", "ph"))


REG_CTE = """rg AS (SELECT *, 2 * ph + pd AS pred FROM sc)"""
REG = ["mse", "rmse", "mae", "r2"]
REG_SQL = """count(*) AS n, avg((fthg - pred) ** 2) AS mse, sqrt(avg((fthg - pred) ** 2)) AS rmse, avg(abs(fthg - pred)) AS mae,
  1 - avg((fthg - pred) ** 2) / var_pop(fthg) AS r2"""


def _goals(spark, folder):
    return scored(spark, folder).withColumn("pred", 2 * F.col("ph") + F.col("pd"))


@query("regression_metrics", sc_sql("SELECT season, n, " + ", ".join(f"{r(m)} AS {m}" for m in REG)
                                    + f" FROM (SELECT season, {REG_SQL} FROM rg GROUP BY season)", REG_CTE))
def regression_metrics(spark, folder):
    return rounded(E.regression_metrics(_goals(spark, folder), ["season"], "fthg", "pred"))


@query(
    "regression_record",
    sc_sql(
        "SELECT league, n, " + ", ".join(f"{r(m)} AS {m}" for m in REG) + f""", {r('bm')} AS baseline_mae, {r('bm - mae')} AS selection_metric
        FROM (SELECT league, {REG_SQL} FROM rg WHERE season >= '1999' GROUP BY league)
        JOIN (SELECT league, avg(abs(fthg - md)) AS bm FROM rg JOIN (SELECT league, median(fthg) AS md FROM rg
          WHERE season < '1999' GROUP BY league) USING (league) WHERE season >= '1999' GROUP BY league) USING (league)""",
        REG_CTE,
    ),
)
def regression_record(spark, folder):
    rows = _goals(spark, folder).withColumn("is_test", F.col("season") >= "1999")
    return rounded(E.regression_record(rows, ["league"], "fthg", "pred", "is_test"))


@query(
    "accuracy_by_team",
    sc_sql(
        """SELECT team, count(*) AS matches, CAST(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM (
        SELECT home_team AS team, actual, predicted FROM sc UNION ALL SELECT away_team, actual, predicted FROM sc) GROUP BY team"""
    ),
)
def accuracy_by_team(spark, folder):
    rows = scored(spark, folder).select(F.explode(F.array("home_team", "away_team")).alias("team"), "actual", "predicted")
    return rows.groupBy("team").agg(
        F.count("*").alias("matches"), F.count_if(F.col("actual") == F.col("predicted")).alias("correct")
    )


LEADER = f"""SELECT concat(league, '-', season) AS experiment, rows, {r('accuracy')} AS accuracy, {r('f1_weighted')} AS f1_weighted,
  {r('log_loss')} AS log_loss, accuracy - 0.4 > -0.02 AND rows >= 100 AS usable FROM met
  JOIN (SELECT league, season, avg(-ln(greatest({TRUE_P}, 1e-15))) AS log_loss FROM sc GROUP BY ALL) USING (league, season)"""


def experiments(spark, folder):
    rows = scored(spark, folder)
    keys = ["league", "season"]
    metrics = E.class_metrics(rows, keys, "actual", "predicted").join(E.log_loss(rows, keys, F.expr(TRUE_P)), keys)
    return rounded(metrics.select(
        F.concat_ws("-", *keys).alias("experiment"), "rows", "accuracy", "f1_weighted", "log_loss",
        ((F.col("accuracy") - 0.4 > -0.02) & (F.col("rows") >= 100)).alias("usable"),
    ))


@query("leaderboard", sc_sql(f"SELECT * FROM ({LEADER}) ORDER BY usable DESC, log_loss, experiment LIMIT 12", METRIC_CTE))
def leaderboard(spark, folder):
    return experiments(spark, folder).orderBy(F.desc("usable"), F.asc("log_loss"), "experiment").limit(12)


@query(
    "best_by_selection",
    sc_sql(
        f"""SELECT usable, arg_min(experiment, (log_loss, -accuracy, experiment)) AS best_log_loss,
        arg_max(experiment, (f1_weighted, accuracy, experiment)) AS best_f1 FROM ({LEADER}) GROUP BY usable""",
        METRIC_CTE,
    ),
)
def best_by_selection(spark, folder):
    return experiments(spark, folder).groupBy("usable").agg(
        F.min_by("experiment", F.struct("log_loss", (-F.col("accuracy")).alias("a"), "experiment")).alias("best_log_loss"),
        F.max_by("experiment", F.struct("f1_weighted", "accuracy", "experiment")).alias("best_f1"),
    )


@query(
    "best_restricted",
    sc_sql(
        f"""SELECT league, b.* FROM (SELECT league, arg_min({{'experiment': experiment, 'train_rows': train_rows, 'valid_rows': rows,
        'log_loss': log_loss, 'restricted': ok}}, (NOT ok, log_loss, -accuracy, experiment)) AS b FROM (SELECT *, train_rows >= 500 AND rows >= 100 AS ok
        FROM ({LEADER}) JOIN (SELECT league, concat(league, '-', season) AS experiment, CAST(coalesce(sum(count(*)) OVER (PARTITION BY league
        ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS train_rows FROM sc GROUP BY league, season)
        USING (experiment)) GROUP BY league)""",
        METRIC_CTE,
    ),
)
def best_restricted(spark, folder):
    """The best season of each league, of those with enough rows before it and in it."""
    sizes = scored(spark, folder).groupBy("league", "season").agg(F.count("*").alias("n"))
    before = Window.partitionBy("league").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    trained = sizes.select(
        "league", F.concat_ws("-", "league", "season").alias("experiment"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("train_rows")
    )
    rows = experiments(spark, folder).withColumnRenamed("rows", "valid_rows").join(trained, "experiment")
    return E.best_experiment(rows, ["league"])


@query(
    "promote_decision",
    sc_sql(
        f"""SELECT league, {r('champion')} AS champion_r2, {r('challenger')} AS challenger_r2,
        COALESCE(challenger, CAST('-inf' AS DOUBLE)) > COALESCE(champion, CAST('-inf' AS DOUBLE)) AS promote FROM (
        SELECT league, 1 - avg((fthg - p1) ** 2) / var_pop(fthg) AS champion,
          1 - avg((fthg - pred) ** 2) / var_pop(fthg) AS challenger
        FROM (SELECT *, 2 * ph AS p1 FROM rg) GROUP BY league)""",
        REG_CTE,
    ),
)
def promote_decision(spark, folder):
    rows = _goals(spark, folder).withColumn("p1", 2 * F.col("ph"))
    a = E.regression_metrics(rows, ["league"], "fthg", "p1").select("league", F.col("r2").alias("champion_r2"))
    b = E.regression_metrics(rows, ["league"], "fthg", "pred").select("league", F.col("r2").alias("challenger_r2"))
    none = F.lit(float("-inf"))
    better = F.coalesce("challenger_r2", none) > F.coalesce("champion_r2", none)
    return rounded(a.join(b, "league").withColumn("promote", better))


# ---------------------------------------------------------------- importance tables


FEATURES = ["shots", "sot", "corners", "yellows", "reds"]
IMP_CTE = "imp AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, season AS run, abs(corr({f}, gf)) AS importance FROM tv GROUP BY season" for f in FEATURES
) + ")"


def importance(spark, folder):
    """Absolute correlation with goals per feature and season, as importances over runs."""
    per_run = team_view(contests(spark, folder)).groupBy(F.col("season").alias("run")).agg(
        *[F.abs(F.corr(f, "gf")).alias(f) for f in FEATURES]
    )
    return per_run.unpivot("run", FEATURES, "feature", "importance")


def imp_sql(body, *ctes):
    return fx_sql(body, TV, IMP_CTE, *ctes)


STAB_CTE = """st AS (SELECT feature, avg(importance) AS avg_importance,
  1 - least(stddev_pop(importance) / (avg(importance) + 1e-10), 1.0) AS stability FROM imp GROUP BY feature)"""
STAB = f"SELECT feature, {r('avg_importance')} AS avg_importance, {r('stability')} AS stability FROM st"


@query("stability_score", imp_sql(STAB, STAB_CTE))
def stability_score(spark, folder):
    return rounded(E.stability(importance(spark, folder)))


@query("stable_features", imp_sql(STAB + " WHERE stability >= 0.5 AND avg_importance >= 0.01", STAB_CTE))
def stable_features(spark, folder):
    return rounded(E.stable_features(E.stability(importance(spark, folder))))


CATEGORY = {"shots": "attack", "sot": "attack", "corners": "attack", "yellows": "discipline", "reds": "discipline"}


@query(
    "importance_by_category",
    imp_sql(
        f"""SELECT category, {r('sum(avg_importance)')} AS importance, count(*) AS features FROM (SELECT *,
        CASE WHEN feature IN ('yellows', 'reds') THEN 'discipline' ELSE 'attack' END AS category FROM st) GROUP BY category""",
        STAB_CTE,
    ),
)
def importance_by_category(spark, folder):
    named = E.stability(importance(spark, folder)).replace(CATEGORY, subset=["feature"])
    return rounded(named.groupBy(F.col("feature").alias("category")).agg(
        F.sum("avg_importance").alias("importance"), F.count("*").alias("features")))


@query(
    "consensus_vote",
    imp_sql(
        """SELECT feature, count(*) AS votes FROM (SELECT feature, row_number() OVER (PARTITION BY run ORDER BY importance DESC, feature)
        AS rn FROM imp) WHERE rn <= 3 GROUP BY feature HAVING count(*) >= 3"""
    ),
)
def consensus_vote(spark, folder):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("importance"), "feature"))
    votes = importance(spark, folder).withColumn("rn", rank).filter("rn <= 3")
    return E.consensus(votes.select("feature", F.col("run").alias("method")))
