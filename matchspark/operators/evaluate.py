"""Evaluation tables over scored rows: metrics, curves, thresholds, selection records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.plans.quantiles import exact_quantiles, value_ranks


def confusion(scored: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Non-zero cells of the confusion matrix."""
    return scored.groupBy(*keys, actual, predicted).agg(F.count("*").alias("n"))


def class_metrics(scored: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Accuracy, weighted precision, recall and F1, balanced accuracy; from the confusion cells."""
    keys = list(keys)
    cells = confusion(scored, keys, actual, predicted)
    both = F.explode(F.array(
        F.struct(F.col(actual).alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
    )).alias("x")
    hit = F.when((F.col(actual) == F.col(predicted)) & (F.col("x.support") > 0), F.col("n")).otherwise(0)
    per_class = cells.select(*keys, both, F.col(actual), F.col(predicted), "n").select(
        *keys, F.col("x.label").alias("label"), "x.support", "x.said", hit.alias("hit")
    ).groupBy(*keys, "label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support"))
    precision = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("said") > 0, 2 * F.col("hit") / (F.col("support") + F.col("said"))).otherwise(0.0)
    weight = F.col("support") / F.sum("support").over(Window.partitionBy(*keys))
    weighted = per_class.select(*keys, "support", "hit", recall.alias("recall"), (weight * precision).alias("p"),
                                (weight * F.coalesce(recall, F.lit(0.0))).alias("r"), (weight * f1).alias("f"))
    return weighted.groupBy(*keys).agg(
        F.sum("support").alias("rows"), (F.sum("hit") / F.sum("support")).alias("accuracy"),
        F.sum("p").alias("precision_weighted"), F.sum("r").alias("recall_weighted"), F.sum("f").alias("f1_weighted"),
        F.avg("recall").alias("balanced_accuracy"),
    )


def log_loss(scored: DataFrame, keys: Sequence[str], p_true: Column) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(-F.ln(F.greatest(p_true, F.lit(1e-15)))).alias("log_loss"))


def roc_auc(scored: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Rank-sum AUC with ties counted half; NULL when only one class is present.

    Rows are counted per distinct score first; the running count of negatives is cut by score.
    """
    ranked = value_ranks(scored, keys, score, {"pos": F.col(label), "neg": 1 - F.col(label)})
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def roc_auc_ovr(scored: DataFrame, keys: Sequence[str], label: str, chances: Mapping[str, Column]) -> DataFrame:
    """One-vs-rest AUC of all classes, weighted by their share; NULL when a class is absent.

    ``chances`` has the probability of each class. Rows become one for each class, so all classes are ranked in one pass.
    """
    keys = list(keys)
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("_class"), p.alias("_p")) for c, p in chances.items()])).alias("c")
    long = scored.select(*keys, F.col(label).alias("_label"), classes).select(
        *keys, "c._class", "c._p", F.when(F.col("_label") == F.col("c._class"), 1).otherwise(0).alias("_y")
    )
    shares = long.groupBy(*keys, "_class").agg(F.avg("_y").alias("_share"))
    each = roc_auc(long, [*keys, "_class"], "_y", "_p").join(shares, [*keys, "_class"])
    all_there = F.count("roc_auc") == len(chances)
    return each.groupBy(*keys).agg(F.when(all_there, F.sum(F.col("roc_auc") * F.col("_share")) / F.sum("_share")).alias("roc_auc_ovr"))


THRESHOLDS = 91


def threshold_sweep(scored: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Balanced accuracy, weighted F1 and their mix at .05, .06, ... .95.

    Each row is put into the bucket of the highest threshold it reaches, so 92 counts per key
    and class replace a row-by-threshold product; the sweep is a running sum over buckets.
    """
    keys = list(keys)
    guess = F.floor((F.col(score) - 0.05) / 0.01).cast("int")

    def at(i: Column) -> Column:
        return F.lit(0.05) + i * F.lit(0.01)

    bucket = F.when(F.col(score) >= at(guess + 1), guess + 1).when(F.col(score) < at(guess), guess - 1).otherwise(guess)
    bucket = F.greatest(F.lit(-1), F.least(bucket, F.lit(THRESHOLDS - 1)))
    counted = scored.groupBy(*keys, bucket.alias("i")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    totals = counted.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    grid = totals.select(*keys, "all_pos", "all_neg", F.explode(F.sequence(F.lit(-1), F.lit(THRESHOLDS - 1))).alias("i"))
    filled = grid.join(counted, [*keys, "i"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = filled.select(*keys, "i", "all_pos", "all_neg", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"))
    return swept.filter("i >= 0").select(*keys, "i", at(F.col("i")).alias("threshold"), *binary_scores())


def binary_scores() -> list[Column]:
    """Balanced accuracy, weighted F1 and selection score from tp, fp, all_pos, all_neg."""
    tn, fn = "(all_neg - fp)", "(all_pos - tp)"
    balanced = f"(tp / nullif(all_pos, 0) + {tn} / nullif(all_neg, 0)) / 2"
    f1_pos = f"coalesce(2 * tp / nullif(2 * tp + fp + {fn}, 0), 0)"
    f1_neg = f"coalesce(2 * {tn} / nullif(2 * {tn} + fp + {fn}, 0), 0)"
    weighted = f"(all_pos * {f1_pos} + all_neg * {f1_neg}) / (all_pos + all_neg)"
    return [
        F.expr(f"{balanced} AS balanced"), F.expr(f"{weighted} AS f1"),
        F.expr(f"({balanced}) * 0.65D + ({weighted}) * 0.35D AS score"),
    ]


def best_threshold(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First threshold with the highest score."""
    best = F.max_by(F.struct("threshold", "score"), F.struct(F.round("score", 12), -F.col("i"))).alias("b")
    return sweep.groupBy(*keys).agg(best).select(*keys, "b.threshold", "b.score")


def selection_record(scored: DataFrame, keys: Sequence[str], label: str, score: str, cut: float = 0.5) -> DataFrame:
    """Selection score with penalties and notes for rare targets."""
    keys = list(keys)
    p, y = F.col(score), F.col(label)
    said = F.when(p >= cut, 1).otherwise(0)
    base = scored.groupBy(*keys).agg(
        F.count("*").alias("test_rows"), F.sum(y).alias("all_pos"), F.sum(1 - y).alias("all_neg"),
        F.sum(said * y).alias("tp"), F.sum(said * (1 - y)).alias("fp"),
        F.avg(F.pow(p - y, 2)).alias("brier_score"),
        F.avg(-F.ln(F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(1e-15)))).alias("log_loss"),
    )
    scores = base.select("*", *binary_scores()).join(roc_auc(scored, keys, label, score), keys)
    minority = F.least("all_pos", "all_neg")
    rows = scores.select(
        *keys, "test_rows", "brier_score", "log_loss", "roc_auc", F.col("balanced").alias("balanced_accuracy"),
        F.col("f1").alias("f1_weighted"), ((F.col("tp") + F.col("all_neg") - F.col("fp")) / F.col("test_rows")).alias("accuracy"),
        minority.alias("minority_count"), (minority / F.col("test_rows")).alias("minority_rate"),
        (1 - minority / F.col("test_rows")).alias("majority_rate"),
    )
    actionable = (F.col("minority_rate") >= 0.08) & (F.col("minority_count") >= 12)
    raw = F.expr("balanced_accuracy * 0.55D + coalesce(roc_auc, balanced_accuracy) * 0.30D + f1_weighted * 0.15D")
    delta = F.col("accuracy") - F.col("majority_rate")
    notes = F.array_join(F.array_compact(F.array(
        F.when(F.col("minority_rate") < 0.20, "imbalanced"), F.when(~actionable, "audit only"),
        F.when(delta <= 0, "no gain over majority"),
    )), "; ")
    return rows.withColumns({
        "baseline_delta": delta, "imbalance_flag": F.col("minority_rate") < 0.20, "actionable": actionable,
        "selection_metric": F.when(actionable, raw).otherwise(raw * 0.85), "notes": notes,
    })


def regression_metrics(rows: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """MSE, RMSE, MAE and R2; the total sum of squares uses the key's own mean."""
    e = F.col(actual) - F.col(predicted)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(F.var_pop(actual) > 0, 1 - F.avg(e * e) / F.var_pop(actual)).alias("r2"),
    )


def regression_record(rows: DataFrame, keys: Sequence[str], actual: str, predicted: str, is_test: str) -> DataFrame:
    """Test metrics against the MAE of the training median."""
    train, test = rows.filter(~F.col(is_test)), rows.filter(F.col(is_test))
    median = exact_quantiles(train, keys, actual, {"median": 0.5})
    base = test.join(median, list(keys)).groupBy(*keys).agg(F.avg(F.abs(F.col(actual) - F.col("median"))).alias("baseline_mae"))
    return (
        regression_metrics(test, keys, actual, predicted).join(base, list(keys))
        .withColumn("selection_metric", F.col("baseline_mae") - F.col("mae"))
    )


def stability(importance: DataFrame) -> DataFrame:
    """1 - min(std / (mean + 1e-10), 1) of each feature over its runs."""
    spread = F.stddev_pop("importance") / (F.avg("importance") + 1e-10)
    return importance.groupBy("feature").agg(
        F.avg("importance").alias("avg_importance"), (1 - F.least(spread, F.lit(1.0))).alias("stability")
    )


def stable_features(stable: DataFrame, min_stability: float = 0.5, min_importance: float = 0.01) -> DataFrame:
    return stable.filter((F.col("stability") >= min_stability) & (F.col("avg_importance") >= min_importance))


def consensus(votes: DataFrame, least: int = 3) -> DataFrame:
    """Features chosen by at least ``least`` methods."""
    return votes.groupBy("feature").agg(F.count_distinct("method").alias("votes")).filter(F.col("votes") >= least)


def best_experiment(rows: DataFrame, keys: Sequence[str], min_train: int = 500, min_valid: int = 100) -> DataFrame:
    """The experiment of each key with the smallest log loss, then the highest accuracy, then the first name.

    Only experiments with ``min_train`` training and ``min_valid`` validation rows compete, all of them where a key has none
    such (``restricted`` is false then). A NULL log loss loses against every other, NULL counts are too few.
    """
    enough = F.coalesce((F.col("train_rows") >= min_train) & (F.col("valid_rows") >= min_valid), F.lit(False))
    rank = F.struct(~enough, F.col("log_loss").isNull(), "log_loss", -F.col("accuracy"), "experiment")
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct("experiment", "train_rows", "valid_rows", "log_loss", enough.alias("restricted")), rank).alias("b"))
    return picked.select(*keys, "b.*")
