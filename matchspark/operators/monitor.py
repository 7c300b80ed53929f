"""Monitoring of predictions: accuracy in time, drift, trend, alerts.

Rows are (event_id, ts, target, predicted, actual); ``event_id`` follows time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.evaluate import regression_metrics
from matchspark.plans.prior import totals_before
from matchspark.plans.quantiles import exact_quantiles

EPS = 1e-6


def daily_mae(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("actual").isNotNull()).groupBy("target", F.to_date("ts").alias("day")).agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae")
    )


def latest(rows: DataFrame, keys: Sequence[str], n: int, order: str = "event_id") -> DataFrame:
    """Newest ``n`` rows per key; all but ``n`` per task are dropped before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def rolling_metric(rows: DataFrame, n: int) -> DataFrame:
    """Mean absolute error over the last n rows of a target, NULL until n rows are there.

    The window sum is a difference of running sums: of this row and of the row n places before,
    found by position, so a target is cut by day like any other key.
    """
    e = F.abs(F.col("predicted") - F.col("actual"))
    base = rows.select("event_id", "target", F.to_date("ts").alias("day"), e.alias("e"))
    placed = totals_before(base, ["target"], ["day"], ["event_id"], {"k": F.lit(1).cast("bigint"), "s": F.col("e").cast("decimal(28,9)")})
    now = placed.select("event_id", "target", (F.col("k") + 1).alias("k"), (F.col("s") + F.col("e").cast("decimal(28,9)")).alias("s"))
    then = placed.select("target", (F.col("k") + n).alias("k"), F.col("s").alias("s0"))
    joined = now.join(then, ["target", "k"], "left")
    return joined.select("event_id", "target", ((F.col("s") - F.col("s0")).cast("double") / n).alias("rolling_mae"))


def latency(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, p95 and p99 with linear interpolation."""
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return mean.join(exact_quantiles(rows, keys, value, {"p95": 0.95, "p99": 0.99}), list(keys))


def drift() -> Column:
    """Shift of mean (bm against hm) and deviation (bs against hs) in deviations of the history."""
    return F.expr(f"(abs(bm - hm) / (hs + {EPS}D) + abs(bs - hs) / (hs + {EPS}D)) / 2")


def drift_score(rows: DataFrame, window: int, batch: int) -> DataFrame:
    """Shift of mean and deviation of the newest batch against a window that contains it."""
    hist = latest(rows, ["target"], window)
    new = latest(rows, ["target"], batch)
    h = hist.groupBy("target").agg(F.avg("predicted").alias("hm"), F.stddev_pop("predicted").alias("hs"))
    b = new.groupBy("target").agg(F.avg("predicted").alias("bm"), F.stddev_pop("predicted").alias("bs"))
    return h.join(b, "target").select("target", drift().alias("drift_score"))


def ks_drift(rows: DataFrame, recent: int = 100) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of the newest rows against all earlier ones.

    The recent sample has at most ``recent`` steps, and between two of them the earlier sample
    only grows, so the distance is reached at a step or just before one. Earlier rows are counted
    between steps in one aggregation; nothing is sorted. A target without rows before the newest
    ``recent`` has nothing to compare and is left out.
    """
    new = latest(rows, ["target"], recent).select("target", "event_id", "predicted")
    steps = new.groupBy("target").agg(
        F.sort_array(F.collect_set("predicted")).alias("steps"), F.count("*").alias("n_new"),
        F.min("event_id").alias("from_id"),
    )
    old = rows.select("target", "event_id", "predicted").join(steps, "target").filter(
        F.col("event_id") < F.col("from_id")
    )
    # 2i = equal to step i, 2i - 1 = between step i - 1 and step i
    above = F.size(F.filter("steps", lambda s: s < F.col("predicted")))
    slot = F.when(F.array_contains("steps", F.col("predicted")), 2 * above).otherwise(2 * above - 1)
    old_counts = old.groupBy("target", slot.alias("slot")).agg(F.count("*").alias("n_old"))
    new_counts = new.join(steps, "target").groupBy(
        "target", (2 * (F.array_position("steps", F.col("predicted")) - 1)).cast("int").alias("slot")
    ).agg(F.count("*").alias("n"))
    both = old_counts.select("target", "slot", F.col("n_old").alias("o"), F.lit(0).cast("bigint").alias("c")).unionByName(
        new_counts.select("target", "slot", F.lit(0).cast("bigint").alias("o"), F.col("n").alias("c"))
    ).groupBy("target", "slot").agg(F.sum("o").alias("o"), F.sum("c").alias("c"))
    upto = Window.partitionBy("target").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("target")
    curves = both.select(
        "target", F.sum("o").over(whole).alias("n_old"), F.sum("c").over(whole).alias("n_new"),
        (F.sum("o").over(upto) / F.nullif(F.sum("o").over(whole), F.lit(0))).alias("f_old"),
        (F.sum("c").over(upto) / F.sum("c").over(whole)).alias("f_new"),
    ).filter(F.col("n_new") + F.col("n_old") > recent)
    d = curves.groupBy("target").agg(
        F.max("n_old").alias("n_old"), F.max("n_new").alias("n_new"), F.max(F.abs(F.col("f_old") - F.col("f_new"))).alias("ks_statistic")
    )
    return d.withColumn("p_value", ks_p_value(F.col("ks_statistic"), F.col("n_old"), F.col("n_new"))).withColumn(
        "drift_detected", F.col("p_value") < 0.05
    )


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value 2 * sum (-1)^(k-1) exp(-2 k^2 lambda^2), the standard large-sample series."""
    lam2 = F.pow(d, 2) * (n * m / (n + m))
    terms = [F.exp(lam2 * (-2.0 * k * k)) * (2.0 if k % 2 else -2.0) for k in range(1, 21)]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(terms[1:], terms[0])))


T975 = {
    1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 5: 2.570582, 6: 2.446912, 7: 2.364624, 8: 2.306004,
    9: 2.262157, 10: 2.228139,
}
"""Fixed values: 97.5 % points of Student's t up to 10 degrees of freedom."""


def t975(df: Column) -> Column:
    """97.5 % point of t: the table, beyond it the Cornish-Fisher series (error below 1e-4)."""
    z = 1.959963984540054
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
    ]
    df = F.nullif(df, F.lit(0))  # without degrees of freedom there is no band
    series = F.lit(z) + F.lit(terms[0]) / df + F.lit(terms[1]) / F.pow(df, 2) + F.lit(terms[2]) / F.pow(df, 3)
    out = series
    for k, v in T975.items():
        out = F.when(df == k, v).otherwise(out)
    return out


def trend(daily: DataFrame) -> DataFrame:
    """Least-squares line through the daily error: slope, direction, forecast with its band.

    A target has one row per calendar day here, so its line is a plain aggregation.
    """
    x = F.row_number().over(Window.partitionBy("target").orderBy("day")) - 1
    agg = daily.withColumn("x", x).groupBy("target").agg(
        F.count("*").alias("n"), F.regr_slope("mae", "x").alias("slope"), F.regr_intercept("mae", "x").alias("intercept"),
        F.regr_sxx("mae", "x").alias("sxx"), F.regr_syy("mae", "x").alias("syy"), F.regr_sxy("mae", "x").alias("sxy"),
        F.stddev_pop("mae").alias("std"), F.avg("x").alias("mx"), F.avg("mae").alias("my"),
    )
    enough = F.col("n") >= 2
    mse = F.when(F.col("n") > 2, F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2))
    ahead = F.col("intercept") + F.col("slope") * F.col("n")
    se = F.sqrt(mse * (1 + 1 / F.col("n") + F.pow(F.col("n") - F.col("mx"), 2) / F.nullif(F.col("sxx"), F.lit(0.0))))
    half = t975(F.col("n") - 2) * se
    slope = F.when(enough, F.col("slope")).otherwise(0.0)
    return agg.select(
        "target", "n", slope.alias("slope"),
        F.when(F.abs(slope) < 0.01, "stable").when(slope < 0, "improving").otherwise("declining").alias("direction"),
        F.when(enough, F.abs(slope) / (F.col("std") + EPS)).otherwise(0.0).alias("confidence"),
        F.when(enough, ahead).otherwise(F.col("my")).alias("next"),
        (ahead - half).alias("next_lower"), (ahead + half).alias("next_upper"),
    )


def trend_bands(daily: DataFrame) -> DataFrame:
    """Fitted value and 95 % band of every day."""
    x = F.row_number().over(Window.partitionBy("target").orderBy("day")) - 1
    points = daily.withColumn("x", x)
    agg = points.groupBy("target").agg(
        F.count("*").alias("n"), F.regr_slope("mae", "x").alias("slope"), F.regr_intercept("mae", "x").alias("intercept"),
        F.regr_sxx("mae", "x").alias("sxx"), F.regr_syy("mae", "x").alias("syy"), F.regr_sxy("mae", "x").alias("sxy"),
        F.avg("x").alias("mx"),
    ).filter("n > 2")
    mse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2)
    fitted = F.col("intercept") + F.col("slope") * F.col("x")
    half = t975(F.col("n") - 2) * F.sqrt(mse * (1 + 1 / F.col("n") + F.pow(F.col("x") - F.col("mx"), 2) / F.col("sxx")))
    return points.join(agg, "target").select(
        "target", "day", fitted.alias("fitted"), (fitted - half).alias("lower"), (fitted + half).alias("upper")
    )


def kendall_trend(daily: DataFrame) -> DataFrame:
    """Kendall tau-b between day order and value, normal p-value with tie correction.

    Discordant pairs are counted bit by bit: two values first differ at one bit of their dense
    rank; among values that agree above that bit, a one before a zero is an inversion. That takes
    one running count per bit instead of all pairs.
    """
    by_value = Window.partitionBy("target").orderBy("mae")
    by_day = Window.partitionBy("target").orderBy("day")
    ranked = daily.select(
        "target", F.row_number().over(by_day).alias("i"), (F.dense_rank().over(by_value) - 1).alias("v")
    )
    top = F.max("v").over(Window.partitionBy("target"))
    last_bit = F.floor(F.log2(F.greatest(top, F.lit(1)))).cast("int")
    bits = ranked.withColumn("_last", last_bit).select(
        "target", "i", "v", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("b")
    ).select(
        "target", "i", "b", F.expr("shiftright(v, b + 1)").alias("head"), F.expr("shiftright(v, b) & 1").alias("bit")
    )
    before = Window.partitionBy("target", "b", "head").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    swaps = bits.select(
        "target", F.when(F.col("bit") == 0, F.coalesce(F.sum("bit").over(before), F.lit(0))).otherwise(0).alias("d")
    ).groupBy("target").agg(F.sum("d").alias("discordant"))
    ties = ranked.groupBy("target", "v").agg(F.count("*").alias("t")).groupBy("target").agg(
        F.sum("t").alias("n"), F.sum(F.expr("t * (t - 1) div 2")).alias("tied"),
        F.sum(F.expr("t * (t - 1) * (2 * t + 5)")).alias("tie_var"),
    )
    joined = swaps.join(ties, "target")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = pairs - F.col("tied") - 2 * F.col("discordant")
    tau = F.when(pairs > F.col("tied"), s / F.sqrt(pairs * (pairs - F.col("tied"))))
    var = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("tie_var")) / 18
    p = F.when(var > 0, two_sided_normal(F.abs(s) / F.sqrt(var)))
    return joined.select("target", "n", tau.alias("tau"), p.alias("p_value"), (p < 0.05).alias("is_significant"))


def two_sided_normal(z: Column) -> Column:
    """2 * (1 - Phi(z)) for z >= 0 by Abramowitz and Stegun 7.1.26, error below 2e-7."""
    x = z / math.sqrt(2.0)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def interval_accuracy(rows: DataFrame, keys: Sequence[str], margin: float) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    inside = F.col("actual").between(F.col("predicted") * (1 - margin), F.col("predicted") * (1 + margin))
    return rows.filter(F.col("actual").isNotNull()).groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(inside, 1).otherwise(0)).alias("within_interval"),
        F.count("*").alias("sample_size"),
    )


def ab_evaluate(rows: DataFrame, arm: Column, minimum: int = 1000) -> DataFrame:
    """Mean metrics of both arms side by side; no verdict below the minimum per arm."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    hit = F.when(e <= 10, 1.0).otherwise(0.0)
    means = rows.groupBy(arm.alias("arm")).agg(F.count("*").alias("n"), F.avg(1 / (1 + e)).alias("closeness"), F.avg(hit).alias("hit"))
    flat = means.agg(*[
        F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in ("champion", "challenger") for c in ("n", "closeness", "hit")
    ])
    enough = (F.col("champion_n") >= minimum) & (F.col("challenger_n") >= minimum)
    better = F.expr("(challenger_closeness + challenger_hit) / 2 > (champion_closeness + champion_hit) / 2")
    return flat.withColumn("challenger_is_better", F.when(enough, better))


def alerts(rows: DataFrame, rmse_limit: float, drift_limit: float, window: int, batch: int) -> DataFrame:
    """One row per target and broken limit."""
    perf = regression_metrics(latest(rows, ["target"], window), ["target"], "actual", "predicted").select(
        F.lit("performance").alias("type"), "target", F.col("rmse").alias("value"), F.lit(rmse_limit).alias("threshold")
    )
    drift = drift_score(rows, window, batch).select(
        F.lit("drift").alias("type"), "target", F.col("drift_score").alias("value"), F.lit(drift_limit).alias("threshold")
    )
    return perf.unionByName(drift).filter(F.col("value") > F.col("threshold"))


def report(rows: DataFrame, window: int, batch: int) -> DataFrame:
    """Performance, drift and error statistics per target."""
    recent = latest(rows, ["target"], window)
    e = F.abs(F.col("predicted") - F.col("actual"))
    stats = recent.groupBy("target").agg(
        F.avg("predicted").alias("prediction_mean"), F.stddev_pop("predicted").alias("prediction_std"),
        F.avg("actual").alias("actual_mean"), F.avg(e).alias("error_mean"), F.stddev_pop(e).alias("error_std"),
    )
    return regression_metrics(recent, ["target"], "actual", "predicted").join(stats, "target").join(
        drift_score(rows, window, batch), "target"
    )
