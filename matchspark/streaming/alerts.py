"""Windowed alert rules. Each works on a batch frame and, with a watermark, on a stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.plans.quantiles import exact_quantiles


def _span(df: DataFrame, length: str, slide: str, late: str | None) -> DataFrame:
    df = df.withWatermark("ts", late) if df.isStreaming and late else df
    return df.withColumn("w", F.window("ts", length, slide))


def _flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *cols)


def rate_alert(df: DataFrame, length: str = "5 minutes", slide: str = "1 minute", late: str | None = "1 hour") -> DataFrame:
    """Windows with at least one failure."""
    failures = _span(df.filter(F.col("target") == "error"), length, slide, late)
    return _flat(failures.groupBy("w").agg(F.count("*").alias("failures")), "failures")


def p95_alert(df: DataFrame, limit: float, length: str = "1 hour", slide: str = "10 minutes", late: str | None = "1 hour") -> DataFrame:
    """Windows whose 95 % latency (the least value that 95 % of the rows do not exceed) is above the limit.

    Exact in batch, with no list of a window's values in one buffer; a stream keeps a summary whose rank is off by a ten
    thousandth of the window's rows at most.
    """
    spans = _span(df, length, slide, late)
    if df.isStreaming:
        found = spans.groupBy("w").agg(F.percentile_approx("predicted", 0.95).alias("p95"))
    else:
        found = exact_quantiles(spans.select("w", "predicted"), ["w"], "predicted", {"p95": 0.95}, interpolate=False)
    return _flat(found.filter(F.col("p95") > limit), "p95")


SMALLEST = 1e-6
"""Values up to this one share the lowest bucket of a sketch and count as zero."""


def p95_sketch(
    df: DataFrame, limit: float, length: str = "1 hour", slide: str = "10 minutes", late: str | None = "1 hour",
    error: float = 0.01,
) -> DataFrame:
    """``p95_alert`` from a histogram that merges: buckets grow by (1 + error) / (1 - error), so p95 is within ``error`` of itself.

    The state of a window is a count a bucket (1,732 buckets span 1e-6 to 1e9 at one hundredth), combined before the shuffle;
    a second aggregate over the closed windows walks the counts. NULLs do not count.
    """
    base = (1 + error) / (1 - error)
    bucket = F.when(F.col("predicted") > SMALLEST, F.ceil(F.log("predicted") / F.lit(math.log(base))))
    counts = _span(df.withColumn("bucket", bucket), length, slide, late).groupBy("w", "bucket").agg(F.count("predicted").alias("n"))
    lists = counts.groupBy("w").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts")
    )
    rank = F.ceil(F.col("total") * 0.95)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("bucket"))
    walked = F.aggregate(
        "counts", start,
        lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["seen"] < rank, x["bucket"]).otherwise(a["bucket"]).alias("bucket")),
    )
    middle = F.coalesce(2 * F.pow(F.lit(base), walked["bucket"]) / (base + 1), F.lit(0.0))
    return _flat(lists.withColumn("p95", middle).filter((F.col("total") > 0) & (F.col("p95") > limit)), "p95")


def error_ratio(df: DataFrame, limit: float, length: str = "1 hour", slide: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Windows whose share of errors is above the limit."""
    spans = _span(df, length, slide, late).groupBy("w").agg(
        F.count("*").alias("n"), F.count_if(F.col("target") == "error").alias("errors")
    )
    kept = spans.withColumn("ratio", F.col("errors") / F.col("n")).filter(F.col("ratio") > limit)
    return _flat(kept, "n", "errors", "ratio")


def sustained_breach(df: DataFrame, limit: float, hold: int) -> DataFrame:
    """Runs of consecutive hours in which the mean error of a target stays above the limit.

    Hours are aggregated first; the runs are found over that short table.
    """
    e = F.abs(F.col("predicted") - F.col("actual"))
    hours = df.groupBy("target", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg(e).alias("mean_error"))
    breach = hours.filter(F.col("mean_error") > limit)
    n = F.row_number().over(Window.partitionBy("target").orderBy("hour"))
    runs = breach.withColumn("run", F.unix_timestamp("hour") - n * 3600)
    return (
        runs.groupBy("target", "run").agg(F.min("hour").alias("from_hour"), F.count("*").alias("hours"))
        .filter(F.col("hours") >= hold).drop("run")
    )
