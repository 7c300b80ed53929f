"""Descriptive statistics: summaries, correlation, histograms, crosstabs, quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.functions import moments as P
from matchspark.operators.importance import ROWS, scales
from matchspark.plans.quantiles import exact_quantiles

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value) rows of the numeric columns, all as double."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns
    ])))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, mean, sample deviation, min, quartiles, max, one row per column."""
    long = long_form(df, columns)
    stats = long.groupBy("name").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return stats.join(exact_quantiles(long, ["name"], "value", QUARTILES), "name", "left")


FEW = 16
"""Up to so many columns the pairs are aggregates of one generated method; beyond, sums of products travel."""


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form, each pair over the rows that have both; NULL where one has no deviation there."""
    return _by_aggregates(df, columns) if len(columns) <= FEW else _by_products(df, columns)


def _by_aggregates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    flat = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{a}|{b}").alias("r"))
            for a, b in pairs for x, y in ({(a, b), (b, a)})]
    return flat.select(F.inline(F.array(*rows)))


def _by_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A task adds up six matrices of columns squared and sends a stripe for each column, so the columns share the reducing.

    Values are scaled by their mean and deviation first (one aggregate, two numbers a column come to the driver). NaN and
    infinite values count as missing.
    """
    clean = df.select(*[F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c) for c in columns])
    sums = clean.select(F.array(*columns).alias("x")).mapInArrow(P.pair_products(*scales(clean, columns)), ROWS)
    found = sums.repartition("fit").mapInArrow(P.pair_correlations, "place int, other int, r double")
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(F.get(names, F.col("place")).alias("a"), F.get(names, F.col("other")).alias("b"), "r")


def correlated_drop(matrix: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Of each pair above the threshold the column with the higher mean |r| (tie: the second)."""
    strength = matrix.groupBy("a").agg(F.avg(F.abs("r")).alias("mean_abs"))
    pairs = matrix.filter((F.col("a") < F.col("b")) & (F.abs("r") > threshold))
    first = strength.select(F.col("a"), F.col("mean_abs").alias("ma"))
    second = strength.select(F.col("a").alias("b"), F.col("mean_abs").alias("mb"))
    drop = F.when(F.round(F.col("ma"), 12) > F.round(F.col("mb"), 12), F.col("a")).otherwise(F.col("b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "r", drop.alias("dropped"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Equal bins between the smallest and largest value, the last bin closed; one value alone is bin 0."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = F.nullif((hi - lo) / bins, F.lit(0.0))
    place = F.when(width.isNull(), 0).otherwise(F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)))
    index = F.when(F.col(value).isNotNull(), place).cast("int")
    return df.groupBy(*keys, index.alias("bin")).agg(F.count("*").alias("n"))


def histogram_overlay(df: DataFrame, keys: Sequence[str], value: str, second: Column, bins: int = 30) -> DataFrame:
    """Two populations of each key in the same bins: counts and shares of the rows where ``second`` is false and true.

    Bins are equal, between the smallest and largest value of the key in both populations, the last one closed; a key with
    one value has bin 0 only. NULL and NaN values and rows of neither population are left out; the share of an
    empty population is NULL.
    """
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("_x"), second.alias("_second")).filter("_x IS NOT NULL AND NOT isnan(_x) AND _second IS NOT NULL")
    sides = {"first": ~F.col("_second"), "second": F.col("_second")}
    bounds = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), *[F.count_if(c).alias(f"_all_{n}") for n, c in sides.items()])
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    bounds = bounds.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    met = rows.join(bounds, same) if keys else rows.crossJoin(F.broadcast(bounds))
    counted = met.groupBy(*keys, place.cast("int").alias("bin"), *[f"_all_{n}" for n in sides]).agg(
        *[F.count_if(c).alias(f"n_{n}") for n, c in sides.items()]
    )
    shares = [(F.col(f"n_{n}") / F.nullif(F.col(f"_all_{n}"), F.lit(0))).alias(f"share_{n}") for n in sides]
    return counted.select(*keys, "bin", *[f"n_{n}" for n in sides], *shares)


def group_quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    bounds = df.groupBy(*keys).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    return bounds.join(exact_quantiles(df, keys, value, QUARTILES), list(keys))


def team_vs_league(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Mean of each team beside the mean of its league; both from per-team sums."""
    per_team = rows.groupBy("league", "team").agg(
        F.count("*").alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values], *[F.count(v).alias(f"_c_{v}") for v in values]
    )
    league = Window.partitionBy("league")
    return per_team.select(
        "league", "team", *[(F.col(f"_s_{v}") / F.col(f"_c_{v}")).alias(f"team_{v}") for v in values],
        *[(F.sum(f"_s_{v}").over(league) / F.sum(f"_c_{v}").over(league)).alias(f"league_{v}") for v in values],
    )
