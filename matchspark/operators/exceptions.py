"""Row rules and match exceptions: split off, list, resolve, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ["postponed", "suspended", "cancelled", "scheduled", "completed"]
"""Fixed values: status domain of an exception."""


def of_team(df: DataFrame, team: str) -> DataFrame:
    return df.filter((F.col("home_team") == team) | (F.col("away_team") == team))


def in_range(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    return df.filter(F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def outliers(df: DataFrame, keys: list[str], value: str, sigmas: float = 3.0) -> DataFrame:
    """Rows further than ``sigmas`` population deviations from the mean of their key.

    Mean and deviation are aggregated per key first and joined back, so no key is gathered. A key without
    deviation has no outliers.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    far = F.abs((F.col(value) - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))) > sigmas
    return df.join(stats, keys).filter(far).drop("_mean", "_std")


def split_exceptions(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and exceptions: postponed matches and matches without a date."""
    postponed = F.col("status") == "postponed"
    odd = postponed | F.col("match_date").isNull()
    found = matches.filter(odd).select(
        "match_id", "home_team", "away_team", F.col("match_date").alias("original_date"),
        F.when(postponed, "postponed").otherwise("scheduled").alias("status"),
        F.when(postponed, "postponed").otherwise("no date").alias("reason"),
    )
    return matches.filter(~odd), found


def resolve(exceptions: DataFrame, updates: DataFrame) -> DataFrame:
    """Keyed update: new date and resolution; a new date makes the match scheduled again.

    Of several updates of one match the earliest dated counts.
    """
    first = updates.groupBy("match_id").agg(
        F.min_by(F.struct("new_date", "resolution"), F.coalesce("new_date", F.lit("9999-12-31").cast("date"))).alias("_u")
    )
    return exceptions.join(first, "match_id", "left").select(
        *[c for c in exceptions.columns if c not in {"status", "new_date", "resolution"}],
        F.col("_u.new_date").alias("new_date"),
        F.col("_u.resolution").alias("resolution"),
        F.when(F.col("_u.new_date").isNotNull(), "scheduled").otherwise(F.col("status")).alias("status"),
    )


def unresolved(exceptions: DataFrame) -> DataFrame:
    return exceptions.filter(F.coalesce("resolution", F.lit("")) == "")


def purge_resolved(exceptions: DataFrame) -> DataFrame:
    return unresolved(exceptions)


def summary(exceptions: DataFrame) -> DataFrame:
    """Count per status of the whole domain, zeros included, in one aggregation."""
    counted = exceptions.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    rows = [F.struct(F.lit(s).alias("status"), F.col(s).alias("exceptions")) for s in STATUSES]
    return counted.select(F.inline(F.array(*rows)))


def rule_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break each rule (SQL text of the breach), all rules in one pass."""
    counted = df.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in rules.items()])
    rows = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return counted.select(F.inline(F.array(*rows)))
