"""Team dimension and joins on it: chain of statistics, two roles, event children, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.sources.tables import table


def team_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row per team from five tables, unmatched statistics NULL.

    Each side is aggregated to one row per team before the join; whether such a side is
    broadcast is left to the size Spark measures at run time.
    """
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("team"), "n_regionkey")
    customers = table(spark, folder, "customer").withColumnRenamed("c_nationkey", "k")
    suppliers = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "k")
    parts = [
        customers.groupBy("k").agg(F.count("*").alias("played")),
        customers.groupBy("k").agg(F.avg("c_acctbal").alias("attack")),
        customers.filter("c_acctbal > 5000").groupBy("k").agg(F.count("*").alias("shots")),
        suppliers.groupBy("k").agg(F.count("*").alias("passes")),
        suppliers.filter("s_acctbal < 0").groupBy("k").agg(F.min("s_acctbal").alias("defence")),
    ]
    return reduce(lambda left, right: left.join(right, "k", "left"), parts, nation).drop("k", "n_regionkey")


def two_roles(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Own and opponent statistics beside each team-view row."""
    values = [c for c in stats.columns if c != "team"]
    own = stats.select("team", *[F.col(c).alias(f"{c}_tm") for c in values])
    other = stats.select(F.col("team").alias("opponent"), *[F.col(c).alias(f"{c}_opp") for c in values])
    return rows.join(own, "team", "left").join(other, "opponent", "left")


def with_event_counts(rows: DataFrame, children: DataFrame) -> DataFrame:
    """Counts of child events of each (match, team) row, 0 where there are none."""
    counted = children.groupBy("match_id", "is_home").agg(
        F.count_if(F.col("card") == "Yellow").alias("yellow_events"),
        F.count_if(F.col("card") == "Second").alias("second_events"),
    )
    return rows.join(counted, ["match_id", "is_home"], "left").fillna(0, ["yellow_events", "second_events"])


def referee_profile(matches: DataFrame) -> DataFrame:
    """Cards of each referee over all matches: mean, sample deviation, mean of reds."""
    cards = F.col("hy") + F.col("ay")
    return matches.groupBy("referee").agg(
        F.avg(cards).alias("avg_cards"), F.stddev_samp(cards).alias("std_cards"),
        F.avg(F.col("hr") + F.col("ar")).alias("avg_reds"),
    )


def home_away_split(rows: DataFrame) -> DataFrame:
    """Mean goals of each team at home and away over all its rows."""
    return rows.groupBy("team").agg(
        F.avg(F.when(F.col("is_home") == 1, F.col("gf"))).alias("goals_home"),
        F.avg(F.when(F.col("is_home") == 0, F.col("gf"))).alias("goals_away"),
    )
