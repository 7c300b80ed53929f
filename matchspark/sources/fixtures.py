"""Match facts derived from the order tables: one row per order that has a line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.session import scratch_dir
from matchspark.sources.tables import table

ORDER_KEY = ["match_date", "home_team", "away_team", "match_id"]
"""Total order of matches inside a league."""


def derive_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Home side = nation of the customer, away side = nation of the first line's supplier.

    The first line of an order is a ``min`` over a struct, so lines shrink to one per order
    before the shuffle; the suppliers are joined after that.
    """
    first_line = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min(
                F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
            ).alias("line")
        )
        .select("l_orderkey", "line.*")
    )
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.trim("n_name").alias("home_team"))
    away = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.trim("n_name").alias("away_team"))
    joined = (
        table(spark, folder, "orders")
        .join(first_line, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(home, "c_nationkey")
        .join(away, "s_nationkey")
    )
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("o_orderkey")
    hg = (F.col("l_quantity").cast("int") % 5).cast("int")
    ag = (part % 4).cast("int")

    def tenths(base: int, key, span: int):
        return (F.lit(base) + key % span) / F.lit(10.0)

    return joined.select(
        order.alias("match_id"),
        F.col("c_mktsegment").alias("league"),
        F.year("o_orderdate").cast("string").alias("season"),
        F.to_date("o_orderdate").alias("match_date"),
        "home_team",
        "away_team",
        hg.alias("fthg"),
        ag.alias("ftag"),
        F.when(hg > ag, "H").when(hg == ag, "D").otherwise("A").alias("ftr"),
        F.when(F.col("l_linenumber") != 7, (8 + part % 9).cast("int")).alias("hs"),
        (6 + supp % 9).cast("int").alias("as_"),
        (4 + part % 5).cast("int").alias("hst"),
        (3 + supp % 5).cast("int").alias("ast"),
        (part % 11).cast("int").alias("hc"),
        (supp % 9).cast("int").alias("ac"),
        (part % 6).cast("int").alias("hy"),
        (supp % 5).cast("int").alias("ay"),
        F.when(part % 13 == 0, 1).otherwise(0).alias("hr"),
        F.when(supp % 17 == 0, 1).otherwise(0).alias("ar"),
        F.when(part % 10 != 0, tenths(12, part, 40)).alias("b1_h"),
        tenths(30, supp, 20).alias("b1_d"),
        tenths(15, order, 45).alias("b1_a"),
        F.when(order % 7 == 0, F.lit(1.0)).otherwise(tenths(13, part, 40)).alias("b2_h"),
        tenths(29, supp, 20).alias("b2_d"),
        tenths(16, order, 45).alias("b2_a"),
        tenths(14, part, 20).alias("ou_over"),
        tenths(14, supp, 20).alias("ou_under"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "scheduled")
        .otherwise("postponed")
        .alias("status"),
        F.concat(F.lit("REF_"), (supp % 12).cast("string")).alias("referee"),
    )


_WRITTEN: dict[tuple[str, str], str] = {}


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Match facts, written once per session to the shared scratch folder and read back.

    Every feature job starts from this table, so the joins behind it run once and a lost
    executor costs a re-read, not a re-join.
    """
    key = (spark.sparkContext.applicationId, folder)
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_dir(spark, "fixtures", folder.strip("/").replace("/", "-"))
        derive_fixtures(spark, folder).write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def contests(spark: SparkSession, folder: str) -> DataFrame:
    """Fixtures between two different sides; a side cannot meet itself."""
    return fixtures(spark, folder).filter(F.col("home_team") != F.col("away_team"))
