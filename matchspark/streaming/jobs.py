"""Streams over landed files: each call handles what is new since the checkpoint, then stops.

Keyed state lives in small versioned tables in the shared folder. A micro-batch is reduced with
ordinary DataFrame operators (which split hot keys) before it meets the state, the new version
is written under the batch id, and a repeated batch overwrites its own version only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchspark.functions.elo import rate_with_state
from matchspark.operators.evaluate import regression_metrics
from matchspark.operators.monitor import drift, latest


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None,
                  sink: str | None = None) -> None:
    """Process everything that is there, then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if handle is not None:
        writer = writer.foreachBatch(handle)
    else:
        writer = writer.format("parquet").outputMode("append").option("path", sink)
    writer.start().awaitTermination()


def read_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def incremental_refresh(spark: SparkSession, source: str, schema: StructType, checkpoint: str, sink: str) -> None:
    """Append each event once, however late it comes.

    A micro-batch is checked against the rows landed before it, of its own days only (the sink
    is partitioned by day), so nothing is dropped as late and the state does not grow.
    """
    day = F.to_date("ts").alias("day")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("*", day).dropDuplicates(["event_id"])
        if batch_id > 0:
            landed = batch.sparkSession.read.schema(LANDED).parquet(sink).filter(F.col("batch") < batch_id)
            landed = landed.join(F.broadcast(rows.select("day").distinct()), "day", "left_semi")  # prunes the folders of other days
            rows = rows.join(landed.select("day", "event_id"), ["day", "event_id"], "left_anti")
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{sink}/batch={batch_id}")

    run_available(read_stream(spark, source, schema), checkpoint, handle)


LANDED = "event_id bigint, ts timestamp, user_id bigint, target string, predicted double, actual double, batch int, day date"


def state_version(root: str, batch_id: int) -> str:
    return f"{root}/v={batch_id:012d}"


def previous_state(spark: SparkSession, root: str, batch_id: int, schema: StructType | str) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(state_version(root, batch_id - 1))


BATCH = """target string, batch_rows bigint, late_rows bigint, n bigint, mse double, rmse double, mae double, r2 double,
drift_score double, batch int"""


def batch_metrics(rows: DataFrame, before: DataFrame, now: DataFrame, late: str) -> DataFrame:
    """A row for each target of a batch: errors over the newest pairs, drift of the batch against them, late rows.

    A row is late if it is older by ``late`` than the newest pair of its target before the batch; it still counts.
    """
    own = rows.groupBy("target").agg(F.count("*").alias("batch_rows"), F.avg("predicted").alias("bm"), F.stddev_pop("predicted").alias("bs"))
    seen = before.groupBy("target").agg(F.max("ts").alias("seen"))
    behind = rows.join(seen, "target").filter(F.col("ts") < F.col("seen") - F.expr(f"INTERVAL {late}"))
    window = now.groupBy("target").agg(F.avg("predicted").alias("hm"), F.stddev_pop("predicted").alias("hs"))
    joined = own.join(behind.groupBy("target").agg(F.count("*").alias("late_rows")), "target", "left").join(window, "target")
    return joined.join(regression_metrics(now, ["target"], "actual", "predicted"), "target").select(
        "target", "batch_rows", F.coalesce("late_rows", F.lit(0)).alias("late_rows"), "n", "mse", "rmse", "mae", "r2", drift().alias("drift_score")
    )


def monitor_stream(
    spark: SparkSession, source: str, schema: StructType, checkpoint: str, state: str, window: int, metrics: str | None = None,
    late: str = "1 HOUR",
) -> None:
    """Keep the newest ``window`` pairs of each target; with a folder for them, the metrics of each batch too."""
    kept = ["event_id", "ts", "target", "predicted", "actual"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*kept)
        old = previous_state(batch.sparkSession, state, batch_id, rows.schema)
        newest = latest(latest(rows, ["target"], window).unionByName(old), ["target"], window)
        newest.write.mode("overwrite").parquet(state_version(state, batch_id))
        if metrics is not None:
            now = batch.sparkSession.read.schema(rows.schema).parquet(state_version(state, batch_id))
            batch_metrics(rows, old, now, late).write.mode("overwrite").parquet(f"{metrics}/batch={batch_id}")

    run_available(read_stream(spark, source, schema), checkpoint, handle)


RATING = "league string, team string, rating double"
CHAIN = ("league string, kind int, match_id bigint, home_team string, away_team string, home_elo double, away_elo double")


def elo_stream(spark: SparkSession, source: str, schema: StructType, checkpoint: str, state: str, sink: str) -> None:
    """Online Elo: ratings so far enter each league's chain as its first rows and leave as its last."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        old = previous_state(batch.sparkSession, state, batch_id, RATING).select(
            "league", F.lit(0).alias("kind"), F.lit(None).cast("date").alias("match_date"), F.col("team").alias("home_team"),
            F.lit("").alias("away_team"), F.lit(None).cast("bigint").alias("match_id"), F.lit(0).alias("fthg"), F.lit(0).alias("ftag"), "rating",
        )
        games = batch.select(
            "league", F.lit(1).alias("kind"), "match_date", "home_team", "away_team", "match_id", "fthg", "ftag",
            F.lit(None).cast("double").alias("rating"),
        )
        order = ["league", "kind", "match_date", "home_team", "away_team", "match_id"]
        chain = old.unionByName(games).repartition("league").sortWithinPartitions(*order)
        target = f"{sink}/v={batch_id:012d}"
        rated = chain.drop("match_date").mapInPandas(rate_with_state, CHAIN)
        rated.write.mode("overwrite").partitionBy("kind").parquet(target)
        done = batch.sparkSession.read.schema(CHAIN).parquet(target)
        ratings = done.filter("kind = 0").select("league", F.col("home_team").alias("team"), F.col("home_elo").alias("rating"))
        ratings.write.mode("overwrite").parquet(state_version(state, batch_id))

    run_available(read_stream(spark, source, schema), checkpoint, handle)


def elo_results(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(CHAIN + ", v string").parquet(sink).filter("kind = 1").select("match_id", "home_elo", "away_elo")
