"""Alert rules in batch, and streams run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators.evaluate import regression_metrics
from matchspark.queries.monitor_queries import DRIFT, ev_sql
from matchspark.queries.rating_queries import ELO_CTE
from matchspark.queries.registry import query, rounded
from matchspark.queries.source_queries import fresh
from matchspark.queries.sql_parts import r, tv_sql
from matchspark.sources.fixtures import contests
from matchspark.sources.tables import events
from matchspark.streaming import alerts as A
from matchspark.streaming import held as H
from matchspark.streaming import jobs as J

RATE_CTE = """rate AS (SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, count(*) AS failures FROM (
  SELECT date_trunc('minute', ts) - i * INTERVAL 1 MINUTE AS w FROM ev, range(5) t(i) WHERE target = 'error') GROUP BY w)"""


@query("rate_alert", ev_sql("SELECT * FROM rate", RATE_CTE))
def rate_alert(spark, folder):
    return A.rate_alert(events(spark, folder)).select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "failures")


@query(
    "p95_alert",
    ev_sql("""SELECT * FROM (SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, quantile_disc(predicted, 0.95) AS p95 FROM (
    SELECT time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE AS w, predicted FROM ev, range(6) t(i)) GROUP BY w) WHERE p95 > 60"""),
)
def p95_alert(spark, folder):
    df = A.p95_alert(events(spark, folder), 60.0)
    return df.select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "p95")


@query(
    "error_ratio",
    ev_sql(f"""SELECT window_start, window_end, n, errors, {r('errors / n')} AS ratio FROM (SELECT date_trunc('hour', ts) AS window_start,
    date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, count(*) FILTER (WHERE target = 'error') AS errors
    FROM ev GROUP BY ALL) WHERE errors / n > 0.01"""),
)
def error_ratio(spark, folder):
    df = rounded(A.error_ratio(events(spark, folder), 0.01))
    return df.select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "n", "errors", "ratio")


@query(
    "sustained_breach",
    ev_sql("""SELECT target, min(hour) AS from_hour, count(*) AS hours FROM (SELECT *, epoch(hour) - row_number() OVER (
    PARTITION BY target ORDER BY hour) * 3600 AS run FROM (SELECT target, date_trunc('hour', ts) AS hour, avg(abs(predicted - actual)) AS e
    FROM ev GROUP BY ALL) WHERE e > 40) GROUP BY target, run HAVING count(*) >= 3"""),
)
def sustained_breach(spark, folder):
    df = A.sustained_breach(events(spark, folder), 40.0, 3)
    return df.withColumn("from_hour", F.col("from_hour").cast("timestamp_ntz"))


def _land(spark, df, path, *parts):
    """Write the parts one after another and yield after each, as files that arrive over time."""
    for condition in parts:
        df.filter(condition).write.mode("append").parquet(path)
        yield


@query(
    "stream_rate_alert",
    ev_sql("""SELECT * FROM rate WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) FROM ev WHERE target = 'error')
    - INTERVAL 1 HOUR""", RATE_CTE),
)
def stream_rate_alert(spark, folder):
    root, df = fresh(spark, "rate"), events(spark, folder)
    for _ in _land(spark, df, root + "/in", "true"):
        J.run_available(A.rate_alert(J.read_stream(spark, root + "/in", df.schema)), root + "/cp", sink=root + "/out")
    out = spark.read.schema("window_start timestamp, window_end timestamp, failures bigint").parquet(root + "/out")
    return out.select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "failures")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _with_timers(spark, run):
    """Run with the state store that has timers, then set the session back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(PROVIDER, before)


def _sent(spark, folder, name, rule, schema):
    """Rows that a rule sends while the events land one half after the other."""
    root, df = fresh(spark, name), events(spark, folder)
    middle = "ts < timestamp_ntz'2024-01-16'"
    for _ in _land(spark, df, root + "/in", middle, f"NOT {middle}"):
        J.run_available(rule(J.read_stream(spark, root + "/in", df.schema)), root + "/cp", sink=root + "/out")
    out = spark.read.schema(schema).parquet(root + "/out")
    return out.select(*[F.col(c).cast("timestamp_ntz") if t == "timestamp" else c for c, t in out.dtypes])


REACHED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM ev)"


@query(
    "stream_error_ratio",
    ev_sql(f"""SELECT window_start, window_end, n, errors, {r('errors / n')} AS ratio FROM (SELECT date_trunc('hour', ts) AS window_start,
    date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, count(*) FILTER (WHERE target = 'error') AS errors
    FROM ev GROUP BY ALL) WHERE errors / n > 0.01 AND window_end <= {REACHED}"""),
)
def stream_error_ratio(spark, folder):
    """Error ratio of each hour that the watermark has closed."""
    schema = "window_start timestamp, window_end timestamp, n bigint, errors bigint, ratio double"
    return rounded(_sent(spark, folder, "ratio", lambda s: A.error_ratio(s, 0.01), schema))


@query(
    "stream_p95_alert",
    ev_sql(f"""SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, {r('p95')} AS p95 FROM (
    SELECT w AS window_start, 2 * pow(1.01E0 / 0.99E0, ceil(ln(quantile_disc(predicted, 0.95)) / ln(1.01E0 / 0.99E0))) / (1.01E0 / 0.99E0 + 1) AS p95
    FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE AS w, predicted FROM ev, range(6) t(i)) GROUP BY w)
    WHERE p95 > 60 AND window_end <= {REACHED}"""),
)
def stream_p95_alert(spark, folder):
    """p95 of each window that the watermark has closed: the bucket of the exact value."""
    schema = "window_start timestamp, window_end timestamp, p95 double"
    return rounded(_sent(spark, folder, "p95", lambda s: A.p95_sketch(s, 60.0), schema))


def _held_sql(steps: str, minutes: int, hold: int) -> str:
    """Islands of met steps up to the time reached, told as the rows that a stream sends."""
    step = f"INTERVAL {minutes} MINUTE"
    return ev_sql(
        f"""SELECT target, 'firing' AS state, since, since + {hold} * {step} AS at, CAST({hold} AS BIGINT) AS steps FROM runs
        UNION ALL SELECT target, 'resolved', since, since + n * {step}, n FROM runs WHERE since + (n + 1) * {step} <= {REACHED}""",
        f"steps AS ({steps})",
        f"""runs AS (SELECT target, min(s) AS since, count(*) AS n FROM (SELECT target, s, epoch(s) - row_number() OVER (
        PARTITION BY target ORDER BY s) * {minutes * 60} AS run FROM steps WHERE met AND s + {step} <= {REACHED}) GROUP BY target, run
        HAVING count(*) >= {hold})""",
    )


ACCURACY = "SELECT target, time_bucket(INTERVAL 30 MINUTE, ts) AS s, avg(CASE WHEN abs(predicted - actual) <= 40 THEN 1E0 ELSE 0E0 END) < 0.7 AS met"


@query(
    "stream_accuracy_drop",
    _held_sql(f"{ACCURACY} FROM ev WHERE predicted IS NOT NULL AND actual IS NOT NULL GROUP BY ALL", 30, 2),
)
def stream_accuracy_drop(spark, folder):
    """Accuracy below 0.7 that has held for an hour, and its end."""
    rule = lambda s: H.held_stream(H.accuracy_steps(s, 40.0, 0.7, "30 minutes"), 2, 1800)
    return _with_timers(spark, lambda: _sent(spark, folder, "accuracy", rule, H.EVENT))


@query(
    "stream_drift_held",
    _held_sql(
        """SELECT target, date_trunc('hour', ts) AS s, (abs(avg(predicted) - max(hm)) + abs(stddev_pop(predicted) - max(hs)))
        / (max(hs) + 1e-6) / 2 > 0.3 AS met FROM ev JOIN (SELECT target, avg(predicted) AS hm, stddev_pop(predicted) AS hs FROM ev GROUP BY ALL)
        USING (target) WHERE predicted IS NOT NULL GROUP BY ALL""",
        60, 2,
    ),
)
def stream_drift_held(spark, folder):
    """Drift beyond 0.3 of the target's history that has held for two hours, and its end."""
    history = events(spark, folder).groupBy("target").agg(F.avg("predicted").alias("hm"), F.stddev_pop("predicted").alias("hs"))
    rule = lambda s: H.held_stream(H.drift_steps(s, history, 0.3, "1 hour"), 2, 3600)
    return _with_timers(spark, lambda: _sent(spark, folder, "drift", rule, H.EVENT))


@query("incremental_refresh", ev_sql("SELECT event_id, target, predicted FROM ev"))
def incremental_refresh(spark, folder):
    root, df = fresh(spark, "refresh"), events(spark, folder)
    for _ in _land(spark, df, root + "/in", "event_id % 10 < 7", "event_id % 10 >= 6"):
        J.incremental_refresh(spark, root + "/in", df.schema, root + "/cp", root + "/out")
    return spark.read.schema(J.LANDED).parquet(root + "/out").select("event_id", "target", "predicted")


@query(
    "stream_monitor",
    ev_sql(
        f"""SELECT target, count(*) AS n, {r('avg((actual - predicted) ** 2)', 4)} AS mse, {r('sqrt(avg((actual - predicted) ** 2))', 4)} AS rmse,
        {r('avg(abs(actual - predicted))', 4)} AS mae, {r('1 - avg((actual - predicted) ** 2) / var_pop(actual)', 4)} AS r2
        FROM num WHERE rn <= 200 GROUP BY target""",
        DRIFT,
    ),
)
def stream_monitor(spark, folder):
    root, df = fresh(spark, "monitor"), events(spark, folder)
    runs = 0
    for _ in _land(spark, df, root + "/in", "user_id % 3 = 0", "user_id % 3 > 0"):
        J.monitor_stream(spark, root + "/in", df.schema, root + "/cp", root + "/state", 200)
        runs += 1
    kept = spark.read.schema(df.schema).parquet(J.state_version(root + "/state", runs - 1))
    return rounded(regression_metrics(kept, ["target"], "actual", "predicted"), 4)


BATCHES = """landed AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS batch FROM ev),
held AS (SELECT * FROM (SELECT k, landed.*, row_number() OVER (PARTITION BY k, target ORDER BY event_id DESC) AS rn
  FROM landed, range(2) t(k) WHERE batch <= k) WHERE rn <= 200),
hist AS (SELECT k, target, count(*) AS n, avg((actual - predicted) ** 2) AS mse, avg(abs(actual - predicted)) AS mae,
  var_pop(actual) AS vy, avg(predicted) AS hm, stddev_pop(predicted) AS hs, max(ts) AS seen FROM held GROUP BY ALL),
own AS (SELECT batch AS k, target, count(*) AS batch_rows, avg(predicted) AS bm, stddev_pop(predicted) AS bs FROM landed GROUP BY ALL),
late AS (SELECT batch AS k, l.target, count(*) AS late_rows FROM landed l JOIN hist h ON h.k = l.batch - 1 AND h.target = l.target
  WHERE l.ts < h.seen - INTERVAL 1 HOUR GROUP BY ALL)"""


@query(
    "stream_batch_metrics",
    ev_sql(
        f"""SELECT CAST(k AS INT) AS batch, target, batch_rows, coalesce(late_rows, 0) AS late_rows, n, {r('mse', 4)} AS mse,
        {r('sqrt(mse)', 4)} AS rmse, {r('mae', 4)} AS mae, {r('1 - mse / vy', 4)} AS r2,
        {r('(abs(bm - hm) / (hs + 1e-6) + abs(bs - hs) / (hs + 1e-6)) / 2', 4)} AS drift_score
        FROM own JOIN hist USING (k, target) LEFT JOIN late USING (k, target)""",
        BATCHES,
    ),
)
def stream_batch_metrics(spark, folder):
    """Metrics, drift and late rows of each batch of predictions."""
    root, df = fresh(spark, "batches"), events(spark, folder)
    for _ in _land(spark, df, root + "/in", "user_id % 3 = 0", "user_id % 3 > 0"):
        J.monitor_stream(spark, root + "/in", df.schema, root + "/cp", root + "/state", 200, root + "/metrics")
    return rounded(spark.read.schema(J.BATCH).parquet(root + "/metrics"), 4)


@query(
    "stream_elo",
    tv_sql("SELECT match_id, round(home_elo + 1e-9, 4) AS home_elo, round(away_elo + 1e-9, 4) AS away_elo FROM elo", ELO_CTE),
)
def stream_elo(spark, folder):
    root = fresh(spark, "elo")
    df = contests(spark, folder).select("league", "season", "match_date", "home_team", "away_team", "match_id", "fthg", "ftag")
    for _ in _land(spark, df, root + "/in", "season < '1998'", "season >= '1998'"):
        J.elo_stream(spark, root + "/in", df.schema, root + "/cp", root + "/state", root + "/out")
    return rounded(J.elo_results(spark, root + "/out"), 4)
