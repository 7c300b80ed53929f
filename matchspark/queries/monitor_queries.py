"""Monitoring of the event log as predictions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from matchspark.operators import monitor as M
from matchspark.operators import statistics as S
from matchspark.queries.registry import query, rounded
from matchspark.queries.sql_parts import r
from matchspark.sources.tables import events

EV = """ev AS (SELECT event_id, ts, user_id, event_type AS target, value AS predicted,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS actual FROM events)"""
DAILY = """daily AS (SELECT target, CAST(ts AS DATE) AS day, avg(abs(predicted - actual)) AS mae FROM ev
  WHERE actual IS NOT NULL GROUP BY ALL)"""


def ev_sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([EV, *ctes]) + "\n" + body


@query("daily_mae", ev_sql(f"SELECT target, day, {r('mae')} AS mae FROM daily", DAILY))
def daily_mae(spark, folder):
    return rounded(M.daily_mae(events(spark, folder)))


@query(
    "history_cap",
    ev_sql("""SELECT event_id, target, predicted FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY event_id DESC) AS rn
    FROM ev) WHERE rn <= 1000"""),
)
def history_cap(spark, folder):
    return M.latest(events(spark, folder), ["target"], 1000).select("event_id", "target", "predicted")


@query(
    "rolling_metric",
    ev_sql(f"""SELECT event_id, target, {r('CASE WHEN count(*) OVER w = 10 THEN avg(abs(predicted - actual)) OVER w END')} AS rolling_mae
    FROM ev WINDOW w AS (PARTITION BY target ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""),
)
def rolling_metric(spark, folder):
    return rounded(M.rolling_metric(events(spark, folder), 10))


@query(
    "latency_percentiles",
    ev_sql(f"""SELECT target, {r('avg(predicted)')} AS mean, {r('quantile_cont(predicted, 0.95)')} AS p95,
    {r('quantile_cont(predicted, 0.99)')} AS p99 FROM ev GROUP BY target"""),
)
def latency_percentiles(spark, folder):
    return rounded(M.latency(events(spark, folder), ["target"], "predicted"))


DRIFT = """num AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY event_id DESC) AS rn FROM ev),
dr AS (SELECT target, (abs(bm - hm) / (hs + 1e-6) + abs(bs - hs) / (hs + 1e-6)) / 2 AS drift_score FROM (SELECT target,
  avg(predicted) FILTER (WHERE rn <= 50) AS bm, stddev_pop(predicted) FILTER (WHERE rn <= 50) AS bs,
  avg(predicted) FILTER (WHERE rn <= 500) AS hm, stddev_pop(predicted) FILTER (WHERE rn <= 500) AS hs FROM num GROUP BY target))"""


@query("drift_score", ev_sql(f"SELECT target, {r('drift_score')} AS drift_score FROM dr", DRIFT))
def drift_score(spark, folder):
    return rounded(M.drift_score(events(spark, folder), 500, 50))


KS_SERIES = " + ".join(f"({2.0 if k % 2 else -2.0}) * exp({-2.0 * k * k} * lam2)" for k in range(1, 21))


@query(
    "ks_drift",
    ev_sql(
        f"""SELECT target, CAST(n_old AS BIGINT) AS n_old, CAST(n_new AS BIGINT) AS n_new, {r('d')} AS ks_statistic, {r('p')} AS p_value, p < 0.05 AS drift_detected
        FROM (SELECT *, least(1.0, greatest(0.0, {KS_SERIES})) AS p FROM (SELECT target, max(n_old) AS n_old, max(n_new) AS n_new,
          max(abs(fo - fn)) AS d, max(abs(fo - fn)) ** 2 * (max(n_old) * max(n_new) / (max(n_old) + max(n_new))) AS lam2 FROM (
          SELECT target, predicted, sum(o) OVER w AS n_old, sum(n) OVER w AS n_new,
            sum(o) OVER u / sum(o) OVER w AS fo, sum(n) OVER u / sum(n) OVER w AS fn FROM (
            SELECT target, predicted, count(*) FILTER (WHERE rn > 100) AS o, count(*) FILTER (WHERE rn <= 100) AS n FROM num GROUP BY ALL)
          WINDOW w AS (PARTITION BY target), u AS (PARTITION BY target ORDER BY predicted)) GROUP BY target))""",
        DRIFT,
    ),
)
def ks_drift(spark, folder):
    return rounded(M.ks_drift(events(spark, folder), 100))


_Z = 1.959963984540054
_T = "CASE df " + " ".join(f"WHEN {k} THEN {v}" for k, v in M.T975.items()) + (
    f" ELSE {_Z} + {(_Z**3 + _Z) / 4} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / (df * df)"
    f" + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / (df * df * df) END"
)
TREND = """xy AS (SELECT target, day, mae, row_number() OVER (PARTITION BY target ORDER BY day) - 1 AS x FROM daily),
fit AS (SELECT target, count(*) AS n, count(*) - 2.0e0 AS df, regr_slope(mae, x) AS slope, regr_intercept(mae, x) AS ic, regr_sxx(mae, x) AS sxx,
  regr_syy(mae, x) AS syy, regr_sxy(mae, x) AS sxy, stddev_pop(mae) AS sd, avg(x) AS mx FROM xy GROUP BY target)"""


@query(
    "mae_trend",
    ev_sql(
        f"""SELECT target, n, {r('slope')} AS slope,
        CASE WHEN abs(slope) < 0.01 THEN 'stable' WHEN slope < 0 THEN 'improving' ELSE 'declining' END AS direction,
        {r('abs(slope) / (sd + 1e-6)')} AS confidence, {r('nx', 5)} AS next, {r('nx - h', 5)} AS next_lower, {r('nx + h', 5)} AS next_upper
        FROM (SELECT *, ic + slope * n AS nx,
          ({_T}) * sqrt(greatest(syy - slope * sxy, 0) / (n - 2) * (1 + 1 / n + (n - mx) ** 2 / sxx)) AS h FROM fit)""",
        DAILY, TREND,
    ),
)
def mae_trend(spark, folder):
    df = M.trend(M.daily_mae(events(spark, folder)))
    return rounded(df.select("target", "n", "slope", "direction", "confidence")).join(
        rounded(df.select("target", "next", "next_lower", "next_upper"), 5), "target")


@query(
    "trend_bands",
    ev_sql(
        f"""SELECT target, day, {r('f', 5)} AS fitted, {r('f - h', 5)} AS lower, {r('f + h', 5)} AS upper FROM (
        SELECT target, day, ic + slope * x AS f,
          ({_T}) * sqrt(greatest(syy - slope * sxy, 0) / (n - 2) * (1 + 1 / n + (x - mx) ** 2 / sxx)) AS h
        FROM xy JOIN fit USING (target) WHERE n > 2)""",
        DAILY, TREND,
    ),
)
def trend_bands(spark, folder):
    return rounded(M.trend_bands(M.daily_mae(events(spark, folder))), 5)


def _p(z: str) -> str:
    x = f"(({z}) / {math.sqrt(2.0)})"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    return (f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
            f" * exp(-{x} * {x})")


@query(
    "kendall_trend",
    ev_sql(
        f"""SELECT target, n, {r('s / sqrt(p0 * (p0 - tied))')} AS tau, {r('p', 5)} AS p_value, p < 0.05 AS is_significant FROM (
        SELECT *, {_p('abs(s) / sqrt(v)')} AS p FROM (
        SELECT target, n, n * (n - 1) / 2.0e0 AS p0, s, tied, (n * (n - 1) * (2 * n + 5) - tv) / 18.0e0 AS v FROM (
          SELECT a.target, CAST(sum(sign(b.mae - a.mae)) AS DOUBLE) AS s FROM xy a JOIN xy b ON a.target = b.target AND a.x < b.x GROUP BY 1)
        JOIN (SELECT target, CAST(sum(t) AS BIGINT) AS n, sum(t * (t - 1) // 2) AS tied, sum(t * (t - 1) * (2 * t + 5)) AS tv FROM (
          SELECT target, mae, count(*) AS t FROM xy GROUP BY ALL) GROUP BY target) USING (target)))""",
        DAILY, TREND,
    ),
)
def kendall_trend(spark, folder):
    df = M.kendall_trend(M.daily_mae(events(spark, folder)))
    return rounded(df.select("target", "n", "tau", "is_significant")).join(rounded(df.select("target", "p_value"), 5), "target")


@query(
    "interval_accuracy",
    ev_sql(
        f"""SELECT target, {r('avg((predicted - actual) ** 2)', 4)} AS mse, {r('avg(abs(predicted - actual))')} AS mae,
        {r('avg(CASE WHEN actual BETWEEN predicted * 0.75 AND predicted * 1.25 THEN 1 ELSE 0 END)')} AS within_interval,
        count(*) AS sample_size FROM ev GROUP BY target"""
    ),
)
def interval_accuracy(spark, folder):
    df = M.interval_accuracy(events(spark, folder), ["target"], 0.25)
    return rounded(df.drop("mse")).join(rounded(df.select("target", "mse"), 4), "target")


@query(
    "ab_evaluate",
    ev_sql(
        f"""SELECT CAST(cn AS BIGINT) AS champion_n, {r('cc')} AS champion_closeness, {r('ch')} AS champion_hit, CAST(hn AS BIGINT) AS challenger_n,
        {r('hc')} AS challenger_closeness, {r('hh')} AS challenger_hit,
        CASE WHEN cn >= 1000 AND hn >= 1000 THEN (hc + hh) / 2 > (cc + ch) / 2 END AS challenger_is_better FROM (
        SELECT count(*) FILTER (WHERE a) AS cn, avg(1 / (1 + e)) FILTER (WHERE a) AS cc, avg(CASE WHEN e <= 10 THEN 1 ELSE 0 END) FILTER (WHERE a) AS ch,
          count(*) FILTER (WHERE NOT a) AS hn, avg(1 / (1 + e)) FILTER (WHERE NOT a) AS hc,
          avg(CASE WHEN e <= 10 THEN 1 ELSE 0 END) FILTER (WHERE NOT a) AS hh
        FROM (SELECT (user_id * 7919) % 10 < 8 AS a, abs(predicted - actual) AS e FROM ev))"""
    ),
)
def ab_evaluate(spark, folder):
    arm = F.when((F.col("user_id") * 7919) % 10 < 8, "champion").otherwise("challenger")
    return rounded(M.ab_evaluate(events(spark, folder), arm))


PERF = """pf AS (SELECT target, count(*) AS n, avg((actual - predicted) ** 2) AS mse, avg(abs(actual - predicted)) AS mae,
  1 - avg((actual - predicted) ** 2) / var_pop(actual) AS r2, avg(predicted) AS pm, stddev_pop(predicted) AS ps, avg(actual) AS am,
  avg(abs(predicted - actual)) AS em, stddev_pop(abs(predicted - actual)) AS es FROM num WHERE rn <= 500 GROUP BY target)"""


@query(
    "monitor_alerts",
    ev_sql(
        f"""SELECT 'performance' AS type, target, {r('sqrt(mse)', 5)} AS value, 0.2e0 AS threshold FROM pf WHERE sqrt(mse) > 0.2
        UNION ALL SELECT 'drift', target, {r('drift_score', 5)}, 0.1e0 FROM dr WHERE drift_score > 0.1""",
        DRIFT, PERF,
    ),
)
def monitor_alerts(spark, folder):
    return rounded(M.alerts(events(spark, folder), 0.2, 0.1, 500, 50), 5)


@query(
    "monitor_report",
    ev_sql(
        f"""SELECT target, n, {r('mse', 4)} AS mse, {r('sqrt(mse)', 4)} AS rmse, {r('mae', 4)} AS mae, {r('r2', 4)} AS r2,
        {r('pm', 4)} AS prediction_mean, {r('ps', 4)} AS prediction_std, {r('am', 4)} AS actual_mean, {r('em', 4)} AS error_mean,
        {r('es', 4)} AS error_std, {r('drift_score', 4)} AS drift_score FROM pf JOIN dr USING (target)""",
        DRIFT, PERF,
    ),
)
def monitor_report(spark, folder):
    return rounded(M.report(events(spark, folder), 500, 50), 4)


@query(
    "drift_overlay",
    ev_sql(
        f"""SELECT target, bin, count(*) FILTER (WHERE ts < '2024-01-23') AS n_first, count(*) FILTER (WHERE ts >= '2024-01-23') AS n_second,
        {r("count(*) FILTER (WHERE ts < '2024-01-23') / max(n1)")} AS share_first, {r("count(*) FILTER (WHERE ts >= '2024-01-23') / max(n2)")} AS share_second
        FROM (SELECT *, CASE WHEN hi > lo THEN CAST(least(floor((predicted - lo) / ((hi - lo) / 30)), 29) AS INT) ELSE 0 END AS bin FROM ev JOIN (
        SELECT target, min(predicted) AS lo, max(predicted) AS hi, nullif(count(*) FILTER (WHERE ts < '2024-01-23'), 0) AS n1,
        nullif(count(*) FILTER (WHERE ts >= '2024-01-23'), 0) AS n2 FROM ev WHERE predicted IS NOT NULL GROUP BY target) USING (target))
        WHERE predicted IS NOT NULL GROUP BY target, bin"""
    ),
)
def drift_overlay(spark, folder):
    """Predictions of the last days in the same bins as those before."""
    return rounded(S.histogram_overlay(events(spark, folder), ["target"], "predicted", F.expr("ts >= timestamp'2024-01-23'")))
