"""Implied probabilities and what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import predictions as P
from matchspark.operators import labels as L
from matchspark.operators.market import with_market
from matchspark.operators.windows import season_ages
from matchspark.queries.registry import query, rounded
from matchspark.queries.sql_parts import fx_sql, r
from matchspark.sources.fixtures import contests

MARKET_CTE = """
books AS (SELECT match_id, b1_h AS h, b1_d AS d, b1_a AS a FROM m WHERE b1_h > 1 AND b1_d > 1 AND b1_a > 1
  UNION ALL SELECT match_id, b2_h, b2_d, b2_a FROM m WHERE b2_h > 1 AND b2_d > 1 AND b2_a > 1),
probs AS (SELECT match_id, avg(1 / h / (1 / h + 1 / d + 1 / a)) AS ph, avg(1 / d / (1 / h + 1 / d + 1 / a)) AS pd,
  avg(1 / a / (1 / h + 1 / d + 1 / a)) AS pa, avg(1 / h + 1 / d + 1 / a) AS ov, count(*) AS n
  FROM books GROUP BY match_id),
mk0 AS (SELECT m.*, COALESCE(ph, 0.45) AS market_home_prob, COALESCE(probs.pd, 0.27) AS market_draw_prob,
  COALESCE(probs.pa, 0.28) AS market_away_prob, COALESCE(ov, 1.0) AS market_overround,
  CAST(COALESCE(probs.n, 0) AS DOUBLE) AS market_sources_count,
  CASE WHEN ou_over > 1 AND ou_under > 1 THEN 1 / ou_over / (1 / ou_over + 1 / ou_under) ELSE 0.5 END
    AS market_over25_prob,
  CASE WHEN ou_over > 1 AND ou_under > 1 THEN 1 / ou_under / (1 / ou_over + 1 / ou_under) ELSE 0.5 END
    AS market_under25_prob,
  CAST(CASE WHEN ou_over > 1 AND ou_under > 1 THEN 1 ELSE 0 END AS DOUBLE) AS market_goals_sources_count
  FROM m LEFT JOIN probs USING (match_id)),
mk AS (SELECT *, market_home_prob - market_away_prob AS market_home_advantage,
  market_home_prob - (market_draw_prob + market_away_prob) AS market_home_vs_not_home_prob,
  market_home_prob - greatest(market_draw_prob, market_away_prob) AS market_home_favorite_margin,
  CAST(CASE WHEN market_home_prob >= greatest(market_draw_prob, market_away_prob) THEN 1 ELSE 0 END AS DOUBLE)
    AS market_is_home_favorite,
  ln(greatest(market_home_prob, 1e-6) / greatest(1 - market_home_prob, 1e-6)) AS market_home_logit,
  -(market_home_prob * ln(greatest(market_home_prob, 1e-15)) + market_draw_prob * ln(greatest(market_draw_prob, 1e-15))
    + market_away_prob * ln(greatest(market_away_prob, 1e-15))) AS market_entropy FROM mk0)"""


def _pick(spark, folder, columns):
    return rounded(with_market(contests(spark, folder)).select("match_id", *columns))


def _sql(columns):
    return fx_sql(
        "SELECT match_id, " + ", ".join(f"{r(c)} AS {c}" for c in columns) + " FROM mk",
        MARKET_CTE,
    )


IMPLIED = ["market_home_prob", "market_draw_prob", "market_away_prob", "market_overround", "market_sources_count"]
DERIVED = [
    "market_home_advantage", "market_home_vs_not_home_prob", "market_home_favorite_margin",
    "market_is_home_favorite", "market_home_logit", "market_entropy",
]
GOALS = ["market_over25_prob", "market_under25_prob", "market_goals_sources_count"]


@query("implied_probs", _sql(IMPLIED))
def implied_probs(spark, folder):
    return _pick(spark, folder, IMPLIED)


@query("market_derivatives", _sql(DERIVED))
def market_derivatives(spark, folder):
    return _pick(spark, folder, DERIVED)


@query("over_under_probs", _sql(GOALS))
def over_under_probs(spark, folder):
    return _pick(spark, folder, GOALS)


# ---------------------------------------------------------------- labels and weights


@query(
    "target_labels",
    fx_sql(
        "SELECT match_id, ftr AS match_result_1x2, "
        + ", ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END AS {n}" for n, p in L.CLASS_TARGETS.items())
        + ", " + ", ".join(f"CAST({p} AS INT) AS {n}" for n, p in L.NUMBER_TARGETS.items()) + " FROM m"
    ),
)
def target_labels(spark, folder):
    return L.target_labels(contests(spark, folder))


@query(
    "target_long",
    fx_sql(
        " UNION ALL ".join(f"SELECT match_id, '{n}' AS target, CASE WHEN {p} THEN 1 ELSE 0 END AS value FROM m" for n, p in L.CLASS_TARGETS.items())
        + "".join(f" UNION ALL SELECT match_id, '{n}', CAST({p} AS INT) FROM m" for n, p in L.NUMBER_TARGETS.items())
    ),
)
def target_long(spark, folder):
    return L.target_long(L.target_labels(contests(spark, folder)))


@query(
    "target_rates",
    fx_sql(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS target, {r("p / n")} AS target_rate, {r("least(p, n - p) / n")} AS minority_rate,
            {r("1 - least(p, n - p) / n")} AS majority_rate, least(p, n - p) AS minority_count
            FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {p}) AS p FROM m)""" for n, p in L.CLASS_TARGETS.items()
        )
    ),
)
def target_rates(spark, folder):
    return rounded(L.target_rates(contests(spark, folder)))


@query(
    "recency_weights",
    fx_sql(
        f"""SELECT match_id, age AS season_age, {r("pow(0.5, ((SELECT max(age) FROM aged) - age) / 2.0)")} AS recency_weight FROM aged""",
        """aged AS (SELECT match_id, CAST(dense_rank() OVER (PARTITION BY league ORDER BY season) - 1 AS INT) AS age FROM m)""",
    ),
)
def recency_weights(spark, folder):
    df = contests(spark, folder)
    aged = df.join(season_ages(df), ["league", "season"]).select("match_id", "season_age")
    return rounded(L.recency_weights(aged, 2.0))


@query(
    "training_weights",
    fx_sql(
        f"""SELECT match_id, {r("n / (k * CAST(nc AS DOUBLE))")} AS class_weight,
        {r("pow(0.5, ((SELECT max(age) FROM aged) - age) / 4.0)")} AS recency_weight,
        {r("n / (k * CAST(nc AS DOUBLE)) * pow(0.5, ((SELECT max(age) FROM aged) - age) / 4.0)")} AS weight FROM aged
        JOIN (SELECT league, ftr, count(*) AS nc FROM m GROUP BY ALL) USING (league, ftr)
        JOIN (SELECT league, count(*) AS n, count(DISTINCT ftr) AS k FROM m GROUP BY ALL) USING (league)""",
        """aged AS (SELECT match_id, league, ftr, CAST(dense_rank() OVER (PARTITION BY league ORDER BY season) - 1 AS INT) AS age FROM m)""",
    ),
)
def training_weights(spark, folder):
    """Class balance times recency."""
    df = contests(spark, folder)
    aged = df.join(season_ages(df), ["league", "season"]).select("match_id", "league", "ftr", "season_age")
    return rounded(L.training_weights(aged, "ftr", 4.0, ["league"]).select("match_id", "class_weight", "recency_weight", "weight"))


@query(
    "balanced_weights",
    fx_sql(
        f"""SELECT match_id, league, ftr, {r("n / (k * CAST(nc AS DOUBLE))")} AS class_weight FROM m
        JOIN (SELECT league, ftr, count(*) AS nc FROM m GROUP BY ALL) USING (league, ftr)
        JOIN (SELECT league, count(*) AS n, count(DISTINCT ftr) AS k FROM m GROUP BY ALL) USING (league)"""
    ),
)
def balanced_weights(spark, folder):
    rows = contests(spark, folder).select("match_id", "league", "ftr")
    return rounded(L.balanced_weights(rows, "ftr", ["league"]))


# ---------------------------------------------------------------- expectations and intervals


@query(
    "heuristic_expectations",
    fx_sql(
        f"""SELECT match_id, {r("market_home_prob * 2 + market_draw_prob", 4)} AS goals_home,
        {r("market_away_prob * 2 + market_draw_prob", 4)} AS goals_away,
        {r("COALESCE(hs, 0) / 8.0e0 + hst / 20.0e0", 4)} AS corners_home,
        {r("as_ / 8.0e0 + ast / 20.0e0", 4)} AS corners_away,
        {r("hc / 12.0e0 + hr * 0.15e0", 4)} AS cards_home, {r("ac / 12.0e0 + ar * 0.15e0", 4)} AS cards_away FROM mk""",
        MARKET_CTE,
    ),
)
def heuristic_expectations(spark, folder):
    return rounded(P.expectations(with_market(contests(spark, folder))), 4)


@query(
    "prediction_intervals",
    fx_sql(
        f"""SELECT match_id, {r("greatest(0, v * 0.75)", 2)} AS goals_lower, {r("v * 1.25", 2)} AS goals_upper,
        {r("greatest(0, v - 1.959963984540054 * v * 0.25)", 2)} AS goals_z_lower,
        {r("v + 1.959963984540054 * v * 0.25", 2)} AS goals_z_upper
        FROM (SELECT match_id, market_home_prob * 2 + market_draw_prob AS v FROM mk)""",
        MARKET_CTE,
    ),
)
def prediction_intervals(spark, folder):
    df = P.expectations(with_market(contests(spark, folder)))
    plain, z = P.interval(F.col("goals_home"), 0.25), P.z_interval(F.col("goals_home"), 0.25)
    return rounded(df.select("match_id", plain[0].alias("goals_lower"), plain[1].alias("goals_upper"),
                             z[0].alias("goals_z_lower"), z[1].alias("goals_z_upper")), 2)


@query(
    "prob_normalise",
    fx_sql(
        f"""SELECT match_id, {r("CASE WHEN t > 0 THEN w / t ELSE 0.34 END", 4)} AS win,
        {r("CASE WHEN t > 0 THEN d / t ELSE 0.32 END", 4)} AS draw, {r("CASE WHEN t > 0 THEN l / t ELSE 0.34 END", 4)} AS loss
        FROM (SELECT match_id, w, d, l, w + d + l AS t FROM (SELECT match_id, CAST(greatest(fthg - 1, 0) AS DOUBLE) AS w,
          CAST(greatest(hy - 2, 0) AS DOUBLE) AS d, CAST(greatest(ftag - 1, 0) AS DOUBLE) AS l FROM m))"""
    ),
)
def prob_normalise(spark, folder):
    scores = F.expr("array(double(ftag - 1), double(hy - 2), double(fthg - 1))")
    parts = P.normalise(scores)
    return rounded(contests(spark, folder).select("match_id", *[p.alias(n) for p, n in zip(parts, ("win", "draw", "loss"))]), 4)


@query(
    "adapt_margins",
    fx_sql(
        f"""SELECT league, n AS sample_size, {r("c")} AS coverage, {r('''least(0.5, greatest(0.1, CASE WHEN c < 0.8
        THEN 0.25 * (1 + (0.8 - c) * 0.5) WHEN c > 0.95 THEN 0.25 * (1 - (c - 0.95) * 0.5) ELSE 0.25 END))''')} AS margin
        FROM (SELECT league, count(*) AS n, avg(CASE WHEN fthg BETWEEN v * 0.25 AND v * 2.5 THEN 1 ELSE 0 END) AS c
          FROM (SELECT league, fthg, market_home_prob * 2 + market_draw_prob AS v FROM mk) GROUP BY league)""",
        MARKET_CTE,
    ),
)
def adapt_margins(spark, folder):
    df = P.expectations(with_market(contests(spark, folder)), "league", "fthg")
    hit = F.col("fthg").between(F.col("goals_home") * 0.25, F.col("goals_home") * 2.5)
    covered = df.groupBy("league").agg(F.count("*").alias("sample_size"), F.avg(F.when(hit, 1).otherwise(0)).alias("coverage"))
    return rounded(covered.withColumn("margin", P.adapted_margin(0.25, F.col("coverage"))))
