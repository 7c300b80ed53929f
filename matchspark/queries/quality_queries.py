"""Quality gate, imputation, scores and manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import exceptions as X
from matchspark.operators import quality as Q
from matchspark.queries.registry import query, rounded
from matchspark.queries.scalar_queries import EXC_CTE, match_exceptions
from matchspark.queries.sql_parts import fx_sql, r
from matchspark.sources.fixtures import fixtures

FEATURES = ["hs", "hst", "hc", "b1_h"]


@query("null_counts", fx_sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM fx" for c in FEATURES)))
def null_counts(spark, folder):
    return Q.null_counts(fixtures(spark, folder), FEATURES)


DUP = "SELECT match_date, home_team, away_team, count(*) AS n FROM fx GROUP BY ALL HAVING count(*) > 1"


@query("duplicate_fixtures", fx_sql(f"""SELECT count(*) AS duplicate_groups, CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS rows_after_first,
    CAST(COALESCE(sum(n), 0) AS BIGINT) AS member_rows FROM ({DUP})"""))
def duplicate_fixtures(spark, folder):
    return Q.duplicate_counts(fixtures(spark, folder))


@query(
    "quality_gate",
    fx_sql(
        f"""SELECT *, issues = '' AS is_valid FROM (SELECT *, concat_ws('; ', CASE WHEN rows = 0 THEN 'no rows' END,
        CASE WHEN rows % 2 <> 0 THEN 'odd row count' END, CASE WHEN null_features > 0 THEN 'null features' END,
        CASE WHEN self_matches > 0 THEN 'self matches' END,
        CASE WHEN duplicate_fixtures > 0 THEN 'duplicate fixtures' END) AS issues FROM (
        SELECT count(*) AS rows, count(*) FILTER (WHERE home_team = away_team) AS self_matches,
        4 * count(*) - count(hs) - count(hst) - count(hc) - count(b1_h) AS null_features,
        (SELECT count(*) FROM ({DUP})) AS duplicate_fixtures, 0 AS missing_columns FROM fx))"""
    ),
)
def quality_gate(spark, folder):
    return Q.quality_gate(fixtures(spark, folder), FEATURES)


@query(
    "median_impute",
    fx_sql(
        """SELECT match_id, CAST(COALESCE(hs, (SELECT quantile_disc(hs, 0.5) FROM fx)) AS DOUBLE) AS hs,
        COALESCE(b1_h, (SELECT quantile_disc(b1_h, 0.5) FROM fx)) AS b1_h FROM fx"""
    ),
)
def median_impute(spark, folder):
    df = fixtures(spark, folder).select("match_id", "hs", "b1_h")
    return Q.impute(df, Q.median_fills(df, ["hs", "b1_h"]))


@query(
    "impute_report",
    fx_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing,
            CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS fill_value FROM fx""" for c in ("hs", "b1_h", "hc")
        )
    ),
)
def impute_report(spark, folder):
    df = fixtures(spark, folder)
    return Q.impute_report(df, Q.median_fills(df, ["hs", "b1_h", "hc"]))


@query(
    "mean_impute",
    fx_sql(
        f"""SELECT match_id, {r("COALESCE(hs, (SELECT avg(hs) FROM fx))")} AS hs,
        {r("COALESCE(b1_h, (SELECT avg(b1_h) FROM fx))")} AS b1_h FROM fx"""
    ),
)
def mean_impute(spark, folder):
    df = fixtures(spark, folder).select("match_id", "hs", "b1_h")
    return rounded(Q.impute(df, Q.mean_fills(df, ["hs", "b1_h"])))


@query(
    "source_manifest",
    fx_sql(
        f"""SELECT season, count(*) AS rows, min(match_date) AS date_min, max(match_date) AS date_max,
        'venue' AS missing_required, count(*) - count(DISTINCT (match_date, home_team, away_team)) AS duplicate_rows,
        count(*) FILTER (WHERE ftr IN ('H', 'D', 'A')) AS result_rows, 8 AS odds_columns,
        {r("count(*) FILTER (WHERE b1_h IS NOT NULL AND b1_d IS NOT NULL AND b1_a IS NOT NULL) / count(*)")}
        AS closing_coverage FROM fx GROUP BY season"""
    ),
)
def source_manifest(spark, folder):
    odds = ["b1_h", "b1_d", "b1_a", "b2_h", "b2_d", "b2_a", "ou_over", "ou_under", "b3_h"]
    required = ["match_date", "home_team", "away_team", "ftr", "fthg", "ftag", "venue"]
    return rounded(Q.source_manifest(fixtures(spark, folder), required, odds, ["b1_h", "b1_d", "b1_a"]))


@query(
    "dq_scores",
    fx_sql(
        f"""SELECT league, rows, self_matches, duplicate_groups, busy_days, {r("completeness")} AS completeness,
        {r("consistency")} AS consistency, {r("timeliness")} AS timeliness, {r("validity")} AS validity,
        {r("completeness * 0.3 + consistency * 0.3 + timeliness * 0.2 + validity * 0.2")} AS overall,
        completeness * 0.3 + consistency * 0.3 + timeliness * 0.2 + validity * 0.2 >= 0.8 AND rows >= 3 AS passes
        FROM (SELECT league, rows, self_matches, COALESCE(dg, 0) AS duplicate_groups, COALESCE(bd, 0) AS busy_days,
         1 - (missing + rows) / (rows * 6.0e0) AS completeness,
         greatest(0.0, 1.0e0 - CASE WHEN COALESCE(dg, 0) > 0 THEN 0.3 ELSE 0 END
           - CASE WHEN self_matches > 0 THEN 0.3 ELSE 0 END - COALESCE(bd, 0) * 0.2) AS consistency,
         greatest(0.0, 1.0e0 - CASE WHEN fut > 0 THEN 0.3 ELSE 0 END - CASE WHEN old > 0 THEN 0.3 ELSE 0 END) AS timeliness,
         0.6e0 AS validity
        FROM (SELECT league, count(*) AS rows, count(*) - count(hs) + count(*) - count(b1_h) AS missing,
          count(*) FILTER (WHERE home_team = away_team) AS self_matches,
          count(*) FILTER (WHERE match_date > DATE '1999-01-08') AS fut,
          count(*) FILTER (WHERE match_date < DATE '1999-01-01' - INTERVAL 730 DAY) AS old FROM fx GROUP BY league)
        LEFT JOIN (SELECT league, count(*) AS dg FROM (SELECT league, match_date, home_team, away_team FROM fx
          GROUP BY ALL HAVING count(*) > 1) GROUP BY league) USING (league)
        LEFT JOIN (SELECT league, count(*) AS bd FROM (SELECT league, t, match_date FROM (
          SELECT league, home_team AS t, match_date FROM fx UNION ALL SELECT league, away_team, match_date FROM fx)
          GROUP BY ALL HAVING count(*) > 1) GROUP BY league) USING (league))"""
    ),
)
def dq_scores(spark, folder):
    required = ["match_date", "home_team", "away_team", "hs", "b1_h", "venue"]
    return rounded(Q.dq_scores(fixtures(spark, folder), required, ["fthg", "ftag", "hc"], "1999-01-01"))


@query(
    "exception_summary",
    fx_sql(
        " UNION ALL ".join(
            f"SELECT '{s}' AS status, count(*) FILTER (WHERE status = '{s}') AS exceptions FROM exc" for s in X.STATUSES
        ),
        EXC_CTE,
    ),
)
def exception_summary(spark, folder):
    return X.summary(match_exceptions(spark, folder))


@query(
    "exceptions_by_team",
    fx_sql(
        """SELECT team, status, count(*) AS exceptions FROM (SELECT home_team AS team, status FROM exc
        UNION ALL SELECT away_team, status FROM exc) GROUP BY ALL""",
        EXC_CTE,
    ),
)
def exceptions_by_team(spark, folder):
    teams = F.explode(F.array("home_team", "away_team")).alias("team")
    return match_exceptions(spark, folder).select(teams, "status").groupBy("team", "status").agg(
        F.count("*").alias("exceptions")
    )
