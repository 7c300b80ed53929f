"""Descriptive aggregates over matches and table numerics."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import statistics as S
from matchspark.operators.team_view import team_view
from matchspark.queries.evaluation_queries import sc_sql, scored
from matchspark.queries.registry import query, rounded
from matchspark.queries.sql_parts import fx_sql, r, tv_sql
from matchspark.sources.fixtures import contests, fixtures
from matchspark.sources.tables import table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS missing, {r(f'avg({c})', 4)} AS mean,
        {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS min, {r(f'quantile_cont({c}, 0.25)', 4)} AS p25,
        {r(f'quantile_cont({c}, 0.5)', 4)} AS p50, {r(f'quantile_cont({c}, 0.75)', 4)} AS p75, {r(f'max({c})', 4)} AS max FROM lineitem"""
        for c in LINE
    ),
)
def describe_numeric(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINE)
    return rounded(S.describe(df, S.numeric_columns(df)), 4)


CORR = ["fthg", "ftag", "hst", "hc", "hy", "shots_sum"]
CORR_CTE = "cr AS (SELECT *, hst + hst AS shots_sum FROM m), mat AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM cr" for a in CORR for b in CORR
) + ")"


def corr_source(spark, folder):
    return contests(spark, folder).withColumn("shots_sum", F.col("hst") + F.col("hst"))


@query("corr_matrix", fx_sql(f"SELECT a, b, {r('r')} AS r FROM mat", CORR_CTE))
def corr_matrix(spark, folder):
    return rounded(S.correlations(corr_source(spark, folder), CORR))


WIDE = ["fthg", "ftag", "hs", "as_", "hst", "ast", "hc", "ac", "hy", "ay", "hr", "ar", "b1_h", "b1_d", "b1_a", "b2_h", "b2_d", "b2_a",
        "ou_over", "ou_under"]


@query(
    "corr_wide",
    fx_sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM m" for a in WIDE for b in WIDE)),
)
def corr_wide(spark, folder):
    """All match figures and odds, more columns than one generated method holds."""
    return rounded(S.correlations(contests(spark, folder), WIDE))


@query(
    "corr_drop",
    fx_sql(
        f"""SELECT mat.a, mat.b, {r('r')} AS r, CASE WHEN round(x.v, 12) > round(y.v, 12) THEN mat.a ELSE mat.b END AS dropped FROM mat
        JOIN (SELECT a, avg(abs(r)) AS v FROM mat GROUP BY a) x ON x.a = mat.a
        JOIN (SELECT a, avg(abs(r)) AS v FROM mat GROUP BY a) y ON y.a = mat.b WHERE mat.a < mat.b AND abs(r) > 0.6""",
        CORR_CTE,
    ),
)
def corr_drop(spark, folder):
    return rounded(S.correlated_drop(S.correlations(corr_source(spark, folder), CORR), 0.6))


@query("monthly_goals", fx_sql(f"SELECT strftime(match_date, '%Y-%m') AS month, {r('avg(fthg + ftag)')} AS goals FROM m GROUP BY 1"))
def monthly_goals(spark, folder):
    month = F.date_format("match_date", "yyyy-MM").alias("month")
    return rounded(contests(spark, folder).groupBy(month).agg(F.avg(F.col("fthg") + F.col("ftag")).alias("goals")))


@query("pivot_heatmap", fx_sql(f"SELECT home_team, away_team, {r('avg(fthg)')} AS goals FROM m GROUP BY home_team, away_team"))
def pivot_heatmap(spark, folder):
    """Cells of the home by away grid in long form, so no team needs a column."""
    return rounded(contests(spark, folder).groupBy("home_team", "away_team").agg(F.avg("fthg").alias("goals")))


@query(
    "team_error",
    sc_sql(
        f"""SELECT team, {r('avg(e)')} AS mean_error FROM (SELECT home_team AS team, abs(2 * ph + pd - fthg) AS e FROM sc
        UNION ALL SELECT away_team, abs(2 * pa + pd - ftag) FROM sc) GROUP BY team"""
    ),
)
def team_error(spark, folder):
    rows = scored(spark, folder).select(F.inline(F.expr(
        """array(struct(home_team AS team, abs(2 * ph + pd - fthg) AS e), struct(away_team AS team, abs(2 * pa + pd - ftag) AS e))"""
    )))
    return rounded(rows.groupBy("team").agg(F.avg("e").alias("mean_error")).orderBy(F.desc("mean_error")))


@query(
    "error_histogram",
    sc_sql(
        """SELECT league, CAST(least(floor((e - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS n
        FROM (SELECT league, round(2 * ph + pd - fthg, 6) AS e FROM sc),
        (SELECT min(round(2 * ph + pd - fthg, 6)) AS lo, max(round(2 * ph + pd - fthg, 6)) AS hi FROM sc) GROUP BY ALL"""
    ),
)
def error_histogram(spark, folder):
    rows = scored(spark, folder).select("league", F.expr("round(2 * ph + pd - fthg, 6) AS e"))
    return S.histogram(rows, ["league"], "e")


@query(
    "team_vs_league",
    tv_sql(
        "SELECT league, team, " + ", ".join(f"{r(f'avg({c})')} AS team_{c}" for c in ("gf", "shots", "corners")) + ", "
        + ", ".join(f"{r(f'max(l_{c})')} AS league_{c}" for c in ("gf", "shots", "corners"))
        + """ FROM tv JOIN (SELECT league, avg(gf) AS l_gf, avg(shots) AS l_shots, avg(corners) AS l_corners FROM tv GROUP BY league)
        USING (league) GROUP BY league, team"""
    ),
)
def team_vs_league(spark, folder):
    return rounded(S.team_vs_league(team_view(contests(spark, folder), stats=["gf", "shots", "corners"]), ["gf", "shots", "corners"]))


@query("distinct_teams", fx_sql("SELECT home_team AS team FROM fx UNION SELECT away_team FROM fx"))
def distinct_teams(spark, folder):
    df = fixtures(spark, folder)
    return df.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


@query(
    "category_crosstab",
    fx_sql(
        """SELECT referee, count(*) AS n, count(*) FILTER (WHERE ftr = 'H') AS h, count(*) FILTER (WHERE ftr = 'D') AS d,
        count(*) FILTER (WHERE ftr = 'A') AS a FROM m GROUP BY referee"""
    ),
)
def category_crosstab(spark, folder):
    df = contests(spark, folder)
    wide = df.groupBy("referee").pivot("ftr", ["H", "D", "A"]).count().fillna(0)
    return wide.select("referee", F.expr("H + D + A AS n"), F.col("H").alias("h"), F.col("D").alias("d"), F.col("A").alias("a"))


@query(
    "group_quartiles",
    fx_sql(
        f"""SELECT referee, CAST(min(hc + ac) AS DOUBLE) AS low, {r('quantile_cont(hc + ac, 0.25)')} AS p25,
        {r('quantile_cont(hc + ac, 0.5)')} AS p50, {r('quantile_cont(hc + ac, 0.75)')} AS p75, CAST(max(hc + ac) AS DOUBLE) AS high
        FROM m GROUP BY referee"""
    ),
)
def group_quartiles(spark, folder):
    df = contests(spark, folder).select("referee", (F.col("hc") + F.col("ac")).alias("corners"))
    return rounded(S.group_quartiles(df, ["referee"], "corners"))
