"""Joins on the team dimension and on child events."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import dimensions as D
from matchspark.operators.market import with_market
from matchspark.operators.team_view import team_view
from matchspark.queries.market_queries import MARKET_CTE
from matchspark.queries.registry import query, rounded
from matchspark.queries.sql_parts import fx_sql, r, tv_sql
from matchspark.sources.fixtures import contests
from matchspark.sources.tables import table

STATS_CTE = """stats AS (SELECT n_name AS team, played, attack, shots, passes, defence FROM nation
 LEFT JOIN (SELECT c_nationkey AS k, count(*) AS played, avg(c_acctbal) AS attack FROM customer GROUP BY 1) a ON a.k = n_nationkey
 LEFT JOIN (SELECT c_nationkey AS k, count(*) AS shots FROM customer WHERE c_acctbal > 5000 GROUP BY 1) b ON b.k = n_nationkey
 LEFT JOIN (SELECT s_nationkey AS k, count(*) AS passes FROM supplier GROUP BY 1) c ON c.k = n_nationkey
 LEFT JOIN (SELECT s_nationkey AS k, min(s_acctbal) AS defence FROM supplier WHERE s_acctbal < 0 GROUP BY 1) d ON d.k = n_nationkey)"""


@query("dim_chain_join", f"WITH {STATS_CTE} SELECT team, played, {r('attack', 3)} AS attack, shots, passes, defence FROM stats")
def dim_chain_join(spark, folder):
    return rounded(D.team_stats(spark, folder), 3)


@query(
    "two_role_join",
    tv_sql(
        f"""SELECT tv.match_id, tv.team, tv.opponent, a.played AS played_tm, b.played AS played_opp, {r('a.attack', 3)} AS attack_tm,
        {r('b.attack', 3)} AS attack_opp, a.defence AS defence_tm, b.defence AS defence_opp FROM tv
        LEFT JOIN stats a ON a.team = tv.team LEFT JOIN stats b ON b.team = tv.opponent""",
        STATS_CTE,
    ),
)
def two_role_join(spark, folder):
    joined = D.two_roles(team_view(contests(spark, folder), stats=[]), D.team_stats(spark, folder))
    return rounded(joined.select("match_id", "team", "opponent", "played_tm", "played_opp", "attack_tm", "attack_opp",
                                 "defence_tm", "defence_opp"), 3)


@query(
    "event_counts_join",
    tv_sql(
        """SELECT tv.match_id, tv.is_home, tv.team, COALESCE(y, 0) AS yellow_events, COALESCE(s, 0) AS second_events
        FROM tv LEFT JOIN (SELECT l_orderkey AS match_id, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS is_home,
          count(*) FILTER (WHERE l_returnflag = 'R') AS y, count(*) FILTER (WHERE l_returnflag = 'A') AS s
          FROM lineitem GROUP BY 1, 2) c ON c.match_id = tv.match_id AND c.is_home = tv.is_home"""
    ),
)
def event_counts_join(spark, folder):
    children = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0).alias("is_home"),
        F.when(F.col("l_returnflag") == "R", "Yellow").when(F.col("l_returnflag") == "A", "Second").alias("card"),
    )
    rows = D.with_event_counts(team_view(contests(spark, folder), stats=[]), children)
    return rows.select("match_id", "is_home", "team", "yellow_events", "second_events")


@query(
    "referee_strictness",
    fx_sql(
        f"""SELECT match_id, referee, {r('avg_cards')} AS avg_cards, {r('std_cards')} AS std_cards, {r('avg_reds')} AS avg_reds
        FROM m JOIN (SELECT referee, avg(hy + ay) AS avg_cards, stddev_samp(hy + ay) AS std_cards, avg(hr + ar) AS avg_reds
          FROM m GROUP BY referee) USING (referee)"""
    ),
)
def referee_strictness(spark, folder):
    df = contests(spark, folder)
    return rounded(df.select("match_id", "referee").join(D.referee_profile(df), "referee"))


@query(
    "home_away_split",
    tv_sql(
        f"""SELECT team, {r('avg(CASE WHEN is_home = 1 THEN gf END)')} AS goals_home,
        {r('avg(CASE WHEN is_home = 0 THEN gf END)')} AS goals_away FROM tv GROUP BY team"""
    ),
)
def home_away_split(spark, folder):
    return rounded(D.home_away_split(team_view(contests(spark, folder), stats=["gf"])))


@query(
    "pred_vs_actual",
    fx_sql(
        f"""SELECT concat_ws('_', season, home_team, away_team, CAST(match_id AS VARCHAR)) AS match_key, kind,
        {r('pred_home')} AS predicted_home, {r('pred_away')} AS predicted_away, actual_home, actual_away FROM (
        SELECT *, 'goals' AS kind, market_home_prob * 2 + market_draw_prob AS pred_home,
          market_away_prob * 2 + market_draw_prob AS pred_away, fthg AS actual_home, ftag AS actual_away FROM mk
        UNION ALL SELECT *, 'corners', hst * 0.5, ast * 0.5, hc, ac FROM mk
        UNION ALL SELECT *, 'cards', hc * 0.2, ac * 0.2, hy, ay FROM mk)""",
        MARKET_CTE,
    ),
)
def pred_vs_actual(spark, folder):
    df = with_market(contests(spark, folder))
    key = F.concat_ws("_", "season", "home_team", "away_team", F.col("match_id").cast("string")).alias("match_key")
    kinds = F.expr(
        """array(
        struct('goals' AS kind, market_home_prob * 2 + market_draw_prob AS predicted_home,
          market_away_prob * 2 + market_draw_prob AS predicted_away, fthg AS actual_home, ftag AS actual_away),
        struct('corners' AS kind, hst * 0.5D AS predicted_home, ast * 0.5D AS predicted_away, hc AS actual_home, ac AS actual_away),
        struct('cards' AS kind, hc * 0.2D AS predicted_home, ac * 0.2D AS predicted_away, hy AS actual_home, ay AS actual_away))"""
    )
    return rounded(df.select(key, F.inline(kinds)))
