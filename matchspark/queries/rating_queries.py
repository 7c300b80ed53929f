"""Elo, league table before kickoff, matchup differences, the assembled row."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import ratings as R
from matchspark.operators import windows as W
from matchspark.queries.market_queries import MARKET_CTE
from matchspark.queries.registry import query, rounded
from matchspark.queries.sql_parts import KEY, r, sides, tv_sql
from matchspark.queries.window_queries import AVG, H2H_CTE, RECENT, REST_CTE, prior_cte, recent_cte
from matchspark.sources.fixtures import contests

ELO_CTE = f"""
teams AS (SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS INT) AS slot FROM nation),
numbered AS (SELECT league, match_id, h.slot AS h, a.slot AS a, fthg, ftag,
  row_number() OVER (PARTITION BY league ORDER BY {KEY}) AS seq
  FROM m JOIN teams h ON h.n_name = home_team JOIN teams a ON a.n_name = away_team),
el AS (
 SELECT league, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS DOUBLE) AS home_elo,
  CAST(NULL AS DOUBLE) AS away_elo, list_transform(range(25), lambda i: 1500.0::DOUBLE) AS rt
  FROM (SELECT DISTINCT league FROM m)
 UNION ALL
 SELECT e.league, n.seq, n.match_id, e.rt[n.h], e.rt[n.a],
  list_transform(e.rt, lambda v, i: CASE WHEN i = n.h THEN v + d WHEN i = n.a THEN v - d ELSE v END)
 FROM el e JOIN (SELECT * FROM numbered) n ON n.league = e.league AND n.seq = e.seq + 1,
 LATERAL (SELECT 20.0 * (CASE WHEN n.fthg > n.ftag THEN 1.0 WHEN n.fthg = n.ftag THEN 0.5 ELSE 0.0 END
   - 1.0 / (1.0 + pow(10.0, (e.rt[n.a] - (e.rt[n.h] + 60.0)) / 400.0))) AS d)),
elo AS (SELECT match_id, home_elo, away_elo, home_elo + 60.0 - away_elo AS elo_diff FROM el WHERE seq > 0)"""


@query(
    "elo_ratings",
    tv_sql(
        """SELECT match_id, round(home_elo + 1e-9, 4) AS home_elo, round(away_elo + 1e-9, 4) AS away_elo,
        round(elo_diff + 1e-9, 4) AS elo_diff FROM elo""",
        ELO_CTE,
    ),
)
def elo_ratings(spark, folder):
    return rounded(R.elo_ratings(contests(spark, folder)), 4)


RANK_CTE = f"""
roster AS (SELECT DISTINCT league, season, team FROM tv),
numb AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY {KEY}) AS k FROM m),
hist AS (SELECT tv.league, tv.season, tv.team, numb.k,
   sum(points) OVER w AS p, sum(gf - ga) OVER w AS gd, sum(gf) OVER w AS g
   FROM tv JOIN numb USING (match_id) WINDOW w AS (PARTITION BY tv.league, tv.season, tv.team ORDER BY k)),
spine AS (SELECT numb.league, numb.season, numb.match_id, numb.k, numb.home_team, numb.away_team, r.team
   FROM numb JOIN roster r ON r.league = numb.league AND r.season = numb.season),
state AS (SELECT s.*, h.p, h.gd, h.g FROM spine s ASOF LEFT JOIN hist h
   ON h.league = s.league AND h.season = s.season AND h.team = s.team AND h.k < s.k),
ranked AS (SELECT match_id, team, home_team, away_team, row_number() OVER (PARTITION BY match_id
   ORDER BY COALESCE(p, 0) DESC, COALESCE(gd, 0) DESC, COALESCE(g, 0) DESC, team) AS rk
   FROM state WHERE p IS NOT NULL OR team = home_team OR team = away_team),
rnk AS (SELECT match_id, CAST(max(CASE WHEN team = home_team THEN rk END) AS INT) AS home_season_rank_prior,
   CAST(max(CASE WHEN team = away_team THEN rk END) AS INT) AS away_season_rank_prior FROM ranked GROUP BY match_id)"""


@query(
    "prior_rank",
    tv_sql(
        """SELECT *, CAST(away_season_rank_prior - home_season_rank_prior AS INT) AS season_rank_diff FROM rnk""",
        RANK_CTE,
    ),
)
def prior_rank(spark, folder):
    return R.prior_rank(contests(spark, folder))


def _side_cte() -> list[str]:
    all_time = {n: AVG[n] for n in W.ALL_TIME if n != "matches_played"}
    return [
        prior_cte("pa", "league, team"),
        prior_cte("ps", "league, season, team"),
        prior_cte("pv", "league, team, is_home"),
        recent_cte("rf"),
        REST_CTE,
        f"fa AS ({sides({**all_time, 'matches_played': 's_n'}, 'pa', None)})",
        f"fs AS ({sides({'season_' + n: AVG[n] for n in W.SEASON} | {'season_played': 's_n'}, 'ps', None)})",
        f"fv AS ({sides({'venue_' + n: AVG[n] for n in W.VENUE}, 'pv', None)})",
        f"fr AS ({sides({n: n for n in RECENT}, 'rf', None)})",
        f"fd AS ({sides({'rest_days': 'rest_days'}, 'rd', None)})",
    ]


def _diff(c: str) -> str:
    return f"home_{c} - away_{c}"


MATCHUP_SQL = {
    "rest_days_diff": _diff("rest_days"),
    "short_rest_home": "CAST(CASE WHEN home_rest_days <= 3 THEN 1 ELSE 0 END AS DOUBLE)",
    "short_rest_away": "CAST(CASE WHEN away_rest_days <= 3 THEN 1 ELSE 0 END AS DOUBLE)",
    "points_ppm_diff": _diff("points_per_match"),
    "win_rate_diff": _diff("win_rate"),
    "goal_diff_ppm_diff": "home_goals_for_per_match - home_goals_against_per_match"
    " - (away_goals_for_per_match - away_goals_against_per_match)",
    "shots_on_target_ppm_diff": _diff("shots_on_target_per_match"),
    "corners_ppm_diff": _diff("corners_per_match"),
    "conversion_rate_diff": _diff("conversion_rate"),
    "season_points_ppm_diff": _diff("season_points_per_match"),
    "season_goal_diff_ppm_diff": _diff("season_goal_diff_per_match"),
    "recent_5_points_diff": _diff("recent_5_points_per_match"),
    "recent_5_goal_diff_diff": _diff("recent_5_goal_diff"),
    "recent_10_points_diff": _diff("recent_10_points_per_match"),
    "recent_10_goal_diff_diff": _diff("recent_10_goal_diff"),
}


def _matchup_select() -> str:
    return ", ".join(
        f"{e} AS {n}" if n.endswith(("rest_home", "rest_away", "rest_days_diff")) else f"{r(e)} AS {n}"
        for n, e in MATCHUP_SQL.items()
    )


@query(
    "matchup_diffs",
    tv_sql(
        f"SELECT match_id, {_matchup_select()} FROM fa JOIN fs USING (match_id) JOIN fr USING (match_id)"
        " JOIN fd USING (match_id)",
        *_side_cte(),
    ),
)
def matchup_diffs(spark, folder):
    features = R.side_features(contests(spark, folder))
    return rounded(features.select("match_id", *[F.expr(e).alias(n) for n, e in R.MATCHUP.items()]))


FEATURE_SQL = {
    "matchday": "CAST(greatest(home_season_played, away_season_played) + 1 AS BIGINT)",
    "home_matches_played": "CAST(home_matches_played AS BIGINT)",
    "away_matches_played": "CAST(away_matches_played AS BIGINT)",
    "home_recent_points_per_match": "home_recent_5_points_per_match",
    "away_recent_points_per_match": "away_recent_5_points_per_match",
    "home_recent_goal_diff": "home_recent_5_goal_diff",
    "away_recent_goal_diff": "away_recent_5_goal_diff",
    "h2h_home_points_per_match": "CASE WHEN ah THEN pa ELSE pb END",
    "h2h_home_goal_diff_per_match": "CASE WHEN ah THEN ga WHEN ga = 0 THEN 0 ELSE -ga END",
    "h2h_matches": "n",
    "season_rank_diff": "CAST(away_season_rank_prior - home_season_rank_prior AS INT)",
    "is_home_promoted_proxy": "CASE WHEN home_matches_played < 15 AND season_age > 0 THEN 1 ELSE 0 END",
    "is_away_promoted_proxy": "CASE WHEN away_matches_played < 15 AND season_age > 0 THEN 1 ELSE 0 END",
    **MATCHUP_SQL,
}
WHOLE = {
    "matchday", "home_rest_days", "away_rest_days", "home_season_rank_prior", "away_season_rank_prior",
    "season_rank_diff", "home_matches_played", "away_matches_played", "rest_days_diff",
    "is_home_promoted_proxy", "is_away_promoted_proxy", "season_age",
}


def features_sql() -> str:
    cols = []
    for name in R.feature_columns():
        expr = FEATURE_SQL.get(name, name)
        cols.append(f"{expr} AS {name}" if name in WHOLE else f"{r(expr, 4)} AS {name}")
    return tv_sql(
        "SELECT " + ", ".join(f"mk.{c}" for c in R.LABELS) + ", " + ", ".join(cols)
        + """ FROM mk JOIN fa USING (match_id) JOIN fs USING (match_id) JOIN fv USING (match_id)
        JOIN fr USING (match_id) JOIN fd USING (match_id) JOIN elo USING (match_id) JOIN rnk USING (match_id)
        JOIN hh USING (match_id) JOIN ages ON ages.league = mk.league AND ages.season = mk.season""",
        *_side_cte(), ELO_CTE, RANK_CTE, H2H_CTE, MARKET_CTE,
        """ages AS (SELECT league, season,
           CAST(row_number() OVER (PARTITION BY league ORDER BY season) - 1 AS INT) AS season_age
           FROM (SELECT DISTINCT league, season FROM m))""",
    )


@query("temporal_features", features_sql())
def temporal_features(spark, folder):
    return rounded(R.temporal_features(contests(spark, folder)), 4)
