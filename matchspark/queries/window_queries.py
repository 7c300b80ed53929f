"""Team view and features known before kickoff."""

from __future__ import annotations

from matchspark.operators import windows as W
from matchspark.operators.team_view import team_view as to_team_view
from matchspark.queries.registry import query, rounded
from matchspark.queries.sql_parts import KEY, fx_sql, sides, tv_sql
from matchspark.sources.fixtures import contests, fixtures

TEAM_W = f"PARTITION BY league, team ORDER BY {KEY}"


@query("fixture_facts", fx_sql("SELECT * FROM fx"))
def fixture_facts(spark, folder):
    return fixtures(spark, folder)


@query(
    "team_view",
    tv_sql("""SELECT match_id, league, season, match_date, is_home, team, opponent, gf, ga, shots, sot,
    corners, yellows, points FROM tv"""),
)
def team_view(spark, folder):
    return to_team_view(contests(spark, folder)).select(
        "match_id", "league", "season", "match_date", "is_home", "team", "opponent", "gf", "ga", "shots", "sot",
        "corners", "yellows", "points",
    )


SUMS = {
    "n": "1",
    "p": "points",
    "gf": "gf",
    "ga": "ga",
    "sh": "COALESCE(shots, 0)",
    "st": "COALESCE(sot, 0)",
    "co": "COALESCE(corners, 0)",
    "ye": "COALESCE(yellows, 0)",
    "w": "CASE WHEN gf > ga THEN 1 ELSE 0 END",
    "d": "CASE WHEN gf = ga THEN 1 ELSE 0 END",
    "l": "CASE WHEN gf < ga THEN 1 ELSE 0 END",
}
AVG = {
    "points_per_match": "s_p / greatest(s_n, 1)",
    "goals_for_per_match": "s_gf / greatest(s_n, 1)",
    "goals_against_per_match": "s_ga / greatest(s_n, 1)",
    "shots_per_match": "s_sh / greatest(s_n, 1)",
    "shots_on_target_per_match": "s_st / greatest(s_n, 1)",
    "corners_per_match": "s_co / greatest(s_n, 1)",
    "cards_per_match": "s_ye / greatest(s_n, 1)",
    "shot_accuracy": "s_st / greatest(s_sh, 1)",
    "conversion_rate": "s_gf / greatest(s_sh, 1)",
    "goals_per_shot_on_target": "s_gf / greatest(s_st, 1)",
    "win_rate": "s_w / greatest(s_n, 1)",
    "draw_rate": "s_d / greatest(s_n, 1)",
    "loss_rate": "s_l / greatest(s_n, 1)",
    "goal_diff_per_match": "(s_gf - s_ga) / greatest(s_n, 1)",
}


def prior_cte(name: str, partition: str) -> str:
    cols = ", ".join(f"CAST(COALESCE(sum({e}) OVER w, 0) AS DOUBLE) AS s_{n}" for n, e in SUMS.items())
    return (
        f"{name} AS (SELECT match_id, is_home, {cols} FROM tv WINDOW w AS (PARTITION BY {partition} ORDER BY {KEY}"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    )


def _averages_sql(partition: str, names: list[str], prefix: str) -> str:
    cols = {f"{prefix}{n}": AVG[n] for n in names if n != "matches_played"}
    body = sides(cols, "pr")
    if "matches_played" in names:
        body = body.replace(
            " FROM pr",
            ", CAST(max(CASE WHEN is_home = 1 THEN s_n END) AS BIGINT) AS home_matches_played"
            ", CAST(max(CASE WHEN is_home = 0 THEN s_n END) AS BIGINT) AS away_matches_played FROM pr",
        )
    return tv_sql(body, prior_cte("pr", partition))


@query("prior_averages", _averages_sql("league, team", W.ALL_TIME, ""))
def prior_averages(spark, folder):
    return rounded(W.prior_averages(contests(spark, folder)))


@query("season_to_date", _averages_sql("league, season, team", W.SEASON, "season_"))
def season_to_date(spark, folder):
    return rounded(W.season_to_date(contests(spark, folder)))


@query("venue_form", _averages_sql("league, team, is_home", W.VENUE, "venue_"))
def venue_form(spark, folder):
    return rounded(W.venue_form(contests(spark, folder)))


def recent_cte(name: str = "rf") -> str:
    cols = []
    for n in (3, 5, 10):
        frame = f"OVER ({TEAM_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols.append(f"COALESCE(avg(points) {frame}, 1.0) AS recent_{n}_points_per_match")
        cols.append(f"COALESCE(avg(gf - ga) {frame}, 0.0) AS recent_{n}_goal_diff")
        cols.append(f"COALESCE(avg(COALESCE(sot, 0)) {frame}, 0.0) AS recent_{n}_shots_on_target")
        cols.append(f"COALESCE(avg(COALESCE(corners, 0)) {frame}, 0.0) AS recent_{n}_corners")
    return f"{name} AS (SELECT match_id, is_home, {', '.join(cols)} FROM tv)"


RECENT = [
    f"recent_{n}_{c}" for n in (3, 5, 10) for c in ("points_per_match", "goal_diff", "shots_on_target", "corners")
]


@query("recent_form", tv_sql(sides({c: c for c in RECENT}, "rf"), recent_cte()))
def recent_form(spark, folder):
    return rounded(W.recent_form(contests(spark, folder)))


H2H_CTE = f"""
orient AS (SELECT *, least(home_team, away_team) AS ta, greatest(home_team, away_team) AS tb FROM m),
hh AS (SELECT match_id,
  COALESCE(avg(CASE WHEN home_team = ta THEN CASE WHEN fthg > ftag THEN 3 WHEN fthg = ftag THEN 1 ELSE 0 END
      ELSE CASE WHEN ftag > fthg THEN 3 WHEN fthg = ftag THEN 1 ELSE 0 END END) OVER w, 1.0) AS pa,
  COALESCE(avg(CASE WHEN home_team = tb THEN CASE WHEN fthg > ftag THEN 3 WHEN fthg = ftag THEN 1 ELSE 0 END
      ELSE CASE WHEN ftag > fthg THEN 3 WHEN fthg = ftag THEN 1 ELSE 0 END END) OVER w, 1.0) AS pb,
  COALESCE(avg(CASE WHEN home_team = ta THEN fthg - ftag ELSE ftag - fthg END) OVER w, 0.0) AS ga,
  CAST(count(*) OVER w AS DOUBLE) AS n, home_team = ta AS ah
 FROM orient WINDOW w AS (PARTITION BY league, ta, tb ORDER BY {KEY} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))"""


@query(
    "h2h_last6",
    fx_sql(
        """SELECT match_id, round(CASE WHEN ah THEN pa ELSE pb END + 1e-9, 6) AS h2h_home_points_per_match,
        round(CASE WHEN ah THEN ga WHEN ga = 0 THEN 0 ELSE -ga END + 1e-9, 6) AS h2h_home_goal_diff_per_match,
        n AS h2h_matches FROM hh""",
        H2H_CTE,
    ),
)
def h2h_last6(spark, folder):
    return rounded(W.h2h_last6(contests(spark, folder)))


REST_CTE = f"""rd AS (SELECT match_id, is_home, CAST(least(COALESCE(date_diff('day',
  lag(match_date) OVER ({TEAM_W}), match_date), 7), 21) AS INT) AS rest_days FROM tv)"""


@query("rest_days", tv_sql(sides({"rest_days": "rest_days"}, "rd", None), REST_CTE))
def rest_days(spark, folder):
    return W.rest_days(contests(spark, folder))


@query(
    "matchday",
    tv_sql(
        "SELECT match_id, CAST(max(n) + 1 AS BIGINT) AS matchday FROM c GROUP BY match_id",
        f"c AS (SELECT match_id, row_number() OVER (PARTITION BY league, season, team ORDER BY {KEY}) - 1 AS n FROM tv)",
    ),
)
def matchday(spark, folder):
    return W.matchday(contests(spark, folder))


@query(
    "promoted_proxy",
    tv_sql(
        """SELECT match_id,
        max(CASE WHEN is_home = 1 AND n < 15 AND age > 0 THEN 1 ELSE 0 END) AS is_home_promoted_proxy,
        max(CASE WHEN is_home = 0 AND n < 15 AND age > 0 THEN 1 ELSE 0 END) AS is_away_promoted_proxy,
        max(age) AS season_age FROM c JOIN a USING (league, season) GROUP BY match_id""",
        f"""c AS (SELECT match_id, league, season, is_home,
            row_number() OVER (PARTITION BY league, team ORDER BY {KEY}) - 1 AS n FROM tv)""",
        """a AS (SELECT league, season, CAST(row_number() OVER (PARTITION BY league ORDER BY season) - 1 AS INT) AS age
            FROM (SELECT DISTINCT league, season FROM m))""",
    ),
)
def promoted_proxy(spark, folder):
    return W.promoted_proxy(contests(spark, folder))


@query(
    "asof_state",
    tv_sql(
        f"""SELECT match_id, team, lag(opponent) OVER ({TEAM_W}) AS last_opponent,
        lag(gf) OVER ({TEAM_W}) AS last_gf, lag(match_date) OVER ({TEAM_W}) AS last_date FROM tv"""
    ),
)
def asof_state(spark, folder):
    return W.asof_state(contests(spark, folder))


ROLL_EXPR = {
    "gf": "gf",
    "ga": "ga",
    "corners": "corners",
    "yellows": "yellows",
    "shot_accuracy": "sot / CAST(CASE WHEN shots = 0 THEN 1 ELSE shots END AS DOUBLE)",
}


@query(
    "rolling_means",
    tv_sql(
        "SELECT match_id, team, "
        + ", ".join(
            f"round(avg({e}) OVER ({TEAM_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS {c}_last{w}"
            for c, e in ROLL_EXPR.items()
            for w in (3, 5)
        )
        + " FROM tv WHERE is_home = 1"
    ),
)
def rolling_means(spark, folder):
    return rounded(W.rolling_means(contests(spark, folder)))


@query(
    "opponent_strength",
    fx_sql(
        """SELECT match_id, round(avg(CASE WHEN fthg > ftag THEN 3 WHEN fthg = ftag THEN 1 ELSE 0 END) OVER (
        PARTITION BY league, away_team ORDER BY match_date, home_team, match_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS opp_ppg FROM m"""
    ),
)
def opponent_strength(spark, folder):
    return rounded(W.opponent_strength(contests(spark, folder)))


def _form_cte(extra: int) -> str:
    lags = [f"lag(points, {i + 1}) OVER ({TEAM_W})" for i in range(5)]
    num = " + ".join(f"COALESCE({w} * {x}, 0)" for w, x in zip(W.FORM_WEIGHTS, lags))
    used = " + ".join(f"CASE WHEN seen + {extra} > {i} THEN {w}::DOUBLE ELSE 0 END" for i, w in enumerate(W.FORM_WEIGHTS))
    return (
        f"wf0 AS (SELECT match_id, is_home, CAST({num} AS DOUBLE) AS num,"
        f" row_number() OVER ({TEAM_W}) - 1 AS seen FROM tv),"
        f" wf AS (SELECT match_id, is_home, CASE WHEN seen > 0 THEN num / ({used}) END AS form FROM wf0)"
    )


def _form_sql(extra: int) -> str:
    body = sides({"form": "form"}, "wf").replace(
        " FROM wf",
        """, round(max(CASE WHEN is_home = 1 THEN form END) * max(CASE WHEN is_home = 0 THEN form END) + 1e-9, 6)
        AS form_x_opponent FROM wf""",
    )
    return tv_sql(body, _form_cte(extra))


@query("weighted_form", _form_sql(0))
def weighted_form(spark, folder):
    return rounded(W.weighted_form(contests(spark, folder)))


@query("weighted_form_literal", _form_sql(1))
def weighted_form_literal(spark, folder):
    return rounded(W.weighted_form(contests(spark, folder), literal=True))


@query(
    "ewm_form",
    tv_sql(
        "SELECT match_id, team, round(lag(y) OVER (PARTITION BY league, team ORDER BY k) + 1e-9, 6) AS ewm_points FROM e",
        f"s AS (SELECT *, row_number() OVER ({TEAM_W}) AS k FROM tv)",
        """e AS (SELECT match_id, league, team, k, CAST(points AS DOUBLE) AS y FROM s WHERE k = 1
        UNION ALL SELECT s.match_id, s.league, s.team, s.k, e.y * (1 - 2.0E0 / 6) + s.points * (2.0E0 / 6)
        FROM e JOIN s ON s.league = e.league AND s.team = e.team AND s.k = e.k + 1)""",
    ),
)
def ewm_form(spark, folder):
    return rounded(W.ewm_form(contests(spark, folder)))


@query(
    "tackle_rate",
    tv_sql(
        """SELECT match_id, team, round(sum(sot) OVER w / CAST(CASE WHEN sum(shots) OVER w = 0 THEN 1
        ELSE sum(shots) OVER w END AS DOUBLE) + 1e-9, 6) AS team_rate FROM tv WINDOW w AS (PARTITION BY league, team)"""
    ),
)
def tackle_rate(spark, folder):
    return rounded(W.tackle_rate(contests(spark, folder)))


FORM_SQL = {
    "wins": "CASE WHEN gf > ga THEN 1 ELSE 0 END",
    "draws": "CASE WHEN gf = ga THEN 1 ELSE 0 END",
    "losses": "CASE WHEN gf < ga THEN 1 ELSE 0 END",
    "goals_scored": "gf",
    "goals_conceded": "ga",
    "corners_for": "corners",
    "corners_against": "corners_against",
    "yellow_cards": "yellows",
}


@query(
    "form_minmatches",
    tv_sql(
        sides(
            {n: f"CASE WHEN n >= 2 THEN v_{n} * CASE WHEN is_home = 1 THEN 1.2E0 ELSE 1 END END" for n in FORM_SQL}, "j"
        ),
        f"""td AS (SELECT DISTINCT league, team, match_date AS d FROM tv)""",
        f"""pick3 AS (SELECT td.*, tv.*, row_number() OVER (PARTITION BY td.league, td.team, td.d
            ORDER BY tv.match_date DESC, tv.home_team DESC, tv.away_team DESC, tv.match_id DESC) AS rn
            FROM td JOIN tv ON tv.league = td.league AND tv.team = td.team AND tv.match_date < td.d
            AND tv.status = 'completed')""",
        "st AS (SELECT league, team, d, count(*) AS n, "
        + ", ".join(f"avg({e}) AS v_{n}" for n, e in FORM_SQL.items())
        + " FROM pick3 WHERE rn <= 3 GROUP BY league, team, d)",
        """j AS (SELECT tv.match_id, tv.is_home, st.* FROM tv LEFT JOIN st
            ON st.league = tv.league AND st.team = tv.team AND st.d = tv.match_date)""",
    ),
)
def form_minmatches(spark, folder):
    return rounded(W.form_minmatches(contests(spark, folder)))


@query(
    "h2h_all",
    fx_sql(
        """SELECT a.match_id,
        round(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN sg > cg THEN 1 ELSE 0 END) + 1e-9, 6) AS h2h_wins,
        round(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN sg = cg THEN 1 ELSE 0 END) + 1e-9, 6) AS h2h_draws,
        round(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN sg < cg THEN 1 ELSE 0 END) + 1e-9, 6) AS h2h_losses,
        round(avg(sg) + 1e-9, 6) AS h2h_goals_scored, round(avg(cg) + 1e-9, 6) AS h2h_goals_conceded,
        round(avg(sc) + 1e-9, 6) AS h2h_corners_for, round(avg(cc) + 1e-9, 6) AS h2h_corners_against,
        round(avg(sy) + 1e-9, 6) AS h2h_yellow_cards
        FROM m a LEFT JOIN pair b ON b.league = a.league AND b.t = a.home_team AND b.o = a.away_team
          AND b.match_date < a.match_date GROUP BY a.match_id""",
        """pair AS (SELECT match_id, league, match_date, home_team AS t, away_team AS o, fthg AS sg, ftag AS cg,
            hc AS sc, ac AS cc, hy AS sy FROM m WHERE status = 'completed'
          UNION ALL SELECT match_id, league, match_date, away_team, home_team, ftag, fthg, ac, hc, ay
            FROM m WHERE status = 'completed')""",
    ),
)
def h2h_all(spark, folder):
    return rounded(W.h2h_all(contests(spark, folder)))


@query(
    "days_since_last",
    tv_sql(
        sides({"days_since_last": "CAST(date_diff('day', ld, match_date) AS INT)"}, "j", None).replace(
            " FROM j", ", max(CASE WHEN isodow(match_date) >= 6 THEN 1 ELSE 0 END) AS is_weekend FROM j"
        ),
        """j AS (SELECT match_id, is_home, match_date, max(CASE WHEN status = 'completed' THEN match_date END) OVER (
            PARTITION BY league, team ORDER BY match_date
            RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS ld FROM tv)""",
    ),
)
def days_since_last(spark, folder):
    return W.days_since_last(contests(spark, folder))
