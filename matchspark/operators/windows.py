"""Features known before kickoff: every frame ends strictly before the current match.

All functions take the match table and return one row per match (or per team-view row where the
name says so). Rows of a team are cut by match date, see :mod:`matchspark.plans.prior`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.team_view import by_match, points, team_view
from matchspark.plans.prior import (
    decayed_before,
    CELL,
    array_avg,
    last_n,
    rows_before,
    sums_of_last,
    tails_before_cell,
    totals_before,
    totals_before_cell,
    with_cell,
)
from matchspark.sources.fixtures import ORDER_KEY

TEAM = ["league", "team"]
OF_DAY = ["league", "match_date", "season"]
"""Columns by which matches are dealt out where all features of a match are made in one place."""
DAY = ["match_date"]
IN_DAY = ["home_team", "away_team", "match_id"]


def sides(matches: DataFrame, stats: Sequence[str] | None = None) -> DataFrame:
    """Team view cut into cells, with the named statistics."""
    return team_view(with_cell(matches), stats=stats)


GOALS = ["gf", "ga"]


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint")


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0).cast("bigint")


def totals(prefix: str = "") -> dict[str, Column]:
    """Summable columns of a team-view row; a missing statistic counts as 0."""
    out = {
        "matches": F.lit(1).cast("bigint"),
        "points_sum": _n("points"),
        "gf_sum": _n("gf"),
        "ga_sum": _n("ga"),
        "shots_sum": _n("shots"),
        "sot_sum": _n("sot"),
        "corners_sum": _n("corners"),
        "yellows_sum": _n("yellows"),
        "wins": _flag(F.col("gf") > F.col("ga")),
        "draws": _flag(F.col("gf") == F.col("ga")),
        "losses": _flag(F.col("gf") < F.col("ga")),
    }
    return {f"{prefix}{n}": c for n, c in out.items()}


def _one() -> Column:
    return F.lit(1).cast("bigint")


def averages(prefix: str = "", names: Sequence[str] | None = None, source: str = "") -> dict[str, Column]:
    """Per-match averages from running totals; a debut gives 0 because denominators start at 1."""
    games = f"greatest({source}matches, 1)"
    shots = f"greatest({source}shots_sum, 1)"
    on_target = f"greatest({source}sot_sum, 1)"
    out = {
        "points_per_match": f"{source}points_sum / {games}",
        "goals_for_per_match": f"{source}gf_sum / {games}",
        "goals_against_per_match": f"{source}ga_sum / {games}",
        "shots_per_match": f"{source}shots_sum / {games}",
        "shots_on_target_per_match": f"{source}sot_sum / {games}",
        "corners_per_match": f"{source}corners_sum / {games}",
        "cards_per_match": f"{source}yellows_sum / {games}",
        "shot_accuracy": f"{source}sot_sum / {shots}",
        "conversion_rate": f"{source}gf_sum / {shots}",
        "goals_per_shot_on_target": f"{source}gf_sum / {on_target}",
        "win_rate": f"{source}wins / {games}",
        "draw_rate": f"{source}draws / {games}",
        "loss_rate": f"{source}losses / {games}",
        "goal_diff_per_match": f"({source}gf_sum - {source}ga_sum) / {games}",
        "matches_played": f"{source}matches",
    }
    return {f"{prefix}{n}": F.expr(c) for n, c in out.items() if names is None or n in names}


ALL_TIME = [
    "points_per_match",
    "goals_for_per_match",
    "goals_against_per_match",
    "shots_per_match",
    "shots_on_target_per_match",
    "corners_per_match",
    "cards_per_match",
    "shot_accuracy",
    "conversion_rate",
    "goals_per_shot_on_target",
    "win_rate",
    "draw_rate",
    "loss_rate",
    "matches_played",
]
SEASON = ["points_per_match", "goal_diff_per_match", "shot_accuracy", "conversion_rate"]
VENUE = [
    "points_per_match",
    "win_rate",
    "loss_rate",
    "goal_diff_per_match",
    "goals_for_per_match",
    "goals_against_per_match",
    "shots_on_target_per_match",
]


def _prior(matches: DataFrame, keys: Sequence[str], names: Sequence[str], prefix: str = "") -> DataFrame:
    summed = totals_before(sides(matches), keys, [CELL], ORDER_KEY, totals())
    cols = averages(prefix, names)
    return by_match(summed.select("match_id", "is_home", *[c.alias(n) for n, c in cols.items()]), list(cols))


def prior_averages(matches: DataFrame) -> DataFrame:
    """All-time averages of both sides before the match."""
    return _prior(matches, TEAM, ALL_TIME)


def season_to_date(matches: DataFrame) -> DataFrame:
    """Averages of both sides within the running season."""
    return _prior(matches, [*TEAM, "season"], SEASON, "season_")


def venue_form(matches: DataFrame) -> DataFrame:
    """Home side at home, away side away."""
    return _prior(matches, [*TEAM, "is_home"], VENUE, "venue_")


RECENT_SUMS = {
    "p": "points",
    "gd": "gf - ga",
    "st": "coalesce(sot, 0)",
    "co": "coalesce(corners, 0)",
}


def recent_columns(windows: Sequence[int], source: str = "") -> dict[str, Column]:
    """Form from window sums (named with ``source`` in front); without history points are 1.0 and the rest 0."""
    out = {}
    for n in windows:
        for field, name, default in (
            ("p", "points_per_match", 1.0),
            ("gd", "goal_diff", 0.0),
            ("st", "shots_on_target", 0.0),
            ("co", "corners", 0.0),
        ):
            out[f"recent_{n}_{name}"] = F.expr(
                f"CASE WHEN {source}count_{n} > 0 THEN {source}{field}_{n} / {source}count_{n} ELSE {default}D END"
            )
    return out


def recent_form(matches: DataFrame, windows: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """Last-n form of both sides over all venues and seasons."""
    looked = sums_of_last(sides(matches, [*GOALS, "sot", "corners"]), TEAM, [CELL], ORDER_KEY, windows, RECENT_SUMS)
    cols = recent_columns(windows)
    return by_match(looked.select("match_id", "is_home", *[c.alias(n) for n, c in cols.items()]), list(cols))


def _oriented(matches: DataFrame, *keep: str) -> DataFrame:
    """Pair key plus the result seen from the alphabetically first side of the pair."""
    first_home = F.col("home_team") < F.col("away_team")
    return with_cell(matches).select(CELL, 
        "match_id", "league", "season", "match_date", "home_team", "away_team", *keep,
        F.least("home_team", "away_team").alias("team_a"),
        F.greatest("home_team", "away_team").alias("team_b"),
        F.when(first_home, 1).otherwise(0).alias("a_home"),
        F.when(first_home, F.col("fthg")).otherwise(F.col("ftag")).alias("a_goals"),
        F.when(first_home, F.col("ftag")).otherwise(F.col("fthg")).alias("b_goals"),
    )


def h2h_last6(matches: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    """Last six meetings of the pair, seen from today's home side; with ``dealt`` the rows lie, and join, by these columns."""
    pair, item = ["league", "team_a", "team_b"], F.struct("a_goals", "b_goals")
    if dealt:
        rows = rows_before(
            _oriented(matches.repartition(*dealt)), pair, ["match_date", "season"], ORDER_KEY, 6, item, plain=_oriented(matches), dealt=dealt
        )
    else:
        rows = rows_before(_oriented(matches), pair, [CELL], ORDER_KEY, 6, item)
    a_home = F.col("a_home") == 1

    def own(x: Column) -> Column:
        return F.when(a_home, x["a_goals"]).otherwise(x["b_goals"])

    def other(x: Column) -> Column:
        return F.when(a_home, x["b_goals"]).otherwise(x["a_goals"])

    prior = F.col("prior")
    return rows.select(
        "match_id", *dealt,
        array_avg(prior, lambda x: points(own(x), other(x)), F.lit(1.0)).alias("h2h_home_points_per_match"),
        array_avg(prior, lambda x: own(x) - other(x), F.lit(0.0)).alias("h2h_home_goal_diff_per_match"),
        F.size(prior).cast("double").alias("h2h_matches"),
    )


def rest_days(matches: DataFrame) -> DataFrame:
    """Days since the last match of each side in any season; first match 7, at most 21."""
    looked = totals_before(
        sides(matches, []), TEAM, [CELL], ORDER_KEY, {}, latest={"last_date": F.col("match_date")}
    )
    return by_match(looked.select("match_id", "is_home", rest_column().alias("rest_days")), ["rest_days"])


def rest_column() -> Column:
    return F.expr("least(coalesce(datediff(match_date, last_date), 7), 21)")


def matchday(matches: DataFrame) -> DataFrame:
    """Round number: more season matches of the two sides, plus one."""
    counted = totals_before(sides(matches, []), [*TEAM, "season"], [CELL], ORDER_KEY, {"played": _one()})
    return counted.groupBy("match_id").agg((F.max("played") + 1).alias("matchday"))


def season_ages(matches: DataFrame) -> DataFrame:
    """Seasons of each league in order: age counted from the first one."""
    seasons = matches.select("league", "season").distinct()
    order = Window.partitionBy("league").orderBy("season")
    return seasons.withColumn("season_age", F.dense_rank().over(order) - 1)


def promoted_proxy(matches: DataFrame, least: int = 15) -> DataFrame:
    """Side with under 15 earlier matches outside the first season; age of the season.

    Only the first 15 rows of a side have fewer before them, so only these (dropped down to 15 in each task before the
    shuffle) are numbered and marked; no other row leaves its place but for the mark of its match.
    """
    first = Window.partitionBy(*TEAM).orderBy("match_date", "season", "home_team", "away_team", "match_id")
    early = team_view(matches, stats=[]).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= least)
    marks = early.groupBy("match_id").agg(F.max("is_home").alias("_home"), F.max(1 - F.col("is_home")).alias("_away"))
    aged = matches.select("match_id", "league", "season").join(season_ages(matches), ["league", "season"]).join(marks, "match_id", "left")
    later = F.col("season_age") > 0
    return aged.select(
        "match_id",
        F.when((F.col("_home") == 1) & later, 1).otherwise(0).alias("is_home_promoted_proxy"),
        F.when((F.col("_away") == 1) & later, 1).otherwise(0).alias("is_away_promoted_proxy"),
        "season_age",
    )


def asof_state(matches: DataFrame) -> DataFrame:
    """As-of lookup: opponent and goals of each side's latest strictly earlier match."""
    looked = rows_before(sides(matches, GOALS), TEAM, [CELL], ORDER_KEY, 1, F.struct("opponent", "gf", "match_date"))
    last = F.get("prior", F.lit(0))
    return looked.select(
        "match_id",
        "team",
        last["opponent"].alias("last_opponent"),
        last["gf"].alias("last_gf"),
        last["match_date"].alias("last_date"),
    )


# ---------------------------------------------------------------- rolling means of a side


def with_ratios(rows: DataFrame) -> DataFrame:
    """Safe ratios of a team-view row: a zero denominator counts as 1."""

    def over(a: str, b: str) -> Column:
        return F.col(a) / F.when(F.col(b) == 0, 1).otherwise(F.col(b))

    return (
        rows.withColumn("shot_accuracy", over("sot", "shots"))
        .withColumn("shot_conversion", over("gf", "shots"))
        .withColumn("card_ratio", over("yellows", "corners"))
    )


ROLLING = ["gf", "ga", "corners", "yellows", "shot_accuracy"]


def rolling_means(matches: DataFrame, windows: Sequence[int] = (3, 5)) -> DataFrame:
    """Mean of the non-NULL values among the last w earlier home matches of each host."""
    hosts = with_ratios(sides(matches, [*GOALS, "shots", "sot", "corners", "yellows"])).filter(F.col("is_home") == 1)
    looked = rows_before(hosts, TEAM, [CELL], ORDER_KEY, max(windows), F.struct(*ROLLING))

    def mean(field: str, w: int) -> Column:
        known = F.filter(last_n(F.col("prior"), w), lambda x: x[field].isNotNull())
        return array_avg(known, lambda x: x[field])

    return looked.select("match_id", "team", *[mean(c, w).alias(f"{c}_last{w}") for c in ROLLING for w in windows])


def opponent_strength(matches: DataFrame) -> DataFrame:
    """Expanding mean of the points hosts took from this opponent before; NULL at first."""
    hosts = with_cell(matches).withColumn("points", points(F.col("fthg"), F.col("ftag")))
    rows = totals_before(
        hosts, ["league", "away_team"], [CELL], ORDER_KEY,
        {"_n": _one(), "_p": _n("points")},
    )
    return rows.select("match_id", F.when(F.col("_n") > 0, F.col("_p") / F.col("_n")).alias("opp_ppg"))


FORM_WEIGHTS = [0.30, 0.25, 0.20, 0.15, 0.10]
"""Fixed values: weights of the last five matches, newest first."""


def weighted_form(matches: DataFrame, literal: bool = False) -> DataFrame:
    """Weighted points of the last five matches of each side, newest first.

    The weights are renormalised over the matches there are. With ``literal`` a missing row just
    before the first match takes one weight slot as well, so n < 5 matches are divided by the
    first n + 1 weights. ``xg_diff`` is the goal difference of the row, ``form_x_opponent`` the form times
    the opponent's form.
    """
    looked = rows_before(sides(matches, GOALS), TEAM, [CELL], ORDER_KEY, 5, F.col("points"))
    newest = F.reverse("prior")
    weights = F.array(*[F.lit(w) for w in FORM_WEIGHTS])
    used = F.size(newest)
    slots = F.least(used + 1, F.lit(5)) if literal else used
    pairs = F.zip_with(newest, F.slice(weights, 1, used), lambda p, w: p * w)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    norm = F.aggregate(F.slice(weights, 1, slots), F.lit(0.0), lambda a, x: a + x)
    form = F.when(used > 0, total / norm)
    both = by_match(looked.select("match_id", "is_home", form.alias("form")), ["form"])
    return both.withColumn("form_x_opponent", F.col("home_form") * F.col("away_form"))


def ewm_form(matches: DataFrame, span: int = 5) -> DataFrame:
    """Shifted exponentially weighted mean of points, alpha = 2/(span+1), first value as start.

    Equal to the recursion over the whole history of the side at every span; matches without points are passed over.
    """
    looked = decayed_before(sides(matches, GOALS), TEAM, [CELL], ORDER_KEY, F.col("points"), 2.0 / (span + 1), "ewm_points")
    return looked.select("match_id", "team", "ewm_points")


def tackle_rate(matches: DataFrame) -> DataFrame:
    """On-target shots over all shots of the team, group totals repeated on each row."""
    rows = team_view(matches, stats=["shots", "sot"])
    total = rows.groupBy(*TEAM).agg(F.sum("sot").alias("_w"), F.sum("shots").alias("_t"))
    rate = F.col("_w") / F.when(F.col("_t") == 0, 1).otherwise(F.col("_t"))
    return rows.join(total, TEAM).select("match_id", "team", rate.alias("team_rate"))


# ---------------------------------------------------------------- strictly earlier dates


FORM_FIELDS = {
    "wins": lambda x: _flag(x["gf"] > x["ga"]),
    "draws": lambda x: _flag(x["gf"] == x["ga"]),
    "losses": lambda x: _flag(x["gf"] < x["ga"]),
    "goals_scored": lambda x: x["gf"],
    "goals_conceded": lambda x: x["ga"],
    "corners_for": lambda x: x["corners"],
    "corners_against": lambda x: x["corners_against"],
    "yellow_cards": lambda x: x["yellows"],
}
FORM_ITEM = ["gf", "ga", "corners", "corners_against", "yellows"]


def _completed(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("status") == "completed")


def _states_at(points_in_time: DataFrame, states: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bring a per-date state to all dates of ``points_in_time``.

    ``states`` holds, at date d, the state *including* d; the answer for a date is the state of
    the latest strictly earlier one. Both tables hold at most one row per key and date.
    """
    both = points_in_time.select(*keys, "match_date", F.lit(None).cast(states.schema[value].dataType).alias(value))
    both = both.unionByName(states.select(*keys, "match_date", value))
    per_day = both.groupBy(*keys, "match_date").agg(F.max(value).alias(value))
    earlier = Window.partitionBy(*keys).orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    return per_day.select(*keys, "match_date", F.last(value, ignorenulls=True).over(earlier).alias(value))


def form_minmatches(matches: DataFrame, window: int = 3, minimum: int = 2, home_weight: float = 1.2) -> DataFrame:
    """Mean of the last ``window`` completed matches on earlier dates; NULL below ``minimum``."""
    rows = team_view(matches, ["status"], FORM_ITEM)
    done = rows.filter(F.col("status") == "completed")
    merged = tails_before_cell(done, TEAM, DAY, IN_DAY, window, F.struct(*FORM_ITEM), inclusive=True)
    state = _states_at(rows.select(*TEAM, "match_date").distinct(), merged, TEAM, "prior")
    joined = rows.select("match_id", "is_home", *TEAM, "match_date").join(state, [*TEAM, "match_date"], "left")
    prior = F.col("prior")
    weight = F.when(F.col("is_home") == 1, F.lit(home_weight)).otherwise(F.lit(1.0))
    cols = {
        n: F.when(F.size(prior) >= minimum, array_avg(prior, pick) * weight) for n, pick in FORM_FIELDS.items()
    }
    return by_match(joined.select("match_id", "is_home", *[c.alias(n) for n, c in cols.items()]), list(cols))


def h2h_all(matches: DataFrame) -> DataFrame:
    """All completed meetings of the pair on earlier dates, eight means from the home side."""
    keys = ["league", "team_a", "team_b"]
    a_home = F.col("a_home") == 1
    rows = _oriented(matches, "status", "hc", "ac", "hy", "ay")
    rows = (
        rows.withColumn("a_corners", F.when(a_home, F.col("hc")).otherwise(F.col("ac")))
        .withColumn("b_corners", F.when(a_home, F.col("ac")).otherwise(F.col("hc")))
        .withColumn("a_yellows", F.when(a_home, F.col("hy")).otherwise(F.col("ay")))
        .withColumn("b_yellows", F.when(a_home, F.col("ay")).otherwise(F.col("hy")))
    )
    done = F.col("status") == "completed"

    def when_done(value: Column) -> Column:
        return F.when(done, value).otherwise(0).cast("bigint")

    sums = {"n": when_done(F.lit(1)), "a_won": when_done(_flag(F.col("a_goals") > F.col("b_goals"))),
            "drawn": when_done(_flag(F.col("a_goals") == F.col("b_goals"))),
            "b_won": when_done(_flag(F.col("a_goals") < F.col("b_goals")))}
    for c in ["goals", "corners", "yellows"]:
        for s in "ab":
            sums[f"{s}_{c}_sum"] = when_done(F.col(f"{s}_{c}"))
    state = totals_before_cell(rows, keys, DAY, sums)
    joined = rows.select("match_id", *keys, "match_date", "a_home").join(state, [*keys, "match_date"], "left")

    def pick(a: str, b: str) -> Column:
        total = F.when(a_home, F.col(a)).otherwise(F.col(b))
        return F.when(F.col("n") > 0, total / F.col("n"))

    return joined.select(
        "match_id",
        pick("a_won", "b_won").alias("h2h_wins"),
        pick("drawn", "drawn").alias("h2h_draws"),
        pick("b_won", "a_won").alias("h2h_losses"),
        pick("a_goals_sum", "b_goals_sum").alias("h2h_goals_scored"),
        pick("b_goals_sum", "a_goals_sum").alias("h2h_goals_conceded"),
        pick("a_corners_sum", "b_corners_sum").alias("h2h_corners_for"),
        pick("b_corners_sum", "a_corners_sum").alias("h2h_corners_against"),
        pick("a_yellows_sum", "b_yellows_sum").alias("h2h_yellow_cards"),
    )


def days_since_last(matches: DataFrame) -> DataFrame:
    """Days since each side's last completed match on an earlier date; weekend flag."""
    rows = team_view(matches, ["status"], [])
    per_day = rows.groupBy(*TEAM, "match_date").agg(
        F.max(F.when(F.col("status") == "completed", F.col("match_date"))).alias("_done")
    )
    earlier = Window.partitionBy(*TEAM).orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    state = per_day.select(*TEAM, "match_date", F.max("_done").over(earlier).alias("_last"))
    joined = rows.select("match_id", "is_home", *TEAM, "match_date").join(state, [*TEAM, "match_date"])
    cols = joined.select(
        "match_id", "is_home", F.datediff("match_date", "_last").alias("days_since_last"),
        F.when(F.weekday("match_date") >= 5, 1).otherwise(0).alias("is_weekend"),
    )
    return by_match(cols, ["days_since_last"], ["is_weekend"])
