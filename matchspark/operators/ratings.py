"""Elo ratings, the league table before kickoff, and the assembled feature row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.elo import HOME_EDGE, rate_batches
from matchspark.functions.standing import place_batches
from matchspark.operators import market as M
from matchspark.operators import windows as W
from matchspark.operators.team_view import by_match, team_view
from matchspark.plans.prior import CELL, sums_of_last, totals_before, totals_before_cell
from matchspark.sources.fixtures import ORDER_KEY

def elo_ratings(matches: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    """Ratings of both sides before each match, carried across seasons within a league.

    Each step needs the opponent's previous step, so a league is one chain. Its five narrow
    columns are sorted by Spark (spilling as needed) and streamed in Arrow batches; a task
    holds one rating per team, never the league. ``dealt``: columns of the match by which the rows are dealt out.
    """
    chain = (
        matches.select("league", "season", *ORDER_KEY, "fthg", "ftag")
        .repartition("league")
        .sortWithinPartitions("league", *ORDER_KEY)
    )
    rated = chain.select("league", "match_id", "season", "match_date", "home_team", "away_team", "fthg", "ftag").mapInArrow(
        rate_batches, "match_id bigint, league string, season string, match_date date, home_elo double, away_elo double"
    ).select("match_id", *dealt, "home_elo", "away_elo")
    rated = rated.repartition(*dealt) if dealt else rated
    return rated.withColumn("elo_diff", elo_diff())


def elo_diff() -> Column:
    return F.col("home_elo") + F.lit(HOME_EDGE) - F.col("away_elo")


def rank_diff() -> Column:
    return F.col("away_season_rank_prior") - F.col("home_season_rank_prior")


def prior_rank(matches: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    """Place of both sides in the season's table just before the match.

    Teams count once they have been seen in the season; order is points, goal difference, goals,
    name. The table at the start of each day comes from per-day totals. Its rows and the day's narrow matches
    are shuffled once on (league, season, date) and streamed in order in Arrow batches; a task holds the table of
    one day, and no match is multiplied by the teams of its season. ``dealt``: columns of the day by which the rows are dealt out.
    """
    day = ["league", "season", "match_date"]
    gained = ["p", "gd", "g", "n"]
    team_day = (
        team_view(matches.dropna(subset=day), stats=W.GOALS).groupBy(*day, "team")
        .agg(F.expr("sum(bigint(points)) AS p"), F.expr("sum(bigint(gf - ga)) AS gd"),
             F.expr("sum(bigint(gf)) AS g"), F.count("*").alias("n"))
    )
    roster = team_day.select("league", "season", "team").distinct()
    grid = (
        team_day.select(*day).distinct().join(roster, ["league", "season"])
        .join(team_day, [*day, "team"], "left").fillna(0, gained)
        .repartition("league", "season", "team")
    )
    before = totals_before_cell(grid, ["league", "season", "team"], ["match_date"], {k: F.col(k) for k in gained}).fillna(0, gained)
    none = {c: F.lit(None).cast("bigint").alias(c) for c in (*gained, "match_id", "fthg", "ftag")}
    opening = before.select(
        *day, F.lit(0).alias("kind"), F.col("team").alias("home_team"), F.lit("").alias("away_team"), none["match_id"], none["fthg"], none["ftag"], *gained
    )
    played = matches.dropna(subset=day).select(
        *day, F.lit(1).alias("kind"), "home_team", "away_team", "match_id",
        F.col("fthg").cast("bigint").alias("fthg"), F.col("ftag").cast("bigint").alias("ftag"), *[none[c] for c in gained],
    )
    rows = opening.unionByName(played).repartition(*day).sortWithinPartitions(*day, "kind", "home_team", "away_team", "match_id")
    ranked = rows.mapInArrow(
        place_batches, "match_id bigint, league string, season string, match_date date, home_season_rank_prior int, away_season_rank_prior int"
    ).select("match_id", *dealt, "home_season_rank_prior", "away_season_rank_prior")
    ranked = ranked.repartition(*dealt) if dealt else ranked
    return ranked.withColumn("season_rank_diff", rank_diff())


def _diff(c: str) -> str:
    return f"home_{c} - away_{c}"


MATCHUP = {
    "rest_days_diff": _diff("rest_days"),
    "short_rest_home": "CASE WHEN home_rest_days <= 3 THEN 1D ELSE 0D END",
    "short_rest_away": "CASE WHEN away_rest_days <= 3 THEN 1D ELSE 0D END",
    "points_ppm_diff": _diff("points_per_match"),
    "win_rate_diff": _diff("win_rate"),
    "goal_diff_ppm_diff": f"({_diff('goals_for_per_match')}) - ({_diff('goals_against_per_match')})",
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
"""Home-minus-away differences and short-rest flags over an assembled feature row."""


SIDE_STATS = [*W.GOALS, "shots", "sot", "corners", "yellows"]


SEASON_SUMS = ["matches", "points_sum", "gf_sum", "ga_sum", "shots_sum", "sot_sum"]
VENUE_SUMS = ["matches", "points_sum", "gf_sum", "ga_sum", "sot_sum", "wins", "losses"]
RECENT = (3, 5, 10)


def looked_back(matches: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    """Team-view rows with all sums over earlier matches, in one pass.

    A cell lies inside one season, so all-time and season totals share the shuffle and the
    window; the venue totals are the home-only running sums or what is left without them. With ``dealt`` (league, date and
    season) the matches are dealt out by these columns once, before there are two rows of each, and no wide row is shuffled.
    """
    plain = W.sides(matches, SIDE_STATS)
    rows, cell = (W.sides(matches.repartition(*dealt), SIDE_STATS), ["match_date", "season"]) if dealt else (plain, [CELL])
    sums = W.totals()
    at_home = {f"h_{k}": F.when(F.col("is_home") == 1, e).otherwise(0) for k, e in sums.items()}
    summed = totals_before(
        rows, W.TEAM, cell, ORDER_KEY, {**sums, **at_home},
        families={"a_": (), "s_": ("season",)}, latest={"last_date": F.col("match_date")}, plain=plain, dealt=dealt,
    )
    looked = sums_of_last(summed, W.TEAM, cell, ORDER_KEY, RECENT, W.RECENT_SUMS, plain=plain, dealt=dealt)
    return looked.select("*", *[
        F.expr(f"CASE WHEN is_home = 1 THEN a_h_{k} ELSE a_{k} - a_h_{k} END AS v_{k}") for k in sums
    ])


def side_sums(matches: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    """What the features of both sides follow from, one row per match."""
    kept = [f"a_{k}" for k in W.totals()] + [f"s_{k}" for k in SEASON_SUMS] + [f"v_{k}" for k in VENUE_SUMS]
    kept += [f"{k}_{n}" for n in RECENT for k in ("count", *W.RECENT_SUMS)]
    found = looked_back(matches, dealt).select("match_id", *dealt, "is_home", *kept, W.rest_column().alias("rest_days"))
    return by_match(found, [*kept, "rest_days"], dealt=dealt)


def side_columns(side: str = "") -> dict[str, Column]:
    """Features of a side over its sums."""
    return {
        **W.averages("", W.ALL_TIME, f"{side}a_"),
        **W.averages("season_", W.SEASON, f"{side}s_"),
        **W.averages("venue_", W.VENUE, f"{side}v_"),
        **W.recent_columns(RECENT, side),
        "season_played": F.col(f"{side}s_matches"),
    }


def side_features(matches: DataFrame) -> DataFrame:
    """All per-side features of a match in one pass over the team view."""
    cols = {**side_columns(), "rest_days": W.rest_column()}
    looked = looked_back(matches)
    return by_match(looked.select("match_id", "is_home", *[c.alias(n) for n, c in cols.items()]), list(cols))


HOME_ONLY = ["venue_points_per_match", "venue_win_rate", "venue_goal_diff_per_match", "venue_goals_for_per_match",
             "venue_goals_against_per_match", "venue_shots_on_target_per_match"]
AWAY_ONLY = ["venue_points_per_match", "venue_loss_rate", "venue_goal_diff_per_match", "venue_goals_for_per_match",
             "venue_goals_against_per_match", "venue_shots_on_target_per_match"]

CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.constraintPropagation.enabled": "false"}
"""Sides of a join that are dealt out by some of its keys stay where they are; hundreds of sums are not written out in each other's terms."""

LABELS = ["match_id", "league", "season", "match_date", "home_team", "away_team", "fthg", "ftag", "ftr",
          "hc", "ac", "hy", "ay", "hr", "ar"]


def one_day_ids(matches: DataFrame) -> bool:
    """Whether no id stands for matches of several leagues, dates or seasons."""
    place = F.xxhash64(*W.OF_DAY)
    ids = matches.groupBy("match_id").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    return ids.filter("match_id IS NOT NULL AND a <> b").isEmpty()


def _joined(matches: DataFrame, sides: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    key, ages = [*dealt, "match_id"], W.season_ages(matches)
    facts = M.with_probabilities(matches.repartition(*dealt) if dealt else matches).select(*LABELS, *M.PROBABILITY_COLUMNS)
    return (
        facts.join(sides, key)
        .join(elo_ratings(matches, dealt), key)
        .join(prior_rank(matches, dealt), key)
        .join(W.h2h_last6(matches, dealt), key)
        .join(F.broadcast(ages) if dealt else ages, ["league", "season"])  # a row for each season of a league
    )


def _derived(joined: DataFrame) -> DataFrame:
    later = F.col("season_age") > 0
    derived = M.with_derived(joined).withColumns({
        "matchday": F.greatest("home_season_played", "away_season_played") + 1,
        "is_home_promoted_proxy": F.when((F.col("home_matches_played") < 15) & later, 1).otherwise(0),
        "is_away_promoted_proxy": F.when((F.col("away_matches_played") < 15) & later, 1).otherwise(0),
        "home_recent_points_per_match": F.col("home_recent_5_points_per_match"),
        "away_recent_points_per_match": F.col("away_recent_5_points_per_match"),
        "home_recent_goal_diff": F.col("home_recent_5_goal_diff"),
        "away_recent_goal_diff": F.col("away_recent_5_goal_diff"),
        **{n: F.expr(e) for n, e in MATCHUP.items()},
    })
    return derived.select(*LABELS, *feature_columns())


def temporal_features(matches: DataFrame) -> DataFrame:
    """The whole pre-match feature row: labels plus 118 features, one row per match."""
    return _derived(_joined(matches, side_features(matches)))


def feature_parts(matches: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    """What the feature row follows from, one row per match: labels, probabilities, sums, ratings, places, meetings.

    It takes a third of the feature row's place when it is stored: sums are whole numbers that lie close together on a day.
    With ``dealt`` (league, date and season; the ids must pass ``one_day_ids``) the parts of a row are made where its day
    lies, so only narrow rows are shuffled. To be written under the settings ``CO_LOCATED``.
    """
    return _joined(matches, side_sums(matches, dealt), dealt).drop("elo_diff", "season_rank_diff")


def from_parts(parts: DataFrame) -> DataFrame:
    """The rows of ``temporal_features`` from stored parts."""
    sides = {f"{side}{n}": c for side in ("home_", "away_") for n, c in side_columns(side).items()}
    return _derived(parts.select("*", *[c.alias(n) for n, c in sides.items()], elo_diff().alias("elo_diff"), rank_diff().alias("season_rank_diff")))


def feature_columns() -> list[str]:
    """Order of the feature vector."""
    vector = [c for c in W.ALL_TIME if c != "goals_per_shot_on_target"]
    both = [f"{s}_{c}" for c in vector for s in ("home", "away")]
    season = [f"{s}_season_{c}" for c in W.SEASON for s in ("home", "away")]
    venue = [f"home_{c}" for c in HOME_ONLY] + [f"away_{c}" for c in AWAY_ONLY]
    recent = [f"{s}_recent_{c}" for s in ("home", "away") for c in ("points_per_match", "goal_diff")]
    recent += [f"{s}_recent_{n}_{c}" for s in ("home", "away") for n in (3, 5, 10)
               for c in ("points_per_match", "goal_diff", "shots_on_target", "corners")]
    return [
        "matchday", "home_elo", "away_elo", "elo_diff", "home_rest_days", "away_rest_days",
        "home_season_rank_prior", "away_season_rank_prior", "season_rank_diff",
        "h2h_home_points_per_match", "h2h_home_goal_diff_per_match", "h2h_matches",
        *M.MARKET_COLUMNS, *both, *season, *venue, *recent, *MATCHUP,
        "is_home_promoted_proxy", "is_away_promoted_proxy", "season_age",
    ]
