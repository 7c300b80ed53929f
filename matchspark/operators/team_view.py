"""Two rows per match, one seen from each side, and back again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.plans.prior import CELL

SIDE_STATS = {
    "gf": ("fthg", "ftag"),
    "ga": ("ftag", "fthg"),
    "shots": ("hs", "as_"),
    "sot": ("hst", "ast"),
    "corners": ("hc", "ac"),
    "corners_against": ("ac", "hc"),
    "yellows": ("hy", "ay"),
    "reds": ("hr", "ar"),
}
"""Team-view column -> (source on the home row, source on the away row)."""


def points(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 3).when(scored == conceded, 1).otherwise(0)


def team_view(matches: DataFrame, keep: Sequence[str] = (), stats: Sequence[str] | None = None) -> DataFrame:
    """Home and away rows from one scan: each match row is exploded into two structs.

    Columns inside the structs cannot be pruned by the optimizer, so name the ``stats`` that are
    needed; points are added when both goal columns are among them. Team names are taken as they are: sources trim them.
    """
    wanted = SIDE_STATS if stats is None else {n: SIDE_STATS[n] for n in stats}
    base = ["match_id", "league", "season", "match_date", "home_team", "away_team", *keep]
    base += [c for c in [CELL] if c in matches.columns]

    def side(home: bool) -> Column:
        i = 0 if home else 1
        teams = ("home_team", "away_team") if home else ("away_team", "home_team")
        return F.struct(
            F.lit(1 if home else 0).alias("is_home"),
            F.col(teams[0]).alias("team"),
            F.col(teams[1]).alias("opponent"),
            *[F.col(src[i]).alias(name) for name, src in wanted.items()],
        )

    rows = matches.select(*base, F.explode(F.array(side(True), side(False))).alias("_side")).select(*base, "_side.*")
    if "gf" in wanted and "ga" in wanted:
        rows = rows.withColumn("points", points(F.col("gf"), F.col("ga")))
    return rows


def by_match(rows: DataFrame, columns: Sequence[str], extra: Sequence[str] = (), dealt: Sequence[str] = ()) -> DataFrame:
    """Fold team-view rows back to one row per match with ``home_<c>`` and ``away_<c>`` columns.

    Each match has exactly two rows: after one shuffle on the match the home row takes its
    columns' away values from the row that follows it, instead of a self-join. Rows that are partitioned by columns of
    the match already (``dealt``) stay where they are, and the columns come along.
    """
    extra = [*dealt, *extra]
    pair = Window.partitionBy(*dealt, "match_id").orderBy(F.desc("is_home"))
    both = rows.select("match_id", "is_home", *extra, *columns, F.lead(F.struct(*columns)).over(pair).alias("_away"))
    return both.filter("is_home = 1").select(
        "match_id", *extra,
        *[F.expr(f"`{c}` AS `home_{c}`") for c in columns],
        *[F.expr(f"_away.`{c}` AS `away_{c}`") for c in columns],
    )
