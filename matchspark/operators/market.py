"""Odds to probabilities: each bookmaker's odds are stripped of the margin, then averaged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_ODDS = [("b1_h", "b1_d", "b1_a"), ("b2_h", "b2_d", "b2_a")]
GOALS_ODDS = [("ou_over", "ou_under")]

MARKET_COLUMNS = [
    "market_home_prob",
    "market_draw_prob",
    "market_away_prob",
    "market_home_advantage",
    "market_home_vs_not_home_prob",
    "market_home_favorite_margin",
    "market_is_home_favorite",
    "market_home_logit",
    "market_entropy",
    "market_overround",
    "market_sources_count",
    "market_over25_prob",
    "market_under25_prob",
    "market_goals_sources_count",
]
PROBABILITY_COLUMNS = [
    "market_home_prob", "market_draw_prob", "market_away_prob", "market_overround", "market_sources_count",
    "market_over25_prob", "market_under25_prob", "market_goals_sources_count",
]
"""Those that come from the odds themselves; the others follow from them."""


def normalised(groups: Sequence[Sequence[str]], defaults: Sequence[float]) -> tuple[list[Column], Column, Column]:
    """Mean probability per outcome, mean overround, and number of usable bookmakers.

    A bookmaker is skipped when one of its odds is missing or not above 1. The few groups are
    written out as plain column arithmetic, which stays inside generated code.
    """
    usable, inverse, total = [], [], []
    for group in groups:
        ok = F.lit(True)
        for c in group:
            ok = ok & F.coalesce(F.col(c) > 1.0, F.lit(False))
        inv = [F.when(ok, F.lit(1.0) / F.col(c)) for c in group]
        usable.append(ok)
        inverse.append(inv)
        total.append(sum(inv[1:], inv[0]))

    def add(parts: list[Column]) -> Column:
        filled = [F.coalesce(p, F.lit(0.0)) for p in parts]
        return sum(filled[1:], filled[0])

    count = add([F.when(ok, F.lit(1.0)).otherwise(0.0) for ok in usable])
    probs = [
        F.when(count > 0, add([inv[i] / t for inv, t in zip(inverse, total)]) / count).otherwise(default)
        for i, default in enumerate(defaults)
    ]
    overround = F.when(count > 0, add(total) / count).otherwise(1.0)
    return probs, overround, count


def with_market(matches: DataFrame) -> DataFrame:
    """Add all market columns."""
    return with_derived(with_probabilities(matches))


def with_probabilities(matches: DataFrame) -> DataFrame:
    """Add what comes from the odds themselves."""
    result, overround, count = normalised(RESULT_ODDS, (0.45, 0.27, 0.28))
    goals, _, goal_count = normalised(GOALS_ODDS, (0.50, 0.50))
    return matches.withColumns({
        "market_home_prob": result[0],
        "market_draw_prob": result[1],
        "market_away_prob": result[2],
        "market_overround": overround,
        "market_sources_count": count,
        "market_over25_prob": goals[0],
        "market_under25_prob": goals[1],
        "market_goals_sources_count": goal_count,
    })


def with_derived(base: DataFrame) -> DataFrame:
    """Add what comes from the probabilities.

    Beyond a join or a shuffle the probabilities are columns; in one projection the optimizer writes each of them out
    wherever it is named, and the code gets too long to be compiled.
    """
    h, d, a = F.col("market_home_prob"), F.col("market_draw_prob"), F.col("market_away_prob")
    best_other = F.greatest(d, a)

    def plogp(p: Column) -> Column:
        return p * F.ln(F.greatest(p, F.lit(1e-15)))

    return base.withColumns({
        "market_home_advantage": h - a,
        "market_home_vs_not_home_prob": h - (d + a),
        "market_home_favorite_margin": h - best_other,
        "market_is_home_favorite": F.when(h >= best_other, 1.0).otherwise(0.0),
        "market_home_logit": F.ln(F.greatest(h, F.lit(1e-6)) / F.greatest(1.0 - h, F.lit(1e-6))),
        "market_entropy": -(plogp(h) + plogp(d) + plogp(a)),
    })
