"""Column functions for predictions: expectations, intervals, probabilities, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054
"""Fixed value: 97.5 % point of the normal distribution."""


def expectations(matches: DataFrame, *keep: str) -> DataFrame:
    """Rule-of-thumb goals, corners and cards of both sides."""
    return matches.select(
        "match_id", *keep,
        F.expr("market_home_prob * 2 + market_draw_prob AS goals_home"),
        F.expr("market_away_prob * 2 + market_draw_prob AS goals_away"),
        F.expr("greatest(coalesce(hs, 0) / 8D + hst / 20D, 0D) AS corners_home"),
        F.expr("greatest(coalesce(as_, 0) / 8D + ast / 20D, 0D) AS corners_away"),
        F.expr("greatest(hc / 12D + hr * 0.15D, 0D) AS cards_home"),
        F.expr("greatest(ac / 12D + ar * 0.15D, 0D) AS cards_away"),
    )


def interval(value: Column, margin: float) -> tuple[Column, Column]:
    """value * (1 -+ margin), not below 0."""
    return F.greatest(F.lit(0.0), value * (1.0 - margin)), value * (1.0 + margin)


def z_interval(value: Column, margin: float, z: float = Z95) -> tuple[Column, Column]:
    half = F.lit(z) * value * margin
    return F.greatest(F.lit(0.0), value - half), value + half


def normalise(scores: Column) -> tuple[Column, Column, Column]:
    """(win, draw, loss) from an array: three scores in the order loss, draw, win are clipped at 0
    and divided by their sum; one entry is a class label; anything else gives .34/.32/.34."""
    clipped = [F.greatest(F.get(scores, F.lit(i)), F.lit(0.0)) for i in range(3)]
    total = clipped[0] + clipped[1] + clipped[2]
    label = F.round(F.get(scores, F.lit(0))).cast("int")

    def pick(i: int, default: float) -> Column:
        return (
            F.when((F.size(scores) >= 3) & (total > 0), clipped[i] / total)
            .when(F.size(scores) == 1, F.when(label == i, 1.0).otherwise(0.0))
            .otherwise(default)
        )

    return pick(2, 0.34), pick(1, 0.32), pick(0, 0.34)


def adapted_margin(base: float, coverage: Column) -> Column:
    """Wider below 80 % coverage, narrower above 95 %, kept within [.1, .5]."""
    raw = (
        F.when(coverage < 0.8, base * (1 + (0.8 - coverage) * 0.5))
        .when(coverage > 0.95, base * (1 - (coverage - 0.95) * 0.5))
        .otherwise(base)
    )
    return F.least(F.lit(0.5), F.greatest(F.lit(0.1), raw))
