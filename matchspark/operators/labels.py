"""Training labels and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASS_TARGETS = {
    "home_win": "ftr = 'H'",
    "draw": "ftr = 'D'",
    "away_win": "ftr = 'A'",
    "home_or_draw_double_chance": "ftr IN ('H', 'D')",
    "away_or_draw_double_chance": "ftr IN ('A', 'D')",
    "over_0_5_goals": "fthg + ftag > 0.5",
    "over_1_5_goals": "fthg + ftag > 1.5",
    "over_2_5_goals": "fthg + ftag > 2.5",
    "over_3_5_goals": "fthg + ftag > 3.5",
    "under_5_5_goals": "fthg + ftag < 5.5",
    "under_6_5_goals": "fthg + ftag < 6.5",
    "both_teams_score": "fthg > 0 AND ftag > 0",
    "home_scores": "fthg > 0",
    "away_scores": "ftag > 0",
    "total_corners_over_8_5": "hc + ac > 8.5",
    "total_corners_over_9_5": "hc + ac > 9.5",
    "total_yellow_cards_over_4_5": "hy + ay > 4.5",
    "any_red_card": "hr + ar > 0",
}
"""Fixed values: binary targets as predicates; the 1X2 result is the column ftr itself."""

NUMBER_TARGETS = {
    "home_goals": "fthg",
    "away_goals": "ftag",
    "total_goals": "fthg + ftag",
    "total_corners": "hc + ac",
    "total_yellow_cards": "hy + ay",
}


def target_labels(matches: DataFrame) -> DataFrame:
    """All targets beside the match id."""
    return matches.select(
        "match_id", F.col("ftr").alias("match_result_1x2"),
        *[F.expr(f"CASE WHEN {p} THEN 1 ELSE 0 END").alias(n) for n, p in CLASS_TARGETS.items()],
        *[F.expr(p).alias(n) for n, p in NUMBER_TARGETS.items()],
    )


def target_long(labels: DataFrame) -> DataFrame:
    """One row per match and target."""
    names = [*CLASS_TARGETS, *NUMBER_TARGETS]
    return labels.unpivot("match_id", names, "target", "value")


def target_rates(matches: DataFrame) -> DataFrame:
    """Positive share, majority and minority of every binary target, from one aggregation."""
    counted = matches.agg(
        F.count("*").alias("_n"), *[F.count_if(F.expr(p)).alias(n) for n, p in CLASS_TARGETS.items()]
    )
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("target"), F.col(n).alias("positives")) for n in CLASS_TARGETS]))
    long = counted.select("_n", rows)
    low = F.least("positives", F.col("_n") - F.col("positives"))
    return long.select(
        "target", (F.col("positives") / F.col("_n")).alias("target_rate"),
        (low / F.col("_n")).alias("minority_rate"), (1 - low / F.col("_n")).alias("majority_rate"),
        low.alias("minority_count"),
    )


def recency_weights(rows: DataFrame, half_life: float | None, age: str = "season_age") -> DataFrame:
    """0.5 ^ ((newest - age) / half life); 1 without a half life."""
    if half_life is None:
        return rows.withColumn("recency_weight", F.lit(1.0))
    newest = rows.agg(F.max(age).alias("a")).scalar()
    return rows.withColumn("recency_weight", F.pow(F.lit(0.5), (newest - F.col(age)) / F.lit(float(half_life))))


def balanced_weights(rows: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    """n / (classes * class size) per row; the counts are aggregated, the small table is joined back."""
    keys = keys or []
    sizes = rows.groupBy(*keys, label).agg(F.count("*").alias("_nc"))
    if keys:
        total = sizes.groupBy(*keys).agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k"))
        sizes = sizes.join(total, keys)
    else:
        sizes = sizes.withColumn("_n", sizes.agg(F.sum("_nc")).scalar()).withColumn("_k", sizes.agg(F.count("*")).scalar())
    weights = sizes.select(*keys, label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("class_weight"))
    return rows.join(weights, [*keys, label])


def training_weights(
    rows: DataFrame, label: str, half_life: float | None, keys: list[str] | None = None, age: str = "season_age"
) -> DataFrame:
    """Adds class_weight, recency_weight and their product ``weight``, by which a fit counts a row.

    Classes are balanced by row numbers, before the recency; rows with a NULL label can't be learnt from and leave, as do those
    with a NULL key.
    """
    known = rows.filter(F.col(label).isNotNull())
    both = balanced_weights(recency_weights(known, half_life, age), label, keys)
    return both.withColumn("weight", F.col("class_weight") * F.col("recency_weight"))
