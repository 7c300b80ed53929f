"""Exact order statistics and ranks without sorting a key in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which does not
hold for continuous values of a hot key. Here values are counted first, the counts are cut into
cells of near-equal magnitude, and running counts come from :func:`totals_before`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.plans.prior import totals_before


def magnitude_cell(value: Column) -> Column:
    """Coarse, order-keeping integer for a double: sign and 64 steps per power of two."""
    step = F.floor(F.log2(F.abs(value)) * 64) + 100000
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * step).cast("int")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """One row per (key, distinct value): each count and its running total over smaller values.

    ``counts`` maps a name to a summable column; the running total is ``<name>_below``.
    """
    known = df.filter(F.col(value).isNotNull())
    cell = magnitude_cell(F.col(value).cast("double")).alias("_cell")
    per_value = known.groupBy(*keys, value).agg(*[F.sum(e).cast("bigint").alias(n) for n, e in counts.items()])
    # straight from the rows: a handful of cells per task, while the counts per value are a full shuffle
    by_cell = known.groupBy(*keys, cell).agg(*[F.sum(e).cast("bigint").alias(f"{n}_below") for n, e in counts.items()])
    below = totals_before(
        per_value.select("*", cell), keys, ["_cell"], [value], {f"{n}_below": F.col(n) for n in counts}, by_cell=by_cell
    )
    return below.drop("_cell")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], interpolate: bool = True
) -> DataFrame:
    """Exact quantiles of ``value`` per key, one column per entry of ``probs``.

    With ``interpolate`` the rank is ``(n-1)*p`` with linear interpolation; without it the lower
    order statistic ``ceil(n*p)`` is taken, as ``percentile_approx`` does in the limit.
    """
    keys = list(keys)
    ranked = value_ranks(df, keys, value, {"_n": F.lit(1)})
    size = ranked.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    joined = ranked.join(size, keys) if keys else ranked.withColumn("_all", size.scalar())
    v = F.col(value).cast("double")

    def at(rank: Column) -> Column:
        hit = (F.col("_n_below") <= rank) & (rank < F.col("_n_below") + F.col("_n"))
        return F.max(F.when(hit, v))

    aggs, outs = [], []
    for name, p in probs.items():
        if interpolate:
            pos = (F.col("_all") - 1) * F.lit(float(p))
            aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
            aggs.append(F.max(pos - F.floor(pos)).alias(f"_w_{name}"))
            lo, hi, w = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
            outs.append((lo + (hi - lo) * w).alias(name))
        else:
            pos = F.greatest(F.ceil(F.col("_all") * F.lit(float(p))) - 1, F.lit(0))
            aggs.append(at(pos).alias(name))
            outs.append(F.col(name))
    return joined.groupBy(*keys).agg(*aggs).select(*keys, *outs)
