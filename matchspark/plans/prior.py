"""Look-back over earlier rows that does not put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends all rows of a key to one task. Here the
rows of a key are cut into *cells*, a prefix of the sort order such as the match date. Each cell
is summarised first (partial aggregation before the shuffle), the short table of cells gets the
window over the key, and rows only meet rows of their own cell. A key that holds a third of the
data is thus spread over as many tasks as it has cells.

The joins carry a merge hint: the rows are partitioned and sorted by (key, cell) for the window
anyway, so only the short side moves.

``keys`` and ``cell`` columns must not be NULL; ``order`` must be total inside a cell.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CELL = "_cell"


def with_cell(matches: DataFrame, grain: str = "day") -> DataFrame:
    """Add the cell column: the day of the match, with grain "pairing" the two sides as well.

    The date stands first, so the order of the cells is the order of time whatever the seasons are called;
    the season only tells apart matches that two seasons have on one day.
    """
    sides = {"day": [], "pairing": ["home_team", "away_team"]}[grain]
    return matches.withColumn(CELL, F.struct(F.col("match_date").alias("d"), "season", *sides))


def last_n(values: Column, n: int | Column) -> Column:
    """Last ``n`` entries of an array, all of it when shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def totals_before(
    df: DataFrame,
    keys: Sequence[str],
    cell: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    families: Mapping[str, Sequence[str]] | None = None,
    latest: Mapping[str, Column] | None = None,
    by_cell: DataFrame | None = None,
    plain: DataFrame | None = None,
    dealt: Sequence[str] = (),
) -> DataFrame:
    """Add, for each name in ``totals``, the sum over all earlier rows of the same key.

    ``families`` maps a column prefix to further keys that are constant inside a cell, such as
    the season: all families share the one shuffle, the one window and the one join.
    ``latest`` columns grow with the order; their last earlier value is added under the name.
    ``by_cell`` may bring the totals per (key, cell) when they come cheaper from elsewhere.
    ``dealt`` names columns among keys and cell by which the rows are partitioned already; the totals then go to the rows.
    They are made from ``plain``, the same rows before they were dealt out, so that these shrink before their shuffle.
    """
    families = families or {"": ()}
    latest = latest or {}
    extra = sorted({c for cols in families.values() for c in cols})
    if by_cell is None:
        # constant inside a cell, so as a key they part nothing, and the sums stay in a hash table where a string's maximum would need a sort
        by_cell = (df if plain is None else plain).groupBy(*keys, *cell, *[c for c in extra if c not in {*keys, *cell}]).agg(
            *[F.sum(e).alias(n) for n, e in totals.items()],
            *[F.max(e).alias(n) for n, e in latest.items()],
        )

    def earlier_cells(more: Sequence[str]):
        return Window.partitionBy(*keys, *more).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)

    carried = [
        F.coalesce(F.sum(n).over(earlier_cells(more)), F.lit(0)).alias(f"_c_{prefix}{n}")
        for prefix, more in families.items()
        for n in totals
    ]
    carried += [F.max(n).over(earlier_cells(())).alias(f"_c_{n}") for n in latest]
    carry = by_cell.select(*keys, *cell, *carried)
    carry = carry.repartition(*dealt) if dealt else carry
    in_cell = Window.partitionBy(*keys, *cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(
        "*",
        *[F.coalesce(F.sum(e).over(in_cell), F.lit(0)).alias(f"_r_{n}") for n, e in totals.items()],
        *[F.max(e).over(in_cell).alias(f"_r_{n}") for n, e in latest.items()],
    )
    added = [F.expr(f"`_c_{p}{n}` + `_r_{n}` AS `{p}{n}`") for p in families for n in totals]
    added += [F.expr(f"coalesce(`_r_{n}`, `_c_{n}`) AS `{n}`") for n in latest]
    return rows.join(carry.hint("merge"), [*keys, *cell]).select(*df.columns, *added)


def sums_of_last(
    df: DataFrame,
    keys: Sequence[str],
    cell: Sequence[str],
    order: Sequence[str],
    windows: Sequence[int],
    fields: Mapping[str, str],
    plain: DataFrame | None = None,
    dealt: Sequence[str] = (),
) -> DataFrame:
    """Add ``<name>_<n>`` (sum over the last n earlier rows) and ``count_<n>`` for each window n.

    ``fields`` maps a name to SQL text without NULLs. Inside the cell a window sum is the
    difference of two running sums; what is missing comes from suffix sums of the earlier
    cells' last rows, so no list is built per row. ``plain`` has the same rows before other columns were added to
    them, so that what adds those does not run again for the last rows. ``dealt``: as in ``totals_before``.
    """
    depth = max(windows)
    item = F.struct(*[F.expr(e).cast("double").alias(n) for n, e in fields.items()])
    state = tails_before_cell(df if plain is None else plain, keys, cell, order, depth, item, "_tail")

    def suffix(j: Column) -> Column:
        near = last_n(F.col("_tail"), j)
        return F.struct(*[array_sum(near, lambda x, n=n: x[n]).alias(n) for n in fields])

    state = state.select(
        *keys,
        *cell,
        F.when(F.size("_tail") > 0, F.transform(F.sequence(F.lit(1), F.size("_tail")), suffix)).alias("_suffix"),
    )
    state = state.repartition(*dealt) if dealt else state
    in_cell = Window.partitionBy(*keys, *cell).orderBy(*order)
    running = in_cell.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(
        "*",
        (F.row_number().over(in_cell) - 1).alias("_k"),
        *[F.coalesce(F.sum(F.expr(e).cast("double")).over(running), F.lit(0.0)).alias(f"_r_{n}") for n, e in fields.items()],
    )
    rows = rows.select(
        "*", *[F.lag(f"_r_{n}", w).over(in_cell).alias(f"_l_{n}_{w}") for n in fields for w in windows]
    )
    joined = rows.join(state.hint("merge"), [*keys, *cell])
    added = []
    for w in windows:
        added.append(F.expr(f"least({w}, _k + coalesce(array_size(_suffix), 0)) AS count_{w}"))
        for n in fields:
            older = f"coalesce(try_element_at(_suffix, least({w} - _k, array_size(_suffix))).{n}, 0D)"
            added.append(F.expr(f"_r_{n} + CASE WHEN _k >= {w} THEN -_l_{n}_{w} ELSE {older} END AS {n}_{w}"))
    return joined.select(*df.columns, *added)


def decayed_before(
    df: DataFrame, keys: Sequence[str], cell: Sequence[str], order: Sequence[str], value: Column, alpha: float, name: str
) -> DataFrame:
    """Add the mean y <- y + alpha * (value - y) over all earlier rows of the key, started with its first value.

    A row is the map y -> A * y + B with A = 1 - alpha, and so is a run of rows. Rows are numbered by ``totals_before``
    and cut into blocks of which each shrinks what came before by e**-40. Maps compose by a running sum inside a block;
    what enters a block is the sum of the one before it and, shrunk, of the one before that; all older ones are
    below e**-80 of a value. A block is a bounded number of rows (20 * (span + 1), about), so a hot key is spread over its blocks,
    and no list is built. Rows whose value is NULL leave the mean as it is; it is NULL before the first value.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies above 0 and is 1 at most")
    keep = 1 - alpha
    size = 1 if keep == 0 else max(1, math.ceil(-40 / math.log(keep)))

    def power(n: Column) -> Column:
        return F.pow(F.lit(keep), n)

    counted = totals_before(
        df.withColumn("_x", value.cast("double")), keys, cell, order, {"_k": F.when(F.col("_x").isNotNull(), 1).otherwise(0).cast("bigint")}
    )
    place = F.col("_k") % size
    share = F.when(F.col("_k") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    placed = counted.withColumn("_block", F.floor(F.col("_k") / size)).withColumn(
        "_term", F.coalesce(share * F.col("_x") / power(place) if keep else share * F.col("_x"), F.lit(0.0))
    )
    whole = placed.groupBy(*keys, "_block").agg((F.sum("_term") * (keep ** (size - 1))).alias("_sum"))
    after = [whole.select(*keys, (F.col("_block") + i).alias("_block"), (F.col("_sum") * keep ** (size * (i - 1))).alias("_sum")) for i in (1, 2)]
    carried = after[0].unionByName(after[1]).groupBy(*keys, "_block").agg(F.sum("_sum").alias("_carry"))
    in_block = Window.partitionBy(*keys, "_block").orderBy(*cell, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_near", F.coalesce(F.sum("_term").over(in_block), F.lit(0.0)))
    near = F.when(place > 0, F.col("_near") * power(place - 1)).otherwise(0.0)
    mean = near + power(place) * F.coalesce("_carry", F.lit(0.0))
    return rows.join(carried.hint("merge"), [*keys, "_block"], "left").select(
        *df.columns, F.when(F.col("_k") > 0, mean).alias(name)
    )


def totals_before_cell(
    df: DataFrame, keys: Sequence[str], cell: Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """One row per (key, cell) with the sums over strictly earlier cells; NULL when there is none."""
    by_cell = df.groupBy(*keys, *cell).agg(*[F.sum(e).alias(n) for n, e in totals.items()])
    earlier_cells = Window.partitionBy(*keys).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    return by_cell.select(*keys, *cell, *[F.sum(n).over(earlier_cells).alias(n) for n in totals])


def tails_before_cell(
    df: DataFrame,
    keys: Sequence[str],
    cell: Sequence[str],
    order: Sequence[str],
    n: int,
    item: Column,
    name: str = "prior",
    inclusive: bool = False,
) -> DataFrame:
    """One row per (key, cell) with the last ``n`` items of strictly earlier cells, oldest first.

    With ``inclusive`` the items of the cell itself count as well.

    ``row_number() <= n`` lets Spark drop all but ``n`` rows per cell before the shuffle, so the
    lists stay bounded whatever the size of the cell.
    """
    newest = Window.partitionBy(*keys, *cell).orderBy(*[F.col(c).desc() for c in order])
    tail = (
        df.select(*keys, *cell, *[c for c in order if c not in {*keys, *cell}], item.alias("_item"))
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
        .groupBy(*keys, *cell)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("p"), F.col("_item").alias("v")))).alias("_t"))
    )
    first, last = (-(n - 1), 0) if inclusive else (-n, -1)
    earlier_cells = Window.partitionBy(*keys).orderBy(*cell).rowsBetween(first, last)
    joined = F.flatten(F.collect_list("_t").over(earlier_cells))
    return tail.select(*keys, *cell, F.transform(last_n(joined, n), lambda x: x["v"]).alias(name))


def rows_before(
    df: DataFrame,
    keys: Sequence[str],
    cell: Sequence[str],
    order: Sequence[str],
    n: int,
    item: Column,
    name: str = "prior",
    plain: DataFrame | None = None,
    dealt: Sequence[str] = (),
) -> DataFrame:
    """Add an array column with the last ``n`` items before each row of the same key, oldest first.

    ``plain`` and ``dealt``: as in ``totals_before``.
    """
    state = tails_before_cell(df if plain is None else plain, keys, cell, order, n, item, "_state")
    state = state.repartition(*dealt) if dealt else state
    in_cell = Window.partitionBy(*keys, *cell).orderBy(*order).rowsBetween(-n, -1)
    rows = df.withColumn("_near", F.collect_list(item).over(in_cell))
    return rows.join(state.hint("merge"), [*keys, *cell]).select(
        *df.columns, last_n(F.concat("_state", "_near"), n).alias(name)
    )


def array_sum(values: Column, pick) -> Column:
    """Sum of ``pick(x)`` over an array, as double."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + pick(x).cast("double"))


def array_avg(values: Column, pick, default: Column | None = None) -> Column:
    """Mean of ``pick(x)`` over an array; ``default`` (or NULL) when it is empty."""
    n = F.size(values)
    return F.when(n > 0, array_sum(values, pick) / n).otherwise(F.lit(None) if default is None else default)
