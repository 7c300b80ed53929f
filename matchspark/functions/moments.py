"""Sums of products and what follows from them; runs inside tasks and, on a few rows, on the driver."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# the functions travel to the tasks by value: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 512
"""Values in a row between tasks, so that batches of rows stay small."""


SOME_ROWS = 1024
"""Rows that are multiplied at once, so that they stay near the processor."""


def matrix(batch: pa.RecordBatch, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Scaled values of the column ``x``; what is missing counts as the centre."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(centre))
    return np.nan_to_num((x - centre) / spread, nan=0.0, posinf=0.0, neginf=0.0)


def with_ends(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ones before the features, the target behind them."""
    return np.column_stack([np.ones(len(z)), z, y])


def poisson_weights(keys: np.ndarray, fit: int, seed: int) -> np.ndarray:
    """Poisson(1) numbers that depend on key, fit and seed alone: how often a row is drawn into a resample."""
    chance = np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 18)])
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(fit + 1) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    even = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53
    return np.searchsorted(np.cumsum(chance), even, side="right")


def in_blocks(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (fit, block, values) of an array for each fit."""
    for fit, values in sums.items():
        parts = [values[k : k + BLOCK].tolist() for k in range(0, len(values), BLOCK)]
        columns = [pa.array([fit] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["fit", "block", "values"])


def add_up(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """The sum of the arrays of each fit in this task, from their blocks."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for fit, block, values in zip(*[batch.column(c).to_pylist() for c in ("fit", "block", "values")], strict=True):
            own = np.array(values)
            sums[fit, block] = sums[fit, block] + own if (fit, block) in sums else own
    fits = sorted({f for f, _ in sums})
    return {f: np.concatenate([sums[k] for k in sorted(sums) if k[0] == f]) for f in fits}


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer: one array for each fit."""
    yield from in_blocks(add_up(batches))


def products(weights: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], centre: np.ndarray, spread: np.ndarray):
    """For each fit the weighted sums of all products of two columns (upper triangle), one array for a task."""

    def run(batches):
        width = len(centre) + 2
        upper, sums = np.triu_indices(width), {}
        for batch in batches:
            rows = with_ends(matrix(batch, centre, spread), batch.column("y").to_numpy(zero_copy_only=False))
            for fit, weight in weights(batch):
                if fit not in sums:
                    sums[fit] = np.zeros((width, width))
                root = np.sqrt(weight)
                for at in range(0, len(rows), SOME_ROWS):
                    some = np.flatnonzero(weight[at : at + SOME_ROWS]) + at
                    own = rows[some] * root[some, None]
                    sums[fit] += own.T @ own  # a matrix times itself takes half the work
        yield from in_blocks({f: g[upper] for f, g in sums.items()})

    return run


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each column of ``x`` the number of values in this task, their mean and the sum of squares around it."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        there = ~np.isnan(x)
        with np.errstate(invalid="ignore"):
            # around a value of the column, so that equal values have exactly no deviation
            start = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0)
            n, off = there.sum(axis=0).astype(float), np.where(there, x - start, 0.0)
            step = off.sum(axis=0) / np.maximum(n, 1.0)
            own = n, start + step, (np.where(there, off - step, 0.0) ** 2).sum(axis=0)
        total = own if total is None else met(total, own)
    if total is not None:
        columns = [pa.array(range(len(total[0])), pa.int32()), *[pa.array(v) for v in total]]
        yield pa.RecordBatch.from_arrays(columns, ["place", "n", "mean", "squares"])


def met(one: tuple, two: tuple) -> tuple:
    """Moments of two lots of values together."""
    with np.errstate(invalid="ignore"):
        n = one[0] + two[0]
        share = two[0] / np.maximum(n, 1.0)
        step = np.where((one[0] > 0) & (two[0] > 0), two[1] - one[1], 0.0)
        mean = np.where(one[0] > 0, one[1] + step * share, two[1])
        return n, mean, one[2] + two[2] + step * step * one[0] * share


def all_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer: one row for each column."""
    found: dict[int, tuple] = {}
    for batch in batches:
        for place, *own in zip(*[batch.column(c).to_pylist() for c in ("place", "n", "mean", "squares")], strict=True):
            found[place] = met(found[place], own) if place in found else tuple(own)
    if found:
        columns = [pa.array(list(found), pa.int32()), *[pa.array([float(v[k]) for v in found.values()]) for k in range(3)]]
        yield pa.RecordBatch.from_arrays(columns, ["place", "n", "mean", "squares"])


def pair_products(centre: np.ndarray, spread: np.ndarray):
    """For each column ``a`` (as fit) six runs of sums against every column ``b``, over the rows that have both.

    They are the number of rows, the sums of a, of a squared, of b, of b squared, and of the product.
    """

    def run(batches):
        width, total = len(centre), None
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)
            there = np.isfinite(x)
            z = np.where(there, (x - centre) / spread, 0.0)
            there = there.astype(float)
            one, two = z.T @ there, (z * z).T @ there
            own = np.stack([there.T @ there, one, two, one.T, two.T, z.T @ z], axis=1)
            total = own if total is None else total + own
        yield from in_blocks({} if total is None else {a: total[a].ravel() for a in range(width)})

    return run


def pair_correlations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer: rows (place, other, r); NULL where the common rows of two columns have no deviation in one of them."""
    for fit, sums in add_up(batches).items():
        n, s_a, q_a, s_b, q_b, both = sums.reshape(6, -1)
        rows = np.maximum(n, 1.0)
        var_a, var_b = q_a / rows - (s_a / rows) ** 2, q_b / rows - (s_b / rows) ** 2
        known = (var_a > 1e-13) & (var_b > 1e-13)
        r = (both / rows - s_a * s_b / rows**2) / np.sqrt(np.where(known, var_a * var_b, 1.0))
        columns = [pa.array([fit] * len(n), pa.int32()), pa.array(range(len(n)), pa.int32()), pa.array(np.clip(r, -1, 1), mask=~known)]
        yield pa.RecordBatch.from_arrays(columns, ["place", "other", "r"])


def square(triangle: np.ndarray) -> np.ndarray:
    """The whole symmetric matrix."""
    width = int((np.sqrt(8 * len(triangle) + 1) - 1) / 2)
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = triangle
    return np.triu(out) + np.triu(out, 1).T


def ridge(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights for a change of one standard deviation, weights for one scaled unit, and the intercept of those.

    Normal equations of the standardised features; a feature without deviation has weight 0.
    """
    n, inner = gram[0, 0], slice(1, -1)
    mean, mean_y = gram[0, inner] / n, gram[0, -1] / n
    cov = gram[inner, inner] / n - np.outer(mean, mean)
    var = np.diag(cov).copy()
    live = var > 1e-12
    sd = np.sqrt(np.where(live, var, 1.0))
    both = np.where(np.outer(live, live), cov / np.outer(sd, sd), 0.0)
    np.fill_diagonal(both, 1.0 + alpha / n)
    with_y = np.where(live, (gram[inner, -1] / n - mean * mean_y) / sd, 0.0)
    weight = np.linalg.solve(both, with_y)
    unit = np.where(live, weight / sd, 0.0)
    return weight, unit, float(mean_y - unit @ mean)


def fitted_weights(alpha: float):
    """Reducer: adds up what tasks have sent and fits; rows (fit, place of the feature, weight)."""

    def run(batches):
        for fit, triangle in add_up(batches).items():
            weight, _, _ = ridge(square(triangle), alpha)
            columns = [pa.array([fit] * len(weight), pa.int32()), pa.array(range(len(weight)), pa.int32()), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["fit", "place", "weight"])

    return run


def permuted_sums(unit: np.ndarray, intercept: float, repeats: int, seed: int, centre: np.ndarray, spread: np.ndarray, pairs: bool = True):
    """For each repeat the sums that score all features and pairs; rows come sorted by cell, then key.

    The rows of a cell change places in two independent permutations. With d = value that came - own value and the
    residual e these are: sum e d and sum d d of each feature in both permutations, and sum d d' of each pair
    across them. Without ``pairs`` there is the first permutation alone, and no products across.
    """

    def cell_sums(cell: int, z: np.ndarray, y: np.ndarray, sums: dict[int, np.ndarray]) -> None:
        e = y - intercept - z @ unit
        for r in range(repeats):
            rng = np.random.default_rng([seed, cell, r])
            one = z[rng.permutation(len(z))] - z
            if not pairs:
                own = np.concatenate([e @ one, np.einsum("ij,ij->j", one, one)])
                sums[r] = sums[r] + own if r in sums else own
                continue
            two = z[rng.permutation(len(z))] - z
            own = np.concatenate([e @ one, (one * one).sum(0), e @ two, (two * two).sum(0), (one.T @ two).ravel()])
            sums[r] = sums[r] + own if r in sums else own

    def run(batches):
        sums, held, cell = {}, [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            z, y = matrix(batch, centre, spread), batch.column("y").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and cells[a] != cell:
                    cell_sums(cell, *map(np.concatenate, zip(*held, strict=True)), sums)
                    held = []
                cell = int(cells[a])
                held.append((z[a:b], y[a:b]))
        if held:
            cell_sums(cell, *map(np.concatenate, zip(*held, strict=True)), sums)
        yield from in_blocks(sums)

    return run


def permuted_scores(unit: np.ndarray, total: float, pairs: np.ndarray):
    """Reducer: the fall of R2 for each feature (``other`` -1) and each pair, and the part that is interaction."""

    def run(batches):
        p = len(unit)
        for fit, sums in add_up(batches).items():
            if not len(pairs):
                sums = np.r_[sums, np.zeros(2 * p + p * p)]
            e1, d1, e2, d2 = (sums[k * p : (k + 1) * p] for k in range(4))
            cross = sums[4 * p :].reshape(p, p)
            one, two = (unit * unit * d1 - 2 * unit * e1) / total, (unit * unit * d2 - 2 * unit * e2) / total
            a, b = pairs[:, 0], pairs[:, 1]
            together = 2 * unit[a] * unit[b] * cross[a, b] / total
            place, other = np.r_[np.arange(p), a], np.r_[np.full(p, -1), b]
            rise = np.r_[one, one[a] + two[b] + together]
            columns = [pa.array([fit] * len(place), pa.int32()), pa.array(place, pa.int32()), pa.array(other, pa.int32()), pa.array(rise)]
            parts = [pa.array(v) for v in (np.r_[one, one[a]], np.r_[np.zeros(p), two[b]], np.r_[np.zeros(p), together])]
            yield pa.RecordBatch.from_arrays([*columns, *parts], ["fit", "place", "other", "score", "first", "second", "interaction"])

    return run


def expected_scores(gram: np.ndarray, unit: np.ndarray, intercept: float) -> tuple[np.ndarray, np.ndarray]:
    """What the scores of single features and the interactions of pairs are on average over all permutations."""
    n, inner = gram[0, 0], slice(1, -1)
    z, y, zz = gram[0, inner], gram[0, -1], gram[inner, inner]
    total = gram[-1, -1] - y * y / n
    e = y - intercept * n - unit @ z
    ez = gram[inner, -1] - intercept * z - zz @ unit
    cov = zz - np.outer(z, z) / n
    single = (2 * unit * unit * np.diag(cov) - 2 * unit * (e * z / n - ez)) / total
    return single, 2 * np.outer(unit, unit) * cov / total
