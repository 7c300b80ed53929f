"""Places in a league table that changes from match to match; runs inside tasks and keeps one day's table."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# the functions travel to the tasks by value: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = ["league", "season", "match_date"]
OPENING = ["p", "gd", "g", "n"]
CHUNK = 1 << 18
"""Places in the tables that are held at once."""


def day_starts(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
    """Rows with which another day begins than that of the row before."""
    new = np.zeros(batch.num_rows, bool)
    for k, name in enumerate(DAY):
        values = batch.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
        new[0] |= last is None or values[0] != last[k]
    return np.flatnonzero(new)


def gains(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Points, difference, goals and count that a match adds to the side with ``own`` goals; NaN is an unknown score."""
    there, both = ~np.isnan(own), ~np.isnan(own + other)
    points = np.where(own > other, 3, np.where(own == other, 1, 0))
    return np.stack([points, np.where(both, own - other, 0), np.where(there, own, 0), there], axis=1).astype(np.int64)


def places(table: np.ndarray, side: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Place of ``side`` in each table (match, team, measure): seen teams first, then points, difference, goals, name."""
    teams, rows = np.arange(table.shape[1]), np.arange(len(side))
    seen = (table[:, :, 3] > 0) | (teams == side[:, None]) | (teams == other[:, None])
    ahead = teams < side[:, None]
    for k in (2, 1, 0):
        mine = table[rows, side, k][:, None]
        ahead = (table[:, :, k] > mine) | ((table[:, :, k] == mine) & ahead)
    return (ahead & seen).sum(axis=1) + 1


def place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by day: the opening table by team name (``kind`` 0), then the day's matches in order (``kind`` 1)."""
    last, slots, table = None, {}, np.zeros((0, 4), np.int64)
    for batch in batches:
        cuts = np.unique(np.r_[0, day_starts(batch, last), batch.num_rows])
        first_is_new = 0 in day_starts(batch, last)
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a or first_is_new:
                slots, table = {}, np.zeros((0, 4), np.int64)
            opened = a + int((kinds[a:b] == 0).sum())
            if opened > a:
                part = batch.slice(a, opened - a)
                slots.update({t: len(slots) + k for k, t in enumerate(part.column("home_team").to_pylist())})
                table = np.concatenate([table, np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in OPENING], axis=1).astype(np.int64)])
            size = max(1, CHUNK // max(len(table), 1))
            for at in range(opened, b, size):
                out, table = _placed(batch.slice(at, min(size, b - at)), slots, table)
                yield out
        last = tuple(batch.column(c).to_numpy(zero_copy_only=False)[-1] for c in DAY)


def _placed(matches: pa.RecordBatch, slots: dict[str, int], table: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """Places before each of some matches of a day, and the table after them."""
    home, away = (np.array([slots[t] for t in matches.column(c).to_pylist()]) for c in ("home_team", "away_team"))
    scored, conceded = (matches.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("fthg", "ftag"))
    rows = np.arange(len(home))
    change = np.zeros((len(home) + 1, *table.shape), np.int64)
    change[0] = table
    np.add.at(change, (rows + 1, home), gains(scored, conceded))
    np.add.at(change, (rows + 1, away), gains(conceded, scored))
    tables = change.cumsum(axis=0)
    found = [pa.array(places(tables[:-1], *sides).astype(np.int32)) for sides in ((home, away), (away, home))]
    names, same = ["match_id", *DAY], [matches.column(c) for c in ("match_id", *DAY)]
    return pa.RecordBatch.from_arrays([*same, *found], [*names, "home_season_rank_prior", "away_season_rank_prior"]), tables[-1]
