"""Elo arithmetic that runs inside tasks; keeps one rating per team."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

# the functions travel to the tasks by value: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELO_START = 1500.0
ELO_K = 20.0
HOME_EDGE = 60.0
MATCH = ["match_id", "league", "season", "match_date"]


def elo_step(home: float, away: float, home_goals: int, away_goals: int) -> float:
    """Points that move from the away to the home side."""
    expected = 1.0 / (1.0 + 10.0 ** ((away - (home + HOME_EDGE)) / 400.0))
    actual = 1.0 if home_goals > away_goals else 0.5 if home_goals == away_goals else 0.0
    return ELO_K * (actual - expected)


def rate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ratings before each match; the columns that say which match it is go through as they are."""
    ratings: dict[str, float] = {}
    current = None
    for batch in batches:
        home_out, away_out = [], []
        goals = [batch.column(c).to_pandas() for c in ("fthg", "ftag")]  # an unknown score is NaN
        for league, home, away, hg, ag in zip(*[batch.column(c).to_pylist() for c in ("league", "home_team", "away_team")], *goals):
            if league != current:
                ratings.clear()
                current = league
            h = ratings.get(home, ELO_START)
            a = ratings.get(away, ELO_START)
            home_out.append(h)
            away_out.append(a)
            moved = elo_step(h, a, hg, ag)
            ratings[home] = h + moved
            ratings[away] = a - moved
        same = [batch.column(c) for c in MATCH]
        yield pa.RecordBatch.from_arrays([*same, pa.array(home_out, pa.float64()), pa.array(away_out, pa.float64())], [*MATCH, "home_elo", "away_elo"])


def rate_with_state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Like :func:`rate_batches`, with ratings coming in as rows of kind 0 and going out the same way."""
    ratings: dict[str, float] = {}
    current = None

    def flush() -> pd.DataFrame:
        return pd.DataFrame({
            "league": current, "kind": 0, "match_id": None, "home_team": list(ratings), "away_team": "",
            "home_elo": list(ratings.values()), "away_elo": None,
        })

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.league != current:
                if ratings:
                    yield flush()
                ratings = {}
                current = row.league
            if row.kind == 0:
                ratings[row.home_team] = row.rating
                continue
            h = ratings.get(row.home_team, ELO_START)
            a = ratings.get(row.away_team, ELO_START)
            out.append((row.league, 1, row.match_id, row.home_team, row.away_team, h, a))
            moved = elo_step(h, a, row.fthg, row.ftag)
            ratings[row.home_team] = h + moved
            ratings[row.away_team] = a - moved
        if out:
            yield pd.DataFrame(out, columns=["league", "kind", "match_id", "home_team", "away_team", "home_elo", "away_elo"])
    if ratings:
        yield flush()
