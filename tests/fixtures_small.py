"""Small hand-made match tables."""

import datetime as dt
import random

SCHEMA = """match_id bigint, league string, season string, match_date date, home_team string, away_team string,
fthg int, ftag int, ftr string, hs int, as_ int, hst int, ast int, hc int, ac int, hy int, ay int, hr int, ar int,
b1_h double, b1_d double, b1_a double, b2_h double, b2_d double, b2_a double, ou_over double, ou_under double,
status string, referee string"""


def match(i, date, home, away, hg, ag, season="2526", league="L", status="completed", odds=(1.8, 3.5, 4.5), **kw):
    r = "H" if hg > ag else "D" if hg == ag else "A"
    stats = {"hs": 10, "as_": 8, "hst": 4, "ast": 3, "hc": 5, "ac": 4, "hy": 2, "ay": 1, "hr": 0, "ar": 0, **kw}
    return (i, league, season, date, home, away, hg, ag, r, *[stats[c] for c in
            ("hs", "as_", "hst", "ast", "hc", "ac", "hy", "ay", "hr", "ar")], *odds, None, None, None, 1.9, 1.9, status, "R")


def two_matches(spark):
    rows = [match(1, dt.date(2025, 8, 1), "A", "B", 2, 1), match(2, dt.date(2025, 8, 8), "B", "A", 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(n=400, teams="ABCDEF", seed=3, hot="A"):
    """Several matches per day; one side takes part in most of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        home = hot if rng.random() < 0.6 else rng.choice(teams)
        away = rng.choice([t for t in teams if t != home])
        if rng.random() < 0.4:
            home, away = away, home
        date = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(150))
        status = "completed" if rng.random() < 0.8 else "scheduled"
        rows.append(match(i, date, home, away, rng.randrange(5), rng.randrange(4), season="24", status=status,
                          hc=rng.randrange(9), hst=rng.randrange(6)))
    return rows
