"""Skew-safe plans against brute force, leakage and invariants."""

import datetime
import math
import random

import pandas as pd
import pytest
from fixtures_small import SCHEMA, match, random_rows
from pyspark.sql import functions as F

from matchspark.operators import evaluate as E
from matchspark.operators import labels as L
from matchspark.operators import monitor as M
from matchspark.operators import ratings as R
from matchspark.operators import statistics as ST
from matchspark.operators import windows as W
from matchspark.operators.team_view import team_view
from matchspark.plans import prior
from matchspark.plans.quantiles import exact_quantiles
from matchspark.sources.fixtures import ORDER_KEY


def history(rows):
    """Team-view rows of plain tuples in match order."""
    order = sorted(rows, key=lambda r: (r[3], r[4], r[5], r[0]))
    seen = {}
    for r in order:
        for home in (True, False):
            team = r[4] if home else r[5]
            yield r[0], team, list(seen.get(team, []))
        for home in (True, False):
            gf, ga = (r[6], r[7]) if home else (r[7], r[6])
            seen.setdefault(r[4] if home else r[5], []).append((gf, ga))


def test_season_labels_do_not_order_time(spark):
    """Season 9900 lies before season 0001; the later match must see the earlier one, not the other way round."""
    rows = [
        match(1, datetime.date(2000, 3, 1), "A", "B", 1, 0, season="9900"),
        match(2, datetime.date(2000, 9, 1), "A", "B", 1, 0, season="0001"),
    ]
    got = {r.match_id: r for r in W.prior_averages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].home_matches_played == 0 and got[2].home_matches_played == 1


@pytest.mark.parametrize("span", [1, 5, 20, 100, 400])
def test_weighted_mean_reaches_back_as_far_as_its_span(spark, span):
    rows = random_rows()
    order = sorted(rows, key=lambda r: (r[3], r[4], r[5], r[0]))
    alpha, state, want = 2 / (span + 1), {}, {}
    for r in order:
        for team in (r[4], r[5]):
            want[(r[0], team)] = state.get(team)
        for team, gf, ga in ((r[4], r[6], r[7]), (r[5], r[7], r[6])):
            p = 3 if gf > ga else 1 if gf == ga else 0
            state[team] = p if team not in state else state[team] * (1 - alpha) + p * alpha
    for r in W.ewm_form(spark.createDataFrame(rows, SCHEMA), span).collect():
        expected = want[(r.match_id, r.team)]
        assert (r.ewm_points is None) == (expected is None)
        assert expected is None or abs(r.ewm_points - expected) < 1e-9


def test_correlations_of_many_columns(spark):
    """118 columns with gaps, a constant, an empty one, one far from zero, NaN and infinity; equal on every partitioning."""
    rng = random.Random(8)
    columns = [f"c{i}" for i in range(118)]
    rows = []
    for _ in range(300):
        base = rng.gauss(0, 1)
        row = [base * (i % 7) + rng.gauss(0, 1) if rng.random() > 0.1 else None for i in range(118)]
        row[3], row[4], row[5] = 7.0, None, 1e9 + rng.gauss(0, 1)
        row[6] = rng.choice([float("nan"), float("inf"), 1.0, 2.0, None])
        rows.append(row)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = {(r.a, r.b): r.r for r in ST.correlations(df, columns).collect()}
    want = pd.DataFrame(rows, columns=columns, dtype=float).replace(float("inf"), float("nan")).corr()
    assert len(got) == 118 * 118
    for (a, b), value in got.items():
        assert (value is None) == math.isnan(want[a][b]), (a, b)
        assert value is None or abs(value - want[a][b]) < 1e-6
    other = {(r.a, r.b): r.r for r in ST.correlations(df.repartition(5), columns).collect()}
    assert all(v is None and other[k] is None or abs(v - other[k]) < 1e-9 for k, v in got.items())
    assert ST.correlations(df.limit(0), columns).filter("r IS NOT NULL").count() == 0


def test_overlay_of_two_populations(spark):
    """A key with one value, one with an empty side, a NULL key, rows without value, the highest value in the last bin."""
    rows = [("a", float(v), v % 2 == 0) for v in range(11)] + [("a", None, True), ("a", float("nan"), False), ("a", 3.0, None)]
    rows += [("one", 5.0, True), ("one", 5.0, False), ("side", 1.0, True), ("side", 2.0, True), (None, 4.0, False)]
    df = spark.createDataFrame(rows, "k string, v double, late boolean")
    got = {(r.k, r.bin): tuple(r)[2:] for r in ST.histogram_overlay(df, ["k"], "v", F.col("late"), 5).collect()}
    assert got["a", 0] == (1, 1, 1 / 5, 1 / 6) and got["a", 4] == (1, 2, 1 / 5, 2 / 6)
    assert sum(v[0] for (k, _), v in got.items() if k == "a") == 5 and sum(v[1] for (k, _), v in got.items() if k == "a") == 6
    assert got["one", 0] == (1, 1, 1.0, 1.0) and got[None, 0] == (1, 0, 1.0, None)
    assert got["side", 0] == (0, 1, None, 0.5) and got["side", 4] == (0, 1, None, 0.5)
    assert sum(r.n_second for r in ST.histogram_overlay(df, [], "v", F.col("late")).collect()) == 9
    assert ST.histogram_overlay(df.limit(0), ["k"], "v", F.col("late")).count() == 0


def test_best_experiment_falls_back_to_all(spark):
    rows = [("x", "small", 10, 100, 0.1, 0.9), ("x", "big", 500, 100, 0.5, 0.5), ("x", "tie", 600, 200, 0.5, 0.6), ("x", "none", 900, 900, None, 0.9),
            ("y", "b", 1, 1, 0.2, 0.5), ("y", "a", 1, None, 0.2, 0.5)]
    df = spark.createDataFrame(rows, "k string, experiment string, train_rows int, valid_rows int, log_loss double, accuracy double")
    got = {r.k: (r.experiment, r.restricted) for r in E.best_experiment(df, ["k"]).collect()}
    assert got == {"x": ("tie", True), "y": ("a", False)}


def test_weights_of_training_rows(spark):
    rows = [("H", 0), ("H", 2), ("H", 2), ("A", 2), (None, 2)]
    df = spark.createDataFrame(rows, "ftr string, season_age int")
    got = sorted((r.ftr, r.season_age, r.weight) for r in L.training_weights(df, "ftr", 1.0).collect())
    assert got == [("A", 2, 2.0), ("H", 0, 4 / 6 / 4), ("H", 2, 4 / 6), ("H", 2, 4 / 6)]
    assert {r.weight for r in L.training_weights(df.filter("season_age = 0"), "ftr", None).collect()} == {1.0}


@pytest.mark.parametrize("alpha", [0.05, 0.5, 1.0])
def test_decayed_mean_of_long_keys_with_gaps(spark, alpha):
    """One key of 900 rows (many blocks), one that has only NULLs, values of both signs, no arrays in the plan."""
    rng = random.Random(2)
    rows = [("a", i // 7, i, None if rng.random() < 0.2 else rng.gauss(0, 100)) for i in range(900)]
    rows += [("b", 0, i, None) for i in range(3)] + [("c", 0, 0, 5.0)]
    df = spark.createDataFrame(rows, "k string, c int, o int, v double")
    got = prior.decayed_before(df, ["k"], ["c"], ["o"], F.col("v"), alpha, "y")
    state = {}
    found = {(r.k, r.o): r.y for r in got.collect()}
    assert len(found) == len(rows)
    for k, _, o, v in rows:
        assert (found[k, o] is None) == (k not in state)
        assert k not in state or abs(found[k, o] - state[k]) < 1e-9
        if v is not None:
            state[k] = state[k] * (1 - alpha) + v * alpha if k in state else v
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert prior.decayed_before(df.limit(0), ["k"], ["c"], ["o"], F.col("v"), alpha, "y").count() == 0


@pytest.mark.parametrize("grain", ["day", "pairing"])
def test_totals_and_window_sums_at_every_grain(spark, grain):
    rows = random_rows()
    view = team_view(prior.with_cell(spark.createDataFrame(rows, SCHEMA), grain))
    keys, cell = ["league", "team"], [prior.CELL]
    totals = prior.totals_before(view, keys, cell, ORDER_KEY, {"sum_gf": F.col("gf")}, latest={"last_date": F.col("match_date")})
    got = prior.sums_of_last(totals, keys, cell, ORDER_KEY, (3, 5), {"g": "gf"})
    got = prior.rows_before(got, keys, cell, ORDER_KEY, 4, F.struct("gf", "ga"))
    found = {(r.match_id, r.team): r for r in got.collect()}
    for match_id, team, before in history(rows):
        r = found[(match_id, team)]
        assert r.sum_gf == sum(g for g, _ in before)
        for n in (3, 5):
            assert r[f"count_{n}"] == min(n, len(before))
            assert r[f"g_{n}"] == sum(g for g, _ in before[-n:])
        assert [(x.gf, x.ga) for x in r.prior] == before[-4:]
        assert (r.last_date is None) == (not before)


def test_one_pass_families_equal_single_runs(spark):
    df = spark.createDataFrame(random_rows(), SCHEMA)
    sides = R.side_features(df)
    cols = [c for c in W.prior_averages(df).columns if c != "match_id"]
    assert sides.select("match_id", *cols).exceptAll(W.prior_averages(df)).count() == 0
    venue = W.venue_form(df)
    assert sides.select(*venue.columns).exceptAll(venue).count() == 0


def test_later_matches_change_nothing_before(spark):
    rows = sorted(random_rows(), key=lambda r: r[3])
    early = rows[:300]
    cut = [r for r in early if r[3] < early[-1][3]]
    a = R.temporal_features(spark.createDataFrame(cut, SCHEMA))
    ids = {r[0] for r in cut}
    b = R.temporal_features(spark.createDataFrame(rows, SCHEMA)).filter(F.col("match_id").isin(list(ids)))
    # the table before kickoff lists all sides of the season, the ones not seen yet do not rank
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_elo_is_zero_sum(spark):
    rows = random_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    rated = {r.match_id: r for r in R.elo_ratings(df).collect()}
    from matchspark.functions.elo import elo_step

    now = {t: 1500.0 for t in "ABCDEF"}
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[5], r[0])):
        got = rated[r[0]]
        assert got.home_elo == pytest.approx(now[r[4]]) and got.away_elo == pytest.approx(now[r[5]])
        moved = elo_step(now[r[4]], now[r[5]], r[6], r[7])
        now[r[4]] += moved
        now[r[5]] -= moved
    assert sum(now.values()) == pytest.approx(1500 * 6)


def test_exact_quantiles(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 50), 7.0, 0.0]) for _ in range(501)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    row = exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.95}).first()
    s = sorted(values)

    def linear(p):
        pos = (len(s) - 1) * p
        lo = math.floor(pos)
        hi = math.ceil(pos)
        return s[lo] + (s[hi] - s[lo]) * (pos - lo)

    assert row.a == pytest.approx(linear(0.25)) and row.b == pytest.approx(linear(0.95))


def test_ks_distance(spark):
    rng = random.Random(1)
    values = [float(rng.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame([(i, "t", v) for i, v in enumerate(values)], "event_id bigint, target string, predicted double")
    old, new = values[:-100], values[-100:]
    d = max(abs(sum(v <= x for v in old) / len(old) - sum(v <= x for v in new) / len(new)) for x in values)
    assert M.ks_drift(df, 100).first().ks_statistic == pytest.approx(d)


def test_kendall_tau(spark):
    import datetime as dt

    rng = random.Random(2)
    values = [float(rng.randrange(8)) for _ in range(40)]
    daily = spark.createDataFrame([("t", dt.date(2025, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)],
                                  "target string, day date, mae double")
    n = len(values)
    sign = sum((values[j] > values[i]) - (values[j] < values[i]) for i in range(n) for j in range(i + 1, n))
    pairs = n * (n - 1) / 2
    ties = sum(values[i] == values[j] for i in range(n) for j in range(i + 1, n))
    assert M.kendall_trend(daily).first().tau == pytest.approx(sign / math.sqrt(pairs * (pairs - ties)))


def test_t_quantile_series_meets_the_table(spark):
    got = spark.range(1).select(M.t975(F.lit(11.0)).alias("a"), M.t975(F.lit(30.0)).alias("b")).first()
    assert got.a == pytest.approx(2.200985, abs=2e-4) and got.b == pytest.approx(2.042272, abs=1e-5)


def test_permutation_keeps_the_values(spark):
    from matchspark.operators.models import shuffled

    df = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("v"), F.lit(1).alias("w"))
    got = shuffled(df, "k", ["v"], 7)
    assert sorted(r.v for r in got.collect()) == list(range(500))
    assert got.filter("k = v").count() < 50
