"""Inputs on which plain arithmetic fails: one value, two days, short histories, too few rows."""

import datetime

import pytest
from fixtures_small import SCHEMA, random_rows
from pyspark.sql import functions as F

from matchspark.operators import evaluate as V
from matchspark.operators import exceptions as E
from matchspark.operators import monitor as M
from matchspark.operators import ratings as R
from matchspark.operators import splits as S
from matchspark.operators import statistics as T
from matchspark.operators import windows as W
from matchspark.sources import files

DAY = datetime.date(2024, 1, 1)


def test_outliers_without_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "k string, v double")
    assert E.outliers(df, ["k"], "v").count() == 0


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "k string, v double")
    assert [(r.bin, r.n) for r in T.histogram(df, ["k"], "v").collect()] == [(0, 2)]


@pytest.mark.parametrize("days", [1, 2, 3])
def test_trend_of_few_days(spark, days):
    df = spark.createDataFrame([("t", DAY + datetime.timedelta(k), 1.0 + k) for k in range(days)], "target string, day date, mae double")
    r = M.trend(df).first()
    assert r.n == days and r.slope == (1.0 if days > 1 else 0.0)
    assert r.direction == ("declining" if days > 1 else "stable")
    assert (r.next_lower is None) == (days < 3)


def test_drift_of_a_short_history(spark):
    rows = [(k, "few", float(k)) for k in range(50)] + [(k, "many", float(k % 7)) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, target string, predicted double")
    assert [r.target for r in M.ks_drift(df).collect()] == ["many"]


@pytest.mark.parametrize(("n", "cut"), [(70, 50), (100, 80), (200, 164), (20, 15), (10, 7)])
def test_inner_cut_is_clamped(spark, n, cut):
    assert spark.range(1).select(S.inner_cut(F.lit(n), 0.82, 60, 20).alias("c")).first().c == cut


def test_season_files_with_their_own_headers(spark, tmp_path):
    """Flat files of one folder, other column order, a missing and an unknown column, a byte order mark."""
    (tmp_path / "X_2425.csv").write_text("match_id,ftr,fthg,ftag,home_team\n1,H,2,1,A\n2,D,0,0,B\n")
    (tmp_path / "X_2526.csv").write_bytes("﻿home_team,fthg,referee,ftr,match_id\nC,4,R,A,3\n".encode())
    rows = sorted(files.scan_seasons(spark, str(tmp_path)).collect(), key=lambda r: r.match_id)
    got = [(r.season, r.match_id, r.home_team, r.fthg, r.ftag, r.ftr) for r in rows]
    assert got == [("2425", 1, "A", 2, 1, "H"), ("2425", 2, "B", 0, 0, "D"), ("2526", 3, "C", 4, None, "A")]


def test_folds_of_a_short_league(spark):
    rows = S.ts_folds(spark.createDataFrame(random_rows()[:3], SCHEMA)).collect()
    assert {r.fold for r in rows} == {0}


@pytest.mark.parametrize("operator", [R.prior_rank, R.elo_ratings, W.h2h_last6, R.temporal_features])
def test_blanks_around_team_names(spark, operator):
    """Trimmed matches give what clean ones do; untrimmed ones lose no row."""
    clean = spark.createDataFrame(random_rows(), SCHEMA)
    blank = F.when(F.col("match_id") % 2 == 0, F.concat("home_team", F.lit("  "))).otherwise(F.col("home_team"))
    raw = clean.withColumn("home_team", blank)
    want = sorted(map(str, operator(clean).collect()))
    assert len(want) == 400
    assert sorted(map(str, operator(files.trimmed(raw)).collect())) == want
    assert operator(raw).count() == 400


def test_one_vs_rest_auc(spark):
    """Equals the definition over pairs, with ties; NULL where a class is absent."""
    import random

    rng = random.Random(3)
    rows = [("k", rng.choice("ABBC"), *[rng.randrange(6) / 5 for _ in "ABC"]) for _ in range(60)] + [("two", c, 0.1, 0.2, 0.7) for c in "AABB"]
    df = spark.createDataFrame(rows, "k string, y string, a double, b double, c double")
    got = {r.k: r.roc_auc_ovr for r in V.roc_auc_ovr(df, ["k"], "y", {c: F.col(c.lower()) for c in "ABC"}).collect()}
    mine, want = [r for r in rows if r[0] == "k"], 0.0
    for n, c in enumerate("ABC"):
        yes, no = [r[2 + n] for r in mine if r[1] == c], [r[2 + n] for r in mine if r[1] != c]
        wins = sum((a > b) + (a == b) / 2 for a in yes for b in no)
        want += wins / (len(yes) * len(no)) * len(yes) / len(mine)
    assert got["k"] == pytest.approx(want, abs=1e-12) and got["two"] is None
