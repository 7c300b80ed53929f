"""Expected values on hand-made rows."""

import datetime as dt

import pytest
from fixtures_small import SCHEMA, match, two_matches
from pyspark.sql import functions as F

from matchspark.functions import clean as C
from matchspark.functions import predictions as P
from matchspark.operators import evaluate as E
from matchspark.operators import exceptions as X
from matchspark.operators import labels as L
from matchspark.operators import monitor as M
from matchspark.operators import quality as Q
from matchspark.operators import ratings as R
from matchspark.operators import splits as S
from matchspark.operators import statistics as ST
from matchspark.operators import windows as W
from matchspark.operators.team_view import team_view
from matchspark.sources import files


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_temporal_row_uses_only_the_past(spark):
    first, second = R.temporal_features(two_matches(spark)).orderBy("match_id").collect()
    assert len(R.feature_columns()) == len(set(R.feature_columns())) == 118
    assert (first.home_matches_played, first.home_elo, first.away_elo, first.elo_diff) == (0, 1500, 1500, 60)
    assert (first.home_rest_days, first.home_recent_5_points_per_match, first.home_season_points_per_match) == (7, 1.0, 0)
    assert (first.h2h_matches, first.market_sources_count) == (0, 1)
    assert (second.home_points_per_match, second.away_points_per_match) == (0, 3)
    assert second.h2h_matches == 1
    assert second.home_elo < 1500 < second.away_elo
    assert (second.home_season_rank_prior, second.away_season_rank_prior) == (2, 1)


def test_season_cut_is_index_120(spark):
    rows = [match(i, dt.date(2025, 8, 1) + dt.timedelta(days=i), "A", "B", 1, 0) for i in range(130)]
    assert one(S.season_cut(spark.createDataFrame(rows, SCHEMA))).split_date == dt.date(2025, 11, 29)


def test_targets_of_one_match(spark):
    df = spark.createDataFrame([match(1, dt.date(2025, 8, 1), "A", "B", 2, 1, hc=6, ac=5, hy=3, ay=2, hr=0, ar=1)], SCHEMA)
    row = one(L.target_labels(df))
    on = ["home_win", "over_0_5_goals", "over_2_5_goals", "under_5_5_goals", "both_teams_score", "total_corners_over_9_5",
          "total_yellow_cards_over_4_5", "any_red_card"]
    assert all(row[c] == 1 for c in on)
    assert (row.total_goals, row.total_corners, row.total_yellow_cards) == (3, 11, 5)


def test_threshold_between_two_and_four_tenths(spark):
    df = spark.createDataFrame([(0, .10), (0, .20), (0, .40), (1, .35), (1, .80)], "y int, p double")
    best = one(E.best_threshold(E.threshold_sweep(df, [], "y", "p"), []))
    assert 0.20 <= best.threshold <= 0.40


def test_team_view_has_two_rows_per_match(spark):
    rows = team_view(two_matches(spark)).collect()
    assert len(rows) == 4 and {r.is_home for r in rows} == {0, 1}


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, C.form_points(lit("PG PG PE PP PG"))) == 10
    assert value(spark, C.form_points(lit(None).cast("string"))) == 0
    assert value(spark, C.first_number(lit("Jugador A 12"))) == 12
    assert value(spark, C.first_number(lit("nobody"))) is None
    assert value(spark, C.lookup(C.WEEKDAYS, lit("Mar"))) == 2
    assert value(spark, C.to_double(lit("12,5%"))) == 12.5
    assert value(spark, C.parse_date(lit("05/08/95"))) == dt.date(1995, 8, 5)
    assert value(spark, C.parse_date(lit("05/08/2025"))) == dt.date(2025, 8, 5)
    assert value(spark, C.parse_date(lit("soon"))) is None
    assert value(spark, C.score_part(lit("2–1"), 2)) == 1
    assert value(spark, C.ascii_fold(lit("Óscar Núñez ß"))) == "Oscar Nunez ss"


def test_headers():
    assert C.flatten_names([("Unnamed: 0", "Equipo"), ("A", "xG"), ("B", "xG"), ("x", "Unnamed: 3")]) == ["Equipo", "xG", "xG_1", "x"]


def test_round_and_columns_are_checked(spark):
    with pytest.raises(ValueError):
        C.for_round(spark.range(1), 39)
    with pytest.raises(ValueError, match="venue"):
        C.require_columns(spark.range(1), ["venue"], "schedule")


def test_impute_makes_the_gate_pass(spark):
    rows = [match(1, dt.date(2025, 8, 1), "A", "B", 1, 0, hs=None), match(2, dt.date(2025, 8, 2), "C", "D", 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    gate = one(Q.quality_gate(df, ["hs", "hst"]))
    assert (gate.null_features, gate.is_valid, gate.issues) == (1, False, "null features")
    assert one(Q.quality_gate(Q.impute(df, Q.median_fills(df, ["hs"])), ["hs", "hst"])).is_valid
    assert "missing columns" in one(Q.quality_gate(df, ["hs", "venue"])).issues


def test_nan_is_missing_before_the_median(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert sorted(r.x for r in Q.impute(df, Q.median_fills(df, ["x"])).collect()) == [1, 2, 2, 3, 4]


def test_each_fault_lowers_its_score(spark):
    good = [match(i, dt.date(2025, 8, i), "A", "B", 1, 0) for i in (1, 2, 3)]
    req = ["match_date", "hs"]

    def scores(rows, as_of="2025-08-10"):
        return one(Q.dq_scores(spark.createDataFrame(rows, SCHEMA), req, ["fthg"], as_of))

    base = scores(good)
    assert (base.completeness, base.consistency, base.timeliness, base.validity, base.passes) == (1, 1, 1, 1, True)
    assert scores(good[:2] + [match(3, dt.date(2025, 8, 3), "A", "B", 1, 0, hs=None)]).completeness < 1
    assert scores(good + [good[0]]).consistency < 1
    assert scores(good, "2028-01-01").timeliness < 1
    assert scores(good + [match(9, dt.date(2025, 8, 9), "A", "B", -1, 0)]).validity < 1


def test_form_needs_the_minimum(spark):
    rows = [match(i, dt.date(2025, 8, i), "A", "B", 2, 0) for i in (1, 2, 3, 4)]
    got = W.form_minmatches(spark.createDataFrame(rows, SCHEMA)).orderBy("match_id").collect()
    assert [r.home_wins for r in got] == [None, None, 1.2, 1.2]
    assert got[3].away_losses == 1.0


def test_rolling_mean_excludes_the_row(spark):
    rows = [match(1, dt.date(2025, 8, 1), "A", "B", 1, 0), match(2, dt.date(2025, 8, 2), "A", "B", 2, 0),
            match(3, dt.date(2025, 8, 3), "A", "B", 4, 0)]
    got = W.rolling_means(spark.createDataFrame(rows, SCHEMA)).orderBy("match_id").collect()
    assert [r.gf_last3 for r in got] == [None, 1.0, 1.5]


def test_safe_ratio(spark):
    assert value(spark, C.safe_ratio(F.lit(12), F.lit(8))) == 1.5
    assert value(spark, C.safe_ratio(F.lit(12), F.lit(0))) == 12


def test_intervals_and_probabilities(spark):
    win, draw, loss = P.normalise(F.array(F.lit(.2), F.lit(.3), F.lit(.5)))
    assert [round(value(spark, c), 6) for c in (win, draw, loss)] == [.5, .3, .2]
    win, draw, loss = P.normalise(F.array(F.lit(2.0)))
    assert [value(spark, c) for c in (win, draw, loss)] == [1, 0, 0]
    low, high = P.interval(F.lit(2.0), .25)
    assert value(spark, low) < value(spark, high)
    assert value(spark, P.adapted_margin(.25, F.lit(0.0))) == pytest.approx(.35)


def test_exceptions(spark):
    rows = [match(1, dt.date(2025, 8, 1), "A", "B", 0, 0, status="postponed"), match(2, None, "C", "D", 0, 0),
            match(3, dt.date(2025, 8, 1), "A", "C", 0, 0)]
    good, found = X.split_exceptions(spark.createDataFrame(rows, SCHEMA))
    assert [r.match_id for r in good.collect()] == [3]
    assert X.of_team(found, "A").count() == 1
    assert {r.status: r.exceptions for r in X.summary(found).collect()}["postponed"] == 1
    updates = spark.createDataFrame([(1, dt.date(2025, 9, 1), "new date")], "match_id bigint, new_date date, resolution string")
    done = X.resolve(found, updates)
    assert {r.match_id: r.status for r in done.collect()} == {1: "scheduled", 2: "scheduled"}
    assert [r.match_id for r in X.unresolved(done).collect()] == [2]


def monitor_rows(spark, n=60, jump=0.0):
    rows = [(i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), "goals", float(i % 5) + (jump if i >= n - 5 else 0), float(i % 4))
            for i in range(n)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, target string, predicted double, actual double")


def test_drift_and_alerts(spark):
    calm = one(M.drift_score(monitor_rows(spark), 50, 5)).drift_score
    wild = one(M.drift_score(monitor_rows(spark, jump=20.0), 50, 5)).drift_score
    assert calm < 0.1 < wild
    kinds = {r.type for r in M.alerts(monitor_rows(spark, jump=20.0), 0.2, 0.1, 50, 5).collect()}
    assert kinds == {"performance", "drift"}
    assert M.latest(monitor_rows(spark), ["target"], 7).count() == 7


def test_correlated_columns_are_found(spark):
    df = spark.range(100).select(F.rand(1).alias("x1"), F.rand(2).alias("x3")).withColumn("x2", F.col("x1") * 0.9)
    drops = ST.correlated_drop(ST.correlations(df, ["x1", "x2", "x3"])).collect()
    assert [(r.a, r.b) for r in drops] == [("x1", "x2")]


def test_cell_of_a_table_row(spark):
    html = '<tr><td>Other</td><td data-stat="corners">4</td></tr><tr><td>Team X</td><td data-stat="corners">7</td></tr>'
    assert value(spark, files.stat_cell(F.lit(html), "Team X", "corners")) == 7
    assert value(spark, files.stat_cell(F.lit(html), "Team X", "cards")) == 0


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, .5), (1, .6)], "y int, p double")
    assert one(E.roc_auc(df, [], "y", "p")).roc_auc is None


def test_literal_form_divides_by_one_more_weight(spark):
    rows = [match(i, dt.date(2025, 8, i), "A", "B", 2, 0) for i in (1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = W.weighted_form(df).orderBy("match_id").collect()[1].home_form
    literal = W.weighted_form(df, literal=True).orderBy("match_id").collect()[1].home_form
    assert plain == pytest.approx(3.0) and literal == pytest.approx(0.9 / 0.55)


def test_trend_without_two_days_is_stable(spark):
    daily = spark.createDataFrame([("goals", dt.date(2025, 1, 1), 2.0)], "target string, day date, mae double")
    row = one(M.trend(daily))
    assert (row.slope, row.direction, row.confidence, row.next) == (0.0, "stable", 0.0, 2.0)
