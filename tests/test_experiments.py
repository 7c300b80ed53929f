"""The experiment run: order of seasons, shared fits, resumption, metrics."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchspark.operators import experiments as X
from matchspark.operators import models as M
from matchspark.session import scratch_dir

SMALL = {"logistic_regression_l2": {"maxIter": 10}, "random_forest_regularized": {"numTrees": 3}}


def test_configurations_of_sixteen_seasons():
    found = X.configurations([str(k) for k in range(16)])
    assert len(found) == 60 and len({e.name for e in found}) == 60 and len({e.fit for e in found}) == 60
    assert found[0].seasons == ("15",)
    few = X.configurations(["a", "b", "c"])
    assert len(few) == 16 and len({e.fit for e in few}) == 6  # windows of three seasons or more are one fit


@pytest.fixture(scope="module")
def rows(spark):
    """Three seasons whose labels don't sort by time; the home side wins where x is high."""
    rng, out = np.random.default_rng(2), []
    for age, season in enumerate(["9900", "0001", "0102"]):
        for k in range(150):
            x = float(rng.normal())
            result = "H" if x + rng.normal() * 0.3 > 0.3 else "A" if x < -0.5 else "D"
            day = datetime.date(1999 + age, 8, 1) + datetime.timedelta(k)
            out.append((1000 * age + k, "L", season, day, age, result, x, None if k % 40 == 0 else float(rng.normal())))
    kind = "match_id bigint, league string, season string, match_date date, season_age int, ftr string, x double, noise double"
    return spark.createDataFrame(out, kind)


def test_run_measures_and_resumes(spark, rows, monkeypatch):
    seasons = X.in_order(rows)
    assert seasons == ["9900", "0001", "0102"]
    table = X.marked(rows, rows, seasons[-1]).cache()
    assert {r.season for r in table.filter("is_test").collect()} == {"0102"}
    assert table.filter("is_test").count() == 30  # from the cut at match 120 of 150 on
    path, experiments = scratch_dir(spark, "test", "experiments"), X.configurations(seasons)
    fits = []
    kept = X.measured

    def counted(*args, **kw):
        fits.append(args[2].fit)
        if len(fits) == 4:
            raise RuntimeError("lost")
        return kept(*args, **kw)

    monkeypatch.setattr(X, "measured", counted)
    with pytest.raises(RuntimeError):
        X.run(table, ["x", "noise"], experiments, path, parallel=1, params=SMALL)
    done = X.finished(spark, path)
    assert len(done) >= 3
    found = {r.experiment: r for r in X.run(table, ["x", "noise"], experiments, path, params=SMALL).collect()}
    assert len(found) == len(experiments) and set(fits[-(6 - len(done)) :]).isdisjoint(done)
    for r in found.values():
        assert r.test_rows == 30 and r.train_rows == {1: 120, 2: 270, 3: 420}[r.seasons]
        assert r.accuracy > 0.7 and 0 < r.log_loss < 1 and r.f1_weighted > 0.7
    assert found["all_random_forest_regularized"].accuracy == found["last_4_random_forest_regularized"].accuracy
    top = X.best(X.run(table, ["x", "noise"], experiments, path, params=SMALL)).first()
    assert top.log_loss == min(r.log_loss for r in found.values())


def test_half_lives_weigh_newer_seasons(spark, rows):
    table = X.marked(rows, rows, "0102").cache()
    one = X.Experiment("w", ("9900", "0001", "0102"), "logistic_regression_l2", 0.05)
    alone = X.Experiment("c", ("0102",), "logistic_regression_l2", None)
    got, want = (X.measured(table, ["x", "noise"], e, True).first() for e in (one, alone))
    assert (got.train_rows, want.train_rows) == (420, 120)
    assert got.log_loss == pytest.approx(want.log_loss, abs=0.02)  # older seasons hardly count


def test_grid_orders_by_date(spark):
    seasons = spark.createDataFrame([("9900", 5, datetime.date(1999, 8, 1)), ("0001", 7, datetime.date(2000, 8, 1))], "season string, n bigint, first date")
    got = {r.experiment: r.train_rows for r in M.experiment_grid(seasons).collect()}
    assert got["current_only_logistic_regression_l2"] == 7 and got["last_2_logistic_regression_l2"] == 12
