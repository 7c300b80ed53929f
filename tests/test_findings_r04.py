"""Findings of the fourth round: what the fits store and shuffle, whole settings of the regressors, fits that go on at once."""

import datetime
import threading

from fixtures_small import SCHEMA, match, random_rows
from test_experiments import SMALL, rows  # noqa: F401

from matchspark.operators import experiments as X
from matchspark.operators import models as M
from matchspark.operators import ratings as R
from matchspark.operators import windows as W
from matchspark.queries import model_queries as Q
from matchspark.session import scratch_dir, settings


def test_stored_parts_give_the_feature_rows_without_wide_shuffles(spark):
    """F3 to F12: parts are dealt out by day; no row is shuffled by its match."""
    made = random_rows(300)
    late = [(r[0] + 1000, r[1], "25", r[3] + datetime.timedelta(days=366), *r[4:]) for r in random_rows(60, "AXYZ", 5)]
    no_date = match(5000, None, "A", "B", 2, 1, season="24")
    matches = spark.createDataFrame([*made, *made[:3], *late, no_date], SCHEMA)
    assert R.one_day_ids(matches)
    want = R.temporal_features(matches)
    with settings(spark, R.CO_LOCATED):
        parts = R.feature_parts(matches, W.OF_DAY)
        plan = parts._jdf.queryExecution().executedPlan().toString()
        path = scratch_dir(spark, "test", "parts")
        parts.write.mode("overwrite").parquet(path)
    assert "Exchange" in plan and "hashpartitioning(match_id" not in plan
    got = R.from_parts(spark.read.parquet(path))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert want.count() > 360 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert not {"home_points_per_match", "points_ppm_diff"} & set(parts.columns)


def test_ids_of_several_days_are_seen(spark):
    day, other = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    once = [match(1, day, "A", "B", 1, 0), match(1, day, "A", "B", 1, 0), match(2, None, "A", "B", 1, 0), match(None, other, "A", "B", 1, 0)]
    assert R.one_day_ids(spark.createDataFrame(once, SCHEMA))
    assert not R.one_day_ids(spark.createDataFrame([*once, match(2, other, "A", "B", 1, 0)], SCHEMA))


def test_settings_come_back(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    with settings(spark, {key: "false"}):
        assert spark.conf.get(key) == "false"
    assert spark.conf.get(key) == before


def test_regressors_have_the_settings_of_their_family(spark, monkeypatch):
    """no parameter makes the forests smaller."""
    seen, kept = {}, M.regressor

    class Known(Exception):
        pass

    def noted(family, n, **params):
        seen[family] = kept(family, n, **params)
        if family == "random_forest":
            raise Known
        return kept(family, n, **({**params, "maxIter": 1} if family == "boosted_trees" else params))

    monkeypatch.setattr(M, "regressor", noted)
    try:
        Q.fit_regressors(spark, "/root/testdata/sf0.001")
    except Known:
        pass
    for family in ("boosted_trees", "random_forest"):
        for name, value in M.REGRESSORS[family][1].items():
            assert seen[family].getOrDefault(name) == value


def test_fits_that_do_not_fit_together_go_on_alone(spark, rows, monkeypatch):  # noqa: F811
    """Spark ML keeps the rows of each fit that goes on."""
    table = X.marked(rows.fillna({"noise": 0.0}), rows, "0102")
    experiments = X.configurations(["9900", "0001", "0102"])
    lock, going, most, kept = threading.Lock(), [], [], X.measured

    class Noted:
        def __init__(self, df):
            self.df = df

        def coalesce(self, n):
            return self

        @property
        def write(self):
            return self

        def mode(self, how):
            return self

        def parquet(self, path):
            self.df.coalesce(1).write.mode("overwrite").parquet(path)
            with lock:
                going.pop()

    def noted(*args, **kw):
        with lock:
            going.append(1)
            most.append(len(going))
        return Noted(kept(*args, **kw))

    monkeypatch.setattr(X, "measured", noted)
    monkeypatch.setattr(X, "storage_bytes", lambda spark: 1)
    found = X.run(table, ["x", "noise"], experiments, scratch_dir(spark, "test", "alone"), parallel=8, params=SMALL)
    assert found.count() == len(experiments) and max(most) == 1 and X.Room(10).free == 10
