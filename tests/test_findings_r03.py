"""Findings of the third round: exact p95, ranks and marks without wide shuffles, shared preparation, products."""

import datetime
import math

import numpy as np
import pyarrow as pa
from fixtures_small import SCHEMA, random_rows
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from matchspark.functions import moments as P
from matchspark.operators import models as M
from matchspark.operators import ratings as R
from matchspark.operators import splits as S
from matchspark.operators import windows as W
from matchspark.streaming import alerts as A


def test_p95_of_a_large_window_is_exact(spark):
    """200,000 values in one hour: a summary that is off by a ten thousandth of the ranks shows."""
    n = 200_000
    start = F.lit(datetime.datetime(2024, 1, 1, 10, 0, 0))
    rows = spark.range(0, n, 1, 8).select(start.alias("ts"), ((F.col("id") * 7919) % n).cast("double").alias("predicted"))
    got = A.p95_alert(rows, 60.0, "1 hour", "1 hour").collect()
    assert [r.p95 for r in got] == [math.ceil(0.95 * n) - 1]


def test_ranks_do_not_multiply_matches(spark):
    """One row a match enters the stream of a day; equal to counting the season's earlier results by hand."""
    rows = random_rows()
    matches = spark.createDataFrame(rows, SCHEMA)
    found = R.prior_rank(matches)
    assert "explode(_table" not in found._jdf.queryExecution().toString()
    order = sorted(rows, key=lambda r: (r[3], r[4], r[5], r[0]))
    state, want = {}, {}
    for r in order:
        for team in (r[4], r[5]):
            state.setdefault(team, [0, 0, 0])
        placed = sorted(state, key=lambda t: (*[-v for v in state[t]], t))
        want[r[0]] = (placed.index(r[4]) + 1, placed.index(r[5]) + 1)
        for team, gf, ga in ((r[4], r[6], r[7]), (r[5], r[7], r[6])):
            state[team] = [a + b for a, b in zip(state[team], (3 if gf > ga else 1 if gf == ga else 0, gf - ga, gf), strict=True)]
    assert {r.match_id: (r.home_season_rank_prior, r.away_season_rank_prior) for r in found.collect()} == want


def test_a_day_may_come_in_many_batches(spark):
    """The table of a day goes on from one Arrow batch to the next."""
    key, matches = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame(random_rows(), SCHEMA)
    want = sorted(R.prior_rank(matches).collect())
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 3)
        assert sorted(R.prior_rank(matches).collect()) == want
    finally:
        spark.conf.set(key, before)


def test_promoted_sides_are_marked_without_a_shuffle_of_all_rows(spark):
    """At most 15 rows of a side leave a task; marks equal a count of earlier matches."""
    late = [(r[0] + 1000, r[1], "25", r[3] + datetime.timedelta(days=366), *r[4:]) for r in random_rows(60, "AXYZ", 5)]
    rows = random_rows() + late
    found = W.promoted_proxy(spark.createDataFrame(rows, SCHEMA))
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[5], r[0])):
        want[r[0]] = tuple(int(r[2] == "25" and seen.get(t, 0) < 15) for t in (r[4], r[5]))
        for t in (r[4], r[5]):
            seen[t] = seen.get(t, 0) + 1
    assert {r.match_id: (r.is_home_promoted_proxy, r.is_away_promoted_proxy) for r in found.collect()} == want


def test_folds_are_found_without_a_join_of_wide_rows(spark):
    matches = spark.createDataFrame(random_rows(), SCHEMA)
    found = S.with_ts_fold(matches, S.ts_fold_starts(matches, 5))
    assert {r.match_id: r.fold for r in found.collect()} == {r.match_id: r.fold for r in S.ts_folds(matches, 5).collect()}


def test_only_features_with_gaps_get_a_median(spark):
    rows = spark.createDataFrame([(float(k % 7), None if k % 5 == 0 else float(k), float(k * k % 11)) for k in range(50)], "a double, b double, c double")
    features = ["a", "b", "c"]
    gaps = M.gapped(rows, features)
    assert gaps == ["b"] and len(M.preparation(features, [])) == 2
    some, every = (Pipeline(stages=M.preparation(features, g)).fit(rows).transform(rows) for g in (gaps, None))
    assert [r.features for r in some.collect()] == [r.features for r in every.collect()]
    whole, stages = M.assembled(rows, ["a", "c"], [], "b")
    assert whole.columns == ["b", "_raw"] and len(stages) == 1


def test_single_permutations_need_no_products_across():
    rng = np.random.default_rng(1)
    z, y, unit = rng.normal(size=(40, 3)), rng.normal(size=40), np.array([0.5, -1.0, 0.2])
    x = pa.array(z.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 40, pa.int64()), x, pa.array(y)], ["cell", "x", "y"])
    scale = np.zeros(3), np.ones(3)
    alone, both = (P.add_up(P.permuted_sums(unit, 0.1, 2, 7, *scale, pairs=p)([batch])) for p in (False, True))
    for r in (0, 1):
        assert len(alone[r]) == 6 and np.allclose(alone[r], both[r][:6])


def test_products_are_those_of_the_weighted_rows():
    rng = np.random.default_rng(2)
    z, y, w = rng.normal(size=(3000, 4)), rng.normal(size=3000), rng.poisson(1, 3000)
    batch = pa.RecordBatch.from_arrays([pa.array(z.tolist(), pa.list_(pa.float64())), pa.array(y)], ["x", "y"])
    (sums,) = P.add_up(P.products(lambda b: iter([(0, w)]), np.zeros(4), np.ones(4))([batch])).values()
    whole = P.with_ends(z, y)
    assert P.SOME_ROWS < 3000 and np.allclose(P.square(sums), (whole * w[:, None]).T @ whole)
