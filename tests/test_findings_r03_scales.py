"""Findings F9 and F13: scales come from arrays in tasks; last rows come from the plain rows."""

import numpy as np
from pyspark.sql import functions as F

from matchspark.operators import importance as I
from matchspark.operators import ratings as R
from matchspark.plans import prior


def test_scales_are_summed_in_arrays(spark, monkeypatch):
    """Missing and NaN values are left out, equal values have no deviation, and no plan has a sum for each feature."""
    rng = np.random.default_rng(3)
    values = rng.normal(1e6, 1e-3, 500)
    rows = [(float(v), 0.1, None, None if k % 3 else float(k), float("nan") if k % 2 else 2.0 + k, k % 2 == 0) for k, v in enumerate(values)]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, even boolean").repartition(7)
    aggregates = []
    monkeypatch.setattr(type(df), "agg", lambda self, *cols: aggregates.append(cols))
    centre, spread = I.scales(df, names)
    assert not aggregates
    d, e = np.arange(0, 500, 3), 2.0 + np.arange(0, 500, 2)
    assert np.allclose(centre, [values.mean(), 0.1, 0, d.mean(), e.mean()], rtol=1e-12)
    assert np.allclose(spread, [values.std(), 1, 1, d.std(), e.std()], rtol=1e-6) and spread[1] == spread[2] == 1.0
    nothing = I.scales(df.filter(F.lit(False)), names)
    assert (nothing[0] == 0).all() and (nothing[1] == 1).all()


def test_last_rows_do_not_run_the_totals_again(spark, monkeypatch):
    """The tails of the cells come from the team view, not from the rows that the totals were added to."""
    from fixtures_small import SCHEMA, random_rows

    seen, kept = [], prior.tails_before_cell

    def tails(df, *args, **kw):
        seen.append(df.columns)
        return kept(df, *args, **kw)

    monkeypatch.setattr(prior, "tails_before_cell", tails)
    R.side_features(spark.createDataFrame(random_rows(), SCHEMA))
    assert len(seen) == 1 and not [c for c in seen[0] if c.startswith(("a_", "s_", "_c_"))]
