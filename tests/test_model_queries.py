"""Every fit query runs to its end on the smallest folder."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
FITS = [
    "fit_pipeline", "fit_nb", "batch_score", "model_roundtrip", "fit_regressors", "feature_select", "permutation_importance",
    "cv_metrics", "tune", "bootstrap_importance", "interaction_importance", "pca_project",
]


@pytest.mark.parametrize("name", FITS)
def test_fit_queries_run(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_regressors_name_their_family(spark):
    rows = entry.queries()["fit_regressors"](spark, FOLDER).collect()
    assert {r.model for r in rows} == {"linear", "ridge", "lasso", "boosted_trees", "random_forest"}
