"""Every registered query against its SQL, and the size-checked ones again on their large-data path."""

import os

import pytest

from compare import compare, connect
from stratafold.plans.registry import PLANS

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGE = [
    "ap_by_model", "topk_capture", "rank_normalize", "rank_ensemble_weights", "rank_ensemble_with_prior", "ecdf", "distribution_summary", "holm_adjust",
    "zone_flags", "zone_distance", "parcel_distance", "zone_assign", "balanced_draw", "positive_sample", "stratified_split", "best_checkpoint",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(PLANS))
def test_query(spark, con, name):
    fn, sql = PLANS[name]
    compare(spark, con, fn, sql, FOLDER)


@pytest.mark.parametrize("name", LARGE)
def test_query_large_path(spark, con, large_paths, name):
    fn, sql = PLANS[name]
    compare(spark, con, fn, sql, FOLDER)


def test_entry(spark):
    import __spark_entry__ as contract
    out = contract.entry(spark)
    assert out.count() == 5
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_no_collect_of_rows_in_plans():
    """Plans never turn a whole result into driver rows."""
    import inspect

    from stratafold.plans import metric_plans, run_plans, spatial_plans, study_plans
    for module in (metric_plans, run_plans, spatial_plans, study_plans):
        source = inspect.getsource(module)
        assert ".collect()" not in source and "toPandas" not in source
