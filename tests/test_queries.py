"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")
CHECKED = ("one_hot", "dirichlet_silos", "split_70_20_10", "undersample", "transform_chain", "knn", "smote", "auc",
           "classification_report", "fedf1", "bag_trees", "merge_eval", "scan_results", "parse_results",
           "parse_results_flat", "write_read_model", "average_results", "pca_reconstruction",
           "pca_uncorrelated", "optimal_logistic", "boost_learns", "step_local_fit", "step_local_evaluate",
           "step_rounds_fedf1", "step_fit_metrics", "step_central_baseline", "step_sweep", "summary_report", "mlp_step",
           "forest_roots", "fit_statuses", "rounds_without_broken", "customer_fits", "boost_two", "boost_onward")


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    from workload.check import compare, duck

    assert compare(spark, duck(SF), name, SF).startswith("ok")


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).collect()) > 0


def test_split_moves_no_rows(spark):
    """Labelling rows with their split must not shuffle them: the scan reaches the output through broadcasts."""
    from siloml.functions.staging import stage
    from siloml.operators import silos
    from workload.queries import regions

    rows = stage(regions(spark, SF))
    plan = silos.split_70_20_10(rows, 1, 5)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Initial Plan")[-1] if "Initial Plan" in plan else plan
    top = main[:main.index("FileScan")]
    assert "BroadcastHashJoin" in top and "SortMergeJoin" not in top and "Exchange hashpartitioning" not in top
