"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles as oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from renewlens.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = (
    "aggregate_asof build_features build_features_fixed build_labels row_index_per_user"
    " split_four_group target_encode_oof roc_auc reliability_curve campaign_curve"
    " sensitivity_grid psi_table noise_floor audit_frame rows_to_features data_contract"
    " seed_runs multi_seed_paired reverse_validation direction_table comparison_table threshold_sweep"
    " before_after grouped_vs_random_arms display_impact calibration_summary segment_report score_table"
    " attach_logs"
).split()
CHOSEN = sorted(catalog.ORACLES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    status, _, _, detail = oracle.compare(spark, con, SF, name)
    assert status == "ok", detail


def test_contract_of_the_entry_module(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 63


def test_plans_avoid_cartesian_products_and_python(spark):
    for name in ("build_features", "aggregate_asof", "build_labels", "window_aggs"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
            assert bad not in plan, (name, bad)
