import pytest

from check_oracle import compare, tables
from conftest import SF
from logsieve.plans.queries import ORACLES, QUERIES

# One query per family; check_oracle.py runs them all.
CHOSEN = ["log_canonical", "profile_all_levels", "feat_transition", "feat_cyclical", "feat_workload_ties",
          "split_by_rows", "split_by_cases", "inject_time", "ctx_no_resource", "context_stats", "minmax_scale",
          "knn_distance", "dbscan_noise", "lof_scores", "classification_metrics", "comparison_wide", "gmm_limit_grid",
          "gmm_thresholds", "score_histogram", "dbscan_noise_line", "predict_sweep",
          "iforest_tables"]


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"iforest_scores"}


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    assert compare(spark, tables(SF), SF, name, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["jitter_draws", "stored_report", "stored_scores", "stored_log", "few_score_limits"])
def test_store_query_equals_sql(spark, name):
    from logsieve.plans import store_queries

    assert compare(spark, tables(SF), SF, name, store_queries.QUERIES[name], store_queries.ORACLES[name]) == ""


def test_workload_in_segments_equals_sql(spark):
    from logsieve.operators import context
    from logsieve.plans.fixtures import fixture

    for name, log in (("feat_resource_workload", "clicks_gaps"), ("feat_workload_ties", "lines")):
        def segmented(spark, sf, log=log):
            return context.resource_workload(fixture(spark, sf, log), limit=50).select("event_key", "resource_workload")

        assert compare(spark, tables(SF), SF, name, segmented, ORACLES[name]) == ""
