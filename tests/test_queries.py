"""Registry shape, and a cross-section of queries against their SQL twins at the smallest scale."""

import pytest

from oracle_check import compare, connect
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ("technique_metrics", "metrics_by_generator", "roc_curve", "delong_comparison", "all_wrong_by_generator",
          "normalised_scores", "stratified_split", "fusion_calibration_split", "duplicate_members", "content_leakage",
          "component_metrics", "service_parity_summary", "published_gap", "quantised_dct", "benford_block_features",
          "cooccurrence_horizontal", "perturbed_signals", "arrival_validation", "latency_summary", "standardised_scores")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None
