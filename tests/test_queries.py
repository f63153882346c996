"""Registered queries against DuckDB at the smallest scale (all of them: python -m tests.oracle)."""

import pytest

from proofmill.plans.registry import oracle_queries, spark_queries
from tests.oracle import DATA, compare, duck

FOLDER = f"{DATA}/sf0.001"
SAMPLE = ["lexical_anchors", "plan_queries", "search_topk", "domain_signal", "tree_flags", "score_risk", "coverage_score", "module_summary", "style_metrics", "style_audit",
          "validate_repositories", "cargo_manifest_facts", "python_symbols", "resolve_relative_imports", "relation_support", "interval_cover", "best_line_window", "dedupe_slices",
          "annotate_strength", "review_gate", "claim_checks", "mapping_checks", "eval_rollup", "changed_files", "pack_fingerprint", "phase_audit_batch"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, con, key):
    ok, note = compare(spark_queries()[key](spark, FOLDER), con, oracle_queries()[key])
    assert ok, note


def test_keys_agree():
    assert set(oracle_queries()) <= set(spark_queries())
