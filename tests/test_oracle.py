"""Every registered query against its SQL, on the smallest tables."""

import pytest

from evalweave.plans.registry import all_oracles, all_queries
from tests.conftest import SMALL
from tests.oracle import compare, duck

# One query per operator runs here; tests/oracle.py runs all of them at any scale.
SAMPLE = [
    "A1_jsonl_scan", "A5_material_inventory", "A6_latest_score", "B1_source_profile", "B6_split_violations", "C1_slug",
    "C2_material_context", "D2_pending_jobs", "D6_latest_rows", "D9_freeze_outcomes", "D10_stream_upsert", "E1_private_leaks",
    "E2_private_key_paths", "E3_text_ngrams", "E7_train_literals", "E8_evidence_inventory", "E10_section_rules", "E13_pages",
    "F4_cell_scores", "F6_paired_deltas", "F6_missing_pairs", "F7_coverage_cells", "F8_negative_transfer", "F13_token_usage",
    "F15_artifact_deltas", "F19_disagreements", "F20_taxonomy_violations", "F25_worklist", "G1_rule_support", "G3_lessons",
    "G5_anchor_context", "H1_eval_rows_all", "H5_eval_coverage", "I5_pack_audit", "D4_response_status", "E12_pattern_reports",
    "F6_missing_pairs_observed", "F9_group_report", "F11_score_rollup", "F11_coverage", "F11_tokens", "F18_pattern_summary",
    "F19_context", "F22_from_listing", "H1_skill_rows",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_with_an_oracle_is_registered():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, con, name):
    problems = compare(spark, con, all_queries()[name], all_oracles()[name], SMALL)
    assert problems == []
