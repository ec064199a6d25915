"""A cross-section of the named queries against their SQL twins on the smallest tables."""

import os

import pytest
from check_oracle import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["s02_bulk_append", "c01_verify_tampered_log", "c02_semantic_violations", "a18_merkle_root", "a20_inclusion_proofs", "a16_quorum",
         "a07_proposal_board", "p07_resolved_meta", "t03_top_keywords", "d02_coherence", "d31_fused_report", "q01_relevance", "t01_exact_knn",
         "t02_hybrid", "c03_build_context", "w10_greedy_budget", "t07_path_aware", "a24_w08_output_modes", "j14_scar_matches",
         "j13_t11_faculty_gap", "c10_bundle_verdicts", "a09_domain_rollup", "s04_numbered_files"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, note = compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).where("ok").count() > 0
