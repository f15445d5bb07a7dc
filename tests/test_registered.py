"""Registered queries beside their checking SQL (the light ones; oracle_check.py runs all)."""

import pytest

from oracle_check import compare, connect

SF = "/root/testdata/sf0.01"
LIGHT = ["clean_text", "dedup_key", "derive_slot", "derive_colors", "triage", "validate_batch", "normalize_multilingual",
         "vector_topk", "coverage_report", "latency_percentiles", "overlap_pairs", "upsert_catalog"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", LIGHT)
def test_matches_sql(spark, con, name):
    from __spark_entry__ import ORACLES, queries

    assert compare(queries()[name](spark, SF), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 140
