"""Every registered query against its SQL, on whole driver tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module

#: Queries that SQL cannot express; tests/llm holds them against plain Python, a round trip or held-out accuracy.
WITHOUT_SQL = {
    "op1_quality_rules", "op2_token_counts", "op3_quality_ranking", "op4_language_mix", "op5_source_mix", "op6_page_diff", "op8_token_files", "op10_jaccard_join", "pipeline",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) & set(entry_module.oracle_sql())))
def test_query_matches_sql(spark, sf_dir, con, name):
    got = entry_module.queries()[name](spark, sf_dir)
    assert difference(got, con, entry_module.oracle_sql()[name]) is None


def test_every_other_query_is_named_here():
    assert set(entry_module.queries()) - set(entry_module.oracle_sql()) <= WITHOUT_SQL
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).columns == ["doc_id", "raw_score", "score", "severity"]
