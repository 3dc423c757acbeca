"""Registered queries against their oracles on the smallest tables, and the shape of their plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from tools.check import compare, connect

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# one query per family; the whole set is checked by tools/check.py
CHOSEN = ["frequent_prompt_words", "turn_pairs", "prompts", "search", "shuffled", "positional_split", "rules_applied",
          "contradictions", "classified_texts", "binary_evaluation", "tfidf", "detected_languages", "stream_turn_numbers"]


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 140


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, name):
    ok, note = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_oracles_parse():
    con = connect(SF)
    for name, sql in ORACLES.items():
        try:
            con.execute("EXPLAIN " + sql)
        except duckdb.Error as error:
            pytest.fail(f"{name}: {error}")


NATIVE = [q for q in ("prompts_english", "turn_numbers", "turn_pairs", "rules_applied", "classified_column", "word_counts",
                      "contradictions", "cleaned_texts_without_stop_words", "tfidf")]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert unwanted not in plan


def test_prompt_extraction_reads_only_its_columns_and_does_not_shuffle(spark):
    plan = QUERIES["prompts_english"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(role,user)" in plan


def test_entry(spark):
    assert entry.entry(spark).columns == ["word", "frequency"]
