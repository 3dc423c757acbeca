"""The registered queries of this package: names, columns, and SQL oracles on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from tools.check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5_sharding": ["doc_id", "bytes", "shard_id"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_vector_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op8_mixing": ["doc_id", "n_tokens", "posterior", "rate", "copies"],
    "op9_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           "kept"],
}
#: Queries with rows of their own.
OTHERS = {
    "op11_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op12_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}
SOURCES = {"op4_warc": "pages", "op7_vector_dedup": "embeddings", "op9_chat": "conversations"}


@pytest.mark.parametrize("name", [n for n in [*COLUMNS, *OTHERS] if n in ORACLES])
def test_query_equals_oracle(spark, name):
    ok, note = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", COLUMNS)
def test_one_row_for_each_of_the_table(spark, name):
    got = QUERIES[name](spark, SF)
    assert got.columns[:len(COLUMNS[name])] == COLUMNS[name] or set(COLUMNS[name]) <= set(got.columns)
    rows = spark.read.parquet(f"{SF}/{SOURCES.get(name, 'documents')}.parquet")
    want = rows.count() if name != "op9_chat" else rows.select("conv_id").distinct().count() + 1
    assert got.count() == want


@pytest.mark.parametrize("name", OTHERS)
def test_columns_of_other_rows(spark, name):
    assert QUERIES[name](spark, SF).columns == OTHERS[name]


def test_quality_runs_no_python(spark):
    plan = QUERIES["op10_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_pipeline_is_registered(spark):
    assert "pipeline" in QUERIES and QUERIES["pipeline"](spark, SF).count() > 0
