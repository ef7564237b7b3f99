"""The queries that SQL can express, against their SQL on the smallest tables; the others' columns."""

import os

import duckdb
import pytest
from foldlog.llm import queries
from tests.core.test_catalogue import shown

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op3_semi_markov_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op6_compression_bands": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_tree_scoring": {"page_id", "url", "text", "n_chars"},
    "op8_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_log_templates": {"doc_id", "text", "n_dropped"},
}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got, wanted = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    assert shown(got, columns) == shown(wanted, columns)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    assert COLUMNS[name] <= set(queries.QUERIES[name](spark, SF).columns)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
