"""Every registered operator over the whole small tables, against its SQL where it has some."""

import duckdb
import pytest

import oracle_check
from skyledger.llm import registry
from skyledger.llm.common import table

QUERIES, ORACLES = registry.all_queries(), registry.all_oracles()
TABLES = {
    "op3_html_extraction": "pages",
    "op6_url_reputation": "pages",
    "op11_vector_codes": "embeddings",
}
CONTRACT = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_simhash": "doc_id fingerprint component_id",
    "op3_html_extraction": "page_id url text n_chars",
    "op4_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_url_reputation": "page_id host path rule verdict",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op13_mixing": "doc_id size source_size target taken",
    "op10_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.fixture(scope="module")
def connection(small):
    made = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "embeddings"):
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, connection, name):
    assert oracle_check.difference(QUERIES[name](spark, small), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op9_token_rollups", "op12_hard_negatives"}))
def test_one_row_per_row_of_the_table(spark, small, name):
    got = QUERIES[name](spark, small)
    assert set(CONTRACT.get(name, "").split()) <= set(got.columns)
    assert got.count() == table(spark, small, TABLES.get(name, "documents")).count()


def test_every_text_comes_back(spark, small):
    assert QUERIES["op8_sentencepiece"](spark, small).where("not round_trip").count() == 0
