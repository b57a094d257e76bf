import importlib

import pytest

import corpus_pipeline
from skyledger.llm import decontaminate, quality, registry, simhash, toxicity
from skyledger.llm.common import DOCUMENT_COLUMNS, table


@pytest.fixture(scope="module")
def kept(spark, small):
    """Rows after each stage."""
    docs, after = table(spark, small, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema if len(after) < 4 else None)
        after.append(docs)
    return after


def test_stages_follow_their_operators(spark, small, kept):
    docs = table(spark, small, "documents")
    good = {r.doc_id for r in quality.score_quality(docs).collect() if r.keep}
    assert {r.doc_id for r in kept[0].collect()} == good
    toxic = {r.doc_id for r in toxicity.score_toxicity(kept[0], table(spark, small, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in kept[1].collect()} == good - toxic
    first = {r.component_id for r in simhash.near_duplicate_components(kept[1]).collect()}
    assert {r.doc_id for r in kept[2].collect()} == first and kept[2].count() == len(first)
    benchmark = table(spark, small, "benchmark")
    hit = {r.doc_id for r in decontaminate.find_leaks(kept[2], benchmark).collect() if r.contaminated}
    before, after = ({r.doc_id: r.text for r in frame.collect()} for frame in kept[2:4])
    assert hit and all(after.get(k) == before[k] for k in before if k not in hit)
    assert not any(r.contaminated for r in decontaminate.find_leaks(kept[3], benchmark).collect())
    assert {r.doc_id: r.decoded for r in kept[4].collect()} == after
    assert all(frame.columns == DOCUMENT_COLUMNS for frame in kept[:4])


def test_run_gives_the_rows_of_the_last_stage(spark, small, kept):
    assert sorted(corpus_pipeline.run(spark, small).collect(), key=str) == sorted(kept[4].collect(), key=str)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert set(registry.all_queries()) | {"pipeline"} <= set(entry.queries())
    assert set(registry.all_oracles()) <= set(entry.oracle_sql())
