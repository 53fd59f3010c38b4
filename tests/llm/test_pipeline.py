"""The pipeline and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from epipanel.llm import queries


def test_stages(spark, small):
    docs = before = corpus_pipeline.read_table(spark, small, "documents")
    for name, function in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(function(spark, docs, small))
        if name != "packing":
            assert sorted(after.columns) == sorted(before.columns)
            ids = {r["doc_id"] for r in after.select("doc_id").collect()}
            assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = after
    run = corpus_pipeline.run(spark, small)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_empty_and_odd_documents(spark, small, tmp_path):
    docs = corpus_pipeline.read_table(spark, small, "documents").limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, small))
    assert docs.count() == 0


@pytest.mark.parametrize("number", range(1, 14))
def test_each_number_has_a_query(number):
    assert sum(n.startswith(f"op{number}_") for n in entry.queries()) == 1


def test_search_is_the_sql(spark, duck, small):
    from oracle import compare

    assert compare(spark, duck, queries.QUERIES["op8_topk"], queries.ORACLE["op8_topk"], small) is None
