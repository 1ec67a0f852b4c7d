import pytest
from oracle import same
from test_whole_job import brute_near

import corpus_pipeline
from tidemark import llm
from tidemark.llm import common


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, sf, name):
    same(spark, sf, llm.queries()[name], llm.oracle_sql()[name])


def test_all_are_registered():
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_stages(spark, sf):
    """Each stage by hand from its own input."""
    docs = common.documents(spark, sf)
    names = docs.columns
    kept = common.written(corpus_pipeline.keep_good(spark, docs, sf), "t")
    assert kept.columns == names and 0 < kept.count() <= docs.count()
    lines = common.written(corpus_pipeline.drop_lines(spark, kept, sf), "t")
    assert lines.columns == names and lines.count() == kept.count() and lines.where("n_chars <> length(text)").count() == 0
    near = common.written(corpus_pipeline.drop_near_copies(spark, lines, sf), "t")
    left, _ = brute_near([(r["doc_id"], r["text"] or "") for r in lines.collect()])  # three bits, or a Jaccard similarity of 0.8
    assert {r["doc_id"] for r in near.select("doc_id").collect()} == left
    mixed = common.written(corpus_pipeline.mix(spark, near, sf), "t")
    assert mixed.columns == names
    most = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert most <= 3
    packed = corpus_pipeline.pack(spark, mixed, sf)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()
