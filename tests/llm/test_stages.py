"""Each pipeline stage on its own: nulls, empty and long texts, repeated rows, empty tables, columns named like ours."""

import pytest
from pyspark.sql import functions as F
from test_whole_job import brute_near

import corpus_pipeline
from tidemark.llm import common

LINE = "This shared line is certainly longer than forty characters, yes."
TEXTS = [
    (1, None), (2, ""), (3, " \n "), *((k, f"{LINE}\nown words of document {k} follow here") for k in range(4, 10)), (10, "one two three four five six seven"),
    (11, "One two  three four five six seven"), (12, "lorem ipsum dolor sit amet " * 5_000), (13, "word"), (13, "word"), (None, "no id here at all, as it was never given"),
]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", "a", None][k % 3], len(t or ""), k, f"x{k}", float(k)) for k, (i, t) in enumerate(TEXTS)]
    named = "doc_id long, text string, lang string, source string, n_chars long, tm_id long, kept string, sequence_id double"
    return common.written(spark.createDataFrame(rows, named).repartition(3), "t")


@pytest.mark.parametrize("name", STAGES)
def test_an_empty_table_stays_empty(spark, sf, docs, name):
    empty = docs.where("false")
    made = STAGES[name](spark, empty, sf)
    assert made.count() == 0
    assert name == "best-fit packing" or made.columns == docs.columns


def test_quality_keeps_texts_without_words_and_all_columns(spark, sf, docs):
    made = STAGES["quality classifier"](spark, docs, sf)
    assert made.columns == docs.columns
    assert {1, 2, 3} <= {r["doc_id"] for r in made.collect()}


def test_lines_go_but_documents_stay(spark, sf, docs):
    made = STAGES["line dedup"](spark, docs, sf)
    assert made.columns == docs.columns and made.count() == len(TEXTS)
    assert [r["doc_id"] for r in made.where(F.col("text").contains(LINE)).collect()] == [9]
    assert made.where("n_chars <> length(coalesce(text, ''))").count() == 0
    assert {r["tm_id"] for r in made.collect()} == set(range(len(TEXTS)))


def test_one_of_each_near_group_stays(spark, sf, docs):
    made = STAGES["SimHash near-dedup"](spark, docs, sf)
    left, _ = brute_near([(i, t or "") for i, t in TEXTS if i is not None])
    got = [r["doc_id"] for r in made.collect()]
    assert made.columns == docs.columns
    assert {i for i in got if i is not None} == left and got.count(13) == 2 and got.count(None) == 1


def test_mix_takes_no_text_without_words(spark, sf, docs):
    made = STAGES["mixing sources"](spark, docs, sf)
    got = [r["doc_id"] for r in made.collect()]
    assert made.columns == docs.columns and not {1, 2, 3} & set(got)
    assert max(got.count(i) for i in set(got) - {13}) <= 3 and got.count(13) <= 6


def test_packing_takes_every_row(spark, sf, docs):
    made = STAGES["best-fit packing"](spark, docs, sf)
    assert made.where("piece = 0").count() == len(TEXTS)
    assert made.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n > 4096 or n <> m").count() == 0
