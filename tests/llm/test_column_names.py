"""Foreign columns come through every stage and operator that keeps columns, whatever their names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import flac, mixing, ngram_join, suffix_array, superkmer

NAMES = ["kept", "spans", "n_removed", "a.b", "__doc", "__th", "__t2", "__text", "__w", "stay_id", "stay_hash", "doc_id_", "size_", "source_", "turn_", "other_0", "id", "n", "__mix_n"]


@pytest.fixture(scope="module")
def docs(spark):
    same = "one and the same sentence of some length that is there in two of the documents, and so goes once from the later of them"
    rows = [(1, "the first document says this " + same, "en", "s"), (2, "another one has other words before " + same, "en", "s"), (3, None, None, None), (4, "", "en", "t"), (5, "short", "en", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for i, c in enumerate(NAMES):
        frame = frame.withColumn(c, F.lit(i))
    return frame


def own(df):
    assert set(NAMES) <= set(df.columns)
    rows = df.select(*(F.col(f"`{c}`") for c in NAMES)).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(range(len(NAMES)))]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    own(out)


def test_operators(docs):
    own(ngram_join.keep_one(docs))
    own(mixing.take_mix(docs))
    own(flac.encode_text(docs))
    own(superkmer.remove_repeats(docs.withColumnRenamed("n_removed", "x"), 3).withColumnRenamed("n_removed", "y").withColumnRenamed("x", "n_removed"))
    cut = suffix_array.remove_repeats(docs, 50)  # its own names are replaced, as it says
    assert dict(cut.dtypes)["kept"] == "binary" and cut.select("`a.b`", "__doc", "__text").distinct().count() == 1
