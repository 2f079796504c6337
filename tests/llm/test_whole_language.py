"""Without labels the language stage still drops only texts without a letter."""

import corpus_pipeline


def test_unlabelled_corpus_is_kept(spark):
    docs = spark.createDataFrame([(0, None, None), (1, "", None), (2, "123 !", None), (3, "some words", None), (4, "日本語", None)], "doc_id long, text string, lang string")
    out = corpus_pipeline.languages(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {3, 4}
