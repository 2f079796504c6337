"""op4_langid: the language of every text of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import langid

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profile = langid.learn(docs)
    rows = langid.predict(docs.select("doc_id", "text"), profile)
    return rows.select("doc_id", langid.held_out(rows.doc_id).alias("held_out"), "lang_pred", "score", "entropy")
