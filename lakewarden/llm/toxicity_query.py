"""op1_toxicity: a toxicity score for every text of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import toxicity

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = toxicity.score(docs, lexicon)
    predicted = F.when(rows.score >= toxicity.PREDICT_AT, 1).otherwise(0)
    return rows.select("doc_id", toxicity.held_out(rows.doc_id).alias("held_out"), "score", predicted.alias("predicted"), "hits")
