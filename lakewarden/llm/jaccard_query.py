"""op7_jaccard: near duplicates among all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import jaccard

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
