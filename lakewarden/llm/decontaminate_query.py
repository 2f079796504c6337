"""op8_decontaminate: benchmark passages in all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import decontaminate

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
