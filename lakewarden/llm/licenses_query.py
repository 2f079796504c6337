"""op2_licenses: license notices in all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import licenses

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
