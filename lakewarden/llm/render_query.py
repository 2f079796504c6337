"""op10_render: the visible text of all ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import render

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.render(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
