"""op12_minhash: fingerprints of all ``documents`` and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import minhash

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    return rows.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next")
