"""op3_packing: all ``documents`` in sequences of at most 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import packing

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
