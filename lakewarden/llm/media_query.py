"""op5_media: every text of ``documents`` as a stored payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import media

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "digest", "shard", "offset", "length", "width", "height", "bit_depth", "channels",
    )
