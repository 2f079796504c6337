"""op6_warc: archives all ``pages``, copies the archive with some damage, and audits the copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import store, warc

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder, copy = store.new_path(spark, "archive"), store.new_path(spark, "replica")
    manifest = warc.write(pages, folder)
    warc.replicate(manifest, folder, copy, warc.flipped)
    ours = warc.tree(manifest, warc.sizes(spark, folder))
    theirs = warc.tree(warc.hashed(manifest, copy), warc.sizes(spark, copy))
    bad = warc.audit(ours, theirs).where("number is not null").select("file", "number", F.lit(False).alias("sound"))
    rows = manifest.join(bad, ["file", "number"], "left")
    return rows.select("page_id", "url", "file", "number", "offset", "length", "sha256", F.coalesce("sound", F.lit(True)).alias("sound"))
