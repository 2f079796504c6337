"""op11_whitening: all ``embeddings`` on their first components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import whitening

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(rows)
    shares = [] if model is None else [model.explained(k) for k in range(min(whitening.COMPONENTS, model.shape.dims))]
    return whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model and model.n).cast("long").alias("n"), "deviation", "whitened",
        F.try_element_at(F.array(*(F.lit(s).cast("double") for s in shares)).cast("array<double>"), F.col("at") + 1).alias("explained"), F.lit(model and model.identity_error).cast("double").alias("identity_error"),
    )
