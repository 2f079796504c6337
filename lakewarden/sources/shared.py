"""A place for tables that the driver and all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names. Where that is unset, a local session, as in tests, gets a folder of its own; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lakewarden-')}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def exported(rows: DataFrame, path: str) -> None:
    """Writes a table as JSON, a row a line, its nulls named."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def purged(rows: DataFrame, path: str) -> None:
    """Empties a stored table; its columns stay."""
    rows.limit(0).write.mode("overwrite").parquet(path)
