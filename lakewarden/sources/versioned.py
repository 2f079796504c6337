"""Tables whose rows can be replaced by key: a change writes the rows that changed, and nothing else.

A table is a folder with ``delta=<version>`` for each change and
``base=<version>`` for each compaction. A read takes the newest base, the
deltas behind it, and of each key the row of the newest version, so a change
costs as much as its own rows, and a version that is written again replaces
what it wrote. Partial aggregation runs before the shuffle of a read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Table:
    """A table at a path, by key columns; a key may hold nulls, and null is a key like others."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def versions(self, kind: str = "delta") -> list[int]:
        """The versions that are there in full, in order."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def put(self, rows: DataFrame, version: int | None = None) -> int:
        """Writes rows that are new or replace those of their keys, of which each may occur once, as a version (by default the next)."""
        if version is None:
            version = max([-1, *self.versions(), *self.versions("base")]) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/delta={version}")
        return version

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest row of each key, of all versions or those before one; None while there is none."""
        known = lambda kind: [v for v in self.versions(kind) if before is None or v < before]
        base = max(known("base"), default=None)
        parts = [(f"delta={v}", v) for v in known("delta") if base is None or v > base]
        if base is not None:
            parts.insert(0, (f"base={base}", base))
        if not parts:
            return None
        rows = None
        schema = self.spark.read.parquet(f"{self.path}/{parts[-1][0]}").schema
        for folder, version in parts:
            own = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").withColumn("__version", F.lit(version).cast("long"))
            rows = own if rows is None else rows.unionByName(own)
        others = [c for c in schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "__version").alias("__row"))
        return newest.select(*self.keys, *(F.col(f"__row.`{c}`").alias(c) for c in others)).select(*schema.names)

    def compact(self, before: int | None = None) -> None:
        """Writes what a read gives as a base, so that reads need no deltas up to here (or to those before a version)."""
        versions = [v for v in self.versions() if before is None or v < before]
        rows = self.read(before)
        if rows is not None and versions:
            rows.write.mode("overwrite").parquet(f"{self.path}/base={versions[-1]}")
