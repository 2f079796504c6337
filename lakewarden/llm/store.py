"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session, as in tests, gets a new one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = folder.get() if folder.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lakewarden-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: its lineage ends there, and a lost executor costs nothing that is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most ids that are sent to every executor: at 16 bytes each, some 16 MB.
MOST_SENT = 1_000_000


def with_ids(rows: DataFrame, ids: DataFrame, key: str | list[str], how: str, most: int = MOST_SENT) -> DataFrame:
    """Joins rows with a written table of ids: sent to the rows if their count allows, else both are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids.hint("merge"), key, how)


#: A key counts as hot with so many rows, or with this share of all rows if that is more: there are then at most 50,000 hot keys.
HOT_ROWS, HOT_SHARE = 1_000, 1 / 50_000


def hot_join(rows: DataFrame, side: DataFrame, key: str | list[str], size: str = "n") -> DataFrame:
    """Inner join of written rows with a written table that has one row a key, which tells how many rows of that key there are.

    Rows of hot keys stay where they are: the few hot rows of the side are
    sent to them. All others are shuffled, so no task gets more than a hot
    key's bound of one key.
    """
    total = side.agg(F.sum(size)).first()[0] or 0
    bound = max(HOT_ROWS, int(total * HOT_SHARE))
    hot, cold = side.where(F.col(size) >= bound), side.where(F.col(size) < bound)
    if not hot.limit(1).count():
        return rows.join(cold.hint("merge"), key)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return near.unionByName(far)


#: Rows and bytes of an Arrow batch: with Spark's own bounds a batch of long texts takes a large part of a worker's memory, several times over.
BATCH_ROWS, BATCH_BYTES = 2_000, 2 << 20
#: Rows that the scan of a table decodes at once: 4096 rows of long texts are buffers of many megabytes, which make the heap grow.
SCAN_ROWS = 512


#: Of a Python worker: name to (key, object).
_HELD: dict[str, tuple[Any, Any]] = {}


def _returned() -> None:
    """Gives a Python worker's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def dropped(operator: str, also: str = "") -> None:
    """Drops what this worker holds of other operators than the one named, and the object of the name ``also``."""
    for name in [k for k in _HELD if k == also or k.split(".")[0] != operator]:
        del _HELD[name]


def held(operator: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, held by a Python worker for the tasks that follow.

    Workers outlive stages. So that memory does not add up, one holds only the
    newest object of each name, and only those of the operator at work.
    """
    known, value = _HELD.get(operator, (None, None))
    if known is not key:
        if known != key:
            dropped(operator.split(".")[0], operator)
            _returned()
            value = make()
        _HELD[operator] = (key, value)  # the same object again is then known without a comparison
    return value


def mapped(rows: DataFrame, function, schema, operator: str = "") -> DataFrame:
    """``mapInArrow`` with smaller batches of scans and of Arrow, which the session keeps from then on.

    Its tasks drop what workers hold of other operators, and return free
    memory when they end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped(operator)
        yield from function(batches)
        _returned()

    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    return rows.mapInArrow(run, schema)
