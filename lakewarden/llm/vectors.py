"""Vectors of an Arrow batch as whole numbers, and sums of large arrays over all tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import store

#: Partial sums that one task adds up, and numbers in one of them: together 64 MB.
FAN, CELL = 64, 1 << 17
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(column: pa.Array, scale: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column have no null and only finite entries, and floor(scale * entry) of those.

    Numbers beyond 64 bits become the nearest that has them. Vectors that are
    shorter than ``dims`` (by default the longest of the column) end in zeros.
    """
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten()  # without what lies under nulls
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are not a number
    bad = ~np.isfinite(entries)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = valid.copy()
    keep[owner[bad]] = False
    dims = int(sizes[keep].max(initial=0)) if dims is None else dims
    with np.errstate(over="ignore", invalid="ignore"):
        floors = np.floor(entries * scale)
        high, low = floors >= 2.0**63, floors < -(2.0**63)
        numbers = np.where(high | low | bad, 0, floors).astype(np.int64)
    numbers[high], numbers[low] = _MOST, _LEAST
    out = np.zeros((int(keep.sum()), dims), np.int64)
    row = np.cumsum(keep) - 1
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = keep[owner]
    out[row[owner[own]], place[own]] = numbers[own]
    return keep, out


@dataclass(frozen=True)
class Shape:
    """Of the vectors that are kept: how many there are, the longest one's length (1 at least) and the largest magnitude of their numbers."""

    rows: int
    dims: int
    most: int

    @property
    def dtype(self) -> str:
        return "<i2" if self.most < 1 << 15 else "<i4" if self.most < 1 << 31 else "<i8"


def shape(rows: DataFrame, scale: int, column: str = "embedding") -> Shape:
    """The shape of a column of vectors; one row a task goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dims, least, most = 0, 0, 0, 0
        for batch in batches:
            _, x = whole(batch.column(0), scale)
            if x.size:
                least, most = min(least, int(x.min())), max(most, int(x.max()))
            n, dims = n + len(x), max(dims, x.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (n, dims, least, most)], names=["n", "dims", "least", "most"])

    found = store.mapped(rows.select(column), run, "n long, dims long, least long, most long", "vectors").agg(F.sum("n"), F.max("dims"), F.min("least"), F.max("most")).first()
    return Shape(found[0] or 0, max(1, found[1] or 0), max(-(found[2] or 0), found[3] or 0))


def planes(x: np.ndarray, wide: bool) -> list[np.ndarray]:
    """Numbers as they are, or their upper and lower halves, whose sums need no more than 64 bits."""
    return [x >> 32, x & 0xFFFFFFFF] if wide else [x]


def joined(sums: np.ndarray, wide: bool) -> list[int]:
    """Sums of :func:`planes` as whole numbers of any size."""
    if not wide:
        return [int(v) for v in sums]
    high, low = np.split(sums, 2)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]


def cells(arrays: list[np.ndarray]) -> pa.RecordBatch:
    """(kind, cell, task, part): 64-bit arrays by number, in pieces of bounded size, as this task's partial sums."""
    task, made = TaskContext.get().partitionId(), []
    for kind, array in enumerate(arrays):
        flat = np.ascontiguousarray(array, np.int64).ravel()
        made += [(kind, at // CELL, task, flat[at : at + CELL].tobytes()) for at in range(0, len(flat), CELL)]
    columns = list(zip(*made, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "cell", "task", "part"])


CELLS = "kind int, cell int, task int, part binary"


def summed(parts: DataFrame, tasks: int) -> DataFrame:
    """(kind, cell, task, part): the sums of all tasks' cells, by a tree whose nodes add up at most :data:`FAN` cells."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.int64) for p in frame.part)
        return pd.DataFrame({"kind": [key[0]], "cell": [key[1]], "task": [key[2]], "part": [total.tobytes()]})

    for _ in range(max(1, math.ceil(math.log(max(tasks, 2), FAN)))):
        parts = parts.groupBy("kind", "cell", F.floor(F.col("task") / FAN).cast("int").alias("task")).applyInPandas(run, CELLS)
    return parts


def collected(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """The sums by kind; their size depends on the vectors' length, not on their number."""
    found: dict[int, list] = {}
    for r in sorted(summed(parts, tasks).collect(), key=lambda r: (r.kind, r.cell)):
        found.setdefault(r.kind, []).append(np.frombuffer(r.part, np.int64))
    return {k: np.concatenate(v) for k, v in found.items()}
