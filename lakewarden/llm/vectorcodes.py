"""Compression of vectors to codes: one codebook for each of several parts, learned and applied exactly on whole numbers.

Entries become floor(scale * entry); a vector is cut into parts of equal
length. A codebook starts as the parts of the vectors with the smallest ids;
each round gives every part its nearest entry and replaces entries by the floor
of the mean of their parts.

The nearest entry is found in two steps. A float32 matrix product gives all
scalar products of a block of parts with the entries. Its error is bounded
whatever the order in which it is added up: with u = 2^-24 and d numbers a
part, each computed product x.c is within g(d + 2) |x| |c| of the exact one,
where g(k) = k u / (1 - k u); two of the d + 2 roundings are those of the
numbers to float32. So |c|^2 - 2 x.c lies in an interval, and an entry can be
nearest only if its interval begins no later than the first one ends. All such
entries are evaluated again in 64-bit whole numbers; the least distance wins,
and of equal ones the lowest index. Numbers so large that their squared
distances might not fit 64 bits are evaluated as whole numbers of any size,
without the screening.

A round reads the table once: tasks add up counts and sums for each entry, and
a tree adds up the tasks' sums. Only codebooks go to the driver.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped; empty and shorter vectors end in zeros, as do all if the length
does not divide by the number of parts; numbers beyond 64 bits become the
nearest that has them. Rows with equal ids start in the order of their vectors,
rows without an id come after all others. With fewer vectors than entries the
codebooks are as small. An ``error`` or sum of errors that does not fit 64 bits
is null. Without vectors there are no rows and no entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import store, vectors

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts that are screened at once, and entries that are evaluated again at once.
BLOCK, AGAIN = 2048, 1 << 16
#: Half the distance from 1 to the next float32.
U32 = 2.0**-24


def _padded(dims: int, parts: int) -> int:
    return -(-dims // parts) * parts


@dataclass(frozen=True, eq=False)
class Codebooks:
    """Entries by part (parts x entries x numbers) of one codebook a part."""

    entries: np.ndarray
    dims: int
    most: int
    scale: int = SCALE

    @property
    def wide(self) -> bool:
        """Whether a squared distance of two parts might not fit 64 bits."""
        return self.entries.shape[2] * (2 * max(self.most, 1)) ** 2 >= 1 << 62

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _exact(x: np.ndarray, entries: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of a part and an entry, in the type of the numbers given."""
    out = np.empty(len(rows), x.dtype)
    for at in range(0, len(rows), AGAIN):
        d = x[rows[at : at + AGAIN]] - entries[columns[at : at + AGAIN]]
        out[at : at + AGAIN] = (d * d).sum(1)
    return out


def _candidates(x: np.ndarray, entries: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (part, entry), in that order, whose interval overlaps that of the part's best entry.

    Float64 steps have a relative error far below 2^-40 for parts of up to a
    thousand numbers; the terms with 2^-40 cover them.
    """
    k = x.shape[1] + 2
    gamma = k * U32 / (1 - k * U32)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    lengths = np.sqrt(norms)
    about = norms[None, :] - 2 * product
    error = 2 * gamma * (1 + 2.0**-40) * size[:, None] * lengths[None, :] + 2.0**-40 * (norms[None, :] + 2 * np.abs(product)) + 2.0**-20
    best = (about + error).min(1)
    return np.nonzero(about - error <= best[:, None])


def nearest(x: np.ndarray, entries: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each part the index of its nearest entry, the lowest of equal ones, and the exact squared distance."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), object if wide else np.int64)
    norms = (entries.astype(np.float64) ** 2).sum(1)
    if wide:
        x, entries = x.astype(object), entries.astype(object)
    for low in range(0, len(x), BLOCK):
        part = x[low : low + BLOCK]
        if wide:
            rows, columns = (v.ravel() for v in np.indices((len(part), len(entries))))
        else:
            rows, columns = _candidates(part, entries, norms)
        exact = _exact(part, entries, rows, columns)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == np.repeat(least, np.diff(starts, append=len(rows))))
        _, first = np.unique(rows[hits], return_index=True)
        at[low : low + BLOCK], far[low : low + BLOCK] = columns[hits[first]], least
    return at, far


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """Vectors as (part, row, number), zeros added where the length does not divide."""
    dims = _padded(x.shape[1], parts)
    x = np.pad(x, ((0, 0), (0, dims - x.shape[1])))
    return np.ascontiguousarray(x.reshape(len(x), parts, dims // parts).transpose(1, 0, 2))


def seeds(rows: DataFrame, shape: vectors.Shape, scale: int, entries: int, key: str, column: str) -> np.ndarray:
    """The vectors with the smallest ids: each task sends on its own smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            keep, x = vectors.whole(batch.column(1), scale, shape.dims)
            ids = batch.column(0).filter(pa.array(keep)).to_pylist()
            bar = best[-1][:2] if len(best) == entries else None
            fresh = [((i is None, i or 0), k) for k, i in enumerate(ids) if bar is None or (i is None, i or 0) <= bar]
            best = sorted(best + [(*place, tuple(x[k].tolist())) for place, k in fresh])[:entries]
        made = list(zip(*best, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.bool_()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.list_(pa.int64()))], names=["late", "id", "x"])

    first = store.mapped(rows.select(F.col(key).cast("long").alias(key), column), run, "late boolean, id long, x array<long>", "vectorcodes")
    return np.array([r.x for r in first.orderBy("late", "id", "x").limit(entries).collect()], np.int64).reshape(-1, shape.dims)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", column: str = "embedding") -> Codebooks:
    """The codebooks of a table of vectors."""
    shape = vectors.shape(rows, scale, column)
    books = Codebooks(_parts(seeds(rows, shape, scale, entries, key, column), parts), shape.dims, shape.most, scale)
    wide = shape.rows * shape.most >= 1 << 62
    source = rows.select(column)
    tasks = source.rdd.getNumPartitions()
    for _ in range(rounds if books.entries.size else 0):
        now = books

        def run(batches: Iterator[pa.RecordBatch], now: Codebooks = now) -> Iterator[pa.RecordBatch]:
            n, size, width = now.entries.shape
            counts, sums = np.zeros((n, size), np.int64), np.zeros((2 if wide else 1, n, size, width), np.int64)
            for batch in batches:
                _, x = vectors.whole(batch.column(0), now.scale, now.dims)
                for k, part in enumerate(_parts(x, n) if len(x) else ()):
                    code, _ = nearest(part, now.entries[k], now.wide)
                    order = np.argsort(code, kind="stable")
                    used, starts = np.unique(code[order], return_index=True)
                    counts[k] += np.bincount(code, minlength=size)
                    for plane, numbers in enumerate(vectors.planes(part, wide)):
                        sums[plane, k, used] += np.add.reduceat(numbers[order], starts)
            yield vectors.cells([counts, sums])

        found = vectors.collected(store.mapped(source, run, vectors.CELLS, "vectorcodes"), tasks)
        counts = found[0].repeat(books.entries.shape[2]).tolist()
        means = [s // n if n else old for s, n, old in zip(vectors.joined(found[1], wide), counts, books.entries.ravel().tolist(), strict=True)]
        books = Codebooks(np.array(means, np.int64).reshape(books.entries.shape), shape.dims, shape.most, scale)
    return books


def encode(rows: DataFrame, books: Codebooks, key: str = "vec_id", column: str = "embedding", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, other columns named, code, error): the index of each part's nearest entry in two hexadecimal digits, in the order of parts, and the squared distances' sum."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(F.col(key).cast("long").alias(key), *also).schema.fields)
    none = not books.entries.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if none:
                continue
            keep, x = vectors.whole(batch.column(batch.num_columns - 1), books.scale, books.dims)
            found = [nearest(part, book, books.wide) for part, book in zip(_parts(x, len(books.entries)), books.entries, strict=True)]
            digits = np.stack([at for at, _ in found], 1).astype(np.uint8)
            error = sum(far for _, far in found)
            exact = pa.array([int(v) if v < 1 << 63 else None for v in error], pa.int64()) if error.dtype == object else pa.array(error)
            own = [c.filter(pa.array(keep)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*own, pa.array([d.tobytes().hex() for d in digits], pa.string()), exact], names=[*batch.schema.names[:-1], "code", "error"])

    return store.mapped(rows.select(F.col(key).cast("long").alias(key), *also, column), run, f"{schema}, code string, error long", "vectorcodes")


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_error``, the sum of errors over rows with an equal label, those without one together. Rows of frequent labels are not shuffled."""
    rows = store.written(coded.withColumns({"__own": F.coalesce(F.col(label).cast("long"), F.lit(0)), "__none": F.col(label).isNull()}), "codes")
    sums = rows.groupBy("__own", "__none").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"), F.count_if(F.col("error").isNull()).alias("__lost"), F.count("*").alias("n"))
    sums = store.written(sums.withColumn("label_error", F.when(F.col("__lost") == 0, F.col("label_error"))).drop("__lost"), "label-errors")
    return store.hot_join(rows, sums, ["__own", "__none"]).drop("__own", "__none", "n")
