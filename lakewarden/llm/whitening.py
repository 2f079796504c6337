"""Whitening of embeddings from an exact scatter in residue numbers.

Entries become whole numbers, floor(scale * entry). The fit list is each
distinct vector of such numbers once. Its count and its sums by dimension are
added up exactly. Every partition of the list then takes its vectors less a
whole-number centre, reduces them modulo several primes, and multiplies them
with their transpose for each prime: a float64 matrix product of residues below
2^20 over :data:`BLOCK` rows stays below 2^53, so it is exact. The residues of
the products are added up over all tasks by a tree, and Chinese remaindering
gives the exact scatter, whatever the order of tasks: there are as many primes
as the count and the largest number need. The covariance, the exact centred
scatter over the squared count, is rounded once, to double; its eigenvectors
are the components.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped; empty and shorter vectors end in zeros; numbers beyond 64 bits
become the nearest that has them. Repeated rows, and rows without an id, are
each returned; they count once in the fit. A component without variance (below
rounding) has a null in ``whitened``, and the identity is measured on the
others; without any variance ``explained`` and the error are null. A
``deviation`` that does not fit 64 bits is null. Without vectors the result has
no rows. Each component's entry of largest magnitude is positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import store, vectors

SCALE, COMPONENTS = 256, 4
#: Rows of one matrix product: 2^13 products of residues below 2^20 in magnitude are exact in float64.
BLOCK, PRIME_BITS = 1 << 13, 21


def primes(bound: int) -> list[int]:
    """The largest primes below 2^21, as many as it takes for a product over twice a bound."""
    found, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= 2 * bound:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def remaindered(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """The whole numbers of least magnitude with given residues (rows: moduli), by Chinese remaindering."""
    product = math.prod(moduli)
    weights = [product // p * pow(product // p, -1, p) for p in moduli]
    total = sum(row.astype(object) * w for row, w in zip(residues, weights, strict=True)) % product
    return [int(v) - product if 2 * v > product else int(v) for v in total]


def residue_scatter(x: np.ndarray, centre: list[int], moduli: list[int], into: np.ndarray) -> None:
    """Adds the scatter of rows less a centre to sums modulo each prime."""
    for k, p in enumerate(moduli):
        offset = np.array([c % p for c in centre], np.int64)
        for at in range(0, len(x), BLOCK):
            r = (x[at : at + BLOCK] % p - offset) % p
            r = np.where(r > p // 2, r - p, r).astype(np.float64)
            into[k] = (into[k] + (r.T @ r).astype(np.int64)) % p


@dataclass(frozen=True, eq=False)
class Whitening:
    """A fit: what the list holds, its covariance, and the components with their variances, by falling variance."""

    shape: vectors.Shape
    scale: int
    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    identity_error: float | None = None

    @property
    def trace(self) -> float:
        return math.fsum(np.diag(self.covariance))

    def explained(self, k: int) -> float | None:
        """The share of all variance that a component (from 0) has."""
        return float(self.values[k] / self.trace) if self.trace > 0 else None

    def scaled(self, k: int) -> np.ndarray:
        """The first k components over their standard deviations; those without variance are not numbers."""
        e = self.values[:k]
        return self.components[:, :k] / np.sqrt(np.where(e > len(self.values) * np.finfo(float).eps * self.trace, e, np.nan))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: in 64 bits where that is sure to do, squares and their sum included, else in numbers of any size."""
        most = self.n * self.shape.most + max(map(abs, self.sums), default=0)
        if self.shape.dims * most * most < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray, k: int) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.scaled(k)


def _fit_list(rows: DataFrame, shape: vectors.Shape, scale: int, column: str) -> DataFrame:
    """(x): each distinct vector once, as the bytes of its numbers; repeats within a task go before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = vectors.whole(batch.column(0), scale, shape.dims)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(shape.dtype)], pa.binary())], names=["x"])

    return store.written(store.mapped(rows.select(column), run, "x binary", "whitening").distinct(), "fit-list")


def _blocks(batches: Iterator[pa.RecordBatch], shape: vectors.Shape) -> Iterator[np.ndarray]:
    for batch in batches:
        data = batch.column(0)
        yield np.frombuffer(b"".join(data.to_pylist()), shape.dtype).reshape(len(data), shape.dims).astype(np.int64)


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, column: str = "embedding") -> Whitening | None:
    """Learns the whitening of a column of vectors; None if there is no vector. The driver holds matrices of the vectors' length squared."""
    shape = vectors.shape(rows, scale, column)
    if not shape.rows:
        return None
    listed = _fit_list(rows, shape, scale, column)
    tasks, wide = listed.rdd.getNumPartitions(), shape.rows * shape.most >= 1 << 62

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2 if wide else 1, shape.dims), np.int64)
        for x in _blocks(batches, shape):
            n += len(x)
            sums += [p.sum(0) for p in vectors.planes(x, wide)]
        yield vectors.cells([np.array([n]), sums])

    found = vectors.collected(store.mapped(listed, totals, vectors.CELLS, "whitening"), tasks)
    n, sums = int(found[0][0]), vectors.joined(found[1], wide)
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    moduli = primes(n * (shape.most + max(map(abs, centre))) ** 2)
    dims = shape.dims

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((len(moduli), dims, dims), np.int64)
        for x in _blocks(batches, shape):
            residue_scatter(x, centre, moduli, own)
        yield vectors.cells(list(own))

    def rebuilt(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The covariance's entries of one cell: exact whole numbers, rounded once."""
        frame = frame.sort_values("kind")
        residues = np.stack([np.frombuffer(p, np.int64) % m for p, m in zip(frame.part, moduli, strict=True)])
        at = key[0] * vectors.CELL
        entries = [(n * q - rest[k // dims] * rest[k % dims]) / (n * n) for k, q in enumerate(remaindered(residues, moduli), at)]
        return pd.DataFrame({"cell": [key[0]], "entries": [entries]})

    parts = vectors.summed(store.mapped(listed, products, vectors.CELLS, "whitening"), tasks)
    made = sorted(parts.groupBy("cell").applyInPandas(rebuilt, "cell int, entries array<double>").collect(), key=lambda r: r.cell)
    covariance = np.concatenate([r.entries for r in made]).reshape(dims, dims)
    values, base = np.linalg.eigh(covariance)
    values, base = values[::-1].clip(0), base[:, ::-1]
    base = base * np.where(np.take_along_axis(base, np.abs(base).argmax(0)[None], 0) < 0, -1.0, 1.0)
    model = Whitening(shape, scale, n, tuple(sums), covariance, values, base)
    return Whitening(shape, scale, n, tuple(sums), covariance, values, base, identity_error(listed, model, components))


def identity_error(listed: DataFrame, model: Whitening, components: int = COMPONENTS) -> float | None:
    """The largest entry, by magnitude, of the covariance of what the fit list becomes, less the identity."""
    k = min(components, model.shape.dims)
    some = np.flatnonzero(np.isfinite(model.scaled(k)).all(0))
    if not len(some):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(len(some)), np.zeros((len(some), len(some)))
        for x in _blocks(batches, model.shape):
            w = model.whitened(model.centred(x), k)[:, some]
            total, square = total + w.sum(0), square + w.T @ w
        flat = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "v"])

    found = store.mapped(listed, run, "at int, v double", "whitening").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r.v for r in sorted(found, key=lambda r: r.at)]) / model.n
    mean, square = flat[: len(some)], flat[len(some) :].reshape(len(some), -1)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(len(some))).max())


def whiten(rows: DataFrame, model: Whitening | None, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, deviation, whitened): for each vector its exact squared distance from the mean times n^2, and its coordinates on the first components over their standard deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                continue
            keep, x = vectors.whole(batch.column(1), model.scale, model.shape.dims)
            y = model.centred(x)
            far = (y * y).sum(1)
            exact = pa.array([int(v) if v < 1 << 63 else None for v in far], pa.int64()) if far.dtype == object else pa.array(far)
            w = model.whitened(y, components)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            at = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), exact, pa.ListArray.from_arrays(at, flat)], names=[key, "deviation", "whitened"])

    return store.mapped(rows.select(F.col(key).cast("long").alias(key), column), run, f"`{key}` long, deviation long, whitened array<double>", "whitening")
