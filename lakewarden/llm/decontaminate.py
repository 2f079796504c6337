"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of a benchmark item is a seed, be it rare or common. Where a
document holds a seed, the words around it are aligned with the item (match
+2, mismatch or gap -1); the best local score, over that of the whole item, is
the similarity. An edited or paraphrased copy keeps most of it. An alignment
that reaches the threshold is found if n words in a row of it are unedited,
and is found whole: the stretch around a seed has room for as many inserted
words as the threshold allows. An item is left out without an alignment only
where the document has too few of its words to reach the threshold.

Documents are never shuffled: the items, whose size is checked, are sent to
the tasks in blocks of at most :data:`BLOCK_WORDS` words, one pass a block.

Defined results: null and empty texts, and items without words, match
nothing. An item of fewer than n words matches only a document of just these
words. Rows with a null id are searched like others. Items with equal text are
reported each; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import store, textvec

GRAM = 3
THRESHOLD = 0.5
#: Words of the items that are sent to the tasks at once (8 bytes each, and about 40 with their index).
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, 1, 1
_FILTER = 1 << 20


@dataclass(frozen=True)
class Items:
    """A block of items by text."""

    ids: tuple[int, ...]
    texts: tuple[str, ...]


@dataclass
class Index:
    words: list[np.ndarray]  # of each item
    seeds: np.ndarray  # sorted n-grams of all items
    owners: np.ndarray  # the item of each seed
    places: np.ndarray  # and its place there
    maybe: np.ndarray  # by the low bits of a gram: whether it can be a seed


def _index(items: Items) -> Index:
    return store.held("decontaminate.index", items, lambda: _indexed(items))


def _indexed(items: Items) -> Index:
    hashes, _, _, at = textvec.words(pa.array(items.texts, pa.string()))
    grams, offsets = textvec.shingles(hashes, at, GRAM)
    order = np.argsort(grams, kind="stable")
    owners = np.searchsorted(offsets, order, "right") - 1
    seeds = grams[order]
    maybe = np.zeros(_FILTER, bool)
    maybe[(seeds & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    return Index(np.split(hashes, at[1:-1]), seeds, owners, order - offsets[owners], maybe)


def _present(grams: np.ndarray, maybe: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the n-grams that are among the known ones."""
    if not len(known):
        return np.zeros(0, np.int64)
    places = np.flatnonzero(maybe[(grams & np.uint64(_FILTER - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, grams[places]), len(known) - 1)
    return places[known[at] == grams[places]]


def aligned(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of an item with a stretch of words: its score, and the first and the last word's end in the stretch.

    A row of the table at a time: with a linear gap, moves along a row are a
    running maximum. The start is followed with the score, as its lower part.
    """
    size = len(words)
    slope = np.arange(size + 1, dtype=np.int64) * GAP
    unit = np.int64(1) << 32
    start = np.arange(size + 1, dtype=np.int64)
    fresh = unit - 1 - start  # among equal scores the earlier start wins
    row = fresh.copy()
    best, best_row = 0, None
    for word in item:
        step = np.where(words == word, MATCH, -MISMATCH) * unit
        new = np.maximum(row - GAP * unit, fresh)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        new = np.maximum.accumulate(new + slope * unit) - slope * unit
        row = np.where(new >> 32 > 0, new, fresh)
        top = int(row.argmax())
        if (int(row[top]) >> 32) > best:
            best, best_row = int(row[top]) >> 32, (top, int(unit - 1 - (row[top] & (unit - 1))))
    return (best, best_row[1], best_row[0]) if best_row else (0, 0, 0)


def _matches(index: Index, words: np.ndarray, hits: np.ndarray, grams: np.ndarray, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """Of one document the items that it holds: (item, similarity, first word, end)."""
    low, high = np.searchsorted(index.seeds, grams[hits], "left"), np.searchsorted(index.seeds, grams[hits], "right")
    count = high - low
    seed = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    diagonals = np.repeat(hits, count) - index.places[seed]
    order = np.lexsort((diagonals, index.owners[seed]))
    owners, diagonals = index.owners[seed][order], diagonals[order]
    bounds = np.flatnonzero(np.diff(owners, prepend=-1, append=-1))
    present = np.unique(words)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        item = int(owners[a])
        own = index.words[item]
        if not _reachable(own, present, threshold):
            continue
        slack = int(2 * len(own) * (1 - threshold)) + 1  # each inserted word takes 1 of a score of 2 a word
        merged: list[tuple[int, int]] = []
        for begin in np.unique(diagonals[a:b]).tolist():
            s = (max(0, begin - slack), min(len(words), begin + len(own) + slack))
            if merged and s[0] <= merged[-1][1] and s[1] - merged[-1][0] <= 4 * len(own) + 32:
                merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
            elif not merged or s[1] > merged[-1][1]:
                merged.append(s)
        best = (0, 0, 0)
        for s, e in merged:
            if _reachable(own, np.unique(words[s:e]), threshold):
                score, first, last = aligned(own, words[s:e])
                best = max(best, (score, -(s + first), s + last))
        similarity = best[0] / (MATCH * len(own))
        if similarity >= threshold:
            yield item, similarity, -best[1], best[2]


def _reachable(own: np.ndarray, present: np.ndarray, threshold: float) -> bool:
    """Whether enough words of an item are among the sorted ones: those that match bound the score."""
    at = np.minimum(np.searchsorted(present, own), len(present) - 1)
    return bool((present[at] == own).mean() >= threshold)


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size. Each is read when it is asked for, so the driver holds one at a time."""
    sized = benchmark.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{M}\p{N}]+")) + F.length(F.regexp_replace("text", r"[\x00-\u0dff]+", "")))).first()[0] or 0  # each character of unspaced scripts is a word
    count = -(-total // BLOCK_WORDS)
    for k in range(count):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield Items(tuple(r.item_id for r in rows), tuple(r.text.lower() for r in rows))


def _held(index: Index, texts: pa.Array, threshold: float) -> Iterator[tuple[int, Iterator[tuple[int, float, int, int]]]]:
    """Of an Arrow array of texts those that hold a seed: the place of each, and what it matches."""
    hashes, _, _, at = textvec.words(texts)
    grams, offsets = textvec.shingles(hashes, at, GRAM)
    places = _present(grams, index.maybe, index.seeds)
    cut = np.searchsorted(places, offsets)
    for i in np.flatnonzero(np.diff(cut)).tolist():
        hits = places[cut[i] : cut[i + 1]] - offsets[i]
        yield i, _matches(index, hashes[at[i] : at[i + 1]], hits, grams[offsets[i] : offsets[i + 1]], threshold)


def _searched(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    schema = "doc_id long, item_id long, similarity double, first_word long, end_word long"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in textvec.portions(batches):
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], items.ids[item], round(similarity, 6), first, end) for i, found in _held(index, batch.column(1), threshold) for item, similarity, first, end in found]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "end_word"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return store.mapped(texts, run, schema, "decontaminate")


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word) for each document and item whose best alignment reaches the threshold.

    Of several blocks each but the last is written before the next is read.
    """
    found, last = None, None
    for items in _blocks(benchmark):
        if last is not None:
            part = store.written(_searched(docs, last, threshold), "matches")
            found = part if found is None else found.unionByName(part)
        last = items
    if last is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long, end_word long")
    part = _searched(docs, last, threshold)
    return part if found is None else found.unionByName(part)


def _without(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in textvec.portions(batches):
            clean = np.ones(batch.num_rows, bool)
            for i, found in _held(index, batch.column(batch.num_columns - 1), threshold):
                clean[i] = next(found, None) is None
            kept = batch.filter(pa.array(clean))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

    return store.mapped(docs.withColumn("__text", F.lower(F.coalesce("text", F.lit("")))), run, docs.schema, "decontaminate")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that hold no item, judged each by its own text, whatever its id; the columns are those of the input."""
    last = None
    for items in _blocks(benchmark):
        if last is not None:
            docs = store.written(_without(docs, last, threshold), "clean")
        last = items
    return docs if last is None else _without(docs, last, threshold)
