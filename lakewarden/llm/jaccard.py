"""Near-duplicate join: word n-gram Jaccard similarity through a MinHash LSH forest, verified exactly.

Texts are lower-cased; words are runs of letters, marks and digits, and single
characters in scripts without spaces; a text's set are the hashes of its runs
of ``n`` words. Texts with equal sets are one class
and only its least id goes on.

The forest has :data:`TREES` tries. In each, the texts are sorted by a
signature of MinHash values of its own; texts that share a prefix are a node.
A node becomes a leaf, whose texts are candidates of each other, as soon as it
holds at most :data:`FEW` texts; else it is split by the next value. Prefixes
are thus short where texts are sparse and long where they are dense, but no
longer than the depth at which a pair exactly at the threshold still meets in
some tree with the target recall: there a node is a leaf whatever its size.
The shortest prefix is :data:`ABOVE` values shorter than that.

Verification is exact and emits no pairs. Candidates are laid out in blocks of
bounded size, neighbours in the forest next to each other. One task intersects
all sets of a block; for two blocks, one task intersects those of their texts
that share a leaf across them. It returns for each text how many links it
has there and the least text that it is connected with. Connected components
join the latter into groups. A leaf of any size is thus spread over tasks by
pairs of blocks, as the number of each text's links takes all pairs of
different sets within it. Nodes that hold very many texts are hot keys of the
joins: their rows are not shuffled.

Defined results: a text without words (or null) has no links and is a group of
its own; a text of fewer than n words has one n-gram, all its words. A row
without an id is returned with a null group and no links. Rows with equal ids
are the same document and get equal results. Copies count as links of each
other. Ties at the threshold count as links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import components, store, textvec

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 24, 12, 0.999
#: A node of at most so many texts is a leaf; values by which the shortest prefix is shorter than the longest.
FEW, ABOVE = 8, 1
#: A block is closed at so many texts, or when its sets hold so many hashes.
BLOCK_TEXTS, BLOCK_HASHES = 1024, 300_000
#: Sets of a block that are intersected at once.
TILE = 256


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix: shortened until a pair at the threshold shares one in some tree with the target recall."""
    for length in range(deepest, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    hashes, _, _, at = textvec.words(texts)
    grams, offsets = textvec.shingles(hashes, at, n)
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        part = np.sort(grams[low:high])
        yield part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part


def prefixes(sets: list[np.ndarray], trees: int, depths: Sequence[int]) -> np.ndarray:
    """For each set (rows) a hash of its MinHash prefix in each tree at each of some depths (columns, by tree); the sets may not be empty."""
    rng = np.random.default_rng(7)
    length = max(depths)
    factors = rng.integers(1, 2**63, trees * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.zeros((trees * len(depths), len(sets)), np.uint64)
    room = np.empty_like(flat)
    for tree in range(trees):
        prefix = np.zeros(len(sets), np.uint64)
        for k in range(length):
            factor = factors[tree * length + k]
            np.multiply(flat, factor, out=room)
            room ^= factor >> np.uint64(7)
            prefix = textvec.mixed(prefix * np.uint64(0x100000001B3) + np.minimum.reduceat(room, starts) + np.uint64(tree * length + k + 1))
            if k + 1 in depths:
                keys[tree * len(depths) + depths.index(k + 1)] = prefix
    return keys.T


def signatures(docs: DataFrame, n: int, wide: int, keys_of: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """(doc_id, d1, d2, size, keys): the digest of each text's set, its size, and the ``wide`` keys that a function gives for each of a list of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches, size=1 << 20):
            sets = list(shingle_sets(batch.column(1), n))
            sizes = np.array([len(s) for s in sets])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            d1, d2 = ids.astype(np.int64).view(np.uint64).copy(), np.zeros(len(sets), np.uint64)
            some = np.flatnonzero(sizes)
            keys = np.zeros((len(some), wide), np.uint64)
            if len(some):
                full = [sets[i] for i in some]
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                flat = np.concatenate(full)
                d1[some] = np.add.reduceat(textvec.mixed(flat), starts)
                d2[some] = np.add.reduceat(textvec.mixed(flat ^ np.uint64(0x5DEECE66D)), starts) | np.uint64(1)
                keys = keys_of(full)
            at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, wide, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), _signed(np.ascontiguousarray(keys).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _signed(d1), _signed(d2), pa.array(sizes.astype(np.int32)), lists], names=["doc_id", "d1", "d2", "size", "keys"])

    return store.mapped(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")), run, "doc_id long, d1 long, d2 long, size int, keys array<long>")


def _blocked(members: DataFrame) -> DataFrame:
    """(rep, copies, block): members in the order of (label, id), cut into blocks of bounded size.

    Each takes its set's size as room, or its share of a block of most texts
    if that is more. Tasks add up their own part of the order; what the parts
    before them take is added after.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(-BLOCK_HASHES // BLOCK_TEXTS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, taken = TaskContext.get().partitionId(), 0
        for frame in frames:
            room = np.maximum(frame["size"].to_numpy(np.int64), least)
            until = taken + np.cumsum(room)
            yield pd.DataFrame({"rep": frame.rep, "copies": frame.copies, "part": part, "begin": until - room, "until": until})
            taken = int(until[-1]) if len(until) else taken

    ordered = members.repartitionByRange(parts, "label", "rep").sortWithinPartitions("label", "rep")
    own = store.written(ordered.select("rep", "size", "copies").mapInPandas(run, "rep long, copies long, part int, begin long, until long"), "order")
    taken, before = [], 0
    for r in own.groupBy("part").agg(F.max("until").alias("until")).orderBy("part").collect():  # a row for each task
        taken.append((r.part, before))
        before += r.until
    shifts = F.broadcast(spark.createDataFrame(taken, "part int, shift long"))
    return own.join(shifts, "part").select("rep", "copies", F.floor((F.col("begin") + F.col("shift")) / BLOCK_HASHES).cast("long").alias("block"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set on the left shares with each on the right."""
    hashes = np.concatenate([*left, *right])
    rows = np.repeat(np.arange(len(left) + len(right), dtype=np.int32), [len(s) for s in (*left, *right)])
    order = np.argsort(hashes, kind="stable")  # so the left rows of a hash come before the right ones
    hashes, rows = hashes[order], rows[order]
    edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    counts = np.diff(np.concatenate([edge, [len(hashes)]]))
    lefts = np.add.reduceat((rows < len(left)).astype(np.int64), edge)
    shared = np.zeros((len(left), len(right)), np.float32)
    both = (lefts > 0) & (lefts < counts)
    few = np.flatnonzero(both & (counts < 16))  # hashes of few rows: their pairs
    pairs = lefts[few] * (counts[few] - lefts[few])
    within = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    width = np.repeat(counts[few] - lefts[few], pairs)
    first = np.repeat(edge[few], pairs)
    a = rows[first + within // width] if len(within) else rows[:0]
    b = rows[first + np.repeat(lefts[few], pairs) + within % width] - len(left) if len(within) else rows[:0]
    shared += np.bincount(a.astype(np.int64) * len(right) + b, minlength=shared.size).reshape(shared.shape)
    often = np.flatnonzero(both & (counts >= 16))
    for low in range(0, len(often), 2048):  # hashes of many rows: a matrix product
        part = often[low : low + 2048]
        column = np.repeat(np.arange(len(part)), counts[part])
        place = np.repeat(edge[part] - (np.cumsum(counts[part]) - counts[part]), counts[part]) + np.arange(len(column))
        grid = np.zeros((len(left) + len(right), len(part)), np.float32)
        grid[rows[place], column] = 1
        shared += grid[: len(left)] @ grid[len(left) :].T
    return shared


def links_of(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets on both sides that are similar enough, a tile of sets at a time."""
    found = []
    for i in range(0, len(left), TILE):
        for j in range(0, len(right), TILE):
            a, b = left[i : i + TILE], right[j : j + TILE]
            shared = intersections(a, b)
            union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - shared
            x, y = np.nonzero(shared >= threshold * union - 1e-6)
            found.append((x + i, y + j))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number connected with each of n numbers, which are in order."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def _verified(threshold: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        store.dropped("jaccard")
        first, second = key
        frame = frame.sort_values("rep", ignore_index=True)
        reps, copies = frame.rep.to_numpy(), frame.copies.to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in frame["set"]]
        left, right = (np.flatnonzero(frame.block.to_numpy() == block) for block in (first, second))
        x, y = links_of([sets[k] for k in left], [sets[k] for k in right], threshold)
        a, b = left[x], right[y]
        if first == second:  # each link is found from both ends
            a, b = a[a != b], b[a != b]
        else:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        texts, docs = np.bincount(a, minlength=len(reps)), np.bincount(a, copies[b], len(reps)).astype(np.int64)
        keep = texts > 0
        return pd.DataFrame({"rep": reps[keep], "root": reps[_roots(a, b, len(reps))][keep], "texts": texts[keep], "docs": docs[keep]})

    return run


def leaves_of(classes: DataFrame, levels: int) -> DataFrame:
    """(key, rep, low, n): the texts of each leaf that holds more than one, with its least text and how many it holds.

    ``keys`` of a class has the prefixes of each tree, from the shortest to
    the longest. A level's nodes are counted; small ones are leaves, and the
    texts of the others go on to the next level.
    """
    trees = F.sequence(F.lit(0), (F.size("keys") / levels).cast("int") - 1)
    rows = classes.where(F.size("keys") > 0).select("rep", F.explode(F.transform(trees, lambda k: F.slice("keys", k * levels + 1, F.lit(levels)))).alias("path"))
    found = None
    for level in range(levels):
        own = rows.withColumn("key", F.element_at("path", level + 1))
        nodes = store.written(own.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1"), "nodes")
        held = store.written(store.hot_join(own, nodes, "key"), "held")
        last = level == levels - 1
        leaf = (held if last else held.where(F.col("n") <= FEW)).select("key", "rep", "low", "n")
        found = leaf if found is None else found.unionByName(leaf)
        if not last:
            rows = held.where(F.col("n") > FEW).select("rep", "path")
    return found


def join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_texts) for every row of ``docs`` (doc_id, text).

    ``class_id`` is the least id that a document is connected with by links of
    at least the threshold; ``n_links`` counts the other documents, and
    ``n_texts`` the different sets among them, that it has such a link with.
    """
    longest = prefix_length(threshold, trees, recall)
    depths = sorted({max(1, longest - ABOVE), longest})
    found = signatures(docs.where("doc_id is not null"), n, trees * len(depths), lambda sets: prefixes(sets, trees, depths))
    return linked(docs, found, len(depths), n, threshold)


def linked(docs: DataFrame, found: DataFrame, levels: int, n: int, threshold: float) -> DataFrame:
    """The result of :func:`join` for texts with given :func:`signatures`, whose keys have ``levels`` levels a tree."""
    lost = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"))
    rows = store.written(found, "signatures")
    same = rows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "size", "keys")).alias("r"), F.count("*").alias("copies"))
    classes = store.written(same.select("d1", "d2", F.col("r.doc_id").alias("rep"), F.col("r.size").alias("size"), "copies", F.col("r.keys").alias("keys")), "classes")
    shared = leaves_of(classes, levels)
    labels = shared.groupBy("rep").agg(F.min("low").alias("label"))
    blocks = store.written(_blocked(labels.join(classes.select("rep", "size", "copies"), "rep")), "blocks")
    placed = store.written(shared.join(blocks.select("rep", "block"), "rep").select("key", "rep", "block"), "placed")
    spread = store.written(placed.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"), "spread")
    across = store.hot_join(placed, spread, "key").drop("n")  # leaves of more than one block
    in_block = store.written(across.select("key", "block").distinct(), "in-block")
    other = in_block.withColumnRenamed("block", "other")
    alone = blocks.select("rep", F.col("block").alias("first"), F.col("block").alias("second"))
    apart = across.join(in_block.join(other, "key").where("block <> other"), ["key", "block"])
    sides = alone.unionByName(apart.select("rep", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches, size=1 << 20):
            made = pa.array([s.tobytes() for s in shingle_sets(batch.column(3), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["rep", "copies", "block", "set"])

    texts = docs.select(F.col("doc_id").alias("rep"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).dropna(subset="rep")
    chosen = store.with_ids(texts, blocks, "rep", "inner").select("rep", "copies", "block", "text")
    full = store.written(store.mapped(chosen, sets, "rep long, copies long, block long, set binary").dropDuplicates(["rep"]), "sets")
    links = sides.join(full, "rep").groupBy("first", "second").applyInPandas(_verified(threshold), "rep long, root long, texts long, docs long")
    links = store.written(links, "links")
    groups = components.components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    found = classes.select("d1", "d2", "rep", "copies").join(counts, "rep", "left").join(groups.select(F.col("a").alias("rep"), F.col("b").alias("least")), "rep", "left")
    found = found.select("d1", "d2", "copies", F.coalesce("least", "rep").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"))
    return store.hot_join(rows.select("doc_id", "d1", "d2"), store.written(found, "found"), ["d1", "d2"], "copies").select("doc_id", "class_id", "n_links", "n_texts").unionByName(lost)


def kept(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: that with the least id. The columns are those of the input; rows without an id stay."""
    links = join(docs, **options)
    spare = store.written(links.where("class_id < doc_id").select("doc_id").distinct(), "spare")
    return store.with_ids(docs, spare, "doc_id", "left_anti")
