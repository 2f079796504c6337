"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text.
A text is parsed greedily against it: each phrase is the longest match that
the automaton can follow, then a new phrase begins at the byte that broke it.
Few phrases mean that long pieces of the text are known. With c phrases over n
symbols against a sample of N symbols, ``c * log2(N) / n`` estimates the cross
entropy, and the language with the least wins.

Texts are lower-cased UTF-8 bytes; ASCII characters that are no letters become
a single space, and all bytes of other characters count as letters.
They are parsed in blocks of :data:`BLOCK` symbols, all blocks of an Arrow
batch in step, so a phrase never crosses a block's end: whole texts count, and
a very long text costs no more than as many bytes of short ones.

Defined results: a null text, or one without any letter, is ``und`` with score
0. Ties go to the language that sorts first. If there is no labelled row at
all, every text is ``und``. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lakewarden.llm import store, textvec

BLOCK = 1024
#: Bounds of the training sample: rows of each language, and characters of all languages together.
ROWS, SYMBOLS = 96, 192_000
UNDETERMINED = "und"


@dataclass(frozen=True)
class Profile:
    """Sampled text by language, in the order of their names."""

    samples: tuple[tuple[str, str], ...]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, rows: int = ROWS, size: int = SYMBOLS) -> Profile:
    """Samples labelled rows with their whole texts: of each language those with the least hash of their id.

    At most ``rows`` rows of a language count, and its even share of ``size``
    characters; a row whose text would go over that is left out, not cut, and
    so is one that alone takes over an eighth of the share, unless a language
    has no other: then its shortest counts. Only rows outside the held-out
    quarter that have a text and a language count. Ties of ids are broken by
    the texts.
    """
    labelled = docs.where(docs.lang.isNotNull() & docs.text.rlike(r"\p{L}") & ~held_out(docs.doc_id))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return Profile(())
    share = size // len(counts)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    below = F.lit(1 << 40)
    for lang, n in counts.items():  # a few times as many rows as are kept, so that few are sorted
        below = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 8 * rows / n) * (1 << 40)))).otherwise(below)
    long = F.greatest(F.length("text") - max(share // 8, 64), F.lit(0))
    near = labelled.where(order < below).select("lang", long.alias("long"), order.alias("rank"), F.xxhash64("text").alias("tie"), "text")
    within = Window.partitionBy("lang").orderBy("long", "rank", "tie")
    first = near.withColumn("k", F.row_number().over(within)).where(F.col("k") <= rows)
    first = first.withColumn("taken", F.sum(F.length("text") + 1).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    first = first.where((F.col("k") == 1) | ((F.col("long") == 0) & (F.col("taken") <= share)))
    texts: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "k").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return Profile(tuple((lang, " ".join(parts).lower()) for lang, parts in sorted(texts.items())))


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, b in enumerate([*range(ord("a"), ord("z") + 1), *range(128, 256)]):
        table[b] = k + 1
    return table


#: 0 for what is no letter, else the number of a letter's byte.
SYMBOL = _letters()
ALPHABET = int(SYMBOL.max()) + 1


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts, with runs of what is no letter as one 0."""
    got = SYMBOL[data]
    keep = np.ones(len(got), bool)
    keep[1:] = (got[1:] != 0) | (got[:-1] != 0)
    keep[offsets[:-1][np.diff(offsets) > 0]] = True  # a text's first, whatever text lies before it
    before = np.zeros(len(got) + 1, np.int32)
    np.cumsum(keep, out=before[1:])
    return got[keep], before[offsets].astype(np.int64)


def automaton(sample: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sample.tolist():
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def tables(profile: Profile) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All automata as one table of moves.

    An entry is the next state's row times two, plus one where the phrase
    broke and a new one began. Returns the table, each symbol's column, the
    first row of each language, and log2 of the samples' sizes.
    """
    coded = []
    for _, text in profile.samples:
        raw = np.frombuffer(text.encode(), np.uint8)
        coded.append(symbols(raw, np.array([0, len(raw)]))[0])
    used = np.unique(np.concatenate([*coded, [0]])).astype(np.int64)
    column = np.full(ALPHABET, len(used), np.int32)  # a column for symbols of no sample
    column[used] = np.arange(len(used))
    width = len(used) + 1
    parts, roots, at = [], [], 0
    for sample in coded:
        moves = automaton(column[sample])
        states = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        keys = np.array([c for m in moves for c in m], np.int64)
        to = np.array([t for m in moves for t in m.values()], np.int64)
        dead = at + len(moves)  # after a symbol unknown to the whole sample, which is a phrase of its own: whatever follows begins a new one
        root = np.full(width, dead, np.int64)
        root[keys[states == 0]] = at + to[states == 0]
        grid = np.tile(((root * width) * 2 + 1).astype(np.int32), (len(moves) + 1, 1))
        grid[0] = (root * width) * 2
        grid[states, keys] = ((at + to) * width) * 2
        parts.append(grid)
        roots.append(at * width)
        at += len(moves) + 1
    sizes = np.log2([max(2, len(s)) for s in coded])
    return np.concatenate([p.ravel() for p in parts]), column, np.array(roots, np.int32), sizes


def phrases(profile: Profile, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of phrases of each text (rows) in each language (columns), and of symbols."""
    table, column, roots, _ = store.held("langid", profile, lambda: tables(profile))
    coded, at = symbols(data, offsets)
    sizes = np.diff(at)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = at[owner] + nth * BLOCK
    lengths = np.minimum(BLOCK, at[owner + 1] - starts)
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros((len(roots), len(owner)), np.int32)
    coded = column[coded]
    for low in range(0, len(order), 4096):
        mine = order[low : low + 4096]
        s, size = starts[mine], lengths[mine]
        states = np.repeat(roots[:, None], len(mine), 1)
        broken = np.ones((len(roots), len(mine)), np.int32)
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # blocks longer than each step
        for t in range(int(size[0])):
            n = active[t]
            moved = table[states[:, :n] + coded[s[:n] + t]]
            broken[:, :n] += moved & 1
            states[:, :n] = moved >> 1
        counts[:, mine] = broken
    total = np.zeros((len(sizes), len(roots)), np.int64)
    for k in range(len(roots)):
        total[:, k] = np.bincount(owner, counts[k], len(sizes))
    return total, sizes


def predict(docs: DataFrame, profile: Profile, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (one less the ratio of the least entropy to the second least) and ``entropy`` (bits per symbol).

    ``prefix`` goes before these names; columns of the input that have them are replaced.
    """
    names = [lang for lang, _ in profile.samples]
    kinds = {f"{prefix}lang_pred": T.StringType(), f"{prefix}score": T.DoubleType(), f"{prefix}entropy": T.DoubleType()}
    docs = docs.drop(*kinds)
    if not names:
        return docs.withColumns(dict(zip(kinds, (F.lit(UNDETERMINED), F.lit(0.0), F.lit(0.0)), strict=True)))
    added = [T.StructField(name, kind) for name, kind in kinds.items()]
    ready = docs.withColumn("__text", F.when(docs[text].rlike(r"\p{L}"), F.concat(F.lit(" "), F.lower(docs[text]), F.lit(" "))).otherwise(""))
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = store.held("langid", profile, lambda: tables(profile))[3]
        for batch in textvec.portions(batches):
            data, offsets = textvec.flat(batch.column(batch.num_columns - 1))
            counts, sizes = phrases(profile, data, offsets)
            known = np.diff(offsets) > 0
            rates = counts * bits / np.maximum(sizes, 1)[:, None]
            best = rates.argmin(1)
            least = rates[np.arange(len(rates)), best]
            second = np.sort(rates, 1)[:, 1] if len(names) > 1 else np.full(len(rates), max(bits))
            margin = np.where(known, np.clip(1 - least / np.maximum(second, 1e-9), 0, 1), 0.0)
            picked = [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(picked, pa.string()), pa.array(margin), pa.array(np.where(known, least, 0.0))], names=schema.names)

    return store.mapped(ready, run, schema, "langid")


def accepted(docs: DataFrame, profile: Profile) -> DataFrame:
    """All documents with a letter, with the columns of the input.

    Any text with a letter gets some language, so neither its entropy nor
    which one it is rejects a document; nor does a profile without a language.
    """
    if not profile.samples:
        return docs.where(docs.text.rlike(r"\p{L}"))
    rows = predict(docs, profile, prefix="__")
    return rows.where(F.col("__lang_pred") != UNDETERMINED).select(*docs.columns)
