"""Best-fit packing of documents into sequences of a fixed number of tokens.

Tokens are counted once, by the tasks that read the texts. Sizes are whole
numbers up to the capacity, so documents and gaps are ranged by size into at
most as many classes. A superstep takes the largest class of documents left,
sweeps the gaps for the successors of its size (the least gap that fits, then
the next), gives each document the gap of its rank, and puts the changed gaps
back under their new size; where no gap fits, new sequences open. The steps
see only how many documents and gaps a class has: their state is bounded by
the capacity, whatever the corpus, and their outcome is a table of rank
intervals. Spark ranks the documents of each class (by salted groups, so that
a size that very many documents share is spread over tasks) and each document
looks up its interval: its sequence and offset.

Defined results: a null or empty text is one token, the separator. A document
longer than the capacity is cut into full pieces, but for the first, which
takes the rest. Rows with equal ids are packed each. An empty table gives an
empty one.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm import store, textvec

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY, SEPARATOR = 2048, 0
#: Distinct stretches of text whose token ids a worker remembers at most (some 200 bytes each); when there are more it forgets all but those at hand.
REMEMBERED = 500_000
#: Stretches that the tokenizer gets as one text.
JOINED = 4096
#: Salted groups of a size, and the rows for which one more is used.
GROUPS, ROWS_PER_GROUP = 256, 100_000


@dataclass
class Encoder:
    """A tokenizer, the bytes that each id stands for, and the ids of stretches that were seen (by their bytes)."""

    tokenizer: Tokenizer
    sizes: np.ndarray
    added: tuple[bytes, ...]
    known: dict[bytes, bytes]


def _encoder(path: str) -> Encoder:
    return store.held("packing", path, lambda: _loaded(path))


def _loaded(path: str) -> Encoder:
    """The tokenizer of a file, whose pre-tokenizer must be the byte-level one: cuts at white space rest on that."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    form = json.loads(exact.to_str())
    first = form["pre_tokenizer"] or {}
    if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True) or form["normalizer"]:
        raise ValueError(f"{path}: no plain byte-level tokenizer")
    added = exact.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized or set(t.content) & set("\t\n\r ") for t in added.values()):
        raise ValueError(f"{path}: an added token depends on what surrounds a stretch of text")
    sizes = np.zeros(exact.get_vocab_size(), np.int64)
    for token, rank in exact.get_vocab().items():
        sizes[rank] = len(token)  # a character for each byte
    for rank, token in added.items():
        sizes[rank] = len(token.content.encode())
    return Encoder(exact, sizes, tuple(t.content.encode() for t in added.values()), {})


def _encoded(parts: list[bytes], encoder: Encoder) -> list[bytes]:
    """The ids that the tokenizer gives each stretch, as 32-bit numbers.

    Stretches that end in a solid character are encoded as one text, with a
    line end before those that do not begin with a blank; that each ends where
    a token ends is checked.
    """
    out: list[bytes] = [b""] * len(parts)
    front = [b"" if _BLANK[p[0]] else b"\n" if _KIND[p[0]] or 0xC3 <= p[0] <= 0xDF else None for p in parts]
    joint = [k for k, p in enumerate(parts) if front[k] is not None and (0x20 < p[-1] < 0x7F or (len(p) > 1 and 0xC3 <= p[-2] <= 0xDF))]
    for low in range(0, len(joint), JOINED):
        some = joint[low : low + JOINED]
        text = b"".join([x for k in some for x in (front[k], parts[k])])
        ids = np.array(encoder.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(encoder.sizes[ids])
        lead = np.array([len(front[k]) for k in some])
        wanted = np.cumsum([len(parts[k]) for k in some] + lead)
        first, last = np.searchsorted(ends, wanted - np.array([len(parts[k]) for k in some]), "right"), np.searchsorted(ends, wanted)
        if len(ends) != last[-1] + 1 or (ends[last] != wanted).any() or (first[1:] != last[:-1] + 1 + lead[1:]).any():
            raise ValueError("the tokenizer joins what was taken for separate stretches")
        raw = ids.tobytes()
        for k, begin, end in zip(some, (4 * first).tolist(), (4 * (last + 1)).tolist(), strict=True):
            out[k] = raw[begin:end]
    rest = sorted(set(range(len(parts))) - set(joint)) if len(joint) < len(parts) else []
    for low in range(0, len(rest), JOINED):
        some = rest[low : low + JOINED]
        for k, e in zip(some, encoder.tokenizer.encode_batch_fast([parts[k].decode() for k in some], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32).tobytes()
    return out


_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
#: Of visible ASCII characters: letters 1, digits 2, others 3, the apostrophe 4, after which a contraction may follow.
_KIND = np.array([(1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 if b == 0x27 else 3) if 0x20 < b < 0x7F else 0 for b in range(256)], np.uint8)


def stretches(data: np.ndarray, offsets: np.ndarray, added: Sequence[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that can be tokenized on their own, whatever surrounds them.

    Byte-level pre-tokenizers keep white space only at the front of a token,
    so a text may be cut before a blank that follows a character that is
    surely no white space: a visible ASCII one, or one of two bytes from U+00C0
    on. They keep letters, digits and other characters apart, so a text may be
    cut where ASCII ones of two kinds meet, but not behind an apostrophe. No
    cut goes through an added token.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, after = _KIND[data[:-1]], _KIND[data[1:]]
        solid = before > 0
        solid[1:] |= (data[1:-1] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
        cut[1 : len(data)] = (_BLANK[data[1:]] & solid) | ((before > 0) & (after > 0) & (before < 4) & (before != after) & ~((before == 3) & (after == 4)))
        raw = data.tobytes() if added else b""
        for token in added:
            at = raw.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = raw.find(token, at + len(token))
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.concatenate([starts[1:], [len(data)]]).astype(np.int64)[: len(starts)]


def _values(column: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls: cut from its bytes, which takes a fraction of the time of a scalar for each."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in pairwise(at)]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by the separator, and the offsets by text."""
    encoder = _encoder(path)
    known = encoder.known
    data, offsets = textvec.flat(texts)
    starts, ends = stretches(data, offsets, encoder.added)
    bounds = pa.py_buffer(np.concatenate([starts, [len(data)]]).astype(np.int64))
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    names, number = _values(coded.dictionary), coded.indices.to_numpy()
    pieces = list(map(known.get, names))
    fresh = [k for k, piece in enumerate(pieces) if piece is None]
    if fresh:
        for k, piece in zip(fresh, _encoded([names[k] for k in fresh], encoder), strict=True):
            pieces[k] = piece
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = range(len(names))
        known.update((names[k], pieces[k]) for k in fresh)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    flat = np.frombuffer(b"".join(pieces), np.uint32)
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    each = sizes[number]
    ends_at = np.concatenate([[0], np.cumsum(each)])
    counts = ends_at[np.searchsorted(starts, offsets)]  # of tokens before each text
    out_at = counts + np.arange(len(offsets))
    out = np.full(out_at[-1], SEPARATOR, np.uint32)
    shift = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    index = np.repeat(at[number] - ends_at[:-1], each) + np.arange(ends_at[-1])
    out[np.arange(ends_at[-1]) + shift] = flat[index]
    return out, out_at


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece that a document is cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches, size=1 << 20):
            ids, at = token_ids(batch.column(1), path)
            totals = np.diff(at)
            count = -(-totals // capacity)
            owner = np.repeat(np.arange(len(totals)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            head = (totals - 1) % capacity + 1  # of the first piece
            start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[owner], capacity)
            low = at[owner] + start
            sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(low.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                bounds = pa.array(np.concatenate([low, [len(ids)]]).astype(np.int32))  # pieces lie one after the other
                columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return store.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, schema, "packing")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Rank intervals: documents of a size from rank ``rank`` on lie in the sequences from ``sequence`` on, at ``offset``.

    The supersteps of the module's docstring. ``gaps[g]`` holds runs of
    sequences (first, how many) with g tokens free.
    """
    gaps: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]
    opened = 0
    rows: list[tuple[int, int, int, int]] = []
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        gap = size
        while left:
            while gap < capacity and not gaps[gap]:
                gap += 1
            each = gap // size  # documents of this size that a gap takes, one after the other
            need = -(-left // each)
            if gaps[gap]:
                first, n = gaps[gap].popleft()
                if n > need:
                    gaps[gap].appendleft((first + need, n - need))
                    n = need
            else:  # no gap fits: open what is needed
                first, n = opened, need
                opened += n
            full, rest = (n, 0) if left >= n * each else divmod(left, each)
            for k in range(each):
                take = full + (k < rest)
                if take:
                    rows.append((size, rank, first, capacity - gap + k * size))
                    rank += take
                    left -= take
            if full:
                gaps[gap - each * size].append((first, full))
            if rest:
                gaps[gap - rest * size].append((first + full, 1))
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"size": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length. A length's rows are numbered in salted groups, then shifted by the groups before."""
    groups = GROUPS + total // ROWS_PER_GROUP
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(within) - 1)
    return numbered.join(shifts, ["length", "salt"]).withColumn("rank", F.col("shift") + F.col("number")).drop("salt", "shift", "number")


def placed(rows: DataFrame, found: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ranked rows: the interval of a plan that holds (length, rank)."""
    names = [c for c in rows.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.int64(1) << 48
        known = found["size"] * width + found["rank"]
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("length")).to_numpy() * width + batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(known, wanted, "right") - 1
            sequence = found["sequence"][at] + wanted - known[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(found["offset"][at])], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "rank")
    return store.mapped(rows, run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Packs all documents (doc_id, text): one row per piece with its sequence and its place there."""
    rows = store.written(pieces(docs, path, capacity, keep_ids), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # of at most `capacity` sizes
    return placed(ranked(rows, sum(counts.values())), plan(counts, capacity))
