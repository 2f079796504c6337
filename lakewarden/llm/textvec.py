"""Numpy helpers over the UTF-8 bytes of an Arrow batch of texts: the Python side of the operators works on whole batches."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: What a character is to words: nothing, a part of one, a mark (part of what it follows), or a word of its own.
NONE, PART, MARK, ALONE = range(4)
#: First and last code points of scripts that put no spaces between words; each of their characters, with its marks, is a word.
UNSPACED = (
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0xA980, 0xA9FF), (0xAA60, 0xAADF),  # of South-East Asia, and Tibetan
    (0x2E80, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),  # of East Asia
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of each in them; the texts may hold no null."""
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans of more bytes are hashed one by one.
LONG = 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges.

    Ranges of up to :data:`LONG` bytes are mixed eight bytes at a time, a
    permutation of the state by each, so that two of one length that differ in
    eight bytes only never meet; longer ones are digested by BLAKE2.
    """
    lengths = ends - starts
    short = np.flatnonzero(lengths <= LONG)
    out = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place on
    state, size, first = mixed((lengths[short].astype(np.uint64) + np.uint64(1)) * _ODD), lengths[short], starts[short]
    for k in range(0, LONG, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        block = eights[first[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]
        state[more] = mixed((state[more] ^ block) * _ODD + np.uint64(k + 1))
    out[short] = state
    for k in np.flatnonzero(lengths > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    kinds = np.array([{"L": PART, "N": PART, "M": MARK}.get(unicodedata.category(chr(c))[0], NONE) for c in range(sys.maxunicode + 1)], np.uint8)
    for low, high in UNSPACED:
        part = kinds[low : high + 1]
        part[part == PART] = ALONE
    return kinds


def _classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte belongs to a word, and whether a word begins at it even if one ends just before."""
    kinds = _kinds()
    got = kinds[data]  # right for ASCII
    fresh = np.zeros(len(data), bool)
    leads = np.flatnonzero(data >= 0xC0)
    if not len(leads):
        return got > 0, fresh
    lead = data[leads].astype(np.int64)
    length = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & np.array([0, 0, 0x1F, 0x0F, 0x07])[length]
    for k in (1, 2, 3):
        more = length > k
        code[more] = code[more] << 6 | data[leads[more] + k] & 0x3F
    kind = kinds[code]
    for k in (0, 1, 2, 3):
        more = length > k
        got[leads[more] + k] = kind[more]
    alone = kind == ALONE
    fresh[leads[alone]] = True
    # what follows a word of its own and its marks begins a new one
    if alone.any():
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        own = got[starts]
        solid = np.where((own == MARK) & ~np.isin(starts, offsets), 0, np.arange(len(own)))
        after = np.maximum.accumulate(solid)[:-1]  # the last character before that is no mark, or a text's first
        fresh[starts[1:][(own[1:] == PART) & (own[after] == ALONE)]] = True
    return got > 0, fresh


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, and for each text the number of its first word (and of the end).

    A word is a run of letters, marks and digits of any script, or one such
    character with its marks where the script has no spaces.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside, first = _classes(data, offsets)
    first[0] |= inside[0]
    first[1:] |= inside[1:] & ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and for each text the number of its first word (and of the end)."""
    data, offsets = flat(texts)
    starts, ends, at = spans(data, offsets)
    return span_hashes(data, starts, ends), starts, ends, at


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the offsets by text.

    A text of one to n - 1 words has one shingle, of all its words; one
    without words has none.
    """
    sizes = np.diff(at)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_at
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        salt = np.uint64((int(_ODD) * (2 * k + 1)) & (2**64 - 1))
        rolled[: len(hashes) - k] += hashes[k:] * salt
    rolled = mixed(rolled)
    begin = np.repeat(at[:-1], counts) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], counts)
    out = rolled[begin]
    for i in np.flatnonzero((sizes > 0) & (sizes < n)):
        total = 0
        for h in hashes[at[i] : at[i + 1]].tolist():
            total = (total * 0x100000001B3 + h) & (2**64 - 1)
        out[out_at[i]] = mixed(np.array([total], np.uint64))[0]
    return out, out_at


def portions(batches: Iterator[pa.RecordBatch], column: int = -1, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a column take about ``size`` bytes or a single row: memory then follows the longest text, not the number of rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column % batch.num_columns))
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, until - at)
            at = until
