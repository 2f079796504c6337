"""Which detectors a text may match: one pass over the bytes of a batch of texts looks for the words and properties of all detectors at once.

A detector needs its literal, one of its words and its properties (see
:mod:`detector`); here these are facts about a text, found with a few array
operations a batch whatever the number of detectors. Words are found by one
of their groups of three characters, and compared in full where it occurs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lakewarden.functions.detector import Detector, needs, words
from lakewarden.functions.text import ZERO_WIDTH

#: Bytes of texts that are looked at together.
PORTION = 1 << 20
#: Letters by how often they occur in texts, the rarest first: a word is looked for by its rarest group.
_RARE = "zqjxkvbpgwyfmucldrhsinoate"


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS, _FIGURES = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_DIGIT, _AT, _SETTER, _SIGN, _HEX = _flags(_FIGURES), _flags("@"), _flags(":="), _flags(":-"), _flags(_FIGURES + "abcdef")
_RUN = _flags(_LETTERS + _FIGURES + "_/+=.~-")
#: Five bits for each byte: letters each their own.
_CLASS = np.zeros(256, np.uint16)
_CLASS[0x20:0x7F] = 31
for _place, _some in enumerate((*_LETTERS, _FIGURES, "_", "-", " "), 1):
    _CLASS[list(_some.encode())] = _place


def _groups(data: np.ndarray) -> np.ndarray:
    """A number below 2^15 for each three bytes in a row."""
    kinds = _CLASS[data]
    return (kinds[:-2] << 10) | (kinds[1:-1] << 5) | kinds[2:]


@dataclass(frozen=True)
class Needed:
    """What texts need for a detector: a literal, one of some words, properties."""

    literal: str
    words: tuple[str, ...]
    properties: tuple[str, ...]


def needed(detector: Detector) -> Needed:
    return Needed(detector.literal, () if detector.literal in words(detector) else words(detector), tuple(sorted(needs(detector))))


@cache
def _looked_for(some: tuple[Needed, ...]) -> tuple[dict[str, bytes], dict[int, list[tuple[str, int]]], np.ndarray]:
    """All words as bytes; by group those that are looked for by it, with its place in the word; and whether a group is one of these."""
    every = {w: w.lower().encode() for n in some for w in (n.literal, *n.words) if w}
    groups: dict[int, list[tuple[str, int]]] = {}
    for name, word in every.items():
        if len(word) > 2:
            common = [_RARE.find(chr(b)) for b in word]  # what is no letter counts as rarest
            place = min(range(len(word) - 2), key=lambda k: sum(common[k : k + 3]))
            groups.setdefault(int(_groups(np.frombuffer(word[place : place + 3], np.uint8))[0]), []).append((name, place))
    wanted = np.zeros(1 << 15, bool)
    wanted[list(groups)] = True
    return every, groups, wanted


class _Texts:
    """A few texts as one run of lower-case bytes, each closed by a zero byte, and which of them hold something at given places."""

    def __init__(self, texts: pa.Array, exact: bool):
        joined = pc.binary_join_element_wise(texts, pa.scalar("", texts.type), pa.scalar("\0", texts.type))
        raw = joined.buffers()[2].to_pybytes() if joined.buffers()[2] else b""
        if (exact and not raw.isascii()) or b"\xe2\x84\xaa" in raw or b"\xc4\xb0" in raw:  # other characters may have ASCII ones as their small letters
            joined = pa.array([t.lower() for t in joined.to_pylist()], pa.large_string())
            raw = joined.buffers()[2].to_pybytes()
        wide = np.int32 if pa.types.is_string(joined.type) else np.int64
        self.ends = np.frombuffer(joined.buffers()[1], wide)[: len(joined) + 1].astype(np.int64)[1:]
        self.data = _LOWER[np.frombuffer(raw, np.uint8)[: self.ends[-1]]]

    def at(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ends), bool)
        out[np.searchsorted(self.ends, places, "right")] = True
        return out

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of some bytes begin, and how long they are; none goes beyond its text."""
        edges = np.flatnonzero(np.diff(flags[self.data].view(np.int8), prepend=0, append=0))
        return edges[::2], edges[1::2] - edges[::2]

    def having(self, some: tuple[Needed, ...]) -> dict[str, np.ndarray]:
        """Of each word and property that occurs, the texts that have it. Names of properties begin with a blank."""
        every, groups, wanted = _looked_for(some)
        data, out = self.data, {}
        for name, word in every.items():
            if len(word) == 1:
                out[name] = self.at(np.flatnonzero(data == word[0]))
            elif len(word) == 2:
                out[name] = self.at(np.flatnonzero((data[:-1] == word[0]) & (data[1:] == word[1])))
        numbers = _groups(data) if len(data) > 2 else np.zeros(0, np.uint16)
        places = np.flatnonzero(wanted[numbers])
        order = np.argsort(numbers[places], kind="stable")
        places = places[order]
        own, first = np.unique(numbers[places], return_index=True)
        for number, begin, end in zip(own.tolist(), first.tolist(), np.append(first, len(places))[1:].tolist(), strict=True):
            for name, place in groups[number]:
                word = every[name]
                starts = places[begin:end] - place
                starts = starts[(starts >= 0) & (starts + len(word) <= len(data))]
                for k, byte in enumerate(word):
                    starts = starts[data[starts + k] == byte]
                if len(starts):
                    out[name] = self.at(starts)
        starts, lengths = self.runs(_DIGIT)
        for name, least in ((" digit", 1), (" digits", 4), (" number", 6)):
            out[name] = self.at(starts[lengths >= least])
        starts, lengths = self.runs(_RUN)
        for name, least in ((" run", 16), (" long", 24)):
            out[name] = self.at(starts[lengths >= least])
        out[" at"], out[" setter"] = self.at(np.flatnonzero(_AT[data])), self.at(np.flatnonzero(_SETTER[data]))
        signs = np.flatnonzero(_SIGN[data])
        signs = signs[signs + 3 < len(data)]
        out[" octets"] = self.at(signs[_HEX[data[signs + 1]] & _HEX[data[signs + 2]] & _SIGN[data[signs + 3]]])
        return out


def _possible(texts: pa.Array, some: tuple[Needed, ...]) -> pa.Array:
    """For each text the numbers, from 1, of those of ``some`` whose needs it has, in their order."""
    known = _Texts(texts, any(not w.isascii() for n in some for w in (n.literal, *n.words)))
    having = known.having(some)
    none = np.zeros(len(texts), bool)
    rows, numbers = [], []
    for number, n in enumerate(some, 1):
        each = [having.get(w, none) for w in ([n.literal] if n.literal else [])] + [having[f" {p}"] for p in n.properties]
        if n.words:
            each.append(np.logical_or.reduce([having.get(w, none) for w in n.words]))
        found = np.flatnonzero(np.logical_and.reduce(each)) if each else np.arange(len(texts))
        rows.append(found)
        numbers.append(np.full(len(found), number, np.int32))
    row = np.concatenate([*rows, np.zeros(0, np.int64)])
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*numbers, np.zeros(0, np.int32)])[order]))


_DROPPED = dict.fromkeys(map(ord, ZERO_WIDTH))


def _normal(texts: pa.Array) -> pa.Array:
    """The texts whose normal form without characters of no width is another one, in that form; null for all others. Characters below U+0300 are their own composed form."""
    some = pc.match_substring_regex(texts, r"[^\x{0}-\x{2ff}]|\x{ad}")
    out: list[str | None] = [None] * len(texts)
    for k in np.flatnonzero(some.fill_null(False).to_numpy(zero_copy_only=False)).tolist():
        text = texts[k].as_py()
        made = unicodedata.normalize("NFC", text).translate(_DROPPED)
        out[k] = None if made == text else made
    return pa.array(out, pa.string())


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        yield texts.slice(at, upto - at)
        at = upto


#: What is told of a text: its normal form, if that is another text, and the numbers of the detectors that it may match.
TOLD = "struct<normal:string,possible:array<int>>"


def teller(detectors: Sequence[Detector], normalize: bool) -> Callable[[pa.Array], pa.Array]:
    """A function of an Arrow array of texts to what is told of them."""
    some = tuple(needed(d) for d in detectors)

    def told(texts: pa.Array) -> pa.Array:
        whole = []
        for part in _portions(texts):
            normal = _normal(part) if normalize else pa.nulls(len(part), pa.string())
            possible = _possible(pc.coalesce(normal, part, pa.scalar("")), some)
            whole.append(pa.StructArray.from_arrays([normal, possible], names=["normal", "possible"]))
        return pa.concat_arrays(whole) if whole else pa.array([], pa.struct([("normal", pa.string()), ("possible", pa.list_(pa.int32()))]))

    return told
