"""Inspection of files: true type, disguise, and the text inside of containers.

Types are told by built-in expressions over the first bytes. Only containers,
whose formats Spark has no reader for, are opened by Python tasks, a file at a
time, within a budget of bytes, entries and depth; what is over the budget is
reported, and what was read until then is kept.
"""

from __future__ import annotations

import gzip
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.llm import store

#: First bytes in hexadecimal, type and family, in the order in which they are tried.
SIGNATURES = (
    ("25504446", "pdf", "pdf"), ("504B0304", "zip", "zip"), ("504B0506", "zip", "zip"), ("1F8B", "gzip", "gzip"), ("D0CF11E0", "ole", "opaque"),
    ("89504E47", "png", "image"), ("FFD8FF", "jpeg", "image"), ("47494638", "gif", "image"), ("52494646", "riff", "media"), ("7F454C46", "elf", "binary"),
    ("4D5A", "pe", "binary"), ("53514C69", "sqlite", "binary"), ("377ABCAF", "7z", "opaque"), ("52617221", "rar", "opaque"),
)
INERT = r"(?i)\.(png|jpe?g|gif|bmp|webp|ico|svg|mp4|mp3|wav|mov|avi)\z"
HEAD, MOST_CONTROL, MOST_HIGH = 4096, 0.02, 0.45


def _like_text(head: Column) -> Column:
    """Whether the first bytes look like text: a mark of byte order, or no zero byte and few control and high bytes."""
    latin = F.decode(head, "ISO-8859-1")
    n = F.length(head)
    control, high = F.regexp_count(latin, F.lit("[\\x00-\\x08\\x0E-\\x1F]")), F.regexp_count(latin, F.lit("[\\x80-\\xFF]"))
    marked = F.hex(F.substring(head, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    return (n > 0) & (marked | (~latin.rlike("\\x00") & (control <= n * MOST_CONTROL) & (high <= n * MOST_HIGH)))


def typed(files: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """Adds ``true_type``, ``family``, ``declared_ext`` and ``masquerade``: whether a container or text goes by the name of a picture or a sound."""
    head = F.substring(F.col(content), 1, HEAD)
    first = F.hex(F.substring(F.col(content), 1, 4))
    kind, family = (F.when(_like_text(head), "text").otherwise(other) for other in ("unknown", "binary"))
    for prefix, t, f in reversed(SIGNATURES):
        kind, family = F.when(F.startswith(first, F.lit(prefix)), t).otherwise(kind), F.when(F.startswith(first, F.lit(prefix)), f).otherwise(family)
    rows = files.withColumns({"true_type": kind, "family": family, "declared_ext": F.lower(F.regexp_extract(F.col(name), r"([^.]*)\z", 1))})
    return rows.withColumn("masquerade", F.coalesce(F.col(name).rlike(INERT) & F.col("family").isin("zip", "pdf", "text", "gzip"), F.lit(False)))


#: Elements that end a line or a cell, and entities.
LINE_ENDS, CELL_ENDS = "w:p|w:tr|a:p|text:p|row|Row", "w:tc|a:tc|text:span|c"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def markup_text(markup: Column) -> Column:
    """The text of markup: ends of paragraphs, rows and cells become line ends and tabs, other tags go."""
    out = F.regexp_replace(markup, f"</({LINE_ENDS})>|<w:br\\s*/?>", "\n")
    out = F.regexp_replace(out, f"</({CELL_ENDS})>", "\t")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, "[ \t]{2,}", " ")


@dataclass(frozen=True)
class Budget:
    """Bounds of an inspection: bytes of a file, bytes that it may unpack to, entries and depth."""

    most_bytes: int = 4 << 20
    most_unpacked: int = 16 << 20
    most_entries: int = 400
    most_depth: int = 3


_OFFICE = re.compile(r"^(word/(document|header\d*|footer\d*|comments|footnotes)|xl/(sharedStrings|worksheets/sheet\d+)|ppt/(slides|notesSlides)/[^/]+|content|docProps/core)\.xml$")
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Spent(Exception):
    """The budget is used up."""


class _Opened:
    """The segments of one file, and what is left of its budget."""

    def __init__(self, budget: Budget):
        self.budget, self.bytes, self.entries = budget, budget.most_unpacked, budget.most_entries
        self.segments: list[tuple[str, str]] = []

    def take(self, stream, most: int | None = None) -> bytes:
        data = stream.read(min(self.bytes, most or self.bytes) + 1)
        if len(data) > self.bytes:
            raise _Spent
        self.bytes -= len(data)
        return data

    def open(self, data: bytes, path: str, depth: int = 0) -> None:
        if depth > self.budget.most_depth:
            raise _Spent
        if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            self._zip(data, path, depth)
        elif data[:2] == b"\x1f\x8b":
            self.open(self.take(gzip.GzipFile(fileobj=io.BytesIO(data))), path.removesuffix(".gz"), depth + 1)
        elif data[:4] == b"%PDF":
            self.segments.append((path, _pdf_text(data, self)))
        else:
            text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "replace").removeprefix("﻿")
            if b"\x00" not in data[:HEAD] or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
                self.segments.append((path, text))

    def _zip(self, data: bytes, path: str, depth: int) -> None:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            infos = [i for i in archive.infolist() if not i.is_dir() and i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)]
            if any(i.filename in ("[Content_Types].xml", "content.xml") for i in infos):  # an office document: its parts with text, the body first
                infos = sorted((i for i in infos if _OFFICE.match(i.filename)), key=lambda i: (not re.search("document|sharedStrings|content", i.filename), i.filename))
            for info in infos:
                self.entries -= 1
                if self.entries < 0:
                    raise _Spent
                with archive.open(info) as stream:
                    self.open(self.take(stream), f"{path}!{info.filename}", depth + 1)


def _pdf_text(data: bytes, opened: _Opened) -> str:
    """The strings that a document's content streams show, and its title, author, subject and keywords."""
    lines = []
    for found in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = found[1]
        if body[:1] == b"\x78":
            try:
                body = opened.take(io.BytesIO(zlib.decompressobj().decompress(body, opened.bytes + 1)))
            except zlib.error:
                continue
        for shown in _SHOWN.finditer(body):
            parts = [re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), p, flags=re.S) for p in _LITERAL.findall(shown[0])]
            lines.append(b"".join(parts).decode("latin-1"))
    lines += [m[2].decode("latin-1") for m in re.finditer(rb"/(Title|Author|Subject|Keywords)\s*\(((?:\\.|[^\\()])*)\)", data)]
    return "\n".join(lines)


def _read(path: str | None, data: bytes | None, budget: Budget) -> list[tuple[str | None, int, str | None, str | None, bool]]:
    """(segment, place, text, skipped, truncated) of one file."""
    opened, skipped, truncated = _Opened(budget), None, False
    if data is None or len(data) > budget.most_bytes:
        skipped = "unreadable" if data is None else "size"
    else:
        try:
            opened.open(bytes(data), path or "")
        except _Spent:
            truncated = True
        except (OSError, EOFError, zipfile.BadZipFile, zlib.error, RuntimeError, ValueError):
            skipped = None if opened.segments else "unreadable"
        if not opened.segments and not skipped:
            skipped = "no text"
    return [(segment, place, text, skipped, truncated) for place, (segment, text) in enumerate(opened.segments or [(None, None)])]


def is_markup(segment: Column, text: Column) -> Column:
    """Whether a piece of a file is markup, by its name or how it begins."""
    return F.coalesce(segment.rlike(r"(?i)\.(xml|rels)\z") | text.rlike(r"\A\s*<(\?xml|[a-zA-Z])"), F.lit(False))


#: Characters of texts that a task holds before they go on.
HELD = 2 << 20
_TYPES = {"path": pa.string(), "segment": pa.string(), "place": pa.int32(), "text": pa.string(), "skipped": pa.string(), "truncated": pa.bool_(), "facts": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES.values())], names=list(_TYPES)[: len(columns)])


def segments(files: DataFrame, content: str = "content", name: str = "path", budget: Budget = Budget(), facts: str | None = None) -> DataFrame:
    """(path, segment, place, text, skipped, truncated): a row for each piece of text in a file, one without text for a file that has none.

    ``place`` orders the segments of a file; ``skipped`` tells why a file was not read; a file that is broken, or over
    its budget, keeps the segments that were read. ``facts`` names a column of texts that goes along with each segment.
    """
    schema = "path string, segment string, place int, text string, skipped string, truncated boolean" + (f", `{facts}` string" if facts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, data, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for found in _read(path, data, budget):
                    rows.append((path, *found, *own))
                    held += len(found[2] or "")
                if held >= HELD:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    raw = store.mapped(files.select(F.col(name).alias("path"), F.col(content).alias("content"), *([facts] if facts else [])), run, schema, "segments")
    return raw.withColumn("text", F.when(is_markup(F.col("segment"), F.col("text")), markup_text(F.col("text"))).otherwise(F.col("text")))


@F.udtf(returnType=T.StructType([T.StructField("segment", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("skipped", T.StringType()), T.StructField("truncated", T.BooleanType())]), useArrow=False)
class Segments:
    """The pieces of one file as a table function, for ``LATERAL segments(content, path)``: a row for each, as :func:`segments` has them.

    The budget's bounds are arguments, in kilobytes, entries and levels.
    """

    def eval(self, content: bytes, path: str, most_kb: int = 4096, most_unpacked_kb: int = 16384, most_entries: int = 400, most_depth: int = 3):
        budget = Budget(most_kb << 10, most_unpacked_kb << 10, most_entries, most_depth)
        for segment, place, text, skipped, truncated in _read(path, content, budget):
            yield segment, place, plain_text(segment, text), skipped, truncated


def plain_text(segment: str | None, text: str | None) -> str | None:
    """The same as :func:`markup_text` of markup, for a row in Python."""
    if text is None or not (re.search(r"(?i)\.(xml|rels)\Z", segment or "") or re.match(r"\s*<(\?xml|[a-zA-Z])", text)):
        return text
    out = re.sub(f"</({LINE_ENDS})>|<w:br\\s*/?>", "\n", text)
    out = re.sub("<[^>]+>", "", re.sub(f"</({CELL_ENDS})>", "\t", out))
    for entity, char in ENTITIES:
        out = out.replace(entity, char)
    return re.sub("[ \t]{2,}", " ", out)
