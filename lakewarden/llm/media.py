"""Media columns: payloads kept outside the rows, by content.

A payload is stored once for each digest, as an 8-bit grey PNG of 64 samples a
line (lossless), in a tar shard; rows carry digest, shard, offset and length.
A pass over the headers alone, by range reads, fills the metadata columns; a
pass over the stored bytes decodes them and computes features.

Each task writes one shard at most, through a temporary name that is renamed
when the shard is complete, and returns its entries; entries are written as a
table, and an attempt that was lost leaves at most a shard that no entry
names. Payloads are never shuffled: tasks skip rows whose digest another row
carries first (ids and digests of these rows are sent to all tasks while few,
joined otherwise).

Defined results: a null or empty text is one payload of 64 zero bytes. A text
whose bytes equal another's padded payload shares its stored form. Rows with a
null id are kept; among equal payloads the row with the least id stores it.
Rows that repeat an id are returned each, whether their texts are equal or not.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import store, textvec

WIDTH = 64
LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes that hold a PNG's signature and its IHDR chunk.
HEADER = 33


def padded(text: str) -> bytes:
    """UTF-8 bytes, filled with zeros to a positive multiple of 64."""
    raw = text.encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], 1)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict[str, int]:
    """Metadata from the first :data:`HEADER` bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    width, height, depth, color = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "channels": {0: 1, 2: 3, 4: 2, 6: 4}[color]}


def from_png(data: bytes) -> bytes:
    """The samples of an 8-bit grey PNG without filters, checksums verified."""
    head = png_header(data)
    at, packed = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk's checksum does not fit")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("only PNG lines without a filter are read")
    return lines[:, 1:].tobytes()


@lru_cache(maxsize=4)
def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Shard:
    """A tar file that grows member by member; it appears under its name when it is closed."""

    def __init__(self, folder: str) -> None:
        self.system, base = _system(folder)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.path, self.draft = f"{base}/{self.name}", f"{base}/.{self.name}.part"
        self.system.create_dir(base, recursive=True)
        self.out = self.system.open_output_stream(self.draft)
        self.at = 0

    def add(self, name: str, data: bytes) -> int:
        """Appends a member and returns the offset of its bytes."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(bytes(-len(data) % tarfile.BLOCKSIZE))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % tarfile.BLOCKSIZE
        return offset

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()
        self.system.move(self.draft, self.path)


def digests(docs: DataFrame) -> DataFrame:
    """Adds ``sha`` (SHA-256 of the padded payload, binary) and ``n_bytes`` (before padding) to (doc_id, text)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    room = F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH)))
    zeros = F.unhex(F.repeat(F.lit("00"), room))
    return docs.withColumn("sha", F.unhex(F.sha2(F.concat(raw, zeros), 256))).withColumn("n_bytes", size.cast("long"))


def stored(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stores every distinct payload. Returns each row's digest (doc_id, sha, n_bytes), and one entry a payload with how many rows share it (sha, n, shard, offset, length)."""
    keyed = digests(docs.select("doc_id", "text"))
    ids = store.written(keyed.select("doc_id", "sha", "n_bytes"), "digests")
    counts = store.written(ids.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "counts")
    repeated = counts.where("n > 1")
    spare = store.written(store.hot_join(ids.select("doc_id", "sha"), repeated, "sha").where("doc_id > first or (doc_id is null and first is not null)").select("doc_id", "sha").distinct(), "spare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, entries = None, set(), []
        for batch in textvec.portions(batches):
            for text in batch.column(0).to_pylist():
                payload = padded(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    seen.add(digest)
                    shard = shard or Shard(folder)
                    data = to_png(payload)
                    entries.append((digest, shard.name, shard.add(f"{digest.hex()}.png", data), len(data)))
        if shard:
            shard.close()
        columns = list(zip(*entries, strict=True)) if entries else [()] * 4
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sha", "shard", "offset", "length"])

    own = store.with_ids(keyed.select("doc_id", "text", "sha"), spare, ["doc_id", "sha"], "left_anti", store.MOST_SENT // 4)
    entries = store.written(store.mapped(own.select(F.coalesce("text", F.lit("")).alias("text")), run, "sha binary, shard string, offset long, length long"), "entries")
    # rows that repeat an id and a text may store a payload twice; one entry counts
    found = entries.groupBy("sha").agg(F.min(F.struct("shard", "offset", "length")).alias("e"))
    shard = F.coalesce("e.shard", F.raise_error(F.concat(F.lit("no payload is stored for "), F.hex("sha"))).cast("string"))
    return ids, store.written(counts.join(found, "sha", "left").select("sha", "n", shard.alias("shard"), "e.offset", "e.length"), "catalogue")


def _reader(folder: str, cache: dict, shard: str):
    """An open shard; one stays open at a time, as entries are read in the order of shards."""
    if shard not in cache:
        for old in cache.values():
            old.close()
        cache.clear()
        system, base = _system(folder)
        cache[shard] = system.open_input_file(f"{base}/{shard}")
    return cache[shard]


def metadata(entries: DataFrame, folder: str) -> DataFrame:
    """Adds width, height, bit_depth and channels from range reads of the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            rows = [png_header(_reader(folder, cache, r["shard"]).read_at(HEADER, r["offset"])) for r in batch.to_pylist()]
            extra = [pa.array([r[c] for r in rows], pa.int64()) for c in ("width", "height", "bit_depth", "channels")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "width", "height", "bit_depth", "channels"])

    return store.mapped(entries, run, "sha binary, n long, shard string, offset long, length long, width long, height long, bit_depth long, channels long")


def feature(payload: bytes) -> str:
    """Mean, standard deviation and a 64-bit difference hash over 65 stretches of the samples."""
    x = np.frombuffer(payload, np.uint8)
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    edges = np.linspace(0, len(x), 66).astype(np.int64)
    means = (total[edges[1:]] - total[edges[:-1]]) / np.maximum(1, np.diff(edges))
    bits = int("".join("1" if b else "0" for b in means[1:] > means[:-1]), 2)
    return f"{x.mean():.4f}:{x.std():.4f}:{bits:016x}"


def described(entries: DataFrame, folder: str) -> DataFrame:
    """Reads each stored payload back and adds what is computed from its bytes."""
    fields = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields), "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            rows = []
            for r in batch.select(["shard", "offset", "length"]).to_pylist():
                data = _reader(folder, cache, r["shard"]).read_at(r["length"], r["offset"])
                payload = from_png(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            extra = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *fields])

    return store.mapped(entries, run, schema)


def columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores the payloads of all rows and returns (doc_id, n_bytes, digest, shard, offset, length, metadata, features)."""
    folder = folder or store.new_path(docs.sparkSession, "media")
    ids, entries = stored(docs, folder)
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = entries.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    media = store.written(described(metadata(ordered, folder), folder), "media-columns")
    return store.hot_join(ids, media, "sha").withColumn("sha", F.lower(F.hex("sha"))).withColumnRenamed("sha", "digest").drop("n")
