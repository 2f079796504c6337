"""WARC archives and their fixity: Merkle trees over records, compared between replicas.

An archive is a set of WARC files of bounded size; each record is a gzip member
of its own, and files keep their records in the order of keys. A file is named
after the task that wrote it and its number there. A manifest has a row for
each record: file, number, offset, length and the SHA-256 of its stored bytes.

The tree has the records' hashes, each with its offset and length, as leaves;
above them nodes of :data:`FANOUT` children over ordered ranges, up to a node
for each file, which also holds the file's size; above these a node for each
task's files, and one root. Two replicas are audited from their roots down:
equal roots end the audit, and only where two hashes differ are the children
compared, so damage is located in a number of steps that grows with the depth.
Each level is a table of its own, and one join of the nodes still suspected.

Bytes are written and read by the tasks, a record at a time (a copy takes a
file at a time, whose size is bounded). A file appears under its name when it
is complete.

Defined results: null and empty bodies are records of length 0; keys may
repeat, a null key sorts first. An empty table gives no file. Repeated rows are
records of their own. Records that a replica lacks, those of a file that it
lacks or that was cut short, and changed ones are reported by number; bytes
behind the last record, and files of the replica that the manifest does not
know, are reported with a null number.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import store

FANOUT = 16
#: Bytes of bodies after which a file is full; one record may exceed it.
FILE_BYTES = 8 << 20
#: Fixed value: the date of all records, as the tables have none.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, number long, page_id long, url string, offset long, length long, sha256 string"


@lru_cache(maxsize=4)
def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(url: str, body: bytes, number: int) -> bytes:
    """A WARC/1.1 resource record, as a gzip member."""
    digest = hashlib.sha256(body).hexdigest()
    head = [
        "WARC/1.1", "WARC-Type: resource", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:sha256:{hashlib.sha256(f'{number} {url} {digest}'.encode()).hexdigest()}>",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the body of a record."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    first, *lines = head.decode(errors="replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def put(system, draft: str, name: str) -> None:
    """Gives a finished draft its name. Where a file of that name is there already, of an attempt before, and the store does not replace files, it goes first; another attempt may have put its own meanwhile, which holds the same."""
    for last in (False, False, True):
        try:
            system.move(draft, name)
            return
        except OSError:
            there = system.get_file_info(name).type == fs.FileType.File
            if last and there:
                system.delete_file(draft)
                return
            if not there:
                raise
            system.delete_file(name)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files in the order of their ids, and returns the manifest.

    Pages are dealt to tasks by ranges of ids (rows that repeat, by their place
    in the input too); a task fills one file after the other. A task that runs
    again writes the same files. The manifest is a table in the shared folder.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        system.create_dir(base, recursive=True)
        out, name, at, number, rows, draft, files, task = None, "", 0, 0, [], "", 0, TaskContext.get().partitionId()
        for batch in frames:
            for page, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(url, body.encode(), number if out else 0)
                if out and at + len(data) > FILE_BYTES:
                    out.close()
                    put(system, draft, f"{base}/{name}")
                    out = None
                if out is None:
                    data = record(url, body.encode(), 0)
                    name = f"{task:06d}-{files:06d}.warc.gz"
                    draft, at, number, files = f"{base}/.{name}.{uuid.uuid4().hex}.part", 0, 0, files + 1
                    out = system.open_output_stream(draft)
                out.write(data)
                rows.append((name, number, page, url, at, len(data), hashlib.sha256(data).hexdigest()))
                at, number = at + len(data), number + 1
                if len(rows) >= 5000:
                    yield _batch(rows)
                    rows = []
        if out:
            out.close()
            put(system, draft, f"{base}/{name}")
        yield _batch(rows)

    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    placed = ready.withColumn("__place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(tasks, "page_id", "url", "__place").sortWithinPartitions("page_id", "url", "html").drop("__place")
    return store.written(store.mapped(ordered, run, MANIFEST), "manifest")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["file", "number", "page_id", "url", "offset", "length", "sha256"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def hashed(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads each record of a replica by its range and returns (file, number, offset, length, sha256) as found there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        name, source = None, None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name = r["file"]
                    try:
                        source = system.open_input_file(f"{base}/{name}")
                    except OSError:
                        source = None
                data = source.read_at(r["length"], r["offset"]) if source and r["offset"] + r["length"] <= source.size() else None
                found.append(None if data is None else hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.select("file", "number", "offset", "length").repartitionByRange(tasks, "file", "number").sortWithinPartitions("file", "number")
    return store.mapped(ranges, run, "file string, number long, offset long, length long, sha256 string")


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the files in a folder, by Spark's listing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    system, base = _system(folder)
    system.create_dir(base, recursive=True)  # an archive of no records has no folder
    return spark.read.format("binaryFile").schema(schema).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def _hashed(kind: str, *parts: str | Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(kind), *parts), 256)


def _rolled(nodes: DataFrame, key: list[str | Column]) -> DataFrame:
    """Parents of nodes (node, first, end, hash): the range that their ordered children cover, and these children's hashes."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return nodes.groupBy(*key).agg(F.min("first").alias("first"), F.max("end").alias("end"), F.array_join(F.transform(children, lambda c: c["hash"]), ",").alias("inside"))


def tree(leaves: DataFrame, files: DataFrame) -> list[DataFrame]:
    """The levels of a tree, from the records up to the root, each a written table (file, node, first, end, hash).

    ``leaves`` are records (file, number, offset, length, sha256), ``files``
    the sizes of the files. The last three levels are those of the files, of
    the tasks that wrote them, and the root.
    """
    nodes = leaves.select("file", F.col("number").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("end"), _hashed("leaf", "offset", "length", F.coalesce("sha256", F.lit("lost"))).alias("hash"))
    levels = [store.written(nodes, "level")]
    last = int(leaves.agg(F.max("number")).first()[0] or 0)
    while last:
        up = _rolled(levels[-1], ["file", F.floor(F.col("node") / FANOUT).cast("long").alias("parent")])
        levels.append(store.written(up.select("file", F.col("parent").alias("node"), "first", "end", _hashed("node", "first", "end", "inside").alias("hash")), "level"))
        last //= FANOUT
    top = levels[-1].join(files, "file", "full").select("file", F.lit(0).cast("long").alias("node"), F.coalesce("first", F.lit(0)).alias("first"), "end", _hashed("file", "file", F.coalesce("bytes", F.lit(-1)), F.coalesce("hash", F.lit("none"))).alias("hash"))
    levels.append(store.written(top, "files"))
    part = F.substring("file", 1, 6)
    ordered = levels[-1].select(part.alias("part"), F.col("file").alias("node"), "first", "end", "hash")
    parts = _rolled(ordered, ["part"]).select(F.col("part").alias("file"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("end"), _hashed("part", "part", "inside").alias("hash"))
    levels.append(store.written(parts, "parts"))
    root = _rolled(levels[-1].select(F.lit("").alias("all"), F.col("file").alias("node"), "first", "end", "hash"), ["all"])  # a row for each task that wrote
    levels.append(store.written(root.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("node"), "first", "end", _hashed("root", "inside").alias("hash")), "root"))
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(file, number, first, end) of what differs between two trees over the same manifest, found from the roots down.

    A file's bytes behind its last record, and a file that only one side has,
    have a null number.
    """
    *below, files, parts, root = ours
    spark = files.sparkSession
    schema = "file string, number long, first long, end long"
    same = [r.hash for r in root.collect()] == [r.hash for r in theirs[-1].collect()]  # a row each
    if same:
        return spark.createDataFrame([], schema)

    def differing(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        other = b.select("file", "node", F.col("hash").alias("other"), F.col("end").alias("other_end"))
        rows = a.join(other, ["file", "node"], "full").where("hash is null or other is null or hash <> other")
        return store.written(rows.select("file", "node", "first", F.coalesce("end", "other_end").alias("end")), name)

    bad_parts = differing(parts, theirs[-2], "suspect-parts").select(F.col("file").alias("part"))
    within = lambda level: level.withColumn("part", F.substring("file", 1, 6)).join(bad_parts, "part", "left_semi").drop("part")
    bad_files = differing(within(files), within(theirs[-3]), "suspect-files")
    suspects = bad_files
    for k in range(len(below) - 1, -1, -1):
        parents = suspects.select("file", F.col("node").alias("parent")) if k < len(below) - 1 else None
        pick = lambda level, p=parents: level.join(bad_files.select("file"), "file", "left_semi") if p is None else level.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(p, ["file", "parent"], "left_semi").drop("parent")
        suspects = differing(pick(below[k]), pick(theirs[k]), f"suspects-{k}")
    records = suspects.select("file", F.col("node").alias("number"), "first", "end")
    whole = bad_files.join(suspects.select("file").distinct(), "file", "left_anti")  # all their records are sound
    return records.unionByName(whole.select("file", F.lit(None).cast("long").alias("number"), F.col("end").alias("first"), F.lit(None).cast("long").alias("end")))


def replicate(manifest: DataFrame, source: str, target: str, damage=None) -> DataFrame:
    """Copies the files of an archive, a file at a time; ``damage(name, data)`` may change what is written, for drills. Returns (file, bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _system(source)
        other, there = _system(target)
        other.create_dir(there, recursive=True)
        for frame in frames:
            sizes = []
            for name in frame.file:
                with system.open_input_file(f"{base}/{name}") as f:
                    data = f.read()
                data = damage(name, data) if damage else data
                draft = f"{there}/.{name}.{uuid.uuid4().hex}.part"
                with other.open_output_stream(draft) as out:
                    out.write(data)
                put(other, draft, f"{there}/{name}")
                sizes.append(len(data))
            yield pd.DataFrame({"file": frame.file, "bytes": sizes})

    return store.written(manifest.select("file").distinct().mapInPandas(run, "file string, bytes long"), "copies")


def flipped(name: str, data: bytes) -> bytes:
    """A drill's damage: in every fourth file by name, one bit of a byte in the middle of the file."""
    (draw,) = struct.unpack(">I", hashlib.sha256(name.encode()).digest()[:4])
    if draw % 4 or not data:
        return data
    at = len(data) // 2
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
