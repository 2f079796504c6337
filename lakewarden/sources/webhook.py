"""Data sources by name: ``attachments`` reads files with their bytes, ``webhook`` sends requests, in batch and as streams.

    spark.dataSource.register(Attachments); spark.dataSource.register(Webhook)
    spark.readStream.format("attachments").load(folder)
    requests.writeStream.format("webhook").option("ledger", folder).option("checkpointLocation", ...).start()

Paths are URIs of any file system that pyarrow knows (file, hdfs, s3, gs), so
that driver and executors see the same files.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lakewarden.operators import forward

#: Bytes of the files that one task reads, and of a file beyond which its content is left out.
PARTITION_BYTES, MOST_BYTES = 64 << 20, 4 << 20


def _opened(uri: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


@dataclass
class Listed(InputPartition):
    """Files (path, size, modified in nanoseconds) of one task."""

    files: tuple[tuple[str, int, int], ...]


class _Files:
    """The files under a path, in the order in which they were modified, then by path."""

    def __init__(self, options):
        self.root, self.most = options["path"], int(options.get("mostbytes", MOST_BYTES))
        self.share = int(options.get("partitionbytes", PARTITION_BYTES))

    def listed(self, after: tuple[int, str] = (-1, ""), until: tuple[int, str] | None = None) -> list[tuple[str, int, int]]:
        from pyarrow import fs

        store, path = _opened(self.root)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = [(f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted((f for f in files if (f[2], f[0]) > after and (until is None or (f[2], f[0]) <= until)), key=lambda f: (f[2], f[0]))

    def dealt(self, files: Sequence[tuple[str, int, int]]) -> list[Listed]:
        """Files in shares of about equal bytes; content that is left out has none."""
        shares, room = [[]], 0
        for f in files:
            size = f[1] if f[1] <= self.most else 0
            if shares[-1] and room + size > self.share:
                shares.append([])
                room = 0
            shares[-1].append(f)
            room += size
        return [Listed(tuple(s)) for s in shares if s]

    def read(self, partition: Listed) -> Iterator[tuple]:
        store, _ = _opened(self.root)
        for path, size, modified in partition.files:
            content = None
            if size <= self.most:
                with store.open_input_stream(path) as stream:
                    content = stream.read()
            yield path, size, datetime.fromtimestamp(modified / 1e9, UTC), content


class _FileReader(DataSourceReader):
    def __init__(self, options):
        self.files = _Files(options)

    def partitions(self):
        return self.files.dealt(self.files.listed()) or [Listed(())]

    def read(self, partition):
        return self.files.read(partition)


class _FileStream(DataSourceStreamReader):
    """An offset is the time and path of the last file that was taken: each file is read once, though the stream restarts."""

    def __init__(self, options):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.files.listed()
        return {"modified": found[-1][2], "path": found[-1][0]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        place = lambda o: (o["modified"], o["path"])
        return self.files.dealt(self.files.listed(place(start), place(end))) or [Listed(())]

    def read(self, partition):
        return self.files.read(partition)


class Attachments(DataSource):
    """Files below ``path``: (path, length, modified, content), the columns that inspection takes.

    Content of files over ``mostBytes`` is null. As a stream, files are taken
    in the order in which they were modified; one that is put there later with
    an older time than the last is not seen.
    """

    @classmethod
    def name(cls) -> str:
        return "attachments"

    def schema(self) -> str:
        return "path string, length bigint, modified timestamp, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FileReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FileStream(self.options)


def post(request: dict) -> forward.Reply:
    """Sends a request over HTTP."""
    sent = urllib.request.Request(request["url"], request["body"].encode(), request["headers"], method=request["method"])
    try:
        with urllib.request.urlopen(sent, timeout=request["timeout_ms"] / 1000) as answer:
            return forward.Reply(answer.status)
    except urllib.error.HTTPError as e:
        return forward.Reply(e.code, e.reason or "")
    except OSError as e:
        return forward.Reply(0, str(e))


@dataclass
class Sent(WriterCommitMessage):
    """What a task did: requests that were taken now, before, and refused."""

    taken: int = 0
    before: int = 0
    refused: int = 0


class Undelivered(RuntimeError):
    """Requests that a receiver may take later."""


class _Sender(DataSourceWriter):
    """Sends each row once.

    What a receiver has taken is in the ledger, by the row's key, so a task or
    a micro-batch that runs again sends only the rest. What it refuses for
    good is in the ledger too. If it cannot be reached the task fails after
    its other rows, and Spark runs it again. Between an answer and its entry a
    machine may fail: receivers that have to see a request once get its key as
    ``Idempotency-Key``.
    """

    def __init__(self, options):
        self.ledger = options["ledger"].rstrip("/")
        self.sender = options.get("sender", f"{__name__}:post")
        self.retries, self.timeout = int(options.get("retries", 4)), int(options.get("timeoutms", 10_000))
        self.wait = float(options.get("waitfactor", 1))

    def _entry(self, key: str) -> str:
        digest = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.ledger}/sent/{digest[:2]}/{digest}"

    def write(self, rows: Iterator[Row]) -> Sent:
        from pyarrow import fs

        module, _, name = self.sender.partition(":")
        send, done, lost = getattr(importlib.import_module(module), name), Sent(), []
        for r in rows:
            store, path = _opened(self._entry(r.key))
            if store.get_file_info(path).type == fs.FileType.File:
                done.before += 1
                continue
            request = {"url": r.url, "method": r.method, "headers": dict(r.headers or {}) | {"Idempotency-Key": r.key}, "body": r.body, "timeout_ms": self.timeout}
            reply, attempts = forward.attempted(lambda q=request: send(q), self.retries, lambda s: time.sleep(s * self.wait))
            if not reply.ok and reply.again:
                lost.append((r.key, reply.error))
                continue
            done.taken, done.refused = done.taken + reply.ok, done.refused + (not reply.ok)
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(json.dumps({"key": r.key, "status": reply.status, "attempts": attempts}).encode())
        if lost:
            raise Undelivered(f"{len(lost)} requests were not delivered, {lost[0][0]} first: {lost[0][1]}")
        return done

    def commit(self, messages) -> None:
        self._committed(messages, "batch-" + hashlib.sha256(repr(time.time_ns()).encode()).hexdigest()[:12])

    def abort(self, messages) -> None:
        """What was sent stays in the ledger, and is not sent again."""

    def _committed(self, messages, name: str) -> None:
        """Writes what a batch did, once: a batch that is committed again keeps what it did first."""
        from pyarrow import fs

        store, path = _opened(f"{self.ledger}/commits/{name}.json")
        if store.get_file_info(path).type == fs.FileType.File:
            return
        counts = {k: sum(getattr(m, k) for m in messages if m) for k in asdict(Sent())}
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(json.dumps(counts).encode())


class _StreamSender(DataSourceStreamWriter, _Sender):
    def __init__(self, options):
        _Sender.__init__(self, options)

    def write(self, rows: Iterator[Row]) -> Sent:
        return _Sender.write(self, rows)

    def commit(self, messages, batchId: int) -> None:
        self._committed(messages, f"batch={batchId}")

    def abort(self, messages, batchId: int) -> None:
        """As in batch."""


class Webhook(DataSource):
    """A sink of requests (key, url, method, headers, body), as :func:`forward.addressed` makes them, with a key that tells them apart.

    Options: ``ledger``, a folder of what was sent; ``sender``, a function
    (``module:name``) that takes a request and returns a :class:`forward.Reply`;
    ``retries``, ``timeoutMs`` and ``waitFactor``.
    """

    @classmethod
    def name(cls) -> str:
        return "webhook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Sender(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamSender(self.options)
