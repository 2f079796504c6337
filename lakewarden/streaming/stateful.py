"""Keyed state over streams: rows in their order, the last of each session, prompts that wait, and spools that are flushed.

Rows of a key may come in any order within the time that the watermark allows.
They wait in the state until it has passed them, and are then taken in the
order of time and id, so results do not depend on how a stream is cut into
micro-batches. State is what is that young, and what each rule keeps. A task
holds some rows of a key at a time, however many wait: the others lie in the
state by slices of time, and are taken a slice after the other. Sessions are
many and short, and each key costs several calls to the state, so a key is a
share of them: its rows are taken in one order, and its state is by session.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lakewarden.operators import forward

#: Microseconds of a second, and a time that never comes.
SECOND, NEVER = 1_000_000, 1 << 62
#: Seconds after which a batch that could not be delivered is sent again if no event comes before.
AGAIN = 60
#: Rows of a key that a task holds before they go into the state by slices of time, the length of these, and rows of output that are held.
HELD, SLICE, MADE = 65_536, 3600 * SECOND, 500
#: Shares of the sessions of a stream; a stream that restarts needs as many as it had.
SHARES = 1024
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Rows (ts in microseconds, id, and ``fields``) of a key, in order, once time has passed them.

    ``take`` gets one row, ``passed`` is told before each row, and at the end
    (without a row), up to which time all is known; both return output rows. ``wakes`` tells
    when the key has to be looked at again though no row may come. In
    processing time the clock is the machine's, and rows are taken as they come.
    """

    fields: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    output: tuple[str, ...] = ()

    def __init__(self, processing: bool = False):
        self.processing = processing

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting_rows", "rows string, slices string")
        self.parts = handle.getMapState("waiting_parts", "slice long, part long", "size long, rows binary")
        self.opened(handle)

    def opened(self, handle) -> None:
        """Opens the state of a rule."""

    def begun(self, key: tuple) -> None:
        """Reads the state of a key."""

    def ended(self, key: tuple) -> None:
        """Writes it."""

    def take(self, key: tuple, row: tuple, now: int) -> list[tuple]:
        raise NotImplementedError

    def passed(self, key: tuple, until: int, row: tuple | None = None) -> list[tuple]:
        return []

    def wakes(self) -> int:
        return NEVER

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, map(self._plain, rows), timerValues)

    def _plain(self, frame: pd.DataFrame) -> list[tuple]:
        columns = [frame[n].astype(object).where(frame[n].notna(), None) for n in ("micros", "id", *self.fields)]
        return [(int(r[0]), *r[1:]) for r in zip(*columns, strict=True)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, (), timerValues)

    def close(self) -> None:
        pass

    def _stored(self, rows: list, slices: dict[int, list[int]]) -> None:
        """Puts rows into the state, as one more part of each slice of time; ``slices`` tells how many parts each has, and its first time."""
        found: dict[int, list] = {}
        for r in rows:
            found.setdefault(r[0] // SLICE, []).append(r)
        for name, some in found.items():
            data, first = pickle.dumps(some, 5), min(r[0] for r in some)
            parts, before = slices.get(name, (0, first))
            self.parts.updateValue((name, parts), (len(data), pa.compress(data, "zstd", asbytes=True)))
            slices[name] = [parts + 1, min(first, before)]

    def _taken(self, name: int, parts: int) -> list:
        """The rows of a slice, which go from the state."""
        rows: list = []
        for k in range(parts):
            size, data = self.parts.getValue((name, k))
            rows += pickle.loads(pa.decompress(bytes(data), size, "zstd", asbytes=True))
            self.parts.removeKey((name, k))
        return rows

    def _advanced(self, key: tuple, fresh: Iterable[list[tuple]], timers) -> Iterator[pd.DataFrame]:
        now = (timers.getCurrentProcessingTimeInMs() if self.processing else timers.getCurrentWatermarkInMs()) * 1000
        until = NEVER if self.processing else now
        known = self.waiting.get()
        held, slices = ([], {}) if known is None else (json.loads(known[0]), {int(k): v for k, v in json.loads(known[1]).items()})
        for rows in fresh:
            held += rows
            if len(held) >= HELD:
                self._stored(held, slices)
                held = []
        if slices:  # rows that are held may belong before those of any slice
            self._stored(held, slices)
            held = []
        self.begun(key)
        due = [None] if not slices else sorted(k for k, (_, first) in slices.items() if first <= until)
        out = []
        for name in due:
            rows = held if name is None else self._taken(name, slices.pop(name)[0])
            rows.sort(key=lambda r: (r[0], r[1] or ""))
            held = [r for r in rows if r[0] > until]
            for row in rows[: len(rows) - len(held)]:
                at = now if self.processing else row[0]
                out += self.passed(key, at - 1, row)
                out += self.take(key, row, at)
                if len(out) >= MADE:
                    yield pd.DataFrame(out, columns=list(self.output))
                    out = []
        out += self.passed(key, now)
        self.ended(key)
        if held or slices:
            self.waiting.update((json.dumps(held), json.dumps(slices)))
        elif known is not None:
            self.waiting.clear()
        wake = min(min((r[0] for r in held), default=NEVER), min((first for _, first in slices.values()), default=NEVER), self.wakes())
        if wake < NEVER:  # a timer goes off once its time lies behind, so one millisecond before the time that has to be reached
            self.handle.registerTimer(-(-wake // 1000) - 1)
        if out:
            yield pd.DataFrame(out, columns=list(self.output))


class Changes(Ordered):
    """Rows whose fingerprint differs from that of the row before them in their session: the last one is kept, so a text that comes back later counts again."""

    fields, types = ("session", "fingerprint", "body"), ("string", "string", "string")
    output = ("session", "id", "micros", "fingerprint", "body")

    def opened(self, handle) -> None:
        self.last = handle.getValueState("last", "fingerprints string")

    def begun(self, key: tuple) -> None:
        found = self.last.get()
        self.seen, self.changed = json.loads(found[0]) if found else {}, False

    def ended(self, key: tuple) -> None:
        if self.changed:
            self.last.update((json.dumps(self.seen),))

    def take(self, key: tuple, row: tuple, now: int) -> list[tuple]:
        ts, name, session, fingerprint, body = row
        if fingerprint == self.seen.get(session):
            return []
        self.seen[session], self.changed = fingerprint, True
        return [(session, name, ts, fingerprint, body)]


class Pending(Ordered):
    """Prompts that wait for the next turn of their session and a moment more, but no longer than their patience, and take the last address until then."""

    fields, types = ("session", "kind", "url"), ("string", "string", "string")
    output = ("session", "id", "micros", "url")

    def __init__(self, patience: float, settle: float, processing: bool = False):
        super().__init__(processing)
        self.patience, self.settle = int(patience * SECOND), int(settle * SECOND)

    def opened(self, handle) -> None:
        self.pending = handle.getListState("pending", "session string, id string, since long, deadline long, url string")

    def begun(self, key: tuple) -> None:
        self.queues: dict[str | None, list[list]] = {}
        for session, *prompt in self.pending.get() if self.pending.exists() else ():
            self.queues.setdefault(session, []).append(prompt)

    def ended(self, key: tuple) -> None:
        rows = [(session, *r) for session, queue in self.queues.items() for r in queue]
        if rows:
            self.pending.put(rows)
        else:
            self.pending.clear()

    def passed(self, key: tuple, until: int, row: tuple | None = None) -> list[tuple]:
        out = []
        for session in list(self.queues) if row is None else [row[2]]:
            queue = self.queues.get(session, [])
            out += [(session, name, deadline, url) for name, _, deadline, url in queue if deadline <= until]
            left = [r for r in queue if r[2] > until]
            if left:
                self.queues[session] = left
            else:
                self.queues.pop(session, None)
        return out

    def take(self, key: tuple, row: tuple, now: int) -> list[tuple]:
        ts, name, session, kind, url = row
        queue = self.queues.get(session, [])
        if kind == "move":
            for r in queue:
                if ts > r[1]:
                    r[3] = url
            return []
        for r in queue:
            r[2] = min(r[2], now + self.settle)
        if kind == "prompt":
            self.queues.setdefault(session, []).append([name, ts, now + self.patience, url])
        return []

    def wakes(self) -> int:
        return min((r[2] for queue in self.queues.values() for r in queue), default=NEVER)


class Spool(Ordered):
    """Events that wait for a profile, sent a batch at a time: when there are enough of them, or when the oldest has waited long enough.

    A batch that cannot be delivered goes back to the head of the queue, and
    goes out again with the next event or after a minute. The queue holds a
    bounded number of events, of which the oldest go. ``deliver`` takes
    (profile, lines) and returns whether they were taken; without it the output
    is the delivery. A batch that runs again after a failure of the machine is
    sent again.
    """

    fields, types = ("line",), ("string",)
    output = ("profile", "batch", "micros", "reason", "n", "first_id", "last_id", "ok", "queued", "ok_total", "fail_total", "consecutive_failures", "lines")

    def __init__(self, settings: Mapping[str, tuple[int, int]], most: int, deliver: Callable[[str, list[str]], bool] | None = None, processing: bool = False):
        super().__init__(processing)
        self.settings, self.most, self.deliver = dict(settings), most, deliver

    def opened(self, handle) -> None:
        self.queued = handle.getListState("queue", "ts long, id string, line string")
        self.counters = handle.getValueState("counters", "batch long, ok long, failed long, consecutive long, attempt long")

    def begun(self, key: tuple) -> None:
        self.queue = list(self.queued.get()) if self.queued.exists() else []
        self.batch, self.ok, self.failed, self.consecutive, self.attempt = self.counters.get() if self.counters.exists() else (0, 0, 0, 0, 0)
        self.size, self.wait = self.settings.get(key[0], (0, 0))

    def ended(self, key: tuple) -> None:
        if self.queue:
            self.queued.put([tuple(r) for r in self.queue])
        else:
            self.queued.clear()
        self.counters.update((self.batch, self.ok, self.failed, self.consecutive, self.attempt))

    def _due(self) -> int:
        if not self.queue or not self.size:
            return NEVER
        due = self.queue[0][0] + self.wait * SECOND
        return max(due, self.attempt + AGAIN * SECOND) if self.consecutive else due

    def _sent(self, key: tuple, at: int, reason: str) -> tuple:
        batch, self.attempt = self.queue[: self.size], at
        lines = [r[2] for r in batch]
        taken = self.deliver is None or self.deliver(key[0], lines)
        number = self.batch
        if taken:
            self.queue = self.queue[self.size :]
            self.batch, self.ok, self.consecutive = self.batch + 1, self.ok + len(batch), 0
        else:
            self.failed, self.consecutive = self.failed + 1, self.consecutive + 1
        return (key[0], number, at, reason, len(batch), batch[0][1], batch[-1][1], taken, len(self.queue), self.ok, self.failed, self.consecutive, lines if taken else [])

    def passed(self, key: tuple, until: int, row: tuple | None = None) -> list[tuple]:
        out = []
        while (due := self._due()) <= until:
            out.append(self._sent(key, due, "age"))
            if self.consecutive:  # whatever the time that has passed, one attempt: the timer comes back
                break
        return out

    def take(self, key: tuple, row: tuple, now: int) -> list[tuple]:
        if not self.size:  # a profile that is gone
            self.queue = []
            return []
        out = self.passed(key, now)
        self.queue = [*self.queue, row][-self.most :]
        return [*out, self._sent(key, now, "size")] if len(self.queue) >= self.size else out

    def wakes(self) -> int:
        return self._due()


def _run(rows: DataFrame, processor: Ordered, key: Column, name: str, columns: Mapping[str, Column], schema: str, ts: str) -> DataFrame:
    """The output of a processor over a watermarked stream; rows without a time have no place in an order and are left out.

    Such state needs the RocksDB store, which streams that the session starts from then on use too; those that restart keep theirs.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ready = rows.where(F.col(ts).isNotNull()).select(key.alias(name), F.col(ts).alias("__ts"), F.unix_micros(ts).alias("micros"), *(c.alias(n) for n, c in columns.items()))
    return ready.groupBy(name).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if processor.processing else "EventTime")


def _share(session: Column) -> Column:
    """The share that a session belongs to."""
    return F.pmod(F.xxhash64(session), F.lit(SHARES))


def changes(rows: DataFrame, session: Column, fingerprint: Column, body: Column | None = None, id: str = "id", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """(session, id, ts, fingerprint, body): the rows of a stream that differ from the one before them in their session."""
    own = F.coalesce(session.cast("string"), F.lit("unknown"))
    columns = {"id": F.col(id).cast("string"), "session": own, "fingerprint": F.coalesce(fingerprint.cast("string"), F.lit("")), "body": F.lit(None).cast("string") if body is None else body.cast("string")}
    out = _run(rows.withWatermark(ts, late), Changes(), _share(own), "share", columns, "session string, id string, micros long, fingerprint string, body string", ts)
    return out.select("session", "id", F.timestamp_micros("micros").alias("ts"), "fingerprint", "body")


def finalized(rows: DataFrame, patience: float = 15, settle: float = 0.5, late: str = "1 minute", processing: bool = False) -> DataFrame:
    """(session, id, final_ts, url): the prompts of a stream of turns and changes of address (session, id, ts, kind, url), where ``kind`` is ``prompt``, ``move`` or that of another turn, as soon as each is given up as pending. The same rule as :func:`jobs.finalized`."""
    own = F.col("session").cast("string")
    columns = {"id": F.coalesce(F.col("id").cast("string"), F.lit("")), "session": own, "kind": F.col("kind"), "url": F.col("url")}
    source = rows if processing else rows.withWatermark("ts", late)
    out = _run(source, Pending(patience, settle, processing), _share(own), "share", columns, "session string, id string, micros long, url string", "ts")
    return out.select("session", "id", F.timestamp_micros("micros").alias("final_ts"), "url")


def spooled(events: DataFrame, profiles: Sequence[forward.Profile], deliver: Callable[[str, list[str]], bool] | None = None, most: int = forward.MOST_SPOOLED, late: str = "1 minute", processing: bool = False) -> DataFrame:
    """(profile, batch, at, reason, n, first_id, last_id, ok, queued, ok_total, fail_total, consecutive_failures, lines): each batch of a stream of events that goes out to a profile, in its form, and each attempt that fails."""
    rows = forward.fan_out(events if processing else events.withWatermark("ts", late), profiles)
    columns = {"id": F.col("id").cast("string"), "line": forward.lines(profiles)}
    schema = "profile string, batch long, micros long, reason string, n long, first_id string, last_id string, ok boolean, queued long, ok_total long, fail_total long, consecutive_failures long, lines array<string>"
    processor = Spool({p.id: (p.batch_size, p.flush_seconds) for p in profiles if p.enabled and p.url}, most, deliver, processing)
    out = _run(rows, processor, F.col("profile"), "profile", columns, schema, "ts")
    return out.withColumn("at", F.timestamp_micros("micros")).drop("micros")
