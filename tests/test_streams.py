"""Streams with state: rows out of order, restarts, replayed batches, timers of both kinds, receivers that fail."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import audit, forward
from lakewarden.sources import versioned
from lakewarden.streaming import jobs, stateful

START = datetime(2024, 5, 1, 12)


def at(seconds):
    return START + timedelta(seconds=seconds)


def fed(spark, folder, rows, schema, number):
    """Adds a file to a folder that a stream reads, a file a micro-batch, in the order in which they are added."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05 * (number > 0))


def stream(spark, folder, schema):
    return jobs.table(spark, str(folder), spark.createDataFrame([], schema).schema, 1)


TURNS = "id string, session string, ts timestamp, text string"


def test_changes_keep_what_comes_back_and_survive_a_restart(spark, tmp_path):
    source = tmp_path / "turns"
    run = lambda: jobs.drained(stateful.changes(stream(spark, source, TURNS), F.col("session"), F.col("text"), late="30 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    fed(spark, source, [("1", "s", at(0), "A"), ("2", "s", at(1), "B"), ("x", "t", at(1), "B"), ("0", None, at(2), None), ("lost", "s", None, "A")], TURNS, 0)
    fed(spark, source, [("4", "s", at(8), "A"), ("3", "s", at(5), "B"), ("9", "s", at(100), "C")], TURNS, 1)  # 3 comes late, and out of order
    found = {(r.session, r.id) for r in run().collect()}
    assert found == {("s", "1"), ("s", "2"), ("t", "x"), ("unknown", "0"), ("s", "4")}  # A, B, A; C is not settled yet
    fed(spark, source, [("10", "s", at(101), "C"), ("11", "s", at(102), "A"), ("12", "s", at(500), "A"), ("late", "s", at(3), "Z")], TURNS, 2)
    assert {(r.session, r.id) for r in run().collect()} == found | {("s", "9"), ("s", "11")}


def test_sessions_share_keys_and_keep_their_state_apart(spark, tmp_path):
    """Changes and pending prompts of many sessions are those of each session by itself, over a restart, from few keys."""
    source, moves, calls = tmp_path / "turns", tmp_path / "moves", tmp_path / "calls"
    calls.mkdir()

    def counted(kind):
        class Counted(kind):
            def begun(self, key):
                (calls / f"{kind.__name__}-{key[0]}").touch()
                super().begun(key)

        return Counted

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(stateful, "SHARES", 3)
        patch.setattr(stateful, "Changes", counted(stateful.Changes))
        patch.setattr(stateful, "Pending", counted(stateful.Pending))
        said, shown, want, urls, last = [], [], set(), {}, {}
        for k in range(400):
            name, text, second = f"s{k % 40}", "ABA"[k // 40 % 3] if k % 7 else "C", k * 3
            said.append((f"{k:03d}", name, at(second), text))
            want |= {(name, f"{k:03d}")} if last.get(name) != text else set()
            last[name] = text
            shown += [(name, f"{k:03d}", at(second), "prompt", name), (name, f"m{k:03d}", at(second + 9), "move", f"{name}/{k}")]
            urls[f"{k:03d}"] = (at(second + 15), f"{name}/{k}")
        for part in (slice(0, 250), slice(250, 400)):
            fed(spark, source, [*said[part][::-1], ("end", "end", at(749 if part.start == 0 else 2000), "A")], TURNS, part.start)
            fed(spark, moves, [*shown[2 * part.start : 2 * part.stop][::-1], ("end", f"end{part.start}", at(749 if part.start == 0 else 2000), "move", None)], MOVES, part.start)
            changed = jobs.drained(stateful.changes(stream(spark, source, TURNS), F.col("session"), F.col("text"), late="30 seconds"), str(tmp_path / "c"), str(tmp_path / "c-state"))
            given_up = jobs.drained(stateful.finalized(stream(spark, moves, MOVES), late="30 seconds"), str(tmp_path / "p"), str(tmp_path / "p-state"))
    assert {(r.session, r.id) for r in changed.collect() if r.session != "end"} == want and changed.where("session != 'end'").count() == len(want)
    assert {r.id: (r.final_ts, r.url) for r in given_up.collect()} == urls
    assert sorted(p.name for p in calls.iterdir()) == [f"{kind}-{k}" for kind in ("Changes", "Pending") for k in range(3)]


MOVES = "session string, id string, ts timestamp, kind string, url string"


def test_pending_prompts_by_event_time(spark, tmp_path):
    source = tmp_path / "rows"
    run = lambda: {r.id: (r.final_ts, r.url) for r in jobs.drained(stateful.finalized(stream(spark, source, MOVES), late="20 seconds"), str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    fed(spark, source, [("s", "p1", at(0), "prompt", "new"), ("s", "m", at(4), "move", "chat/1"), ("t", "p2", at(0), "prompt", "home"), ("s", "p3", at(60), "prompt", "chat/1")], MOVES, 0)
    first = run()
    assert first == {"p1": (at(15), "chat/1"), "p2": (at(15), "home")}
    fed(spark, source, [("s", "a", at(62), "response", None), ("s", "m2", at(62.4), "move", "chat/2"), ("s", "m3", at(62.6), "move", "chat/3"), ("u", "z", at(200), "response", None)], MOVES, 1)
    assert run() == first | {"p3": (at(62.5), "chat/2")}  # p3 waited in the state of the run before


def test_pending_prompts_by_the_clock(spark, tmp_path):
    source = tmp_path / "rows"
    fed(spark, source, [("s", "p1", at(0), "prompt", "new"), ("s", "m", at(1), "move", "chat/1")], MOVES, 0)
    rows = stateful.finalized(stream(spark, source, MOVES), patience=1, processing=True)
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        found, until = [], time.time() + 60
        while not found and time.time() < until:
            time.sleep(1)
            if query.exception():
                raise query.exception()
            found = spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
        assert [(r.id, r.url) for r in found] == [("p1", "chat/1")]
    finally:
        query.stop()


EVENTS = "id string, ts timestamp, action string, tool string, url string, max_severity string, classifications array<string>, total_findings long, items array<struct<label:string,classification:string,severity:string,count:bigint,evidence:string>>"


def event(k, seconds):
    return (f"e{k:03d}", at(seconds), "mask", "ChatGPT", "u", "HIGH", ["X"], 1, [("L", "X", "HIGH", 1, "•")])


def test_spool_goes_out_by_size_and_age_and_fails_to_the_head(spark, tmp_path):
    source, down = tmp_path / "events", tmp_path / "down"
    profiles = [forward.Profile("a", batch_size=3, flush_seconds=100, form="ndjson"), forward.Profile("off", enabled=False)]

    def deliver(profile, lines):
        return not down.exists()

    run = lambda: sorted((r.batch, r.first_id, r.last_id, r.reason, r.ok, r.queued, r.consecutive_failures) for r in jobs.drained(stateful.spooled(forward.events(stream(spark, source, EVENTS)), profiles, deliver, most=5, late="10 seconds"), str(tmp_path / "out"), str(tmp_path / "state")).collect())
    fed(spark, source, [event(k, k) for k in range(5)] + [event(99, 300)], EVENTS, 0)
    assert run() == [(0, "e000", "e002", "size", True, 0, 0), (1, "e003", "e004", "age", True, 0, 0)]
    down.touch()
    fed(spark, source, [event(k, 301 + k) for k in range(10, 17)] + [event(98, 350)], EVENTS, 1)
    failed = sorted((r[6], r[1], r[2], r[5]) for r in run() if not r[4])
    assert failed == [(1, "e099", "e011", 3), (2, "e099", "e011", 4), (3, "e099", "e011", 5), (4, "e010", "e012", 5), (5, "e011", "e013", 5), (6, "e012", "e014", 5)]  # the queue keeps the newest five
    down.unlink()
    fed(spark, source, [event(97, 900)], EVENTS, 2)
    assert [r for r in run() if r[0] >= 2 and r[4]] == [(2, "e013", "e015", "size", True, 2, 0), (3, "e016", "e098", "age", True, 0, 0)]


def test_rows_of_a_key_that_wait_lie_in_the_state_by_slices_of_time(spark, tmp_path):
    """With few rows held at a time the batches are the same, from files that are out of order, and over restarts."""
    source, most = tmp_path / "events", tmp_path / "most"
    profiles = [forward.Profile("a", batch_size=7, flush_seconds=900, form="ndjson")]
    seconds = [(k * 2_477) % 40_000 for k in range(400)]

    class Small(stateful.Spool):
        def init(self, handle):
            stateful.HELD, stateful.MADE = 16, 3
            super().init(handle)

        def _advanced(self, key, fresh, timers):
            yield from super()._advanced(key, ([r] for rows in fresh for r in rows), timers)

        def _stored(self, rows, slices):
            most.mkdir(exist_ok=True)
            (most / str(len(rows))).touch()
            super()._stored(rows, slices)

    def run(kind, name):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(stateful, "Spool", kind)
            rows = stateful.spooled(forward.events(stream(spark, source, EVENTS)), profiles, late="10 seconds")
        return sorted((r.batch, r.first_id, r.last_id, r.n, r.reason, r.at, tuple(r.lines)) for r in jobs.drained(rows, str(tmp_path / name / "out"), str(tmp_path / name / "state")).collect())

    fed(spark, source, [event(k, s) for k, s in enumerate(seconds)], EVENTS, 0)
    run(stateful.Spool, "plain"), run(Small, "small")
    fed(spark, source, [event(k, 40_000 + s) for k, s in enumerate(seconds, 400)] + [event(999, 90_000)], EVENTS, 1)
    want = run(stateful.Spool, "plain")
    assert sum(r[3] for r in want) == 800 and run(Small, "small") == want
    assert most.exists() and max(int(p.name) for p in most.iterdir()) <= 16


ATTEMPTS = "profile string, at long, n long, ok boolean, status int, error string, ms long"


def test_health_of_replayed_batches_is_that_of_all_attempts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACTED", 2)
    source = tmp_path / "attempts"
    rows = [("a", 1, 3, True, 200, None, 5), ("a", 2, 2, False, 503, "busy", 6), ("b", 1, 1, False, 0, "net", 1)], [("a", 3, 2, False, 503, "busy", 7), ("c", 4, 9, True, 200, None, 1)], [("b", 5, 4, False, 0, "net", 2), ("c", 6, 1, False, 400, "no", 2)]
    for number, some in enumerate(rows):
        fed(spark, source, some, ATTEMPTS, number)
        jobs.finished(jobs.health_kept(stream(spark, source, ATTEMPTS), str(tmp_path / "kept")))
    kept = lambda: sorted(map(tuple, jobs.health_now(spark, str(tmp_path / "kept")).select(*forward.health(spark.read.schema(ATTEMPTS).parquet(str(source))).columns).collect()))
    whole = sorted(map(tuple, forward.health(spark.read.schema(ATTEMPTS).parquet(str(source))).collect()))
    assert kept() == whole and [r[-1] for r in whole] == [2, 2, 1]
    (tmp_path / "kept" / "checkpoint" / "commits" / "2").unlink()  # the last micro-batch did not get to its end, and runs again
    for crc in (tmp_path / "kept" / "checkpoint" / "commits").glob(".2.crc"):
        crc.unlink()
    jobs.finished(jobs.health_kept(stream(spark, source, ATTEMPTS), str(tmp_path / "kept")))
    assert kept() == whole
    assert jobs.health_now(spark, str(tmp_path / "none")).count() == 0


def test_hits_of_late_and_replayed_batches(spark, tmp_path):
    source, kept = tmp_path / "log", str(tmp_path / "kept")
    schema = "ts timestamp, items array<struct<label:string,count:bigint>>"
    days = lambda n: START - timedelta(days=n)
    parts = [(days(0), [("A", 2), ("B", None)]), (days(6.9), [("A", 0)]), (None, [("A", 5)])], [(days(7.1), [("A", 7)]), (days(30), [("B", 1), (None, 4)]), (days(30.2), [("B", 9)]), (days(-2), [("C", 1)])], [(days(13), [("A", 1)]), (days(6.9), [])]
    for number, rows in enumerate(parts):
        fed(spark, source, rows, schema, number)
        jobs.finished(jobs.hits_rolled(stream(spark, source, schema), kept))
    for name in ("2", ".2.crc"):
        (tmp_path / "kept" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    jobs.finished(jobs.hits_rolled(stream(spark, source, schema), kept))
    log = spark.read.schema(schema).parquet(str(source))
    for window in (7, 14, 30):
        want, got = audit.hits(log, START, window), audit.rolled_hits(jobs.rolled(spark, kept), log, START, window)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_versioned_rows_are_replaced_by_key(spark, tmp_path):
    table = versioned.Table(spark, str(tmp_path / "stars"), ["id"])
    put = lambda rows, version=None: table.put(spark.createDataFrame(rows, "id long, starred boolean, note string"), version)
    rows = lambda before=None: sorted(((r.id, r.starred, r.note) for r in table.read(before).collect()), key=repr)
    assert table.read() is None
    assert put([(1, False, "a"), (2, False, None), (None, True, "n")]) == 0
    assert put([(2, True, None)]) == 1
    put([(2, True, "again")], 1)  # the same version again
    assert rows() == [(1, False, "a"), (2, True, "again"), (None, True, "n")] and rows(before=1)[1] == (2, False, None)
    table.compact(before=1)
    assert table.versions("base") == [0] and rows()[1] == (2, True, "again")
    table.compact()
    put([(1, True, "b")])
    assert table.versions() == [0, 1, 2] and table.versions("base") == [0, 1]
    assert rows() == [(1, True, "b"), (2, True, "again"), (None, True, "n")]
