"""Queries over streams with state, each drained over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import display
from lakewarden.operators import audit, forward
from lakewarden.plans import sql
from lakewarden.plans.queries import _EVENTS
from lakewarden.plans.registry import query
from lakewarden.sources import activity, shared
from lakewarden.streaming import jobs, stateful

_C, _L = f"WITH {sql.CAPTURES}", f"WITH {sql.LOG}"


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Tables as streams, under the names that batch readers give them."""
    return {n: jobs.table(spark, f"{sf_dir}/{n}.parque[t]", spark.read.parquet(f"{sf_dir}/{n}.parquet").schema) for n in names}


def _drained(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    return jobs.drained(rows, shared.new_path(spark, name), shared.new_path(spark, f"{name}-state"))


_LATE = "INTERVAL 1 MINUTE"


@query("stream_changes", f"""WITH e AS (SELECT user_id::VARCHAR AS session, ts::TIMESTAMP AS ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS before FROM events)
SELECT session, event_id::VARCHAR AS id, event_type AS fingerprint FROM e WHERE event_type IS DISTINCT FROM before AND ts <= date_trunc('millisecond', (SELECT max(ts) FROM e)) - {_LATE}""")
def stream_changes(spark, sf_dir):
    """What users do that differs from what they did last; what they did before that counts again."""
    events = _tables(spark, sf_dir, "events")["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    found = stateful.changes(events, F.col("user_id"), F.col("event_type"), id="event_id")
    return _drained(found, "changes").select("session", "id", "fingerprint")


@query("stream_responses", f"""{_C}, r AS (SELECT *, coalesce(session_url, 'unknown') AS session FROM caps WHERE type = 'response' AND length(content) > 20)
SELECT session, id, left(content, 40) AS head FROM (SELECT *, lag(content) OVER (PARTITION BY session ORDER BY ts, id) AS before FROM r) WHERE content IS DISTINCT FROM before AND ts <= (SELECT max(ts) FROM r) - {_LATE}""")
def stream_responses(spark, sf_dir):
    """New responses of each session: longer than 20 characters, and not the one that was captured last."""
    turns = activity.captured(_tables(spark, sf_dir, "conversations")["conversations"])
    said = turns.where((F.col("type") == "response") & (F.length("content") > 20))
    found = stateful.changes(said, F.col("session_url"), display.fingerprint(F.col("content")), F.substring("content", 1, 40))
    return _drained(found, "responses").select("session", "id", F.col("body").alias("head"))


@query("stream_prompts", f"""{_C}, c AS (SELECT *, coalesce(session_url, 'none') AS session, lead(ts) OVER (PARTITION BY coalesce(session_url, 'none') ORDER BY ts, id) AS next FROM caps),
p AS (SELECT *, least(ts + INTERVAL 15 SECOND, coalesce(next + INTERVAL 500 MILLISECOND, ts + INTERVAL 15 SECOND)) AS final_ts FROM c WHERE type = 'prompt'),
m AS (SELECT session, ts + INTERVAL 9 SECOND AS moved, id || '/moved' AS there FROM c WHERE starred)
SELECT p.id, epoch_ms(final_ts) AS final_ms, coalesce(max_by(there, moved), any_value(session_url), 'none') AS url FROM p LEFT JOIN m ON m.session = p.session AND moved > p.ts AND moved <= final_ts
WHERE final_ts <= (SELECT max(t) FROM (SELECT ts AS t FROM c UNION ALL SELECT moved FROM m)) - {_LATE} GROUP BY p.id, final_ts""")
def stream_prompts(spark, sf_dir):
    """Prompts as they are given up as pending, with the address that their session has then: ``prompts_finalized`` as a stream."""
    turns = activity.captured(_tables(spark, sf_dir, "conversations")["conversations"]).withColumn("session", F.coalesce("session_url", F.lit("none")))
    said = F.struct(F.col("ts").alias("ts"), F.col("type").alias("kind"), F.col("session").alias("url"))
    moved = F.when(F.col("starred"), F.struct((F.col("ts") + F.expr("INTERVAL 9 SECOND")).alias("ts"), F.lit("move").alias("kind"), F.concat("id", F.lit("/moved")).alias("url")))
    rows = turns.select("session", "id", F.explode(F.array_compact(F.array(said, moved))).alias("r")).select("session", "id", "r.*")
    return _drained(stateful.finalized(rows), "prompts").select("id", F.unix_millis("final_ts").alias("final_ms"), "url")


#: Receivers whose batches go out by size and by age.
WAITING = (
    forward.Profile("all", batch_size=12, flush_seconds=3600),
    forward.Profile("grave", min_severity="HIGH", content="redacted", form="cef", batch_size=5, flush_seconds=1800),
    forward.Profile("files", events=("dlp.file",), min_severity="CRITICAL", content="full", form="ndjson", batch_size=3, flush_seconds=900),
)
_WAITING = " UNION ALL ".join(f"SELECT '{p.id}' AS profile, {p.batch_size} AS size, {p.flush_seconds} AS wait, id, ts FROM e WHERE {where}" for p, where in zip(WAITING, ("true", "rank >= 3", "rank >= 4 AND type = 'dlp.file'"), strict=True))


@query("stream_flushes", f"""{_EVENTS.replace("WITH ", "WITH RECURSIVE ", 1)}, wm AS (SELECT date_trunc('millisecond', max(ts)) - {_LATE} AS w FROM log),
f AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ts, id::VARCHAR) AS k FROM ({_WAITING}) WHERE ts <= (SELECT w FROM wm)),
n AS (SELECT a.*, a.ts + to_seconds(a.wait) AS due, (SELECT count(*) FROM f b WHERE b.profile = a.profile AND b.ts < a.ts + to_seconds(a.wait)) AS aged FROM f a),
b AS (SELECT profile, 0 AS batch, k, least(k + size - 1, aged) AS last, due, aged < k + size - 1 AS old FROM n WHERE k = 1
    UNION ALL SELECT n.profile, batch + 1, n.k, least(n.k + size - 1, n.aged), n.due, n.aged < n.k + size - 1 FROM b JOIN n ON n.profile = b.profile AND n.k = b.last + 1)
SELECT b.profile, batch::BIGINT AS batch, CASE WHEN old THEN 'age' ELSE 'size' END AS reason, last - b.k + 1 AS n, x.id::VARCHAR AS first_id, y.id::VARCHAR AS last_id, epoch_us(CASE WHEN old THEN due ELSE y.ts END) AS at_micros
FROM b JOIN f x ON x.profile = b.profile AND x.k = b.k JOIN f y ON y.profile = b.profile AND y.k = b.last, wm WHERE CASE WHEN old THEN due <= w ELSE true END""")
def stream_flushes(spark, sf_dir):
    """The batches that go out to each receiver by the time of the events: as soon as one is full, or its oldest event has waited long enough."""
    log = activity.audited(_tables(spark, sf_dir, "events")["events"])
    found = _drained(stateful.spooled(forward.events(log), WAITING), "flushes")
    return found.select("profile", "batch", "reason", "n", "first_id", "last_id", F.unix_micros("at").alias("at_micros"))


@query("stream_health", """WITH a AS (SELECT user_id % 7 AS profile, event_type <> 'error' AS ok, 1 + event_id % 5 AS n, event_id AS k FROM events),
g AS (SELECT profile, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS sent, count(*) FILTER (NOT ok) AS failed, max(k) FILTER (ok) AS last_success, max(k) AS last_attempt FROM a GROUP BY profile)
SELECT 'p' || profile AS profile, sent, failed, last_success, last_attempt, (SELECT count(*) FROM a WHERE a.profile = g.profile AND NOT ok AND (last_success IS NULL OR k > last_success)) AS consecutive_failures FROM g""")
def stream_health(spark, sf_dir):
    """The health of receivers, kept by micro-batches in a versioned table; events stand for attempts, errors for those that failed."""
    events = _tables(spark, sf_dir, "events")["events"]
    ok = F.col("event_type") != "error"
    attempts = events.select(
        F.concat(F.lit("p"), F.col("user_id") % 7).alias("profile"), F.col("event_id").alias("at"), (1 + F.col("event_id") % 5).alias("n"), ok.alias("ok"), F.when(ok, 200).otherwise(503).alias("status"), F.when(~ok, "busy").alias("error"), F.lit(0).cast("long").alias("ms"),
    )
    folder = shared.new_path(spark, "health")
    jobs.finished(jobs.health_kept(attempts, folder))
    return jobs.health_now(spark, folder).select("profile", "sent", "failed", "last_success", "last_attempt", "consecutive_failures")


_WINDOWS = (7, 14, 30)


@query("stream_hits", f"""{_L}, i AS (SELECT label1 AS label, count1 AS n, ts FROM log UNION ALL SELECT label2, count2, ts FROM log), d AS (SELECT unnest([{", ".join(map(str, _WINDOWS))}]) AS days)
SELECT days, label, sum(n)::BIGINT AS hits, epoch_us(min(ts)) AS since FROM i, d WHERE ts IS NULL OR ts >= {sql.NOW.format("log")} - to_days(days) GROUP BY ALL""")
def stream_hits(spark, sf_dir):
    """Hits of the last 7, 14 and 30 days, from days that a stream has rolled up; of the log only parts of three days are read."""
    folder = shared.new_path(spark, "hits")
    jobs.finished(jobs.hits_rolled(activity.audited(_tables(spark, sf_dir, "events")["events"]), folder))
    log = activity.audit_log(spark, sf_dir)
    now, rolled, found = activity.latest(log), jobs.rolled(spark, folder), None
    for days in _WINDOWS:
        own = audit.rolled_hits(rolled, log, now, days).select(F.lit(days).alias("days"), "label", "hits", F.unix_micros("since").alias("since"))
        found = own if found is None else found.unionByName(own)
    return found
