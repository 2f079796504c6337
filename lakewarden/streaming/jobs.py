"""The same work on streams: watermarked counts, scanning as rows arrive, and delivery of batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakewarden.operators import audit, forward, sanitize
from lakewarden.operators import policy as policies
from lakewarden.sources import shared, versioned


#: Micro-batches after which the table of receivers' states is compacted.
COMPACTED = 32
#: What is kept of each receiver.
HEALTH = "profile string, sent long, failed long, last_success long, last_attempt long, last_status int, last_ms long, last_error string, consecutive_failures long"


def table(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the parquet files that match a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window of time and key; rows later than ``late`` are dropped, so state stays bounded."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.floor(F.col(value) * 100 + 0.5).cast("long")).alias("cents"))
    return rows.select(F.unix_seconds("w.start").alias("window_start"), key, "n", "cents")


def distinct(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Drops rows that were seen within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def settled(turns: DataFrame, gap: str = "4 seconds", late: str = "1 minute", key: str = "session_url", ts: str = "ts") -> DataFrame:
    """(session, first, last, n, content): what a session said once it was quiet for ``gap``: the content of its last change. A session window closes when the watermark has passed its end."""
    rows = turns.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.coalesce(key, F.lit("unknown")).alias("session"))
    made = rows.agg(F.count("*").alias("n"), F.max_by("content", F.struct(ts, "id")).alias("content"))
    return made.select("session", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n", "content")


def finalized(turns: DataFrame, moves: DataFrame, patience: float = 15, settle: float = 0.5) -> DataFrame:
    """Prompts with the address that their session has when they are given up as pending.

    A prompt (id, session, ts, url of ``turns`` of type prompt) waits for the next turn of its session, and a
    moment more, but no longer than ``patience`` seconds; ``moves`` (session,
    ts, url) are changes of address, of which the last before that counts.
    """
    micros = lambda seconds: F.expr(f"INTERVAL '{seconds}' SECOND")
    after = F.lead("ts").over(Window.partitionBy("session").orderBy("ts", "id"))
    prompts = turns.withColumn("__next", after).where(F.col("type") == "prompt")
    ends = prompts.withColumn("final_ts", F.least(F.col("ts") + micros(patience), F.coalesce(F.col("__next") + micros(settle), F.col("ts") + micros(patience)))).drop("__next")
    seen = ends.select("id", "session", F.col("ts").alias("since"), "final_ts").join(moves.select("session", F.col("ts").alias("moved"), F.col("url").alias("there")), "session").where("moved > since and moved <= final_ts")
    last = seen.groupBy("id").agg(F.max_by("there", "moved").alias("there"))
    return ends.join(last, "id", "left").withColumn("url", F.coalesce("there", "url")).drop("there")


def sanitized(docs: DataFrame, policy: sanitize.Policy | None = None) -> DataFrame:
    """A stream of texts with what the policy does with each: narrow, so without state."""
    return sanitize.sanitize(docs, policy=policy)


def guarded(docs: DataFrame, policy_path: str, path: str, checkpoint: str, text: str = "text", key: str | None = None) -> StreamingQuery:
    """Sanitizes a stream with the policy at a path, read anew for each micro-batch, so that a change counts from the next one on.

    A policy whose signature does not hold counts as the default one. A
    micro-batch that runs again overwrites what it wrote.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = sanitize.sanitize(batch, text, policies.loaded(policy_path, batch.sparkSession, key))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(events: DataFrame, profiles: Callable[[], Sequence[forward.Profile]], deliver: Callable[[dict], forward.Reply], folder: str, wait: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Sends every micro-batch to its receivers from the tasks, in batches of each profile's size, with retries.

    ``profiles`` is asked anew for each micro-batch, so removed ones get
    nothing more and what waits for them goes. What could not be delivered goes
    out with the next micro-batch. The folder holds ``attempts`` (for
    :func:`forward.health`) and ``waiting``, by micro-batch: one that runs
    again overwrites them, so receivers get each event at least once.
    """

    def send(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, list(profiles())
        rows = forward.fan_out(batch, now)
        waiting = f"{folder}/waiting/batch={number - 1}"
        if number and shared.exists(spark, waiting):
            rows = rows.unionByName(forward.pruned(spark.read.schema(rows.schema).parquet(waiting), forward.receivers(spark, now)))
        path = f"{folder}/work/batch={number}"
        forward.chunked(rows).write.mode("overwrite").parquet(path)
        ready = spark.read.parquet(path)
        done = forward.sent(forward.addressed(forward.serialized(ready, now), now), now, deliver, wait).withColumn("at", F.lit(number).cast("long"))
        done.write.mode("overwrite").parquet(f"{folder}/attempts/batch={number}")
        lost = spark.read.parquet(f"{folder}/attempts/batch={number}").where("not ok").select("profile", "batch")
        ready.join(lost, ["profile", "batch"], "left_semi").drop("batch").write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")

    return events.writeStream.foreachBatch(send).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def health_kept(attempts: DataFrame, folder: str) -> StreamingQuery:
    """Keeps the state of each receiver (:func:`forward.health`) in a versioned table at a folder, from a stream of attempts.

    A micro-batch reads the rows of its own receivers alone, and writes those
    that it changes as its version: one that runs again starts from the version
    before it and replaces its own. Attempts of a later micro-batch count as
    later ones.
    """

    def put(batch: DataFrame, number: int) -> None:
        table = versioned.Table(batch.sparkSession, f"{folder}/table", ["profile"])
        if number and number % COMPACTED == 0:
            table.compact(before=number)
        fresh, known = forward.health(batch), table.read(before=number)
        table.put(fresh if known is None else forward.merged(known, fresh), number)

    return attempts.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def health_now(spark: SparkSession, folder: str) -> DataFrame:
    """The states that :func:`health_kept` has kept so far."""
    found = versioned.Table(spark, f"{folder}/table", ["profile"]).read()
    return spark.createDataFrame([], HEALTH) if found is None else found


def hits_rolled(log: DataFrame, folder: str) -> StreamingQuery:
    """Keeps hits by day and label (:func:`audit.daily`) of a stream of audit entries, by micro-batch and day; one that runs again overwrites what it wrote, and late entries add to their own day."""

    def put(batch: DataFrame, number: int) -> None:
        audit.daily(batch).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/hits/batch={number}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def rolled(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`hits_rolled` has kept: (day, label, hits, since), a row for each micro-batch, with days as partitions."""
    schema = "label string, hits long, since timestamp, batch long, day date"
    return spark.read.schema(schema).option("basePath", f"{folder}/hits").parquet(f"{folder}/hits")


def finished(query: StreamingQuery) -> StreamingQuery:
    """Waits for a query that reads what there is now; an error of it is raised."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into a table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finished(query)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
