"""Captured chat turns and audit entries, read from the tables of conversations and events.

Both are narrow projections of one table each, so filters and columns reach
the scan. ``as_of`` stands for the present wherever a span of time counts back
from it: by default the latest time of the table, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions.catalogue import DETECTORS

#: The tools that turns come from, and the class of what is none of them.
TOOLS = ("ChatGPT", "Gemini", "Claude", "Perplexity", "Copilot", "Unknown AI")
START = 1_704_067_200
ACTIONS = {"error": "block", "signup": "mask", "purchase": "file-quarantine", "click": "warn", "view": "file-notify"}


def pick(values: tuple[str, ...], at: Column) -> Column:
    """The value of a fixed list at a place from 0."""
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def captured(conversations: DataFrame) -> DataFrame:
    """(id, type, content, tool, ts, session_url, starred): users' and assistants' turns, of a table or a stream."""
    return conversations.where(F.col("role").isin("user", "assistant")).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.when(F.col("role") == "user", "prompt").otherwise("response").alias("type"),
        F.col("text").alias("content"),
        pick(TOOLS, F.col("conv_id") % len(TOOLS)).alias("tool"),
        F.timestamp_seconds(START + F.col("conv_id") * 2220 + F.col("turn") * 20).alias("ts"),
        F.when(F.col("conv_id") % 11 != 0, F.concat(F.lit("https://chat.example/"), F.col("conv_id"))).alias("session_url"),
        ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("starred"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/events.parquet"))


def audited(events: DataFrame) -> DataFrame:
    """(id, ts, action, tool, url, max_severity, classifications, total_findings, items) of events, of a table or a stream; an entry has two items, with masked evidence."""
    events = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    labels, classes, grades = (tuple(getattr(d, name) for d in DETECTORS[:100]) for name in ("label", "data_class", "severity"))
    other = (F.col("k") * 7 + 3) % 100
    item = lambda at, n: F.struct(pick(labels, at).alias("label"), pick(classes, at).alias("classification"), pick(grades, at).alias("severity"), n.cast("long").alias("count"), F.lit("••••").alias("evidence"))
    action = F.lit(None)
    for kind, name in ACTIONS.items():
        action = F.when(F.col("event_type") == kind, name).otherwise(action)
    severity = F.when(F.col("value") < 5, "LOW").when(F.col("value") < 15, "MEDIUM").when(F.col("value") < 40, "HIGH").otherwise("CRITICAL")
    rows = events.select("event_id", "ts", "user_id", action.alias("action"), severity.alias("max_severity"), F.array(item(F.col("k"), F.col("k") % 4 + 1), item(other, F.lit(1))).alias("items"))
    return rows.select(
        F.col("event_id").alias("id"), "ts", "action", pick(TOOLS, F.col("user_id") % len(TOOLS)).alias("tool"),
        F.concat(F.lit("https://tool.example/u/"), F.col("user_id")).alias("url"), "max_severity",
        F.array_distinct(F.transform("items", lambda i: i["classification"])).alias("classifications"),
        F.aggregate("items", F.lit(0).cast("long"), lambda acc, i: acc + i["count"]).alias("total_findings"), "items",
    )


def latest(rows: DataFrame, ts: str = "ts"):
    """The latest time of a table: what the present is by default."""
    return rows.agg(F.max(ts)).first()[0]
