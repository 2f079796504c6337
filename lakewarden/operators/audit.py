"""The audit log: statistics, facets, filters, retention, and how often each detector was hit."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ENTRIES, PAGE, HIT_DAYS = 1_000, 50, 30
RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), severity), F.lit(1))


def is_file(action: Column) -> Column:
    return F.startswith(action, F.lit("file"))


def stats(log: DataFrame) -> DataFrame:
    kinds = {f"n_{a}": F.count_if(F.col("action") == a) for a in ("mask", "block", "warn")}
    return log.agg(F.count("*").alias("n_entries"), *(c.alias(k) for k, c in kinds.items()), F.count_if(is_file(F.col("action"))).alias("n_file"), F.coalesce(F.sum("total_findings"), F.lit(0)).alias("n_findings"))


def band(log: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """What happened in the last day and week, and how many detectors are on."""
    day, week = F.col("ts") > F.lit(as_of - timedelta(days=1)), F.col("ts") > F.lit(as_of - timedelta(days=7))
    seen = log.where(week).agg(
        F.count_if(day & (F.col("action") == "mask")).alias("masked"), F.count_if(day & (F.col("action") == "block")).alias("blocked"),
        F.count_if(is_file(F.col("action"))).alias("files"), F.coalesce(F.sum("total_findings"), F.lit(0)).alias("findings"),
    )
    coverage = rules.agg(F.floor(F.count_if("default_on") * 100 / F.count("*") + 0.5).alias("coverage"))
    both = seen.join(F.broadcast(coverage))  # one row each
    return both.withColumn("state", F.when(F.col("coverage") >= 70, "good").when(F.col("coverage") >= 40, "warn").otherwise("bad"))


def facets(log: DataFrame) -> DataFrame:
    """Entries by tool, and by severity, in one pass."""
    sets = log.groupingSets([["tool"], ["max_severity"]], "tool", "max_severity").agg(F.grouping("tool").alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 0, "tool").otherwise("severity").alias("facet"), F.when(F.col("g") == 0, F.col("tool")).otherwise(F.col("max_severity")).alias("name"), "n")


def ordered(facets: DataFrame) -> DataFrame:
    """Facets with their place: those of most entries first, then by name."""
    return facets.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "name")))  # a row for each tool and severity


def matching(log: DataFrame, action: str = "all", tool: str = "all", severity: str = "all", q: str = "") -> DataFrame:
    """Entries by action (``file`` stands for all that begin so), tool, severity, and a piece of text in any of their names."""
    if action != "all":
        log = log.where(is_file(F.col("action")) if action == "file" else F.col("action") == action)
    if tool != "all":
        log = log.where(F.col("tool") == tool)
    if severity != "all":
        log = log.where(F.col("max_severity") == severity)
    if q:
        name = ["file_name"] if "file_name" in log.columns else []
        hay = F.concat_ws(" ", "tool", "url", *name, F.array_join("classifications", " "), F.array_join(F.transform("items", lambda i: i["label"]), " "))
        log = log.where(F.contains(F.lower(hay), F.lit(q.lower())))
    return log


def page(log: DataFrame, number: int = 0, size: int = PAGE) -> DataFrame:
    """A page of entries, newest first."""
    return log.orderBy(F.desc("ts"), "id").offset(number * size).limit(size)


def retained(log: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The entries that are kept: high and critical ones before others, newest first."""
    high = F.upper(F.coalesce("max_severity", F.lit(""))).isin("HIGH", "CRITICAL")
    return log.withColumn("__high", high).orderBy(F.desc("__high"), F.desc("ts"), "id").limit(most).drop("__high")


def hits(log: DataFrame, as_of, days: int = HIT_DAYS) -> DataFrame:
    """(label, hits, since) over the last days; entries without a time count too."""
    recent = log.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(as_of - timedelta(days=days))))
    items = recent.select("ts", F.explode("items").alias("i")).where("i.label is not null")
    return items.groupBy(F.col("i.label").alias("label")).agg(F.sum(F.coalesce(F.when(F.col("i.count") > 0, F.col("i.count")), F.lit(1))).alias("hits"), F.min("ts").alias("since"))


def daily(log: DataFrame) -> DataFrame:
    """(day, label, hits, since): hits rolled up by day; entries without a time have a day of their own, null."""
    items = log.select("ts", F.explode("items").alias("i")).where("i.label is not null")
    return items.groupBy(F.to_date("ts").alias("day"), F.col("i.label").alias("label")).agg(F.sum(F.coalesce(F.when(F.col("i.count") > 0, F.col("i.count")), F.lit(1))).alias("hits"), F.min("ts").alias("since"))


def rolled_hits(rolled: DataFrame, log: DataFrame, as_of, days: int = HIT_DAYS) -> DataFrame:
    """What :func:`hits` gives, from roll-ups (:func:`daily`, of which a day may have several) of whole days; of the log only the part of the first day that counts is read."""
    cut = as_of - timedelta(days=days)
    morning = (cut + timedelta(days=1)).replace(hour=0, minute=0, second=0, microsecond=0)
    whole = rolled.where(F.col("day").isNull() | (F.col("day") > F.lit(cut.date()))).select("label", "hits", "since")
    edge = daily(log.where((F.col("ts") >= F.lit(cut)) & (F.col("ts") < F.lit(morning)))).select("label", "hits", "since")
    return whole.unionByName(edge).groupBy("label").agg(F.sum("hits").alias("hits"), F.min("since").alias("since"))


def by_class(hit: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits by class of data; a label that several detectors share counts for each."""
    return rules.join(hit, "label", "left").groupBy("classification").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count("*").alias("n_rules"))


def dead(hit: DataFrame, rules: DataFrame) -> DataFrame:
    """Detectors that are on and were never hit."""
    return rules.where("default_on").join(hit, "label", "left_anti").select("rule_id", "label", "classification")
