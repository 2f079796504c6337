"""Inspection of files end to end: type, text, findings, risk, action, and the audit entries of it.

Files are rows (path, content, and perhaps tool, url, batch). Types and skip
reasons are narrow expressions; segments are opened by tasks, a file at a time
within a budget; findings of all segments of a file are rolled up by one
aggregation that combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import folds
from lakewarden.functions.catalogue import DETECTORS
from lakewarden.functions.detector import SEVERITY_RANK, Detector
from lakewarden.operators import files, policy, sanitize, scan

RANK = {a: k for k, a in enumerate(policy.ACTIONS)}


def enumerated(attached: DataFrame) -> DataFrame:
    """Each attached file once: rows that repeat a path and its bytes are one."""
    return attached.withColumn("__sha", F.sha2("content", 256)).dropDuplicates(["path", "__sha"]).drop("__sha")


def skipped(settings: policy.Inspection) -> Column:
    """Why a typed file (path, content, true_type, family) is not opened, or null."""
    out = F.when(F.lit(not settings.enabled or settings.depth == "off"), "inspection disabled").when(F.col("content").isNull(), "unreadable")
    out = out.when(F.octet_length("content") > int(settings.most_kb * 1024), f"exceeds {settings.most_kb:g} KB inspection limit")
    out = out.when(F.col("family").isin("image", "media", "binary", "opaque"), F.concat(F.lit("no extractable text ("), "true_type", F.lit(")")))
    if settings.depth == "shallow":
        out = out.when(F.col("family") != "text", "container skipped (shallow inspection)")
    if not settings.archives and not settings.documents:
        out = out.when(F.col("family") == "zip", "container inspection disabled")
    return out


def inspected(attached: DataFrame, settings: policy.Inspection | None = None, enabled: Sequence[str] | None = None, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """A report of each file: type, disguise, fingerprint, segments, findings rolled up by label, score, band and action.

    A file without content is unreadable; paths are the key of files and have
    to differ. ``items`` is ordered by where a label is found first. Other
    columns of the files are kept (of types that JSON has).
    """
    settings = settings or policy.Inspection()
    typed = files.typed(attached).withColumn("skip_reason", skipped(settings))
    typed = typed.withColumn("masquerade", F.col("masquerade") & F.lit(settings.masquerade)).withColumn("size_bytes", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))
    sha = (F.substring(F.sha2("content", 256), 1, 16) if settings.fingerprint else F.lit(None).cast("string")).alias("sha")
    told = typed.select("path", "true_type", "declared_ext", "masquerade", "size_bytes", "skip_reason", sha, *(c for c in attached.columns if c not in ("path", "content")), F.when(F.col("skip_reason").isNull(), F.col("content")).alias("__content"))
    known = told.drop("path", "__content").schema
    # what is known of a file goes with its segments as a text, so its bytes are read once, and those of skipped files go no further
    ready = told.select("path", "__content", F.to_json(F.struct(*known.names), {"ignoreNullFields": "false"}).alias("__facts"))
    opened = files.segments(ready, "__content", budget=settings.budget, facts="__facts").withColumnRenamed("truncated", "cut")
    scanned = scan.scan(opened, enabled=enabled, only=detectors)
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY_RANK.items() for x in pair)), F.col("f.severity"))
    long = scanned.select("path", "__facts", "segment", "place", F.col("cut"), F.length("text").alias("chars"), F.posexplode_outer("findings").alias("k", "f"))
    first = F.coalesce("k", F.lit(0)) == 0
    found = F.col("f").isNotNull()
    order = F.struct("place", "f.start", "f.ordinal")
    by_label = long.groupBy("path", F.col("f.label").alias("label")).agg(
        F.first("__facts").alias("__facts"), F.count_if(found).alias("n"), F.sum(F.when(first, F.coalesce("chars", F.lit(0))).otherwise(0)).alias("chars"), F.count_if(first & F.col("segment").isNotNull() & (F.coalesce("chars", F.lit(0)) > 0)).alias("segments"), F.bool_or("cut").alias("truncated"),
        F.coalesce(F.max(rank), F.lit(0)).alias("worst"), F.count_if(F.col("f.classification") == "AUTHENTICATION_SECRET").alias("secrets"), F.count_if((F.col("f.classification") == "AUTHENTICATION_SECRET") & ~F.col("f.low")).alias("firm"),
        F.min(F.when(found, order)).alias("at"), F.min_by(F.struct("f.classification", "f.severity", "f.evidence", "segment"), order).alias("r"),
    )
    item = F.struct("at", "label", "r.classification", "r.severity", F.col("n").alias("count"), "r.evidence", "r.segment")
    rolled = by_label.groupBy("path").agg(
        F.first("__facts").alias("__facts"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("segments").alias("segments"), F.bool_or("truncated").alias("truncated"), F.max("worst").alias("worst"), F.sum("secrets").alias("secrets"), F.sum("firm").alias("firm"),
        F.count_if(F.col("label").isin(*sanitize.IDENTITY)).alias("identities"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, item))).alias("items"),
    )  # at most a row for each label of the catalogue
    rows = rolled.withColumn("__facts", F.from_json("__facts", known))
    rows = rows.select("path", *(F.col(f"__facts.`{c}`").alias(c) for c in known.names), *(c for c in rolled.columns if c not in ("path", "__facts")))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "segments", "worst", "secrets", "firm", "identities")}
    rows = rows.withColumns(zero | {"truncated": F.coalesce("truncated", F.lit(False)), "n_bytes": F.when(F.coalesce("chars", F.lit(0)) > 0, F.col("chars")).otherwise(F.col("size_bytes")), "items": F.coalesce("items", F.array().cast(rolled.schema["items"].dataType))})
    rows = sanitize.scored(rows).withColumn("factors", factors(rows))
    actions = F.create_map(*(F.lit(x) for pair in settings.actions.items() for x in pair))
    acted = (F.col("n") > 0) | (F.col("masquerade") & F.coalesce(F.col("skip_reason").isNull() | F.startswith("skip_reason", F.lit("no extractable")), F.lit(False)))
    action = F.when(acted, F.coalesce(F.element_at(actions, F.col("band")), F.lit("notify"))).otherwise("allow")
    worst = F.element_at(F.create_map(*(F.lit(x) for k, v in SEVERITY_RANK.items() for x in (v, k))), F.col("worst").cast("int"))
    return rows.withColumns({"action": action, "max_severity": worst, "items": F.transform("items", lambda i: i.dropFields("at"))}).drop("chars", "worst", "file_action")


def factors(rows: DataFrame) -> Column:
    """(k, v): what the score of a report is made of."""
    n, distinct, secrets = F.col("n"), F.col("identities"), F.col("secrets")
    worst = F.element_at(F.create_map(*(F.lit(x) for k, v in SEVERITY_RANK.items() for x in (v, k))), F.greatest(F.col("worst").cast("int"), F.lit(1)))
    points = F.element_at(F.create_map(*(F.lit(x) for pair in sanitize.POINTS.items() for x in pair)), worst)
    factor = lambda when, k, v: F.when(when, F.struct(k.alias("k"), v.cast("string").alias("v")))
    made = [
        factor(n > 0, F.concat(F.lit("Severity ("), worst, F.lit(")")), points),
        factor(secrets > 0, F.concat(F.lit("Credential material x"), secrets), F.least(F.lit(30), 20 + secrets * 2)),
        factor(distinct >= 3, F.concat(F.lit("Compound identity ("), distinct, F.lit(" attributes)")), F.least(F.lit(30), 15 + (distinct - 3) * 5)),
        factor(distinct == 2, F.lit("Correlated attributes (2)"), F.lit(6)),
        factor(n >= 25, F.concat(F.lit("Bulk exposure ("), n, F.lit(" items)")), F.least(F.lit(25), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) * 4 + 0.5))),
        factor((n > 0) & F.col("masquerade"), F.lit("Type masquerade"), F.lit(15)),
        factor((n >= 100) & (distinct >= 2), F.lit("Bulk personal data (reportable scale)"), F.lit("floor")),
    ]
    total = lambda f: F.least(F.lit(100), F.aggregate(F.filter(f, lambda x: x["v"] != "floor"), F.lit(0), lambda acc, x: acc + x["v"].cast("int")))
    floor = lambda f: F.when(F.col("score") > total(f), F.concat(f, F.array(F.struct(F.lit("Policy floor applied").alias("k"), (F.col("score") - total(f)).cast("string").alias("v"))))).otherwise(f)
    return folds.let(F.array_compact(F.array(*made)), floor)


def logged(reports: DataFrame, as_of, tool: str = "Unknown AI", url: str = "") -> DataFrame:
    """Audit entries of reports: redacted evidence, the score and what it is made of, and the fingerprint; never the content."""
    return reports.select(
        F.sha2(F.concat_ws("|", "path", F.coalesce("sha", F.lit(""))), 256).alias("id"), F.lit(as_of).alias("ts"), F.lit("file").alias("source"), F.concat(F.lit("file-"), "action").alias("action"), F.col("action").alias("response_action"),
        F.col("path").alias("file_name"), "true_type", "declared_ext", "masquerade", "size_bytes", "segments", "truncated", "sha", F.col("score").alias("risk_score"), F.col("band").alias("risk_band"), F.col("factors").alias("risk_factors"),
        F.lit(tool).alias("tool"), F.lit(url).alias("url"), "max_severity", F.array_distinct(F.transform("items", lambda i: i["classification"])).alias("classifications"), F.col("n").alias("total_findings"), "items",
    )


def quarantined(log: DataFrame, file_name: str) -> DataFrame:
    """The entry that a user's removal of a file adds: that of the file again, as a quarantine. Counts of files go by fingerprint."""
    return log.where(F.col("file_name") == file_name).withColumns({"id": F.concat("id", F.lit("-removed")), "action": F.lit("file-quarantine"), "response_action": F.lit("quarantine")})


def files_seen(log: DataFrame) -> DataFrame:
    """How many entries of files there are, and of how many different files."""
    return log.where(F.col("source") == "file").agg(F.count("*").alias("n_entries"), F.count_distinct(F.struct("file_name", "sha")).alias("n_files"))


def enforced(reports: DataFrame, batch: str = "batch") -> DataFrame:
    """Of each batch of files (a column of the reports): the strongest action, and the file of the highest score (of several, the first by path)."""
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), F.col("action"))
    return reports.groupBy(batch).agg(F.max_by("action", rank).alias("action"), F.min_by(F.struct("path", "score", "band"), F.struct(-F.col("score"), "path")).alias("worst"), F.count("*").alias("n_files")).select(batch, "action", "n_files", F.col("worst.path").alias("worst_path"), F.col("worst.score").alias("worst_score"), F.col("worst.band").alias("worst_band"))
