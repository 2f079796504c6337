"""Forwarding of events: subscription, projection, wire formats, batches and authentication."""

from __future__ import annotations

import base64
import math
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.functions import folds, sqlnames
from lakewarden.operators import audit

#: Severities on the scales of receivers.
LEVEL = {"LOW": 2, "MEDIUM": 5, "HIGH": 7, "CRITICAL": 10}
SHIPPED = {"LOW": 3, "MEDIUM": 4, "HIGH": 5, "CRITICAL": 6}
VENDOR, PRODUCT, VERSION = "lakewarden", "text-protection", "1.0"
MOST_SPOOLED, MESSAGE = 500, 1_000


#: Kinds of events, forms, authentications, what of a content is sent, and methods.
KINDS = ("dlp.mask", "dlp.block", "dlp.warn", "dlp.file", "prompt.captured", "response.captured", "policy.changed")
FORM_NAMES = ("json", "ndjson", "splunk", "cef", "leef", "ecs", "coralogix", "template")
AUTHS = ("none", "bearer", "header", "basic", "hmac", "query")
CONTENTS = ("none", "redacted", "full")
METHODS = ("POST", "PUT", "PATCH")
#: The least, the most and the usual of each number of a profile.
BOUNDS = {"batch_size": (1, 200, 20), "flush_seconds": (10, 3600, 60), "max_retries": (0, 8, 4), "timeout_ms": (1000, 60000, 10000)}


@dataclass(frozen=True)
class Profile:
    """A receiver: the kinds of events it takes, the least severity of findings, what of their content it sees, its form, and how it is reached."""

    id: str
    events: tuple[str, ...] = ("dlp.mask", "dlp.block", "dlp.warn", "dlp.file")
    min_severity: str = "LOW"
    content: str = "none"
    form: str = "json"
    batch_size: int = 20
    auth: Mapping[str, str] = field(default_factory=dict)
    name: str = ""
    enabled: bool = True
    url: str = "https://siem.example/in"
    method: str = "POST"
    headers: tuple[tuple[str, str], ...] = ()
    flush_seconds: int = 60
    max_retries: int = 4
    timeout_ms: int = 10000
    body: str = '{"event":"%%type%%","detections":"%%detections%%"}'
    content_type: str = "application/json"


def normalized(given: Mapping, usual: Profile | None = None) -> Profile:
    """A profile from loose settings.

    Words count if they are known, numbers are rounded and clamped. A profile
    that names events takes just those; only one without any takes the usual
    ones. Full content needs a confirmation, else it is redacted.
    """
    usual = usual or Profile(str(given.get("id", "")))
    word = lambda key, known, other: given.get(key) if given.get(key) in known else other
    numbers = {}
    for key, (low, high, other) in BOUNDS.items():
        try:
            value = float(given.get(key))
            numbers[key] = int(max(low, min(high, math.floor(value + 0.5)))) if math.isfinite(value) else other
        except (TypeError, ValueError):
            numbers[key] = other
    events = tuple(k for k in KINDS if given["events"].get(k)) if isinstance(given.get("events"), Mapping) else usual.events
    auth = given.get("auth") if isinstance(given.get("auth"), Mapping) else {}
    kind = auth.get("type") if auth.get("type") in AUTHS else "none"
    content = word("content", CONTENTS, "none")
    return Profile(
        str(given.get("id") or usual.id), events, word("min_severity", audit.RANKS, "LOW"), "redacted" if content == "full" and not given.get("content_confirmed") else content, word("form", FORM_NAMES, "json"),
        auth={"type": kind} | {k: str(v) for k, v in auth.items() if k != "type" and v is not None}, name=str(given.get("name") or usual.name)[:60], enabled=bool(given.get("enabled", True)), url=str(given.get("url") or ""),
        method=word("method", METHODS, "POST"), headers=tuple((str(h["name"])[:80], str(h.get("value") or "")[:500]) for h in given.get("headers") or () if isinstance(h, Mapping) and h.get("name"))[:20],
        body=given["body"][:8000] if isinstance(given.get("body"), str) else usual.body, content_type=str(given.get("content_type") or "application/json")[:80], **numbers,
    )


def mapped(values: Mapping[str, int], at: Column, default: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), at), F.lit(default))


DETECTION = "struct<label:string,classification:string,severity:string,count:bigint,evidence:string,segment:string>"
FILE = "struct<name:string,trueType:string,declaredExt:string,masquerade:boolean,sizeBytes:bigint,parts:bigint,truncated:boolean,sha256:string>"
RISK = "struct<score:int,band:string,factors:array<struct<k:string,v:string>>>"


def _shaped(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Events with all columns, in their order; ``detail`` is a VARIANT, as each kind of event has details of its own."""
    usual = {
        "id": F.lit(None).cast("string"), "type": F.lit(None).cast("string"), "ts": F.lit(None).cast("timestamp"), "severity": F.lit("LOW"), "outcome": F.lit("observed"), "tool": F.lit("Unknown"), "url": F.lit(""),
        "classifications": F.array().cast("array<string>"), "finding_count": F.lit(0).cast("long"), "detections": F.array().cast(f"array<{DETECTION}>"), "file": F.lit(None).cast(FILE), "risk": F.lit(None).cast(RISK),
        "content": F.lit(None).cast("string"), "detail": F.parse_json(F.lit("{}")),
    }
    return rows.select(*((columns.get(name, c)).alias(name) for name, c in usual.items()))


def events(log: DataFrame) -> DataFrame:
    """Normalized events of audit entries, those of files (:func:`inspect.logged`) with what is known of the file and its risk.

    Columns that a log does not have are null in its events, as are an item's
    severity, evidence and segment. An outcome is the response to a file where
    the log has one, else the action.
    """
    action, has = F.col("action"), set(log.columns)
    kind = F.when(audit.is_file(action), "dlp.file").when(action == "block", "dlp.block").when(action == "warn", "dlp.warn").otherwise("dlp.mask")
    known = {f.name for f in log.schema["items"].dataType.elementType.fields}
    text = lambda i, name: i[name] if name in known else F.lit(None).cast("string")
    detections = F.transform("items", lambda i: F.struct(i["label"].alias("label"), i["classification"].alias("classification"), text(i, "severity").alias("severity"), i["count"].cast("long").alias("count"), text(i, "evidence").alias("evidence"), text(i, "segment").alias("segment")))
    outcome = F.coalesce(*([F.nullif("response_action", F.lit(""))] if "response_action" in has else []), F.nullif(F.regexp_replace(action, "file-", ""), F.lit("")), F.lit("observed"))
    columns = {
        "id": F.col("id"), "type": kind, "ts": F.col("ts"), "severity": F.coalesce("max_severity", F.lit("LOW")), "outcome": outcome, "tool": F.coalesce("tool", F.lit("Unknown")),
        "url": F.coalesce("url", F.lit("")), "classifications": F.col("classifications"), "finding_count": F.coalesce("total_findings", F.lit(0).cast("long")), "detections": detections,
    }
    if "file_name" in has:
        file = F.struct(
            F.col("file_name").alias("name"), F.col("true_type").alias("trueType"), F.col("declared_ext").alias("declaredExt"), F.coalesce("masquerade", F.lit(False)).alias("masquerade"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("sizeBytes"),
            F.coalesce("segments", F.lit(0)).cast("long").alias("parts"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.col("sha").alias("sha256"),
        )
        columns["file"] = F.when(F.col("source") == "file", file) if "source" in has else F.when(F.col("file_name").isNotNull(), file)
    if "risk_score" in has:
        factors = F.coalesce("risk_factors", F.array().cast("array<struct<k:string,v:string>>"))
        columns["risk"] = F.when(F.col("risk_score").isNotNull(), F.struct(F.col("risk_score").cast("int").alias("score"), F.col("risk_band").alias("band"), factors.alias("factors")))
    return _shaped(log, columns)


def captured(captures: DataFrame) -> DataFrame:
    """Events of turns (id, type, content, tool, ts, session_url, tokens, tags, category)."""
    detail = F.to_variant_object(F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("category", F.lit("")).alias("category")))
    return _shaped(captures, {
        "id": F.col("id"), "type": F.concat("type", F.lit(".captured")), "ts": F.col("ts"), "outcome": F.lit("captured"), "tool": F.coalesce("tool", F.lit("Unknown")), "url": F.coalesce("session_url", F.lit("")), "content": F.coalesce("content", F.lit("")), "detail": detail,
    })


def policy_changed(summary: DataFrame, as_of, depth: str = "deep", labeling: bool = False) -> DataFrame:
    """The event of a policy that was saved, from its summary: one row, or one a tenant."""
    detail = F.to_variant_object(F.struct(F.col("detecting").alias("detectorsEnabled"), F.col("block_switches").alias("detectorsBlocking"), F.lit(labeling).alias("labeling"), F.lit(depth).alias("inspectionDepth")))
    return _shaped(summary, {"id": F.sha2(F.concat_ws("|", *(["tenant"] if "tenant" in summary.columns else []), "detecting", "block_switches", F.lit(str(as_of))), 256), "type": F.lit("policy.changed"), "ts": F.lit(as_of), "severity": F.lit("MEDIUM"), "outcome": F.lit("changed"), "detail": detail})


def sample(spark: SparkSession, as_of) -> DataFrame:
    """One event of an invented finding, to try a receiver with; fixed values: what it says."""
    row = (f"test-{as_of:%Y%m%d%H%M%S}", as_of, "block", "ChatGPT", "https://chatgpt.com/", "CRITICAL", ["AUTHENTICATION_SECRET"], 1, [("AWS_KEY", "AUTHENTICATION_SECRET", "CRITICAL", 1, "••••••")])
    return events(spark.createDataFrame([row], "id string, ts timestamp, action string, tool string, url string, max_severity string, classifications array<string>, total_findings long, items array<struct<label:string,classification:string,severity:string,count:bigint,evidence:string>>"))


def _escaped(value: Column) -> Column:
    """Of an extension's value: backslash, equals sign and line ends."""
    for found, put in (("\\", "\\\\"), ("=", "\\="), ("\r\n", "\\n"), ("\n", "\\n")):
        value = F.replace(value, F.lit(found), F.lit(put))
    return value


def _header(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def _pairs(fields: Mapping[str, Column], separator: str, clean) -> Column:
    """``key=value`` of what is neither null nor empty."""
    made = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), clean(c.cast("string")))) for k, c in fields.items()]
    return F.concat_ws(separator, *made)


def _labels(counted: bool) -> Column:
    times = lambda d: F.when(d["count"] > 1, F.concat(F.lit("x"), d["count"].cast("string"))).otherwise("") if counted else F.lit("")
    return F.array_join(F.transform("detections", lambda d: F.concat(d["label"], times(d))), ",")


def _time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def cef(vendor: str = VENDOR, product: str = PRODUCT, version: str = VERSION) -> Column:
    fields = {
        "rt": F.unix_millis("ts"), "act": F.col("outcome"), "outcome": F.col("outcome"), "cat": F.array_join("classifications", ","), "cnt": F.col("finding_count"), "request": F.col("url"),
        "cs1Label": F.lit("aiTool"), "cs1": F.col("tool"), "cs2Label": F.lit("detectors"), "cs2": _labels(True),
        "fname": F.col("file.name"), "fsize": F.col("file.sizeBytes"), "fileType": F.col("file.trueType"), "fileHash": F.col("file.sha256"), "cs3Label": F.when(F.col("file").isNotNull(), "masquerade"), "cs3": F.col("file.masquerade"),
        "cn1Label": F.when(F.col("risk").isNotNull(), "riskScore"), "cn1": F.col("risk.score"), "cs4Label": F.when(F.col("risk").isNotNull(), "riskBand"), "cs4": F.col("risk.band"), "msg": F.substring("content", 1, MESSAGE),
    }
    name = F.concat_ws(" ", "type", "outcome")
    head = F.concat_ws("|", F.lit("CEF:0"), *(_header(c) for c in (F.lit(vendor), F.lit(product), F.lit(version), F.col("type"), name)), mapped(LEVEL, F.col("severity"), 2).cast("string"))
    return F.concat(head, F.lit("|"), _pairs(fields, " ", _escaped))


def leef(vendor: str = VENDOR, product: str = PRODUCT, version: str = VERSION) -> Column:
    fields = {
        "devTime": _time(F.col("ts")), "devTimeFormat": F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "cat": F.array_join("classifications", ","), "sev": mapped(LEVEL, F.col("severity"), 2),
        "action": F.col("outcome"), "aiTool": F.col("tool"), "url": F.col("url"), "findingCount": F.col("finding_count"), "detectors": _labels(False),
        "fileName": F.col("file.name"), "fileType": F.col("file.trueType"), "fileSize": F.col("file.sizeBytes"), "fileHash": F.col("file.sha256"), "masquerade": F.col("file.masquerade"), "riskScore": F.col("risk.score"), "riskBand": F.col("risk.band"),
        "msg": F.regexp_replace(F.substring("content", 1, MESSAGE), "\r?\n", " "),
    }
    head = F.concat_ws("|", F.lit("LEEF:2.0"), F.lit(vendor), F.lit(product), F.lit(version), "type", F.lit("x09"))
    return F.concat(head, F.lit("|"), _pairs(fields, "\t", lambda v: F.replace(v, F.lit("\t"), F.lit(" "))))


def _event() -> Column:
    return F.struct(
        "type", _time(F.col("ts")).alias("ts"), F.lit(VENDOR).alias("vendor"), F.lit(PRODUCT).alias("product"), F.lit(VERSION).alias("version"), "severity", "outcome", F.col("tool").alias("aiTool"), "url", "id", "detections", "classifications",
        F.col("finding_count").alias("findingCount"), "file", "risk", "content", F.lit(None).cast("string").alias("actor"), "detail",
    )


def as_json(value: Column) -> Column:
    """JSON with its nulls, but for evidence: what a receiver may not see is not named either. What a risk's factors add are numbers where they are. Quotes inside of texts are escaped, so no piece that is changed can stand in one."""
    return F.regexp_replace(F.replace(F.to_json(value, {"ignoreNullFields": "false"}), F.lit(',"evidence":null'), F.lit("")), '"v":"(-?[0-9]+)"', '"v":$1')


def _members(fields: Mapping[str, Column]) -> Column:
    """A JSON object of members that are JSON; null ones are left out."""
    return F.concat(F.lit("{"), F.array_join(F.array(*(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items())), ","), F.lit("}"))


def ecs(vendor: str = VENDOR, product: str = PRODUCT, version: str = VERSION) -> Column:
    """An event in the Elastic Common Schema; what an event does not have is left out."""
    text = lambda value: F.when(value.isNotNull(), F.regexp_replace(F.to_json(F.struct(value.alias("x"))), r'\A\{"x":|\}\z', ""))  # noqa: E731  a text as JSON
    kind = F.when(F.startswith(F.col("type"), F.lit("dlp.")), "alert").otherwise("event")
    event = F.struct(kind.alias("kind"), F.array(F.lit("intrusion_detection")).alias("category"), F.col("outcome").alias("action"), mapped(LEVEL, F.col("severity"), 2).alias("severity"), F.lit(product).alias("dataset"), F.lit(vendor).alias("module"), F.lit(vendor).alias("provider"))
    scored = F.struct(*(event[f].alias(f) for f in ("kind", "category", "action", "severity", "dataset", "module", "provider")), F.col("risk.score").alias("risk_score"))
    found = F.struct("detections", F.col("finding_count").alias("findingCount"), "detail")
    file = {"name": F.col("file.name"), "size": F.col("file.sizeBytes"), "extension": F.col("file.declaredExt"), "mime_type": F.col("file.trueType")}
    hashed = F.struct(*(v.alias(k) for k, v in file.items()), F.struct(F.col("file.sha256").alias("sha256")).alias("hash"))
    return _members({
        "@timestamp": text(_time(F.col("ts"))), "event": F.when(F.col("risk").isNotNull(), as_json(scored)).otherwise(as_json(event)),
        "observer": as_json(F.struct(F.lit(vendor).alias("vendor"), F.lit(product).alias("product"), F.lit(version).alias("version"))), "rule": as_json(F.struct(F.col("type").alias("name"))),
        "labels": as_json(F.struct(F.col("tool").alias("ai_tool"), F.array_join("classifications", ",").alias("classifications"), "outcome")),
        "dlp": F.when(F.col("file").isNotNull(), as_json(F.struct("detections", F.col("finding_count").alias("findingCount"), "detail", F.col("file.masquerade").alias("masquerade")))).otherwise(as_json(found)),
        "url": F.when(F.col("url") != "", as_json(F.struct(F.col("url").alias("full")))),
        "file": F.when(F.col("file.sha256").isNotNull(), as_json(hashed)).when(F.col("file").isNotNull(), as_json(F.struct(*(v.alias(k) for k, v in file.items())))), "message": F.when(F.col("content") != "", text(F.col("content"))),
    })


def splunk(host: str = PRODUCT, source: str = VENDOR, sourcetype: str = "dlp", index: str = "") -> Column:
    extra = [F.lit(index).alias("index")] if index else []
    return as_json(F.struct(F.unix_seconds("ts").alias("time"), F.lit(host).alias("host"), F.lit(source).alias("source"), F.lit(sourcetype).alias("sourcetype"), _event().alias("event"), *extra))


def shipped(application: str = VENDOR, subsystem: str = "dlp", computer: str = PRODUCT) -> Column:
    """An entry of a JSON array of logs, with the whole event as its text."""
    return as_json(F.struct(F.lit(application).alias("applicationName"), F.lit(subsystem).alias("subsystemName"), F.lit(computer).alias("computerName"), mapped(SHIPPED, F.col("severity"), 3).alias("severity"), F.unix_millis("ts").alias("timestamp"), F.col("type").alias("category"), F.col("tool").alias("className"), F.col("outcome").alias("methodName"), _event().alias("text")))


def template(body: str, json: bool = True) -> Column:
    """A body with ``%%path%%`` in it: a field of the event, or one inside of it by a dotted path (``%%risk.score%%``, ``%%detections.0.label%%``); ``%%json%%`` is the whole event.

    The event is a VARIANT, of which paths are taken: objects and arrays give
    their JSON, what is not there gives nothing. ``detections`` and
    ``classifications`` are joined by commas. Values are escaped as inside a
    JSON string if the body is JSON.
    """

    def inside(value: Column) -> Column:
        value = F.coalesce(value.cast("string"), F.lit(""))
        if not json:
            return value
        for char, put in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            value = F.replace(value, F.lit(char), F.lit(put))
        return value

    def field(whole: Column, event: Column, name: str) -> Column:
        if not all(name.split(".")):
            return F.lit("")
        path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in name.split("."))
        kind = F.schema_of_variant(F.try_variant_get(event, path, "variant"))
        return F.when(kind.rlike("^(OBJECT|ARRAY)"), F.get_json_object(whole, path)).otherwise(F.try_variant_get(event, path, "string"))

    made = {"detections": _labels(True), "classifications": F.array_join("classifications", ",")}

    def rendered(whole: Column, event: Column) -> Column:
        parts, at = [], 0
        for found in re.finditer("%%([A-Za-z0-9_.]+)%%", body):
            value = whole if found[1] == "json" else made[found[1]] if found[1] in made else field(whole, event, found[1])
            parts += [F.lit(body[at : found.start()]), inside(value)]
            at = found.end()
        return F.concat(*parts, F.lit(body[at:]))

    return folds.let(as_json(_event()), lambda whole: folds.let(F.parse_json(whole), lambda event: rendered(whole, event)))


FORMS = {"json": lambda: as_json(_event()), "ndjson": lambda: as_json(_event()), "cef": cef, "leef": leef, "ecs": ecs, "splunk": splunk, "coralogix": shipped}


def fan_out(log_events: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    """Each event once for every profile that takes it, with what that profile may see of it: no content unless it sees all, and no evidence if it sees none.

    Profiles are few and part of the plan: a row makes the array of those that
    take it, so nothing is joined or shuffled.
    """
    takes = [F.when(F.col("type").isin(*p.events) & (~F.startswith(F.col("type"), F.lit("dlp.")) | (audit.rank(F.col("severity")) >= audit.RANKS.get(p.min_severity, 1))), F.struct(F.lit(p.id).alias("profile"), F.lit(p.content).alias("mode"), F.lit(p.batch_size).alias("batch_size"))) for p in profiles if p.enabled and p.url]
    return _projected(log_events.withColumn("__p", F.explode(F.filter(F.array(*takes), lambda p: p.isNotNull()))).select("*", "__p.*").drop("__p"))


#: Receivers that are sent to every task; a table of more is shuffled by kind of event.
MOST_PROFILES = 2_000


def profile_rows(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    """(profile, events, min_severity, mode, batch_size, enabled, url): profiles as a table."""
    rows = [(p.id, list(p.events), p.min_severity, p.content, p.batch_size, p.enabled, p.url) for p in profiles]
    return spark.createDataFrame(rows, "profile string, events array<string>, min_severity string, mode string, batch_size int, enabled boolean, url string")


def fan_out_by(log_events: DataFrame, profiles: DataFrame) -> DataFrame:
    """What :func:`fan_out` gives, for profiles that are rows (:func:`profile_rows`): a join by kind of event, so a change of one changes no plan."""
    takes = profiles.where("enabled and url <> ''").select("profile", "mode", "batch_size", audit.rank(F.col("min_severity")).alias("__least"), F.explode(F.array_distinct("events")).alias("__kind"))
    takes = F.broadcast(takes) if profiles.count() <= MOST_PROFILES else takes
    rows = log_events.join(takes, (F.col("type") == F.col("__kind")) & (~F.startswith(F.col("type"), F.lit("dlp.")) | (audit.rank(F.col("severity")) >= F.col("__least"))))
    return _projected(rows.drop("__kind", "__least"))


def _projected(rows: DataFrame) -> DataFrame:
    """Of events that were fanned out, what the mode of their profile lets it see."""
    rows = rows.withColumn("content", F.when(F.col("mode") == "full", F.col("content")))
    bare = F.transform("detections", lambda d: d.withField("evidence", F.lit(None).cast("string")))
    return rows.withColumn("detections", F.when(F.col("mode") == "none", bare).otherwise(F.col("detections")))


def spooled(rows: DataFrame, most: int = MOST_SPOOLED) -> DataFrame:
    """The newest events that wait for each profile, with the batch each goes out in.

    The rank limit runs before the shuffle too (a group limit on every task),
    so a profile that takes all events sends a bounded number of rows.
    """
    newest = Window.partitionBy("profile").orderBy(F.desc("ts"), F.desc("id"))
    kept = rows.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= most).drop("k")
    order = Window.partitionBy("profile").orderBy("ts", "id")
    return kept.withColumn("batch", F.floor((F.row_number().over(order) - 1) / F.col("batch_size")).cast("long"))


def chunked(rows: DataFrame, shares: int | None = None) -> DataFrame:
    """Numbers batches of at most a profile's size within shares of its events, so that a profile that takes all events is no single task's work. No event is dropped.

    An event's share is told by its id, so a batch has the same number and the
    same events however the rows are split and whatever runs again.
    """
    shares = shares or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64("id"), F.lit(shares)))
    order = Window.partitionBy("profile", "__share").orderBy("ts", "id")
    place = F.floor((F.row_number().over(order) - 1) / F.col("batch_size"))
    return dealt.withColumn("batch", (F.col("__share") * (1 << 32) + place).cast("long")).drop("__share")


#: What a form's body is.
TYPES = {"json": "application/json", "ndjson": "application/x-ndjson", "splunk": "application/json", "cef": "text/plain", "leef": "text/plain", "ecs": "application/x-ndjson", "coralogix": "application/json"}


def _body(form: str, lines: Column, n: Column, content_type: str) -> Column:
    """The lines of a batch as the body that a form has."""
    joined = F.array_join(lines, "\n")
    if form == "json":
        head = f'{{"vendor":"{VENDOR}","product":"{PRODUCT}","version":"{VERSION}","count":'
        return F.when(n == 1, F.element_at(lines, 1)).otherwise(F.concat(F.lit(head), n.cast("string"), F.lit(',"events":['), F.array_join(lines, ","), F.lit("]}")))
    if form == "coralogix":
        return F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))
    if form == "template":
        many = F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")) if "json" in content_type.lower() else joined
        return F.when(n == 1, F.element_at(lines, 1)).otherwise(many)
    return F.concat(joined, F.lit("\n")) if form in ("ndjson", "ecs") else joined


def lines(profiles: Sequence[Profile]) -> Column:
    """An event that was fanned out, in the form of its profile."""
    line = F.lit(None).cast("string")
    for p in profiles:
        line = F.when(F.col("profile") == p.id, template(p.body, "json" in p.content_type.lower()) if p.form == "template" else FORMS[p.form]()).otherwise(line)
    return line


def serialized(rows: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    """(profile, batch, n, oldest, body, content_type): the events of a batch as one body, in the form of its profile; batches are bounded by the profile."""
    body, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in profiles:
        own = F.col("profile") == p.id
        body = F.when(own, _body(p.form, F.col("lines"), F.col("n"), p.content_type)).otherwise(body)
        kind = F.when(own, p.content_type if p.form == "template" else TYPES[p.form]).otherwise(kind)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "line"))), lambda x: x["line"])
    made = rows.withColumn("line", lines(profiles)).groupBy("profile", "batch").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), ordered.alias("lines"))
    return made.select("profile", "batch", "n", "oldest", body.alias("body"), kind.alias("content_type"))


def addressed(bodies: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    """Adds ``url``, ``method`` and ``headers`` to bodies: what a receiver takes, its own headers, and its authentication."""
    url, method, found = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for p in profiles:
        own, a = F.col("profile") == p.id, p.auth
        kind = a.get("type", "none")
        made = {"User-Agent": F.lit(f"{VENDOR}/{VERSION}"), "X-Event-Count": F.col("n").cast("string"), "X-Format": F.lit(p.form), "Content-Type": F.col("content_type")} | {k: F.lit(v) for k, v in (*p.headers, *headers(a).items())}
        if kind == "hmac" and a.get("secret"):
            made[a.get("signature_header", "X-Signature")] = F.concat(F.lit("sha256="), sqlnames.hmac_of(a["secret"], F.col("body")))
        at = p.url
        if kind == "query" and a.get("name"):
            at += ("&" if "?" in at else "?") + f"{quote(a['name'], safe='')}={quote(a.get('value', ''), safe='')}"
        found = F.when(own, F.create_map(*(x for k, v in made.items() for x in (F.lit(k), v)))).otherwise(found)
        url, method = F.when(own, at).otherwise(url), F.when(own, p.method).otherwise(method)
    return bodies.withColumns({"url": url, "method": method, "headers": found})


def headers(auth: Mapping[str, str]) -> dict[str, str]:
    """Headers of an authentication that does not depend on the body."""
    kind = auth.get("type", "none")
    if kind == "bearer" and auth.get("token"):
        return {"Authorization": f"Bearer {auth['token']}"}
    if kind == "header" and auth.get("name"):
        return {auth["name"]: auth.get("value", "")}
    if kind == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{auth.get('username', '')}:{auth.get('password', '')}".encode()).decode()}
    return {}


#: Characters of a header that a preview shows.
SHOWN = 12


def previewed(requests: DataFrame) -> DataFrame:
    """Requests as people may see them: of headers that are not about the body only the first characters."""
    plain = ("Content-Type", "User-Agent", "X-Event-Count", "X-Format")
    shown = F.transform_values("headers", lambda k, v: F.when(k.isin(*plain) | (F.length(v) <= SHOWN), v).otherwise(F.concat(F.substring(v, 1, SHOWN), F.lit("…"))))
    return requests.withColumn("headers", shown)


def due(spooled: DataFrame, profiles: Sequence[Profile], as_of, force: bool = False) -> DataFrame:
    """The first batch of each profile's queue, if the queue holds a whole one or its oldest event has waited long enough (one without a time has)."""
    waits = F.create_map(*(F.lit(x) for p in profiles for x in (p.id, p.flush_seconds)))
    queues = spooled.groupBy("profile").agg(F.count("*").alias("queued"), F.first("batch_size").alias("size"), F.min_by("ts", F.struct("batch", F.col("ts").isNotNull(), "ts", "id")).alias("oldest"))
    waited = F.coalesce(F.unix_micros(F.lit(as_of)) - F.unix_micros("oldest"), F.lit(1 << 62)) / 1_000_000
    ready = queues.where(F.lit(force) | (F.col("queued") >= F.col("size")) | (waited >= F.element_at(waits, F.col("profile"))))
    return spooled.where("batch = 0").join(F.broadcast(ready.select("profile")), "profile", "left_semi")  # at most a row a profile


@dataclass(frozen=True)
class Reply:
    """What a receiver said: an HTTP status, or 0 for none."""

    status: int
    error: str = ""

    @property
    def ok(self) -> bool:
        return 200 <= self.status < 300

    @property
    def again(self) -> bool:
        """Whether a later attempt may succeed: a bad request will not be mended by waiting."""
        return self.status == 0 or self.status == 429 or self.status >= 500


#: Milliseconds of the first wait and the longest one.
FIRST_WAIT, LONGEST_WAIT = 500, 30_000


def attempted(send: Callable[[], Reply], most: int, wait: Callable[[float], None] = time.sleep) -> tuple[Reply, int]:
    """Sends until a receiver takes it or cannot, with waits that double; returns the last reply and the number of attempts."""
    for n in range(1, most + 2):
        reply = send()
        if reply.ok or not reply.again or n > most:
            return reply, n
        wait(min(LONGEST_WAIT, FIRST_WAIT * 2**n) / 1000)
    raise AssertionError


def sent(requests: DataFrame, profiles: Sequence[Profile], deliver: Callable[[dict], Reply], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(profile, batch, n, ok, status, error, attempts, ms) of requests that tasks send, each with retries.

    ``deliver`` takes a request (profile, url, method, headers, body,
    timeout_ms) and is the only part that knows a network. Addresses of this
    machine or a private network are refused without an attempt.
    """
    limits = {p.id: (p.max_retries, p.timeout_ms) for p in profiles}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                began = time.monotonic()
                if r.refused:
                    reply, attempts = Reply(400, "no endpoint" if not r.url else "blocked: a private address"), 0
                else:
                    request = {"profile": r.profile, "url": r.url, "method": r.method, "headers": dict(r.headers), "body": r.body, "timeout_ms": limits[r.profile][1]}
                    reply, attempts = attempted(lambda q=request: deliver(q), limits[r.profile][0], wait)
                rows.append((r.profile, r.batch, r.n, reply.ok, reply.status, reply.error, attempts, int(1000 * (time.monotonic() - began))))
            yield pd.DataFrame(rows, columns=["profile", "batch", "n", "ok", "status", "error", "attempts", "ms"])

    ready = requests.select("profile", "batch", "n", "url", "method", "headers", "body", private_host(F.col("url")).alias("refused"))
    return ready.mapInPandas(run, "profile string, batch long, n long, ok boolean, status int, error string, attempts int, ms long")


def health(attempts: DataFrame) -> DataFrame:
    """The state of each receiver from all attempts (profile, at, n, ok, status, error, ms): events sent, failures, failures since the last success, and what came last."""
    rows = attempts.groupBy("profile").agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("sent"), F.count_if(~F.col("ok")).alias("failed"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.max("at").alias("last_attempt"),
        F.max_by("status", "at").alias("last_status"), F.max_by("ms", "at").alias("last_ms"), F.max_by(F.when(F.col("ok"), F.lit(None)).otherwise(F.col("error")), "at").alias("last_error"),
    )
    since = attempts.join(F.broadcast(rows.select("profile", "last_success")), "profile").where(~F.col("ok") & (F.col("last_success").isNull() | (F.col("at") > F.col("last_success"))))  # a row a profile
    return rows.join(since.groupBy("profile").agg(F.count("*").alias("consecutive_failures")), "profile", "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))


def merged(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The states of the receivers of ``fresh``, from their states before and those of later attempts alone."""
    both = fresh.alias("f").join(known.alias("k"), "profile", "left")
    new, old = (lambda c: F.col(f"f.{c}")), (lambda c: F.col(f"k.{c}"))
    added = lambda c: (new(c) + F.coalesce(old(c), F.lit(0))).alias(c)
    since = F.when(new("last_success").isNotNull(), new("consecutive_failures")).otherwise(new("consecutive_failures") + F.coalesce(old("consecutive_failures"), F.lit(0)))
    made = {"sent": added("sent"), "failed": added("failed"), "last_success": F.coalesce(new("last_success"), old("last_success")).alias("last_success"), "consecutive_failures": since.alias("consecutive_failures")}
    return both.select(*("profile" if c == "profile" else made.get(c, new(c).alias(c)) for c in fresh.columns))


def receivers(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    return spark.createDataFrame([(p.id, p.name or p.id, p.enabled and bool(p.url), p.form) for p in profiles], "profile string, name string, enabled boolean, form string")


def overview(known: DataFrame, spooled: DataFrame, states: DataFrame) -> DataFrame:
    """Each receiver with what waits for it and whether it is healthy, failing or idle."""
    queued = spooled.groupBy("profile").agg(F.count("*").alias("queued"))
    rows = known.join(queued, "profile", "left").join(states.select("profile", "sent", "last_success", "consecutive_failures"), "profile", "left")
    state = F.when(F.coalesce("consecutive_failures", F.lit(0)) > 0, "failing").when(F.col("last_success").isNotNull(), "healthy").otherwise("idle")
    return rows.select("profile", "name", "enabled", "form", F.coalesce("queued", F.lit(0)).alias("queued"), F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), state.alias("state"))


def summary(receivers: DataFrame) -> DataFrame:
    """How many receivers there are and are enabled, what waits for all of them, and how many are in each state."""
    return receivers.agg(F.count("*").alias("n_profiles"), F.count_if("enabled").alias("n_enabled"), F.coalesce(F.sum("queued"), F.lit(0)).alias("queued"), *(F.count_if(F.col("state") == s).alias(s) for s in ("healthy", "failing", "idle")))


def pruned(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Queues or states of the profiles that are still there."""
    return rows.join(F.broadcast(known.select("profile")), "profile", "left_semi")  # profiles are few and come from settings


def private_host(url: Column) -> Column:
    """Whether a URL leads to this machine or a private network."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), F.lit("")))
    return (host == "") | host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0|\[::1\]|\[f[cd]|\[fe80)|\.local$")
