"""Queries over detection, policy, rewriting, risk and files, with the detectors whose findings SQL can tell."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators import files, inspect, policy, sanitize, scan
from lakewarden.plans import sql
from lakewarden.plans.registry import query

TOLD = [d.id for _, d in sql.TOLD]
#: A posture in which every detector of them masks, and those of secrets block.
STRICT = sanitize.Policy({d.id: sanitize.Switches(True, True, d.secret and d.severity == "CRITICAL", True) for _, d in sql.TOLD})


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of much work each, from files that are too small for all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


@query("findings_told", f"""{sql.FOUND} SELECT doc_id, rule_id, label, classification, severity, start, stop AS "end", evidence FROM told""")
def findings_told(spark, sf_dir):
    rows = scan.exploded(scan.scan(_texts(spark, sf_dir), enabled=TOLD), "doc_id")
    return rows.select("doc_id", "f.rule_id", "f.label", "f.classification", "f.severity", "f.start", "f.end", "f.evidence")


@query("finding_counts_told", f"{sql.FOUND} SELECT rule_id, label, classification, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM told GROUP BY ALL")
def finding_counts_told(spark, sf_dir):
    rows = scan.exploded(scan.scan(_texts(spark, sf_dir), enabled=TOLD), "doc_id")
    return rows.groupBy("f.rule_id", "f.label", "f.classification").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


_BLOCKS = ", ".join(sql.quoted(k) for k, s in STRICT.rules.items() if s.block)


@query("sanitized_told", f"""{sql.FOUND},
pieces AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER w, 0) AS before, stop - start AS room FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
masked AS (SELECT p.doc_id, string_agg(substring(t, before + 1, start - before) || repeat('X', least(32, greatest(4, room))::INT), '' ORDER BY start) || substring(any_value(t), max(stop) + 1) AS m FROM pieces p JOIN docs d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
acts AS (SELECT doc_id, count(*) AS n, bool_or(rule_id IN ({_BLOCKS})) AS blocks, max(rank) AS worst FROM found GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n IS NULL THEN 'allow' WHEN blocks THEN 'block' ELSE 'mask' END AS action, coalesce(n, 0) AS n_findings, CASE worst WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END AS max_severity,
    CASE WHEN n IS NOT NULL AND NOT blocks THEN m ELSE d.text END AS sanitized, CASE WHEN n IS NULL THEN d.text WHEN NOT blocks THEN m END AS stored
FROM documents d LEFT JOIN acts a ON a.doc_id = d.doc_id LEFT JOIN masked ON masked.doc_id = d.doc_id""")
def sanitized_told(spark, sf_dir):
    rows = sanitize.stored(sanitize.sanitize(_texts(spark, sf_dir), policy=STRICT))
    return rows.select("doc_id", "action", "n_findings", "max_severity", "sanitized", "stored")


@query("sanitized_verified", "SELECT doc_id, false AS held FROM documents")
def sanitized_verified(spark, sf_dir):
    """What was rewritten holds nothing more that has to be masked."""
    return sanitize.verified(sanitize.sanitize(_texts(spark, sf_dir), policy=STRICT), STRICT).select("doc_id", "held")


@query("sanitized_held", f"""{sql.FOUND}, acts AS (SELECT doc_id, bool_or(rule_id IN ({_BLOCKS})) AS blocks FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(NOT blocks, false) AND d.doc_id % 2 = 0 AS held FROM documents d LEFT JOIN acts USING (doc_id)""")
def sanitized_held(spark, sf_dir):
    """What was rewritten is held back where an address comes back into it before it is written, in every second document."""
    rows = sanitize.sanitize(_texts(spark, sf_dir), policy=STRICT)
    back = F.when((F.col("action") == "mask") & (F.col("doc_id") % 2 == 0), F.concat("sanitized", F.lit(" write to someone@example.org")))
    return sanitize.verified(rows.withColumn("sanitized", F.coalesce(back, "sanitized")), STRICT).select("doc_id", "held")


@query("log_items_told", f"""{sql.FOUND} SELECT doc_id, label, arg_min(classification, struct_pack(a := start, b := ordinal)) AS classification, arg_min(severity, struct_pack(a := start, b := ordinal)) AS severity,
arg_min(evidence, struct_pack(a := start, b := ordinal)) AS evidence, count(*) AS n FROM told GROUP BY doc_id, label""")
def log_items_told(spark, sf_dir):
    return sanitize.log_items(scan.scan(_texts(spark, sf_dir), enabled=TOLD), "doc_id")


@query("log_records", f"""{sql.FOUND}, labels AS (SELECT doc_id, label, count(*) AS c, arg_min(evidence, start) AS e, min(start) AS first_start FROM told GROUP BY doc_id, label),
items AS (SELECT doc_id, string_agg(label || 'x' || c || ' ' || e, ',' ORDER BY first_start) AS items FROM labels GROUP BY doc_id)
SELECT doc_id::VARCHAR AS id, CASE WHEN bool_or(rule_id IN ({_BLOCKS})) THEN 'block' ELSE 'mask' END AS action, count(*) AS total_findings, any_value(items) AS items FROM found JOIN items USING (doc_id) GROUP BY doc_id""")
def log_records(spark, sf_dir):
    rows = sanitize.logged(sanitize.sanitize(_texts(spark, sf_dir), policy=STRICT), "doc_id", None)
    shown = F.array_join(F.transform("items", lambda i: F.concat(i["label"], F.lit("x"), i["count"], F.lit(" "), i["evidence"])), ",")
    return rows.select("id", "action", "total_findings", shown.alias("items"))


@query("risk_told", f"{sql.scored()} SELECT doc_id, n, identities, score, band, CASE WHEN n = 0 THEN 0.0 ELSE round(n / greatest(1.0, octet_length(encode(coalesce(o.text, ''))) / 1024), 2) END AS density FROM scored JOIN documents o USING (doc_id)")
def risk_told(spark, sf_dir):
    rows = scan.scan(_texts(spark, sf_dir), enabled=TOLD)
    return sanitize.risk(rows, "doc_id", F.octet_length(F.coalesce("text", F.lit("")))).select("doc_id", "n", "identities", "score", "band", "density")


# --- files ---

_NAME = "doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.txt' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a third of them go by the name of a picture."""
    docs = _texts(spark, sf_dir)
    name = F.concat(F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".txt"))
    return docs.select(name.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), (F.col("doc_id") % 10).alias("batch"))


_SETTINGS = policy.inspection({"maxSizeKB": 64, "actions": {"CRITICAL": "block", "HIGH": "quarantine", "MODERATE": "notify"}})
#: Typed bytes of a document: text unless it is empty, as it holds no zero byte and few control and high ones.
_BYTES = "hex(encode(left(coalesce(text, ''), 4096)))[1:8192]"
_TYPED = f"""typed AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS o, {_NAME} AS path, {_BYTES} AS h FROM documents),
pairs AS (SELECT *, regexp_extract_all(h, '..') AS p FROM typed),
counted AS (SELECT *, len(p) AS size, len(list_filter(p, lambda x: x <= '08' OR x BETWEEN '0E' AND '1F')) AS control, len(list_filter(p, lambda x: x >= '80')) AS high FROM pairs),
kinds AS (SELECT doc_id, o, path, CASE WHEN size > 0 AND (starts_with(h, 'EFBBBF') OR (control <= size * 0.02 AND high <= size * 0.45)) THEN 'text' ELSE 'unknown' END AS true_type FROM counted)"""


@query("file_types", f"WITH {_TYPED} SELECT doc_id, true_type, CASE WHEN true_type = 'text' THEN 'text' ELSE 'binary' END AS family, regexp_extract(path, '[^.]*$') AS declared_ext, true_type = 'text' AND ends_with(path, '.png') AS masquerade FROM kinds")
def file_types(spark, sf_dir):
    """Documents as files: the type of their bytes against the name that their source gives them."""
    typed = files.typed(_files(spark, sf_dir))
    return typed.select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "true_type", "family", "declared_ext", "masquerade")


_INSPECTED = f"""{sql.scored("d.doc_id % 3 = 0 AND d.t <> ''")}, {_TYPED},
reports AS (SELECT k.path, k.doc_id % 10 AS batch, true_type, CASE WHEN octet_length(encode(o)) > 65536 THEN 'exceeds 64 KB inspection limit' WHEN true_type = 'unknown' THEN 'no extractable text (unknown)' END AS skip_reason,
    true_type = 'text' AND k.doc_id % 3 = 0 AS masquerade, octet_length(encode(o)) AS size_bytes, sha256(encode(o))[1:16] AS sha, s.n, s.score, s.band FROM kinds k JOIN scored s ON s.doc_id = k.doc_id),
acted AS (SELECT *, CASE WHEN skip_reason IS NOT NULL THEN 0 ELSE n END AS found, CASE WHEN skip_reason IS NOT NULL THEN 0 ELSE score END AS points, CASE WHEN skip_reason IS NOT NULL THEN 'LOW' ELSE band END AS grade FROM reports),
done AS (SELECT *, CASE WHEN found > 0 OR (masquerade AND skip_reason IS NULL) THEN CASE grade WHEN 'CRITICAL' THEN 'block' WHEN 'HIGH' THEN 'quarantine' WHEN 'MODERATE' THEN 'notify' ELSE 'allow' END ELSE 'allow' END AS action FROM acted)"""


@query("file_inspection", f"{_INSPECTED} SELECT path, true_type, skip_reason, masquerade, size_bytes, sha, (skip_reason IS NULL)::BIGINT AS segments, found AS n, points AS score, grade AS band, action FROM done")
def file_inspection(spark, sf_dir):
    return inspect.inspected(_files(spark, sf_dir), _SETTINGS, TOLD).select("path", "true_type", "skip_reason", "masquerade", "size_bytes", "sha", "segments", "n", "score", "band", "action")


@query("file_batches", f"""{_INSPECTED}, best AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY points DESC, path) AS k FROM done)
SELECT batch, CASE max(CASE action WHEN 'block' THEN 3 WHEN 'quarantine' THEN 2 WHEN 'notify' THEN 1 ELSE 0 END) WHEN 3 THEN 'block' WHEN 2 THEN 'quarantine' WHEN 1 THEN 'notify' ELSE 'allow' END AS action, count(*) AS n_files,
    max(path) FILTER (k = 1) AS worst_path, max(points) AS worst_score, max(grade) FILTER (k = 1) AS worst_band FROM best GROUP BY batch""")
def file_batches(spark, sf_dir):
    return inspect.enforced(inspect.inspected(_files(spark, sf_dir), _SETTINGS, TOLD))


@query("file_log", f"{_INSPECTED} SELECT path AS file_name, 'file-' || action AS action, points AS risk_score, grade AS risk_band, found AS total_findings FROM done")
def file_log(spark, sf_dir):
    log = inspect.logged(inspect.inspected(_files(spark, sf_dir), _SETTINGS, TOLD), None)
    return log.select("file_name", "action", "risk_score", "risk_band", "total_findings")


@query("files_attached", "SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, coalesce(text, '') FROM documents)")
def files_attached(spark, sf_dir):
    """Files that are attached twice are enumerated once."""
    attached = _files(spark, sf_dir)
    return inspect.enumerated(attached.unionByName(attached)).agg(F.count("*").alias("n"))


# --- policy ---

_RULES = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {sql.quoted(d.id)}, {sql.quoted(d.label)}, {sql.quoted(d.data_class)}, {sql.quoted(d.level)}, {str(d.on).lower()}, {str(d.secret).lower()})" for k, d in enumerate(policy.DETECTORS)) + """) AS r(k, rule_id, label, classification, level, is_on, secret)),
rules AS (SELECT c_custkey::VARCHAR AS tenant, rule_id, label, classification, level, is_on AND (c_custkey * 7 + k) % 10 <> 0 AS enabled, is_on AND (c_custkey + k) % 3 <> 0 AS mask, secret AND is_on AND c_acctbal < 0 AS block, is_on AND c_custkey % 5 <> 0 AS warn FROM customer, cat)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies of all customers: each has a few detectors off or not masking, and those of secrets block for customers in debt."""
    known = F.from_json(F.lit(json.dumps([{"k": k, "id": d.id, "on": d.on, "secret": d.secret} for k, d in enumerate(policy.DETECTORS)])), "array<struct<k:int,id:string,on:boolean,secret:boolean>>")
    key = F.col("c_custkey")
    switches = lambda d: F.struct((d["on"] & ((key * 7 + d["k"]) % 10 != 0)).alias("enabled"), (d["on"] & ((key + d["k"]) % 3 != 0)).alias("mask"), (d["secret"] & d["on"] & (F.col("c_acctbal") < 0)).alias("block"), (d["on"] & (key % 5 != 0)).alias("warn"))
    rules = F.map_from_entries(F.transform(known, lambda d: F.struct(d["id"].alias("key"), switches(d).alias("value"))))
    customers = _spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal"))
    return policy.by_tenant(customers.select(key.cast("string").alias("tenant"), rules.alias("rules")))


@query("policy_summary", f"WITH {_RULES} SELECT tenant, count(*) AS n_rules, count(*) FILTER (enabled) AS detecting, count(*) FILTER (enabled AND mask) AS masking, count(*) FILTER (enabled AND block) AS blocking, count(*) FILTER (block) AS block_switches FROM rules GROUP BY tenant")
def policy_summary(spark, sf_dir):
    return policy.summary(_rules(spark, sf_dir), "tenant")


@query("policy_groups", f"WITH {_RULES} SELECT tenant, classification, count(*) AS n_rules, " + ", ".join(f"CASE WHEN bool_and({c}) THEN 'on' WHEN bool_or({c}) THEN 'mixed' ELSE 'off' END AS {c}, count(*) FILTER ({c}) AS n_{c}" for c in policy.COLUMNS) + " FROM rules GROUP BY tenant, classification")
def policy_groups(spark, sf_dir):
    return policy.groups(_rules(spark, sf_dir), "tenant")


@query("policy_posture", f"WITH {_RULES} SELECT tenant, CASE WHEN bool_or(block) THEN 'block' WHEN bool_or(mask) THEN 'mask' ELSE 'monitor' END AS posture, bool_and(warn) AS all_warn FROM rules WHERE enabled GROUP BY tenant")
def policy_posture(spark, sf_dir):
    return policy.posture(_rules(spark, sf_dir), "tenant")


@query("detectors_matching", f"WITH {_RULES}, m AS (SELECT * FROM rules WHERE (contains(lower(rule_id), 'key') OR contains(lower(label), 'key')) AND enabled UNION ALL SELECT * FROM rules WHERE level = 'candidate') SELECT rule_id, label, level, count(*) AS n_tenants, count(*) FILTER (enabled) AS n_on FROM m GROUP BY ALL")
def detectors_matching(spark, sf_dir):
    """Detectors that a search finds, and for how many tenants: those on about keys, and candidates."""
    rules = _rules(spark, sf_dir)
    found = policy.matching(rules, " KEY ", "on").unionByName(policy.matching(rules, "", "candidate"))
    return found.groupBy("rule_id", "label", "level").agg(F.count("*").alias("n_tenants"), F.count_if("enabled").alias("n_on"))
