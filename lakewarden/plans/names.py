"""Queries by SQL functions, over containers, with rules of a caller's own, with policies and receivers as rows, and events of files."""

from __future__ import annotations

import gzip
import hashlib
import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import sqlnames
from lakewarden.functions.detector import Detector
from lakewarden.operators import forward, inspect, rules, sanitize, scan
from lakewarden.plans import detection, sql
from lakewarden.plans.queries import _FANNED, PROFILES
from lakewarden.plans.registry import query
from lakewarden.sources import activity


def _viewed(spark: SparkSession, rows: DataFrame, sql_text: str) -> DataFrame:
    """SQL over rows, with the session's functions."""
    sqlnames.register(spark)
    return spark.sql(sql_text, docs=rows)


# --- validators ---

#: Numbers made of the digests of texts: a share of them is valid by chance.
_MADE = {
    "aadhaar": "concat('7', substring(d, 2, 11))", "luhn": "substring(d, 1, 16)", "iban": "concat('DE', substring(d, 1, 20))", "library_luhn": "substring(d, 3, 9)", "library_vin": "upper(substring(h, 1, 17))",
    "library_isin": "concat('US', upper(substring(h, 1, 9)), substring(d, 10, 1))", "library_cusip": "concat(upper(substring(h, 1, 8)), substring(d, 9, 1))", "library_cpf": "concat(substring(d, 1, 9), '-', substring(d, 10, 2))",
    "library_dni": "concat(substring(d, 1, 8), substring('TRWAGMYFPDXBNJZS', 1 + ascii(substring(h, 30, 1)) % 16, 1))", "library_imo": "concat('IMO ', substring(d, 1, 7))", "library_dea": "concat('AB', substring(d, 1, 7))", "library_aadhaar": "substring(d, 5, 12)",
}
_CASTS = ", ".join(f"{v} AS {k}" for k, v in _MADE.items())
#: The products of the dihedral group and the permutations of Verhoeff's scheme, a row a string.
_PRODUCTS = "['0123456789', '1234067895', '2340178956', '3401289567', '4012395678', '5987604321', '6598710432', '7659821043', '8765932104', '9876543210']"
_POWERS = "['0123456789', '1576283094', '5803796142', '8916043527', '9453126870', '4286573901', '2793806415', '7046913258']"


def _luhn(s: str) -> str:
    return f"(list_sum(list_transform(string_split(reverse({s}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0)"


def _sum(s: str, weights) -> str:
    return "(" + " + ".join(f"{w} * {s}[{k}]::INT" for k, w in enumerate(weights, 1)) + ")"


def _verhoeff(s: str) -> str:
    steps = f"list_transform(string_split(reverse({s}), ''), lambda c, i: {_POWERS}[(i - 1) % 8 + 1][c::INT + 1]::INT)"
    return f"(CASE WHEN {s}[1] > '1' THEN list_reduce(list_prepend(0, {steps}), lambda a, b: {_PRODUCTS}[a + 1][b + 1]::INT) = 0 ELSE false END)"


_CODES = "list_transform(string_split({s}, ''), lambda c: CASE WHEN c <= '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END)"
_VIN = "translate(library_vin, 'ABCDEF', '123456')"
_VIN_SUM = _sum(_VIN, (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2))
_CUSIP = f"list_sum(list_transform({_CODES.format(s='library_cusip[1:8]')}, lambda c, i: (c::INT * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) // 10 + (c::INT * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) % 10))"
_CPF = "replace(library_cpf, '-', '')"
_VALID = {
    "aadhaar": _verhoeff("aadhaar"), "luhn": _luhn("luhn"), "iban": "((iban[5:] || '1314' || iban[3:4])::HUGEINT % 97 = 1)", "library_luhn": _luhn("library_luhn"),
    "library_vin": f"(library_vin[9] = CASE WHEN {_VIN_SUM} % 11 = 10 THEN 'X' ELSE ({_VIN_SUM} % 11)::VARCHAR END)", "library_isin": _luhn(f"array_to_string({_CODES.format(s='library_isin')}, '')"), "library_cusip": f"((10 - {_CUSIP} % 10) % 10 = library_cusip[9]::INT)",
    "library_cpf": f"({_sum(_CPF, range(10, 1, -1))} * 10 % 11 % 10 = {_CPF}[10]::INT AND {_sum(_CPF, range(11, 1, -1))} * 10 % 11 % 10 = {_CPF}[11]::INT AND length(replace({_CPF}, {_CPF}[1], '')) > 0)",
    "library_dni": "('TRWAGMYFPDXBNJZSQVHLCKE'[library_dni[1:8]::INT % 23 + 1] = library_dni[9])", "library_imo": f"({_sum('library_imo[5:]', (7, 6, 5, 4, 3, 2))} % 10 = library_imo[11]::INT)", "library_dea": f"({_sum('library_dea[3:]', (1, 2, 1, 2, 1, 2))} % 10 = library_dea[9]::INT)",
    "library_aadhaar": _verhoeff("library_aadhaar"),
}


@query("validators_told", f"""WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS h, translate(md5(coalesce(text, '')), 'abcdef', '012345') AS d FROM documents), n AS (SELECT doc_id, {_CASTS} FROM t)
SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in _VALID.items())} FROM n""")
def validators_told(spark, sf_dir):
    """All validators by their SQL names, on numbers made of the texts' digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).withColumn("d", F.translate("h", "abcdef", "012345"))
    return _viewed(spark, docs.selectExpr("doc_id", *(f"{v} AS {k}" for k, v in _MADE.items())), f"SELECT doc_id, {', '.join(f'{k}({k}) AS {k}' for k in _MADE)} FROM {{docs}}")


# --- signatures ---

_KEY = "a key that is longer than the sixty-four bytes which a block of SHA-256 has, so that its digest counts"
_PADS = [bytes(b ^ p for b in hashlib.sha256(_KEY.encode()).digest().ljust(64, b"\0")) for p in (0x36, 0x5C)]
_BLOBS = ["'" + "".join(f"\\x{b:02X}" for b in p) + "'::BLOB" for p in _PADS]


@query("hmac_told", f"SELECT doc_id, sha256({_BLOBS[1]} || unhex(sha256({_BLOBS[0]} || encode(coalesce(text, ''))))) AS mac, mac AS by_name FROM documents")
def hmac_told(spark, sf_dir):
    """The HMAC-SHA-256 of every text, by an expression and by its SQL name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _viewed(spark, docs.withColumns({"mac": sqlnames.hmac_of(_KEY, F.col("text")), "k": F.lit(_KEY)}), "SELECT doc_id, mac, hmac_sha256(k, text) AS by_name FROM {docs}")


# --- containers ---


def packed(kind: str, text: str) -> bytes:
    """A file of a kind with a text in it."""
    out = io.BytesIO()
    if kind == "gz":
        return gzip.compress(text.encode(), mtime=0)
    if kind == "pdf":
        shown = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1")
        return b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (" + shown + b") Tj ET") + b"\nendstream\n"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        if kind == "docx":
            markup = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            archive.writestr("[Content_Types].xml", "<Types/>")
            archive.writestr("docProps/core.xml", "<core>by nobody</core>")
            archive.writestr("word/document.xml", f"<?xml version='1.0'?><w:document><w:p><w:r><w:t>{markup}</w:t></w:r></w:p></w:document>")
        elif kind == "two.zip":
            archive.writestr("first.txt", "nothing to see here")
            archive.writestr("second.txt", text)
        else:
            archive.writestr("a.txt", text)
            archive.writestr("inner/b.txt.gz", gzip.compress(text[::-1].encode(), mtime=0))
    return out.getvalue()


_KINDS = ("gz", "pdf", "docx", "zip")


@F.pandas_udf(T.BinaryType())
def _packed(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([packed(k, t) for k, t in zip(kinds, texts, strict=True)])


_SAID = "'T:' || regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g')"


@query("segments_told", f"""WITH t AS (SELECT doc_id, {_SAID} AS t FROM documents), s AS (SELECT doc_id, 'gz' AS kind, doc_id || '.gz' AS path, doc_id::VARCHAR AS segment, 0 AS place, t AS text FROM t
UNION ALL SELECT doc_id, 'pdf', doc_id || '.pdf', doc_id || '.pdf', 0, t FROM t
UNION ALL SELECT doc_id, 'docx', doc_id || '.docx', doc_id || '.docx!word/document.xml', 0, regexp_replace(t, ' {{2,}}', ' ', 'g') || chr(10) FROM t
UNION ALL SELECT doc_id, 'docx', doc_id || '.docx', doc_id || '.docx!docProps/core.xml', 1, 'by nobody' FROM t
UNION ALL SELECT doc_id, 'zip', doc_id || '.zip', doc_id || '.zip!a.txt', 0, t FROM t UNION ALL SELECT doc_id, 'zip', doc_id || '.zip', doc_id || '.zip!inner/b.txt', 1, reverse(t) FROM t)
SELECT doc_id, kind, segment, place, length(text) AS chars, md5(text) AS digest FROM s""")
def segments_told(spark, sf_dir):
    """Every text packed as gzip, PDF, office document and zip, and what a lateral join with ``segments`` takes out again."""
    docs = detection._texts(spark, sf_dir).select("doc_id", F.concat(F.lit("T:"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "?")).alias("text"))
    made = docs.withColumn("kind", F.explode(F.array(*map(F.lit, _KINDS)))).select("doc_id", "kind", F.concat_ws(".", "doc_id", "kind").alias("path"), _packed("kind", "text").alias("content"))
    return _viewed(spark, made, "SELECT doc_id, kind, segment, place, CAST(length(text) AS BIGINT) AS chars, md5(CAST(text AS BINARY)) AS digest FROM {docs} d, LATERAL segments(d.content, d.path)")


@query("archives_inspected", f"""{sql.scored()}, labels AS (SELECT doc_id, label, count(*) AS c, min(struct_pack(a := start, b := ordinal)) AS o FROM told GROUP BY doc_id, label),
rolled AS (SELECT doc_id, string_agg(label || 'x' || c || '@second.txt', ',' ORDER BY o) AS items FROM labels GROUP BY doc_id)
SELECT s.doc_id || '.zip' AS path, 'zip' AS true_type, CASE WHEN octet_length(encode(coalesce(d.text, ''))) > 0 THEN 2 ELSE 1 END::BIGINT AS segments, n, identities, score, band, coalesce(items, '') AS items FROM scored s JOIN documents d ON d.doc_id = s.doc_id LEFT JOIN rolled r ON r.doc_id = s.doc_id""")
def archives_inspected(spark, sf_dir):
    """Archives of two files each, of which the second is a text: findings of all segments as one report, each with its segment."""
    docs = detection._texts(spark, sf_dir)
    attached = docs.select(F.concat("doc_id", F.lit(".zip")).alias("path"), _packed(F.lit("two.zip"), F.coalesce("text", F.lit(""))).alias("content"))
    items = F.array_join(F.transform("items", lambda i: F.concat(i["label"], F.lit("x"), i["count"], F.lit("@"), F.element_at(F.split(i["segment"], "!"), -1))), ",")
    return inspect.inspected(attached, enabled=detection.TOLD).select("path", "true_type", "segments", "n", "identities", "score", "band", items.alias("items"))


# --- rules of a caller's own ---

OWN = Detector("OWN_PAIR", "PAIR", "BUSINESS_IDENTIFIER", "LOW", "[0-9]{2}")


@query("rules_registered", """WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[0-9]{2}')) AS v, unnest(list_slice(regexp_split_to_array(text, '[0-9]{2}'), 1, -2)) AS b, generate_subscripts(regexp_extract_all(text, '[0-9]{2}'), 1) AS i FROM (SELECT doc_id, replace(text, chr(8203), '') AS text FROM documents WHERE regexp_matches(text, '[0-9]{2}'))),
p AS (SELECT *, (sum(length(b) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2)::INT AS start FROM m)
SELECT doc_id, start, start + 2 AS "end", v AS value FROM p WHERE v::INT % 3 = 0 AND start > 0 AND text[start] <> '-'""")
def rules_registered(spark, sf_dir):
    """Findings of a rule that a caller adds, with a predicate of a value, its text and its place."""
    mine = rules.Rules().registered(OWN, lambda value, text, start: (value.cast("int") % 3 == 0) & (start > 0) & (F.substring(text, start, F.lit(1)) != "-"))
    rows = scan.exploded(mine.scan(detection._texts(spark, sf_dir), enabled=[OWN.id]), "doc_id", "scanned")
    return rows.select("doc_id", "f.start", "f.end", F.substring("scanned", F.col("f.start") + 1, F.col("f.end") - F.col("f.start")).alias("value"))


# --- policies and receivers as rows ---

_LOOSE = sanitize.Policy({d.id: sanitize.Switches(d.id != "EMAIL" and k % 4 != 0, k % 3 != 0, False, True) for k, (_, d) in enumerate(sql.TOLD)})
_OFF, _SEEN = (", ".join(sql.quoted(k) for k, s in _LOOSE.rules.items() if test(s)) for test in (lambda s: not s.enabled, lambda s: s.enabled and not s.mask))
_STRICT_BLOCKS = detection._BLOCKS
_HALF = "CAST(substring(source, 4) AS INT) % 2"
_BY_SOURCE = sql.FOUND.replace("SELECT doc_id, translate(", f"SELECT doc_id, {_HALF.replace('CAST(substring(source, 4) AS INT)', 'source[4:]::INT')} = 0 AS strict, translate(", 1).replace("WHERE v <> ''", f"JOIN docs USING (doc_id) WHERE (strict OR rule_id NOT IN ({_OFF})) AND v <> ''", 1)


@query("sanitized_by_source", f"""{_BY_SOURCE}, hidden AS (SELECT f.* FROM found f JOIN docs USING (doc_id) WHERE strict OR rule_id NOT IN ({_SEEN})),
pieces AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER w, 0) AS before, stop - start AS room FROM hidden WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
masked AS (SELECT p.doc_id, string_agg(substring(t, before + 1, start - before) || repeat('X', least(32, greatest(4, room))::INT), '' ORDER BY start) || substring(any_value(t), max(stop) + 1) AS m FROM pieces p JOIN docs d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
acts AS (SELECT doc_id, count(*) AS n, any_value(strict) AND bool_or(rule_id IN ({_STRICT_BLOCKS})) AS blocks FROM found JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n IS NULL THEN 'allow' WHEN blocks THEN 'block' WHEN m IS NOT NULL THEN 'mask' ELSE 'warn' END AS action, coalesce(n, 0) AS n_findings, CASE WHEN n IS NOT NULL AND NOT blocks AND m IS NOT NULL THEN m ELSE d.text END AS sanitized
FROM documents d LEFT JOIN acts a ON a.doc_id = d.doc_id LEFT JOIN masked ON masked.doc_id = d.doc_id""")
def sanitized_by_source(spark, sf_dir):
    """Texts of two kinds of sources, each by the policy of its own, which are rows."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.expr(_HALF).alias("tenant")), spark.sparkContext.defaultParallelism
    docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
    policies = sanitize.policy_rows(spark, [("0", None, detection.STRICT), ("1", None, _LOOSE)])
    told = [d for _, d in sql.TOLD]
    return sanitize.sanitize_by(docs, policies, "tenant", detectors=told).select("doc_id", "action", "n_findings", "sanitized")


@query("forwarded_by_rows", f"{_FANNED} SELECT profile, type, max_severity AS severity, count(*) AS n, sum(CASE profile WHEN 'all' THEN 0 ELSE 2 END)::BIGINT AS n_evidence FROM f GROUP BY profile, type, max_severity")
def forwarded_by_rows(spark, sf_dir):
    """Events fanned out to receivers that are rows of a table."""
    rows = forward.fan_out_by(forward.events(activity.audit_log(spark, sf_dir)), forward.profile_rows(spark, PROFILES))
    seen = F.sum(F.size(F.filter("detections", lambda d: d["evidence"].isNotNull())))
    return rows.groupBy("profile", "type", "severity").agg(F.count("*").alias("n"), seen.alias("n_evidence"))


# --- events of files ---

_BODY = '{"f":"%%file.name%%","s":"%%file.sha256%%","m":"%%file.masquerade%%","z":%%file.sizeBytes%%,"r":"%%risk.score%%","b":"%%risk.band%%","d":"%%detections%%","q":"%%detections.0.segment%%","x":"%%risk.factors.0.k%%","none":"%%file.nothing%%"}'
_SEEN_FILES = f"""{detection._INSPECTED},
labels AS (SELECT doc_id, label, count(*) AS c, min(struct_pack(a := start, b := ordinal)) AS o, arg_min(classification, struct_pack(a := start, b := ordinal)) AS cls, max(rank) AS worst FROM told GROUP BY doc_id, label),
rolled AS (SELECT doc_id, string_agg(label || CASE WHEN c > 1 THEN 'x' || c ELSE '' END, ',' ORDER BY o) AS counted, string_agg(label, ',' ORDER BY o) AS names, list(cls ORDER BY o) AS classes, max(worst) AS worst FROM labels GROUP BY doc_id),
ev AS (SELECT d.*, split_part(path, '.', 1)::BIGINT AS doc_id FROM done d),
e AS (SELECT ev.*, CASE WHEN skip_reason IS NULL THEN counted END AS counted, CASE WHEN skip_reason IS NULL THEN names END AS names, CASE WHEN skip_reason IS NULL THEN array_to_string(list_filter(classes, lambda x, i: list_position(classes, x) = i), ',') END AS cat,
    CASE WHEN skip_reason IS NULL THEN worst END AS worst, CASE WHEN skip_reason IS NULL THEN 1 ELSE 0 END AS parts FROM ev LEFT JOIN rolled r ON r.doc_id = ev.doc_id),
w AS (SELECT *, CASE worst WHEN 4 THEN 10 WHEN 3 THEN 7 WHEN 2 THEN 5 ELSE 2 END AS level, CASE worst WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM e)"""
_PAIR = "CASE WHEN coalesce({v}::VARCHAR, '') <> '' THEN '{k}=' || {v} END"


def _pairs(separator: str, fields: dict[str, str]) -> str:
    return f"concat_ws({separator}, " + ", ".join(_PAIR.format(k=k, v=v) for k, v in fields.items()) + ")"


_CEF = _pairs("' '", {"act": "action", "outcome": "action", "cat": "cat", "cnt": "found", "cs1Label": "'aiTool'", "cs1": "'Unknown AI'", "cs2Label": "'detectors'", "cs2": "counted", "fname": "path", "fsize": "size_bytes", "fileType": "true_type", "fileHash": "sha", "cs3Label": "'masquerade'", "cs3": "masquerade", "cn1Label": "'riskScore'", "cn1": "points", "cs4Label": "'riskBand'", "cs4": "grade"})
_LEEF = _pairs("chr(9)", {"devTimeFormat": "'yyyy-MM-dd''T''HH:mm:ss.SSSXXX'", "cat": "cat", "sev": "level", "action": "action", "aiTool": "'Unknown AI'", "findingCount": "found", "detectors": "names", "fileName": "path", "fileType": "true_type", "fileSize": "size_bytes", "fileHash": "sha", "masquerade": "masquerade", "riskScore": "points", "riskBand": "grade"})
_HEAD = "|".join((forward.VENDOR, forward.PRODUCT, forward.VERSION))


@query("events_of_files", f"""{_SEEN_FILES} SELECT path, 'CEF:0|{_HEAD}|dlp.file|dlp.file ' || action || '|' || level || '|' || {_CEF} AS cef, 'LEEF:2.0|{_HEAD}|dlp.file|x09|' || {_LEEF} AS leef,
json_object('name', path, 'trueType', true_type, 'declaredExt', regexp_extract(path, '[^.]*$'), 'masquerade', masquerade, 'sizeBytes', size_bytes, 'parts', parts, 'truncated', false, 'sha256', sha)::VARCHAR AS file,
json_object('name', path, 'size', size_bytes, 'extension', regexp_extract(path, '[^.]*$'), 'mime_type', true_type, 'hash', json_object('sha256', sha))::VARCHAR AS ecs_file, points AS ecs_risk, masquerade AS ecs_masquerade,
'{{"f":"' || path || '","s":"' || sha || '","m":"' || masquerade || '","z":' || size_bytes || ',"r":"' || points || '","b":"' || grade || '","d":"' || coalesce(counted, '') || '","q":"' || CASE WHEN counted IS NULL THEN '' ELSE path END || '","x":"' || CASE WHEN found > 0 THEN 'Severity (' || severity || ')' ELSE '' END || '","none":""}}' AS template,
severity AS shipped_severity, points AS splunk_score, 'dlp.file' AS ndjson_type FROM w""")
def events_of_files(spark, sf_dir):
    """Events of inspected files in all forms, with the file, its risk, and where each finding lies."""
    log = inspect.logged(inspect.inspected(detection._files(spark, sf_dir), detection._SETTINGS, detection.TOLD), None).withColumn("ts", F.lit(None).cast("timestamp"))
    rows = forward.events(log)
    form = {name: make() for name, make in forward.FORMS.items()} | {"template": forward.template(_BODY)}
    made = rows.select(F.col("file.name").alias("path"), *(c.alias(f"{n}_line") for n, c in form.items()))
    inside = lambda name, path: F.get_json_object(f"{name}_line", path)
    return made.select(
        "path", F.col("cef_line").alias("cef"), F.col("leef_line").alias("leef"), inside("json", "$.file").alias("file"), inside("ecs", "$.file").alias("ecs_file"), inside("ecs", "$.event.risk_score").cast("int").alias("ecs_risk"), inside("ecs", "$.dlp.masquerade").cast("boolean").alias("ecs_masquerade"),
        F.col("template_line").alias("template"), F.element_at(F.create_map(*(F.lit(x) for k, v in forward.SHIPPED.items() for x in (v, k))), inside("coralogix", "$.severity").cast("int")).alias("shipped_severity"), inside("splunk", "$.event.risk.score").cast("int").alias("splunk_score"), inside("ndjson", "$.type").alias("ndjson_type"),
    )
