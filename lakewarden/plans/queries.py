"""The queries over the driver's tables, each with its SQL where SQL can tell its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import catalogue, text
from lakewarden.functions.detector import java_pattern
from lakewarden.operators import audit, captures, files, forward, sanitize, scan
from lakewarden.plans import sql
from lakewarden.plans.registry import query
from lakewarden.sources import activity, shared
from lakewarden.streaming import jobs

PROFILES = (
    forward.Profile("all"),
    forward.Profile("grave", min_severity="HIGH", content="redacted", form="cef", batch_size=50),
    forward.Profile("files", events=("dlp.file",), min_severity="CRITICAL", content="full", form="ndjson", batch_size=7),
)
_C, _E, _L = f"WITH {sql.CAPTURES}", f"WITH {sql.ENRICHED}", f"WITH {sql.LOG}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, dealt out if the table has fewer splits than there are cores: to scan one takes far longer than to send it. Larger tables stay as they are read."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.enriched(activity.captures(spark, sf_dir))


# --- turns ---


@query("capture_measures", f"{_E} SELECT id, tokens, array_to_string(tags, ',') AS tags FROM enr")
def capture_measures(spark, sf_dir):
    return _enriched(spark, sf_dir).select("id", "tokens", F.array_join("tags", ",").alias("tags"))


@query("capture_stats", f"{_E} SELECT count(*) AS n_items, coalesce(sum(tokens), 0)::BIGINT AS n_tokens, count(*) FILTER (type = 'prompt') AS n_prompts, count(*) FILTER (type = 'response') AS n_responses, count(*) FILTER (starred) AS n_starred FROM enr")
def capture_stats(spark, sf_dir):
    return captures.stats(_enriched(spark, sf_dir))


@query("captures_without_repeats", f"""{_C}, l AS (SELECT *, lag(content) OVER w AS c, lag(tool) OVER w AS t, lag(type) OVER w AS y FROM caps WINDOW w AS (ORDER BY ts, id))
SELECT id, type, tool FROM l WHERE c IS NULL OR NOT (c = content AND t = tool AND y = type)""")
def captures_without_repeats(spark, sf_dir):
    return captures.without_repeats(activity.captures(spark, sf_dir)).select("id", "type", "tool")


@query("captures_retained", f"""WITH RECURSIVE {sql.CAPTURES}, n AS MATERIALIZED (SELECT *, length(content) + {captures.ITEM_BYTES} AS cost, row_number() OVER (ORDER BY ts DESC, id) AS k FROM caps),
r AS (SELECT 0::BIGINT AS k, 0::BIGINT AS items, 0::BIGINT AS bytes, false AS kept, false AS overflow
    UNION ALL SELECT k, items + fits::INT, bytes + CASE WHEN fits OR spare THEN cost ELSE 0 END, fits OR spare, spare AND NOT fits FROM (
        SELECT n.k, items, bytes, cost, items < {captures.MOST_ITEMS} AND bytes + cost <= {captures.MOST_BYTES} AS fits, starred AND bytes + cost <= {captures.MOST_BYTES + captures.STARRED_BYTES} AS spare FROM r JOIN n ON n.k = r.k + 1))
SELECT id, type, tool, starred, overflow FROM r JOIN n USING (k) WHERE kept""")
def captures_retained(spark, sf_dir):
    return captures.retained(activity.captures(spark, sf_dir)).select("id", "type", "tool", "starred", "overflow")


#: A budget that is used up: turns of every third conversation come twice, and ids are those of conversations.
_TIGHT = (60, 60_000, 20_000)


@query("captures_budget_bites", f"""WITH RECURSIVE {sql.CAPTURES}, t AS (SELECT string_split(id, '-')[1] AS id, ts, starred, type, tool, content FROM caps, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR string_split(id, '-')[1]::BIGINT % 3 = 0),
n AS MATERIALIZED (SELECT *, length(content) + {captures.ITEM_BYTES} AS cost, row_number() OVER (ORDER BY ts DESC, id, starred, length(content)) AS k FROM t),
r AS (SELECT 0::BIGINT AS k, 0::BIGINT AS items, 0::BIGINT AS bytes, false AS kept, false AS overflow
    UNION ALL SELECT k, items + fits::INT, bytes + CASE WHEN fits OR spare THEN cost ELSE 0 END, fits OR spare, spare AND NOT fits FROM (
        SELECT n.k, items, bytes, cost, items < {_TIGHT[0]} AND bytes + cost <= {_TIGHT[1]} AS fits, starred AND bytes + cost <= {sum(_TIGHT[1:])} AS spare FROM r JOIN n ON n.k = r.k + 1))
SELECT id, epoch_us(ts) AS ts, type, tool, starred, overflow FROM r JOIN n USING (k) WHERE kept""")
def captures_budget_bites(spark, sf_dir):
    """A budget that does not hold all turns, some of which share their id with others or come twice."""
    turns = activity.captures(spark, sf_dir).withColumn("id", F.split("id", "-")[0])
    twice = turns.unionByName(turns.where(F.col("id").cast("long") % 3 == 0))
    return captures.retained(twice, *_TIGHT).select("id", F.unix_micros("ts").alias("ts"), "type", "tool", "starred", "overflow")


@query("threads", f"""{_E}, t AS (SELECT *, coalesce(session_url, 'unknown') AS u FROM enr),
x AS (SELECT u, ts, id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, id, place) AS k FROM x),
g AS (SELECT u, tag, count(*) AS n, min(k) AS first FROM o GROUP BY ALL),
top AS (SELECT u, tag AS top_tag FROM g QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, first) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, id) AS k FROM t)
SELECT u AS url, coalesce(max_by(content, k) FILTER (type = 'prompt'), min_by(content, k)) AS preview, min_by(tool, k) AS tool, epoch(max(ts))::BIGINT AS last_time, bool_or(starred) AS has_starred, count(*) AS n_items, any_value(top_tag) AS top_tag
FROM r JOIN top USING (u) GROUP BY u""")
def threads(spark, sf_dir):
    return captures.threads(_enriched(spark, sf_dir)).withColumn("last_time", F.unix_seconds("last_time"))


@query("recall", f"""{_E}, n AS (SELECT * FROM enr ORDER BY ts DESC, id LIMIT {captures.NEWEST}),
h AS (SELECT * FROM n WHERE type = 'prompt' AND contains(lower(substring(content, 1, {captures.PREFIX})), 'tion') QUALIFY row_number() OVER (PARTITION BY content ORDER BY ts DESC, id) = 1)
SELECT id, tool, substring(content, 1, {captures.SHOWN}) AS content, length(content) AS full_length FROM h ORDER BY ts DESC, id LIMIT {captures.HITS}""")
def recall(spark, sf_dir):
    return captures.recall(_enriched(spark, sf_dir), "tion").select("id", "tool", "content", F.col("full_length").cast("long").alias("full_length"))


@query("tag_cloud", f"""{_E}, c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM enr) GROUP BY tag ORDER BY n DESC, tag LIMIT {captures.TOP_TAGS}) SELECT tag, n, 10 + 6 * n / max(n) OVER () AS size FROM c""")
def tag_cloud(spark, sf_dir):
    return captures.tag_cloud(_enriched(spark, sf_dir))


@query("prompt_graph", f"""{_E}, n AS (SELECT * FROM enr WHERE type = 'prompt' ORDER BY ts DESC, id LIMIT {captures.GRAPH_PROMPTS})
SELECT DISTINCT unnest(list_concat(['tool:' || tool], list_transform(tags, lambda t: 'cat:' || t))) AS source, 'prompt:' || sha256(content)[1:16] AS target FROM n""")
def prompt_graph(spark, sf_dir):
    return captures.graph(_enriched(spark, sf_dir))


_CLASS = "CASE " + " ".join(f"WHEN contains(lower(tool), '{c}') THEN '{c}'" for c in ("chatgpt", "gemini", "claude", "perplexity", "copilot")) + " ELSE 'default' END"


def _bucket_sql(frame: str) -> str:
    days, unit = captures.FRAMES[frame]
    return f"""{_C}, b AS (SELECT epoch(date_trunc('{unit}', ts))::BIGINT AS bucket, {_CLASS} AS tool, count(*) AS n FROM caps WHERE ts >= {sql.NOW.format("caps")} - INTERVAL {days} DAY GROUP BY ALL)
SELECT bucket, tool, n, (sum(n) OVER (PARTITION BY bucket))::BIGINT AS total, 100 * n / (sum(n) OVER (PARTITION BY bucket))::BIGINT AS share FROM b"""


def _bucket_query(frame: str):
    @query(f"buckets_{frame}", _bucket_sql(frame))
    def run(spark, sf_dir):
        rows = activity.captures(spark, sf_dir)
        return captures.buckets(rows, frame, activity.latest(rows))

    return run


for _frame in captures.FRAMES:
    _bucket_query(_frame)


@query("week_over_week", f"""{_C}, w AS (SELECT count(*) FILTER (ts > {sql.NOW.format("caps")} - INTERVAL 7 DAY) AS this_week, count(*) FILTER (ts > {sql.NOW.format("caps")} - INTERVAL 14 DAY AND ts <= {sql.NOW.format("caps")} - INTERVAL 7 DAY) AS last_week FROM caps)
SELECT this_week, last_week, CASE WHEN last_week = 0 THEN CASE WHEN this_week > 0 THEN 100 ELSE 0 END ELSE floor((this_week - last_week) * 100 / last_week + 0.5) END::BIGINT AS change FROM w""")
def week_over_week(spark, sf_dir):
    rows = activity.captures(spark, sf_dir)
    return captures.week_over_week(rows, activity.latest(rows))


@query("streak", f"""{_C}, d AS (SELECT DISTINCT ts::DATE AS day FROM caps), k AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM d)
SELECT count(*) FILTER (day + (k - 1)::INT = (SELECT max(day) FROM d)) AS streak FROM k WHERE k <= 365""")
def streak(spark, sf_dir):
    rows = activity.captures(spark, sf_dir)
    return captures.streak(rows, activity.latest(rows))


# --- the audit log ---


@query("log_stats", f"{_L} SELECT count(*) AS n_entries, count(*) FILTER (action = 'mask') AS n_mask, count(*) FILTER (action = 'block') AS n_block, count(*) FILTER (action = 'warn') AS n_warn, count(*) FILTER (starts_with(action, 'file')) AS n_file, sum(total_findings)::BIGINT AS n_findings FROM log")
def log_stats(spark, sf_dir):
    return audit.stats(activity.audit_log(spark, sf_dir))


@query("log_band", f"""{_L}, {sql.rules()}, s AS (SELECT count(*) FILTER (ts > {sql.NOW.format("log")} - INTERVAL 1 DAY AND action = 'mask') AS masked, count(*) FILTER (ts > {sql.NOW.format("log")} - INTERVAL 1 DAY AND action = 'block') AS blocked,
    count(*) FILTER (starts_with(action, 'file')) AS files, coalesce(sum(total_findings), 0)::BIGINT AS findings FROM log WHERE ts > {sql.NOW.format("log")} - INTERVAL 7 DAY),
c AS (SELECT floor(count(*) FILTER (default_on) * 100 / count(*) + 0.5)::BIGINT AS coverage FROM rules)
SELECT *, CASE WHEN coverage >= 70 THEN 'good' WHEN coverage >= 40 THEN 'warn' ELSE 'bad' END AS state FROM s, c""")
def log_band(spark, sf_dir):
    log = activity.audit_log(spark, sf_dir)
    return audit.band(log, catalogue.table(spark), activity.latest(log))


@query("log_facets", f"{_L} SELECT 'tool' AS facet, tool AS name, count(*) AS n FROM log GROUP BY tool UNION ALL SELECT 'severity', max_severity, count(*) FROM log GROUP BY max_severity")
def log_facets(spark, sf_dir):
    return audit.facets(activity.audit_log(spark, sf_dir))


_HAY = "lower(concat_ws(' ', tool, url, CASE WHEN class1 = class2 THEN class1 ELSE class1 || ' ' || class2 END, label1 || ' ' || label2))"


@query("log_search", f"{_L} SELECT id, action, tool, max_severity FROM log WHERE starts_with(action, 'file') AND max_severity = 'HIGH' AND contains({_HAY}, 'pass')")
def log_search(spark, sf_dir):
    return audit.matching(activity.audit_log(spark, sf_dir), action="file", severity="HIGH", q="PASS").select("id", "action", "tool", "max_severity")


@query("log_page", f"{_L} SELECT id, action, tool, max_severity FROM log WHERE tool = 'Claude' ORDER BY ts DESC, id LIMIT {audit.PAGE} OFFSET {2 * audit.PAGE}")
def log_page(spark, sf_dir):
    return audit.page(audit.matching(activity.audit_log(spark, sf_dir), tool="Claude"), 2).select("id", "action", "tool", "max_severity")


@query("log_retained", f"{_L} SELECT id, max_severity FROM log ORDER BY max_severity IN ('HIGH', 'CRITICAL') DESC, ts DESC, id LIMIT {audit.MOST_ENTRIES}")
def log_retained(spark, sf_dir):
    return audit.retained(activity.audit_log(spark, sf_dir)).select("id", "max_severity")


_HITS = f"""{_L}, r AS (SELECT * FROM log WHERE ts IS NULL OR ts >= {sql.NOW.format("log")} - INTERVAL {audit.HIT_DAYS} DAY),
hits AS (SELECT label, sum(n)::BIGINT AS hits, min(ts) AS since FROM (SELECT label1 AS label, count1 AS n, ts FROM r UNION ALL SELECT label2, count2, ts FROM r) GROUP BY label)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity.audit_log(spark, sf_dir)
    return audit.hits(log, activity.latest(log))


@query("detector_hits", f"{_HITS} SELECT label, hits, epoch_us(since) AS since FROM hits")
def detector_hits(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("since", F.unix_micros(F.col("since").cast("timestamp")))


@query("class_hits", f"{_HITS}, {sql.rules()} SELECT classification, coalesce(sum(hits), 0)::BIGINT AS hits, count(*) AS n_rules FROM rules LEFT JOIN hits USING (label) GROUP BY classification")
def class_hits(spark, sf_dir):
    return audit.by_class(_hits(spark, sf_dir), catalogue.table(spark))


@query("dead_detectors", f"{_HITS}, {sql.rules()} SELECT rule_id, label, classification FROM rules WHERE default_on AND label NOT IN (SELECT label FROM hits)")
def dead_detectors(spark, sf_dir):
    return audit.dead(_hits(spark, sf_dir), catalogue.table(spark))


# --- forwarding ---

_EVENTS = f"""{_L}, e AS (SELECT *, CASE WHEN starts_with(action, 'file') THEN 'dlp.file' WHEN action = 'block' THEN 'dlp.block' WHEN action = 'warn' THEN 'dlp.warn' ELSE 'dlp.mask' END AS type, replace(action, 'file-', '') AS outcome,
    CASE WHEN class1 = class2 THEN class1 ELSE class1 || ',' || class2 END AS cat, CASE max_severity WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 5 WHEN 'HIGH' THEN 7 ELSE 10 END AS level,
    CASE max_severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS rank FROM log)"""
_HEAD = f"{forward.VENDOR}|{forward.PRODUCT}|{forward.VERSION}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward.events(activity.audit_log(spark, sf_dir))


@query("events_cef", f"""{_EVENTS} SELECT id, 'CEF:0|{_HEAD}|' || type || '|' || type || ' ' || outcome || '|' || level || '|rt=' || (epoch_us(ts) // 1000) || ' act=' || outcome || ' outcome=' || outcome || ' cat=' || cat || ' cnt=' || total_findings
    || ' request=' || url || ' cs1Label=aiTool cs1=' || tool || ' cs2Label=detectors cs2=' || label1 || CASE WHEN count1 > 1 THEN 'x' || count1 ELSE '' END || ',' || label2 AS line FROM e""")
def events_cef(spark, sf_dir):
    return _events(spark, sf_dir).select("id", forward.cef().alias("line"))


@query("events_leef", f"""{_EVENTS} SELECT id, 'LEEF:2.0|{_HEAD}|' || type || '|x09|' || concat_ws(chr(9), 'devTime=' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z', 'devTimeFormat=yyyy-MM-dd''T''HH:mm:ss.SSSXXX',
    'cat=' || cat, 'sev=' || level, 'action=' || outcome, 'aiTool=' || tool, 'url=' || url, 'findingCount=' || total_findings, 'detectors=' || label1 || ',' || label2) AS line FROM e""")
def events_leef(spark, sf_dir):
    return _events(spark, sf_dir).select("id", forward.leef().alias("line"))


_ORDER = {"all": ("true", 20), "grave": ("rank >= 3", 50), "files": ("rank >= 4 AND type = 'dlp.file'", 7)}
_FANNED = _EVENTS + ", f AS (" + " UNION ALL ".join(f"SELECT '{p}' AS profile, {n} AS size, id, ts, type, max_severity FROM e WHERE {where}" for p, (where, n) in _ORDER.items()) + ")"


@query("forwarded", f"{_FANNED} SELECT profile, type, max_severity AS severity, count(*) AS n FROM f GROUP BY ALL")
def forwarded(spark, sf_dir):
    return forward.fan_out(_events(spark, sf_dir), PROFILES).groupBy("profile", "type", "severity").agg(F.count("*").alias("n"))


@query("spooled_batches", f"""{_FANNED}, s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY profile ORDER BY ts DESC, id DESC) <= {forward.MOST_SPOOLED}),
b AS (SELECT *, (row_number() OVER (PARTITION BY profile ORDER BY ts, id) - 1) // size AS batch FROM s) SELECT profile, batch::BIGINT AS batch, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM b GROUP BY ALL""")
def spooled_batches(spark, sf_dir):
    rows = forward.spooled(forward.fan_out(_events(spark, sf_dir), PROFILES))
    return rows.groupBy("profile", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# --- texts ---


def _plain_sql() -> str:
    parts = []
    for _, d in sql.PLAIN:
        flags = "".join(f for f in "ims" if f in d.flags)
        pattern = sql.quoted((f"(?{flags})" if flags else "") + d.pattern)
        gate = f"contains(lower(text), {sql.quoted(d.literal)}) AND " if d.literal else ""
        parts.append(f"SELECT {sql.quoted(d.id)} AS rule_id, count(*) AS n_docs, sum(len(regexp_extract_all(text, {pattern})))::BIGINT AS n_matches FROM documents WHERE {gate}regexp_matches(text, {pattern})")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_docs > 0"


@query("candidate_counts", _plain_sql())
def candidate_counts(spark, sf_dir):
    """Candidates, before any gate but the literal one, of the detectors whose patterns SQL can match."""
    docs, found = scan.prepared(_documents(spark, sf_dir), "text"), []
    for _, d in sql.PLAIN:
        found.append(F.when(scan.gate(d, "text"), F.struct(F.lit(d.id).alias("rule_id"), F.regexp_count("text", F.lit(java_pattern(d)[0])).alias("n"))))
    rows = docs.select(F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.groupBy("f.rule_id").agg(F.count("*").alias("n_docs"), F.sum("f.n").alias("n_matches"))


@query("findings")
def findings(spark, sf_dir):
    rows = scan.exploded(scan.scan(_documents(spark, sf_dir)), "doc_id")
    return rows.select("doc_id", "f.rule_id", "f.label", "f.classification", "f.severity", "f.start", "f.end", "f.evidence")


@query("finding_counts")
def finding_counts(spark, sf_dir):
    rows = scan.exploded(scan.scan(_documents(spark, sf_dir)), "doc_id")
    return rows.groupBy("f.rule_id", "f.label", "f.classification").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("sanitized")
def sanitized(spark, sf_dir):
    return sanitize.sanitize(_documents(spark, sf_dir)).select("doc_id", "action", "warn", "n_findings", "max_severity", F.array_join("classifications", ",").alias("classifications"), "sanitized")


@query("document_risk")
def document_risk(spark, sf_dir):
    rows = scan.scan(_documents(spark, sf_dir))
    return sanitize.risk(rows, "doc_id", F.octet_length(F.coalesce("text", F.lit("")))).select("doc_id", "n", "identities", "score", "band", "density", "file_action")


@query("page_text", """SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
    '</(w:p|w:tr|a:p|text:p|row|Row)>|<w:br\\s*/?>', chr(10), 'g'), '</(w:tc|a:tc|text:span|c)>', chr(9), 'g'), '<[^>]+>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&'), '[ \t]{2,}', ' ', 'g') AS text FROM pages""")
def page_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", files.markup_text(F.col("html")).alias("text"))


@query("value_measures", """SELECT c_custkey, round(list_aggregate(string_split(c_name, ''), 'entropy'), 6) AS entropy,
    (regexp_matches(c_name, '[a-z]')::INT + regexp_matches(c_name, '[A-Z]')::INT + regexp_matches(c_name, '[0-9]')::INT + regexp_matches(c_name, '[^a-zA-Z0-9]')::INT) AS diversity, repeat('X', least(32, greatest(4, length(c_name)))::INT) AS mask,
    CASE WHEN length(c_name) <= 4 THEN '••••' ELSE left(c_name, 1) || '••••' || right(c_name, 1) || ' (' || length(c_name) || ')' END AS evidence FROM customer""")
def value_measures(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_name").alias("v"))
    v = F.col("v")
    return rows.select("c_custkey", F.round(text.entropy(v), 6).alias("entropy"), text.diversity(v).alias("diversity"), text.mask_of(F.length(v)).alias("mask"), text.evidence(v, F.lit(False)).alias("evidence"))


# --- streams ---


@query("stream_windows", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS s, event_type, count(*) AS n, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL)
SELECT epoch(s)::BIGINT AS window_start, event_type, n, cents FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts::TIMESTAMP) FROM events) - INTERVAL 2 HOUR""")
def stream_windows(spark, sf_dir):
    """Windows that the watermark has closed when the stream has read all there is."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value").schema
    rows = jobs.windowed(jobs.table(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp")))
    return jobs.drained(rows, shared.new_path(spark, "windows"), shared.new_path(spark, "windows-state"))
