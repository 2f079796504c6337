"""Queries over turns, the audit log and receivers: lists, views, events, bodies, delivery."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import display
from lakewarden.operators import audit, captures, forward, policy
from lakewarden.plans import detection, sql
from lakewarden.plans.queries import _EVENTS, _FANNED, PROFILES
from lakewarden.plans.registry import query
from lakewarden.sources import activity, shared, versioned
from lakewarden.streaming import jobs

_C, _E, _L = f"WITH {sql.CAPTURES}", f"WITH {sql.ENRICHED}", f"WITH {sql.LOG}"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.enriched(activity.captures(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward.events(activity.audit_log(spark, sf_dir))


# --- turns ---


@query("captures_listed", f"{_C} SELECT id, type, tool FROM caps WHERE contains(lower(content), 'th') AND tool = 'Claude' AND type = 'prompt' ORDER BY ts DESC, id LIMIT {captures.MOST_LISTED}")
def captures_listed(spark, sf_dir):
    return captures.listed(activity.captures(spark, sf_dir), "TH", "Claude", "prompt").select("id", "type", "tool")


@query("captures_recent", f"{_C} SELECT id, type, tool FROM caps ORDER BY ts DESC, id LIMIT {captures.RECENT}")
def captures_recent(spark, sf_dir):
    return captures.listed(activity.captures(spark, sf_dir), most=captures.RECENT).select("id", "type", "tool")


@query("captures_starred", f"{_C} SELECT id, type, tool FROM caps WHERE starred AND type = 'response'")
def captures_starred(spark, sf_dir):
    return captures.listed(activity.captures(spark, sf_dir), kind="response", starred=True, most=None).select("id", "type", "tool")


@query("captures_drilled", f"""{_E} SELECT id, 'tag' AS node FROM enr WHERE list_contains(tags, 'AI/ML') UNION ALL SELECT id, 'tool' FROM enr WHERE tool = 'Gemini'
UNION ALL SELECT id, 'item' FROM enr WHERE content = (SELECT content FROM enr WHERE id = (SELECT min(id) FROM enr))""")
def captures_drilled(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    first = rows.orderBy("id").first()
    views = [("tag", "AI/ML"), ("tool", "Gemini"), ("item", first.content if first else "")]
    found = [captures.drilled(rows, node, value).select("id", F.lit(node).alias("node")) for node, value in views]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("tags_fallback", f"""{_E}, t AS (SELECT id, CASE WHEN tool = 'Gemini' THEN NULL WHEN tool = 'Copilot' THEN [] ELSE tags END AS tags, CASE type WHEN 'prompt' THEN tags[1] WHEN 'response' THEN CASE WHEN starred THEN '' END END AS category FROM enr)
SELECT id, array_to_string(coalesce(tags, [CASE WHEN coalesce(category, '') <> '' THEN category ELSE 'General' END]), ',') AS tags FROM t""")
def tags_fallback(spark, sf_dir):
    """Turns whose tags are missing go by their category, or by none; an empty list of tags stays one."""
    rows = _turns(spark, sf_dir)
    tags = F.when(F.col("tool") == "Gemini", F.lit(None)).when(F.col("tool") == "Copilot", F.array().cast("array<string>")).otherwise(F.col("tags"))
    category = F.when(F.col("type") == "prompt", F.col("category")).when(F.col("starred"), "")
    return rows.select("id", F.array_join(captures.tags_or(tags, category), ",").alias("tags"))


_STARRED = "(SELECT min(id) FROM caps WHERE starred AND session_url IS NOT NULL)"


@query("thread_of_starred", f"{_C} SELECT id, type, tool FROM caps WHERE session_url = (SELECT session_url FROM caps WHERE id = {_STARRED})")
def thread_of_starred(spark, sf_dir):
    rows = activity.captures(spark, sf_dir)
    first = rows.where("starred and session_url is not null").agg(F.min("id")).first()[0]
    return captures.thread_of(rows, first).select("id", "type", "tool")


@query("threads_listed", f"""{_C}, t AS (SELECT coalesce(session_url, 'unknown') AS url, max(ts) AS last, count(*) AS n_items FROM caps WHERE length(content) >= 2 GROUP BY ALL)
SELECT url, epoch(last)::BIGINT AS last_time, n_items FROM t ORDER BY last DESC, url LIMIT 20""")
def threads_listed(spark, sf_dir):
    return captures.threads_listed(_turns(spark, sf_dir), 20).select("url", F.unix_seconds("last_time").alias("last_time"), "n_items")


_CLASS = "CASE " + " ".join(f"WHEN contains(lower(tool), '{c}') THEN '{c}'" for c in ("chatgpt", "gemini", "claude", "perplexity", "copilot")) + " ELSE 'default' END"


@query("tool_breakdown", f"""{_C}, t AS (SELECT {_CLASS} AS tool, count(*) AS n, max(ts) AS newest FROM caps WHERE ts > {sql.NOW.format("caps")} - INTERVAL 7 DAY GROUP BY ALL)
SELECT tool, n, row_number() OVER (ORDER BY n DESC, newest DESC, tool) = 1 AS top FROM t""")
def tool_breakdown(spark, sf_dir):
    rows = activity.captures(spark, sf_dir)
    return captures.tool_breakdown(rows, activity.latest(rows))


@query("graph_nodes", f"""{_E}, n AS (SELECT * FROM enr WHERE type = 'prompt' ORDER BY ts DESC, id LIMIT {captures.GRAPH_PROMPTS})
SELECT DISTINCT 'tool:' || tool AS id, 'tool' AS kind, tool AS label FROM n UNION SELECT 'cat:' || t, 'category', t FROM (SELECT unnest(tags) AS t FROM n) UNION SELECT 'prompt:' || sha256(content)[1:16], 'item', left(content, 80) FROM n""")
def graph_nodes(spark, sf_dir):
    return captures.graph_nodes(_turns(spark, sf_dir))


_AGO = "floor((epoch_us({now}) - epoch_us(ts)) / 60000000)::BIGINT".format(now=sql.NOW.format("caps"))
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("turn_display", f"""{_C}, s AS (SELECT *, left(content, 100) || '|' || right(content, 100) || '|' || length(content) AS sample, {_AGO} AS m, CASE WHEN length(content) > 60 THEN left(content, 60) || '…' ELSE content END AS cut, '**' || tool || '** `' || type || '` *x* <' AS md FROM caps WHERE content <> ''),
h AS (SELECT *, list_reduce(list_transform(string_split(sample, ''), lambda c: unicode(c)::BIGINT), lambda a, b: (a * 31 + b) % 4294967296) AS h, strpos(lower(cut), 'th') AS found FROM s)
SELECT id, CASE WHEN h >= 2147483648 THEN '-' || lower(to_base(4294967296 - h, 36)) ELSE lower(to_base(h, 36)) END AS fingerprint,
    CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 10080 THEN (m // 1440) || 'd ago' ELSE month(ts) || '/' || day(ts) || '/' || year(ts) END AS ago,
    CASE WHEN found = 0 THEN {_ESCAPED.format("cut")} ELSE {_ESCAPED.format("left(cut, found - 1)")} || '<mark>' || {_ESCAPED.format("substring(cut, found, 2)")} || '</mark>' || {_ESCAPED.format("substring(cut, found + 2)")} END AS shown,
    '<strong>' || tool || '</strong> <code>' || type || '</code> <em>x</em> <' AS markdown, upper(type[1]) || type[2:] || ' Turn' AS label,
    CASE WHEN contains(lower(tool), 'chatgpt') THEN 'ChatGPT' WHEN contains(lower(tool), 'gemini') THEN 'Gemini' WHEN contains(lower(tool), 'claude') THEN 'Claude' WHEN contains(lower(tool), 'perplexity') THEN 'Perplexity' WHEN contains(lower(tool), 'copilot') THEN 'Copilot' ELSE 'Unknown AI' END AS host_tool FROM h""")
def turn_display(spark, sf_dir):
    rows = activity.captures(spark, sf_dir).where("content <> ''")
    now = activity.latest(activity.captures(spark, sf_dir))
    marked = F.concat(F.lit("**"), "tool", F.lit("** `"), "type", F.lit("` *x* <"))
    return rows.select(
        "id", display.fingerprint(F.col("content")).alias("fingerprint"), display.relative(F.col("ts"), now).alias("ago"), display.highlighted(F.col("content"), "Th", 60).alias("shown"), display.markdown(marked).alias("markdown"),
        display.humanized(F.concat("type", F.lit("_turn"))).alias("label"), display.tool_of(F.concat(F.lit("www."), F.lower("tool"), F.lit(".example"))).alias("host_tool"),
    )


@query("prompts_finalized", f"""{_C}, c AS (SELECT *, coalesce(session_url, 'none') AS session, lead(ts) OVER (PARTITION BY coalesce(session_url, 'none') ORDER BY ts, id) AS next FROM caps),
p AS (SELECT *, least(ts + INTERVAL 15 SECOND, coalesce(next + INTERVAL 500 MILLISECOND, ts + INTERVAL 15 SECOND)) AS final_ts FROM c WHERE type = 'prompt'),
m AS (SELECT session, ts + INTERVAL 9 SECOND AS moved, id || '/moved' AS there FROM c WHERE starred)
SELECT p.id, epoch_ms(final_ts) AS final_ms, coalesce(max_by(there, moved), any_value(session_url), 'none') AS url FROM p LEFT JOIN m ON m.session = p.session AND moved > p.ts AND moved <= final_ts GROUP BY p.id, final_ts""")
def prompts_finalized(spark, sf_dir):
    turns = activity.captures(spark, sf_dir).withColumn("session", F.coalesce("session_url", F.lit("none"))).withColumn("url", F.col("session"))
    moves = turns.where("starred").select("session", (F.col("ts") + F.expr("INTERVAL 9 SECOND")).alias("ts"), F.concat("id", F.lit("/moved")).alias("url"))
    return jobs.finalized(turns, moves).select("id", F.unix_millis("final_ts").alias("final_ms"), "url")


@query("stars_toggled", f"{_C} SELECT id, CASE WHEN tool = 'Claude' THEN NOT starred ELSE starred END AS starred FROM caps")
def stars_toggled(spark, sf_dir):
    """Stars of a table in which those of one tool are toggled: only the rows that change are written."""
    table = versioned.Table(spark, shared.new_path(spark, "stars"), ["id"])
    table.put(activity.captures(spark, sf_dir).select("id", "tool", "starred"))
    captures.toggled(table, F.col("tool") == "Claude")
    return table.read().select("id", "starred")


# --- the audit log ---


@query("log_newest", f"{_L} SELECT id FROM log ORDER BY ts DESC, id LIMIT 200")
def log_newest(spark, sf_dir):
    return audit.page(activity.audit_log(spark, sf_dir), 0, 200).select("id")


@query("facets_ordered", f"""{_L}, f AS (SELECT 'tool' AS facet, tool AS name, count(*) AS n FROM log GROUP BY tool UNION ALL SELECT 'severity', max_severity, count(*) FROM log GROUP BY max_severity)
SELECT facet, name, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, name) AS place FROM f""")
def facets_ordered(spark, sf_dir):
    return audit.ordered(audit.facets(activity.audit_log(spark, sf_dir)))


# --- events ---

_ITEM = "json_object('label', label{k}, 'classification', class{k}, 'severity', grade{k}, 'count', count{k}{e}, 'segment', NULL)"
_GRADES = sql.listed(d.severity for d in policy.DETECTORS[:100])
_STAMP = "strftime(date_trunc('second', e.ts), '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(e.ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z'"


def _event(evidence: bool, ts: str = "stamp") -> str:
    extra = ", 'evidence', '••••'" if evidence else ""
    return f"json_object('type', type, 'ts', {ts}, 'vendor', '{forward.VENDOR}', 'product', '{forward.PRODUCT}', 'version', '{forward.VERSION}', 'severity', max_severity, 'outcome', outcome, 'aiTool', tool, 'url', url, 'id', id, 'detections', json_array({_ITEM.format(k=1, e=extra)}, {_ITEM.format(k=2, e=extra)}), 'classifications', CASE WHEN class1 = class2 THEN json_array(class1) ELSE json_array(class1, class2) END, 'findingCount', total_findings, 'file', NULL, 'risk', NULL, 'content', NULL, 'actor', NULL, 'detail', '{{}}'::JSON)"


_WIRED = f"{_EVENTS}, w AS (SELECT e.*, {_GRADES}[ev.k + 1] AS grade1, {_GRADES}[(ev.k * 7 + 3) % 100 + 1] AS grade2, {_STAMP} AS stamp FROM e JOIN ev ON ev.event_id = e.id)"
_NAMES = (forward.VENDOR, forward.PRODUCT, forward.VERSION)


@query("events_wire", f"""{_WIRED} SELECT id, {_event(True)}::VARCHAR AS json,
    json_object('time', epoch_us(ts) // 1000000, 'host', '{_NAMES[1]}', 'source', '{_NAMES[0]}', 'sourcetype', 'dlp', 'event', {_event(True)})::VARCHAR AS splunk,
    json_object('@timestamp', stamp, 'event', json_object('kind', 'alert', 'category', json_array('intrusion_detection'), 'action', outcome, 'severity', level, 'dataset', '{_NAMES[1]}', 'module', '{_NAMES[0]}', 'provider', '{_NAMES[0]}'), 'observer', json_object('vendor', '{_NAMES[0]}', 'product', '{_NAMES[1]}', 'version', '{_NAMES[2]}'),
        'rule', json_object('name', type), 'labels', json_object('ai_tool', tool, 'classifications', cat, 'outcome', outcome), 'dlp', json_object('detections', json_array({_ITEM.format(k=1, e=", 'evidence', '••••'")}, {_ITEM.format(k=2, e=", 'evidence', '••••'")}), 'findingCount', total_findings, 'detail', '{{}}'::JSON), 'url', json_object('full', url))::VARCHAR AS ecs,
    json_object('applicationName', '{_NAMES[0]}', 'subsystemName', 'dlp', 'computerName', '{_NAMES[1]}', 'severity', CASE max_severity WHEN 'LOW' THEN 3 WHEN 'MEDIUM' THEN 4 WHEN 'HIGH' THEN 5 ELSE 6 END, 'timestamp', epoch_us(ts) // 1000, 'category', type, 'className', tool, 'methodName', outcome, 'text', {_event(True)})::VARCHAR AS shipped,
    '{{"t":"' || type || '","p":"' || label2 || '/' || total_findings || '","d":"' || label1 || CASE WHEN count1 > 1 THEN 'x' || count1 ELSE '' END || ',' || label2 || '","c":"' || cat || '","none":""}}' AS template FROM w""")
def events_wire(spark, sf_dir):
    body = '{"t":"%%type%%","p":"%%detections.1.label%%/%%findingCount%%","d":"%%detections%%","c":"%%classifications%%","none":"%%risk.score%%%%nothing.at.all%%%%file%%"}'
    return _events(spark, sf_dir).select("id", forward.as_json(forward._event()).alias("json"), forward.splunk().alias("splunk"), forward.ecs().alias("ecs"), forward.shipped().alias("shipped"), forward.template(body).alias("template"))


@query("events_captured", f"{_E} SELECT id, type || '.captured' AS type, 'captured' AS outcome, coalesce(session_url, '') AS url, tokens::VARCHAR AS tokens, array_to_string(tags, ',') AS tags, tags[1] AS category, length(content) AS chars FROM enr")
def events_captured(spark, sf_dir):
    rows = forward.captured(_turns(spark, sf_dir))
    return rows.select("id", "type", "outcome", "url", *(F.variant_get("detail", f"$.{k}", "string").alias(k) for k in ("tokens", "category")), F.array_join(F.variant_get("detail", "$.tags", "array<string>"), ",").alias("tags"), F.length("content").cast("long").alias("chars"))


@query("events_of_settings", f"""WITH {detection._RULES} SELECT 'policy.changed' AS type, 'MEDIUM' AS severity, 'changed' AS outcome, 0::BIGINT AS finding_count, (count(*) FILTER (enabled))::VARCHAR AS detectors, (count(*) FILTER (block))::VARCHAR AS blocking, count(DISTINCT tenant) AS tenants FROM rules GROUP BY tenant
UNION ALL SELECT 'dlp.block', 'CRITICAL', 'block', 1, NULL, NULL, 1""")
def events_of_settings(spark, sf_dir):
    """The events of all customers' policies as they are saved, and the sample that receivers are tried with."""
    now = datetime(2024, 1, 1)
    changed = forward.policy_changed(policy.summary(detection._rules(spark, sf_dir), "tenant"), now)
    rows = changed.unionByName(forward.sample(spark, now))
    return rows.select("type", "severity", "outcome", "finding_count", *(F.try_variant_get("detail", f"$.{k}", "string").alias(n) for k, n in (("detectorsEnabled", "detectors"), ("detectorsBlocking", "blocking"))), F.lit(1).cast("long").alias("tenants"))


# --- receivers ---

_SPOOLED = f"{_FANNED}, s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY profile ORDER BY ts DESC, id DESC) <= {forward.MOST_SPOOLED}), b AS (SELECT *, ((row_number() OVER (PARTITION BY profile ORDER BY ts, id) - 1) // size)::BIGINT AS batch FROM s)"


def _spooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward.spooled(forward.fan_out(_events(spark, sf_dir), PROFILES))


@query("spool_pruned", f"{_SPOOLED} SELECT profile, count(*) AS n FROM b WHERE profile <> 'grave' GROUP BY profile")
def spool_pruned(spark, sf_dir):
    """What waits for receivers that are still there: one of three is gone."""
    left = [p for p in PROFILES if p.id != "grave"]
    return forward.pruned(_spooled(spark, sf_dir), forward.receivers(spark, left)).groupBy("profile").agg(F.count("*").alias("n"))


@query("event_views", f"{_FANNED} SELECT profile, count(*) AS n, CASE profile WHEN 'all' THEN 0 ELSE 2 * count(*) END AS n_evidence, 0::BIGINT AS n_content FROM f GROUP BY profile")
def event_views(spark, sf_dir):
    """What each receiver may see: one that sees nothing gets no evidence either."""
    rows = forward.fan_out(_events(spark, sf_dir), PROFILES)
    seen = F.sum(F.size(F.filter("detections", lambda d: d["evidence"].isNotNull())))
    return rows.groupBy("profile").agg(F.count("*").alias("n"), seen.alias("n_evidence"), F.count("content").alias("n_content"))


_LINES = f"""{_WIRED.replace("WITH ", "WITH ", 1)}, x AS (SELECT 'all' AS profile, 20 AS size, id, ts, {_event(False)}::VARCHAR AS line FROM w UNION ALL SELECT 'files', 7, id, ts, {_event(True)}::VARCHAR FROM w WHERE rank >= 4 AND type = 'dlp.file'
    UNION ALL SELECT 'grave', 50, id, ts, 'CEF:0|{"|".join(_NAMES)}|' || type || '|' || type || ' ' || outcome || '|' || level || '|rt=' || (epoch_us(ts) // 1000) || ' act=' || outcome || ' outcome=' || outcome || ' cat=' || cat || ' cnt=' || total_findings || ' request=' || url || ' cs1Label=aiTool cs1=' || tool || ' cs2Label=detectors cs2=' || label1 || CASE WHEN count1 > 1 THEN 'x' || count1 ELSE '' END || ',' || label2 FROM w WHERE rank >= 3),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY profile ORDER BY ts DESC, id DESC) <= {forward.MOST_SPOOLED}), b AS (SELECT *, ((row_number() OVER (PARTITION BY profile ORDER BY ts, id) - 1) // size)::BIGINT AS batch FROM s),
g AS (SELECT profile, batch, count(*) AS n, CASE WHEN profile = 'all' THEN string_agg(line, ',' ORDER BY ts, id) ELSE string_agg(line, E'\\n' ORDER BY ts, id) END AS lines FROM b GROUP BY profile, batch)"""


@query("batch_bodies", f"""{_LINES} SELECT profile, batch, n, CASE profile WHEN 'grave' THEN lines WHEN 'files' THEN lines || chr(10) ELSE CASE WHEN n = 1 THEN lines ELSE '{{"vendor":"{_NAMES[0]}","product":"{_NAMES[1]}","version":"{_NAMES[2]}","count":' || n || ',"events":[' || lines || ']}}' END END AS body,
    CASE profile WHEN 'grave' THEN 'text/plain' WHEN 'files' THEN 'application/x-ndjson' ELSE 'application/json' END AS content_type FROM g""")
def batch_bodies(spark, sf_dir):
    return forward.serialized(_spooled(spark, sf_dir), PROFILES).select("profile", "batch", "n", "body", "content_type")


@query("batches_due", f"{_SPOOLED} SELECT profile, count(*) AS n FROM b WHERE batch = 0 GROUP BY profile")
def batches_due(spark, sf_dir):
    return forward.due(_spooled(spark, sf_dir), PROFILES, datetime(2030, 1, 1)).groupBy("profile").agg(F.count("*").alias("n"))


def _answer(request: dict) -> forward.Reply:
    """A receiver for tests: busy for bodies of an even length, refusing those that a third divides, else content."""
    size = len(request["body"])
    return forward.Reply(503, "busy") if size % 2 == 0 else forward.Reply(400, "no") if size % 3 == 0 else forward.Reply(200)


_ANSWERED = f"""{_LINES}, bodies AS (SELECT profile, batch, n, length(CASE profile WHEN 'grave' THEN lines WHEN 'files' THEN lines || chr(10) ELSE CASE WHEN n = 1 THEN lines ELSE '{{"vendor":"{_NAMES[0]}","product":"{_NAMES[1]}","version":"{_NAMES[2]}","count":' || n || ',"events":[' || lines || ']}}' END END) AS size FROM g),
tries AS (SELECT profile, batch, n, CASE WHEN size % 2 = 0 THEN 503 WHEN size % 3 = 0 THEN 400 ELSE 200 END AS status FROM bodies)"""


@query("delivery_attempts", f"{_ANSWERED} SELECT profile, batch, status, status = 200 AS ok, CASE WHEN status = 503 THEN 5 ELSE 1 END AS attempts FROM tries")
def delivery_attempts(spark, sf_dir):
    return _attempts(spark, sf_dir).select("profile", "batch", "status", "ok", "attempts")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = forward.addressed(forward.serialized(_spooled(spark, sf_dir), PROFILES), PROFILES)
    return forward.sent(requests, PROFILES, _answer, lambda seconds: None).withColumn("at", F.col("batch"))


_HEALTH = f"""{_ANSWERED}, base AS (SELECT profile, coalesce(sum(n) FILTER (status = 200), 0)::BIGINT AS sent, count(*) FILTER (status <> 200) AS failed, max(batch) FILTER (status = 200) AS good, arg_max(status, batch) AS last_status FROM tries GROUP BY profile),
states AS (SELECT b.*, (SELECT count(*) FROM tries t WHERE t.profile = b.profile AND status <> 200 AND (good IS NULL OR batch > good)) AS consecutive_failures FROM base b)"""


@query("receiver_health", f"{_HEALTH} SELECT profile, sent, failed, last_status, consecutive_failures FROM states")
def receiver_health(spark, sf_dir):
    return forward.health(_attempts(spark, sf_dir)).select("profile", "sent", "failed", "last_status", "consecutive_failures")


@query("receivers", f"""{_HEALTH}, queues AS (SELECT profile, sum(n)::BIGINT AS queued FROM tries GROUP BY profile)
SELECT profile, queued, sent, CASE WHEN consecutive_failures > 0 THEN 'failing' WHEN good IS NOT NULL THEN 'healthy' ELSE 'idle' END AS state FROM states JOIN queues USING (profile)""")
def receivers(spark, sf_dir):
    known = forward.receivers(spark, PROFILES)
    spooled = forward.pruned(_spooled(spark, sf_dir), known)
    return forward.overview(known, spooled, forward.health(_attempts(spark, sf_dir))).select("profile", "queued", "sent", "state")


# --- streams ---


def _stream(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select(*names).schema
    return jobs.table(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_settled", """WITH e AS (SELECT user_id % 50 AS session, ts::TIMESTAMP AS ts, event_id, event_type FROM events),
l AS (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts) AS before FROM e), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT session::VARCHAR AS session, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts) + INTERVAL 1 HOUR) // 1000 AS last_ms, count(*) AS n, max_by(event_type, struct_pack(a := ts, b := event_id)) AS content FROM s GROUP BY session, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 MINUTE""")
def stream_settled(spark, sf_dir):
    """Sessions that were quiet for an hour and that the watermark has closed when the stream has read all there is."""
    rows = _stream(spark, sf_dir, "ts", "event_id", "user_id", "event_type").select("ts", F.col("event_id").alias("id"), (F.col("user_id") % 50).cast("string").alias("session_url"), F.col("event_type").alias("content"))
    found = jobs.drained(jobs.settled(rows, "1 hour"), shared.new_path(spark, "settled"), shared.new_path(spark, "settled-state"))
    return found.select("session", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "n", "content")


@query("stream_distinct", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_distinct(spark, sf_dir):
    """Turns that come twice within the watermark count once."""
    once = _stream(spark, sf_dir, "ts", "event_id", "event_type")
    twice = once.unionByName(_stream(spark, sf_dir, "ts", "event_id", "event_type"))
    found = jobs.drained(jobs.distinct(twice, ["event_id"]), shared.new_path(spark, "distinct"), shared.new_path(spark, "distinct-state"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"))
