"""Pieces of DuckDB SQL that the queries' oracles share: the same tables, from the same fixed values."""

from __future__ import annotations

from lakewarden.functions.catalogue import DETECTORS
from lakewarden.functions.detector import Detector
from lakewarden.functions import text
from lakewarden.operators import captures, sanitize
from lakewarden.sources import activity


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


CAPTURES = f"""caps AS (SELECT concat_ws('-', conv_id, turn) AS id, CASE WHEN role = 'user' THEN 'prompt' ELSE 'response' END AS type, text AS content,
    {listed(activity.TOOLS)}[conv_id % {len(activity.TOOLS)} + 1] AS tool, make_timestamp((({activity.START} + conv_id * 2220 + turn * 20) * 1000000)::BIGINT) AS ts,
    CASE WHEN conv_id % 11 <> 0 THEN 'https://chat.example/' || conv_id END AS session_url, (conv_id + turn) % 7 = 0 AS starred
    FROM conversations WHERE role IN ('user', 'assistant'))"""

_CUT = f"CASE WHEN length(content) > {captures.MOST_RECEIVED} THEN left(content, {captures.MOST_RECEIVED}) || chr(10) || '[…truncated at 20KB]' ELSE content END"
_FOUND = ", ".join(
    [f"CASE WHEN contains(lower(taken), {quoted(word)}) THEN {quoted(tag)} END" for word, tag in captures.KEYWORDS]
    + [f"CASE WHEN regexp_matches(taken, {quoted(captures.CODE)}) THEN 'Code' END", f"CASE WHEN regexp_matches(trim(taken), {quoted(captures.QUESTION)}) THEN 'Question' END", f"CASE WHEN regexp_matches(lower(taken), {quoted(captures.EXPLAIN)}) THEN 'Explanation' END"]
)
ENRICHED = f"""{CAPTURES},
taken AS (SELECT *, {_CUT} AS taken FROM caps WHERE length(content) >= 2),
found AS (SELECT *, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS f FROM taken),
enr AS (SELECT * EXCLUDE (f, content, taken), CASE WHEN len(f) = 0 THEN ['General'] ELSE list_filter(f, lambda x, i: list_position(f, x) = i)[1:{captures.MOST_TAGS}] END AS tags,
    CASE WHEN length(taken) = 0 THEN 0 ELSE greatest(CASE WHEN regexp_matches(taken, {quoted(captures.CODE_TOKENS)}) THEN ceil(length(taken) / 3.5) ELSE ceil(length(taken) / 4.0) END,
        ceil(len(regexp_split_to_array(trim(taken), '\\s+')) * 1.33)) END::BIGINT AS tokens,
    CASE WHEN length(taken) <= {captures.MOST_CONTENT} THEN taken ELSE left(taken, {captures.MOST_CONTENT}) || chr(10) || chr(10) || '[… truncated: ' || (length(taken) - {captures.MOST_CONTENT}) || ' more characters]' END AS content FROM found)"""

_LABELS, _CLASSES = listed(d.label for d in DETECTORS[:100]), listed(d.data_class for d in DETECTORS[:100])
_CASES = " ".join(f"WHEN event_type = {quoted(k)} THEN {quoted(v)}" for k, v in activity.ACTIONS.items())
LOG = f"""ev AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value, (props ->> '$.k')::INT AS k FROM events),
log AS (SELECT event_id AS id, ts, CASE {_CASES} END AS action, {listed(activity.TOOLS)}[user_id % {len(activity.TOOLS)} + 1] AS tool, 'https://tool.example/u/' || user_id AS url,
    CASE WHEN value < 5 THEN 'LOW' WHEN value < 15 THEN 'MEDIUM' WHEN value < 40 THEN 'HIGH' ELSE 'CRITICAL' END AS max_severity,
    {_LABELS}[k + 1] AS label1, {_CLASSES}[k + 1] AS class1, (k % 4 + 1)::BIGINT AS count1, {_LABELS}[(k * 7 + 3) % 100 + 1] AS label2, {_CLASSES}[(k * 7 + 3) % 100 + 1] AS class2, 1::BIGINT AS count2, (k % 4 + 2)::BIGINT AS total_findings
    FROM ev)"""
NOW = "(SELECT max(ts) FROM {})"


def rules(detectors: tuple[Detector, ...] = DETECTORS) -> str:
    rows = ", ".join(f"({quoted(d.id)}, {quoted(d.label)}, {quoted(d.data_class)}, {str(d.on).lower()})" for d in detectors)
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS r(rule_id, label, classification, default_on))"


def plain(d: Detector) -> bool:
    """Whether a detector's pattern means the same to an engine without look-around and long repeats."""
    return d.on and "(?<" not in d.pattern and "(?=" not in d.pattern and "(?!" not in d.pattern and "{0,4000}" not in d.pattern and d.pattern.isascii()


PLAIN = tuple((k, d) for k, d in enumerate(DETECTORS) if plain(d))


#: Detectors whose findings SQL can tell: no value inside of a match, no check, no guard against placeholders.
TOLD = tuple((k, d) for k, d in PLAIN if not d.group and not d.validator and not d.inline and not d.low)


def _candidates() -> str:
    parts = []
    for k, d in TOLD:
        flags = "".join(f for f in "ims" if f in d.flags)
        pattern = quoted((f"(?{flags})" if flags else "") + d.pattern)
        gate = f"contains(lower(t), {quoted(d.literal)}) AND " if d.literal else ""
        parts.append(f"SELECT doc_id, {k} AS ordinal, unnest(regexp_extract_all(t, {pattern})) AS v, unnest(list_slice(regexp_split_to_array(t, {pattern}), 1, -2)) AS b, generate_subscripts(regexp_extract_all(t, {pattern}), 1) AS i FROM docs WHERE {gate}regexp_matches(t, {pattern})")
    return " UNION ALL ".join(parts)


def _known() -> str:
    rows = ", ".join(f"({k}, {quoted(d.id)}, {quoted(d.label)}, {quoted(d.data_class)}, {quoted(d.severity)}, {d.rank}, {str(d.secret).lower()})" for k, d in TOLD)
    return f"(SELECT * FROM (VALUES {rows}) AS r(ordinal, rule_id, label, classification, severity, rank, secret))"


_ZERO_WIDTH = "".join(text.ZERO_WIDTH)
#: Findings of these detectors, overlaps resolved one finding after the other.
FOUND = f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, translate(nfc_normalize(text), {quoted(_ZERO_WIDTH)}, '') AS t FROM documents),
raw AS MATERIALIZED ({_candidates()}),
placed AS (SELECT doc_id, ordinal, v, sum(length(b)) OVER w + coalesce(sum(length(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM raw WINDOW w AS (PARTITION BY doc_id, ordinal ORDER BY i)),
ranked AS MATERIALIZED (SELECT doc_id, r.*, v, start::INT AS start, (start + length(v))::INT AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, rank DESC, length(v) DESC, ordinal) AS k FROM placed JOIN {_known()} r USING (ordinal) WHERE v <> '' AND NOT regexp_matches(regexp_replace(v, '\\s', '', 'g'), '^X+$')),
swept AS (SELECT doc_id, k, true AS kept, stop AS last FROM ranked WHERE k = 1
    UNION ALL SELECT r.doc_id, r.k, r.start >= s.last, CASE WHEN r.start >= s.last THEN r.stop ELSE s.last END FROM swept s JOIN ranked r ON r.doc_id = s.doc_id AND r.k = s.k + 1),
found AS MATERIALIZED (SELECT r.*, regexp_replace(v, '\\s', '', 'g') AS bare FROM ranked r JOIN swept s USING (doc_id, k) WHERE s.kept),
told AS (SELECT *, CASE WHEN secret THEN '••••••' WHEN length(bare) <= 4 THEN '••••' ELSE left(bare, 1) || '••••' || right(bare, 1) || ' (' || length(bare) || ')' END AS evidence FROM found)"""
_POINTS = " ".join(f"WHEN {rank} THEN {sanitize.POINTS[name]}" for name, rank in (("LOW", 1), ("MEDIUM", 2), ("HIGH", 3), ("CRITICAL", 4)))
#: The score of (n, worst, secrets, identities, masquerade), as one expression.
_SCORE = f"""CASE WHEN n = 0 THEN 0 ELSE greatest(CASE WHEN secrets > 0 OR (n >= 100 AND identities >= 2) THEN 80 ELSE 0 END, least(100, CASE worst {_POINTS} END + CASE WHEN secrets > 0 THEN least(30, 20 + 2 * secrets) ELSE 0 END
    + CASE WHEN identities >= 3 THEN least(30, 15 + 5 * (identities - 3)) WHEN identities = 2 THEN 6 ELSE 0 END + CASE WHEN n >= 25 THEN least(25, floor(log2(n) * 4 + 0.5)) ELSE 0 END + CASE WHEN masquerade THEN 15 ELSE 0 END)) END::INT"""
_BAND = "CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MODERATE' ELSE 'LOW' END"


def scored(masquerade: str = "false") -> str:
    """(doc_id, t, masquerade, n, worst, secrets, identities, score, band) of each document; ``masquerade`` is a condition on document d."""
    return f"""{FOUND},
measured AS (SELECT doc_id, count(*) AS n, max(rank) AS worst, count(*) FILTER (classification = 'AUTHENTICATION_SECRET') AS secrets, count(DISTINCT label) FILTER (label IN ({", ".join(map(quoted, sanitize.IDENTITY))})) AS identities FROM found GROUP BY doc_id),
joined AS (SELECT d.doc_id, d.t, coalesce(n, 0) AS n, coalesce(worst, 0) AS worst, coalesce(secrets, 0) AS secrets, coalesce(identities, 0) AS identities, {masquerade} AS masquerade FROM docs d LEFT JOIN measured m ON m.doc_id = d.doc_id),
scores AS (SELECT *, {_SCORE} AS score FROM joined), scored AS (SELECT *, {_BAND} AS band FROM scores)"""
