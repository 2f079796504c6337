"""Personal data in texts, with built-in Spark expressions only.

A regular expression per kind proposes spans, a validator (octet range, Luhn,
mod-97, digit count) confirms or drops each of them, and words in the 40
characters before a span raise its confidence.

Defined results: a null text counts as empty; an empty text has no spans.
Offsets are code points, the end is exclusive. Within a kind spans are
leftmost and do not overlap; spans of different kinds may overlap. Rows are
never merged, so repeated rows give repeated results; further columns of the
input stay as they are.

Every pattern scans a text in linear time: the greedy parts are possessive and
can only begin where a run of their characters begins (or where the last match
ended), which leaves the same leftmost matches as the plain pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import folds

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]++"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: A text without this string has no span of the kind, so the pattern is not run.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Confidence (percent) of a confirmed span, and what a context word adds.
CONFIDENCE = {"email": (80, 15), "ip": (60, 30), "card": (70, 25), "phone": (60, 30), "iban": (85, 10), "ssn": (30, 60)}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "host|server|addr|login",
    "card": "card|visa|credit|payment|debit",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|tax",
}
#: Characters before a span in which context words count, and the least confidence of a span that is kept.
WINDOW = 40
LEAST = 50


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets_fit(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN: its letters count as two digits, 10 to 35."""
    compact = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(compact, 5, 60), F.substring(compact, 1, 4))
    code = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: (acc * F.when(c <= "9", 10).otherwise(100) + code(c)) % 97,
    )


def _confirmed(kind: str, value: Column) -> Column:
    """Whether the validator of a kind accepts a proposed value."""
    digits = F.length(_digits(value))
    if kind == "ip":
        return _octets_fit(value)
    if kind == "card":
        return digits.between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return digits.between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & (_mod97(value) == 1)
    if kind == "ssn":
        area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
        return ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    return F.lit(True)


SPAN = "struct<kind:string,start:int,end:int,confidence:int>"
SPANS = f"array<{SPAN}>"


def spans_of(kind: str, text: Column) -> Column:
    """The confirmed spans of one kind in a text that is not null, by start.

    The pieces between the matches and the matches themselves come from the
    same pattern, so their lengths add up to the offsets.
    """
    pieces = F.split(text, PATTERNS[kind], -1)
    values = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    base, bonus = CONFIDENCE[kind]

    def placed(at: Column, pair: Column) -> tuple[Column, Column]:
        before, value = pair["before"], pair["value"]
        start = at + F.length(before)
        end = start + F.length(value)
        near = F.lower(F.right(before, F.lit(WINDOW))).rlike(CONTEXT[kind])
        confidence = F.lit(base) + F.when(near, bonus).otherwise(0)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), confidence.alias("confidence"))
        return end, F.when(_confirmed(kind, value) & (confidence >= LEAST), F.array(span)).otherwise(F.array().cast(SPANS))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), values, lambda b, v: F.struct(b.alias("before"), v.alias("value")))
    found = folds.collected(pairs, F.lit(0), SPAN, placed)
    possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(possible & text.rlike(PATTERNS[kind]), found).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """Adds ``<prefix><kind>``, an array of spans, for each kind; texts are read once and nothing is shuffled. Columns of these names are replaced."""
    return docs.withColumns({f"{prefix}{kind}": spans_of(kind, F.coalesce(docs[text], F.lit(""))) for kind in PATTERNS})


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span by its kind in brackets, as ``[EMAIL]``; overlapping spans become one, named after the first.

    A null text stays null. The columns are those of the input.
    """
    found = find(docs, text, "__pii_")
    spans = F.array_sort(
        F.concat(*(found[f"__pii_{k}"] for k in PATTERNS)),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
    )
    body = F.col(text)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.concat(F.substring(body, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(piece)).otherwise(F.array().cast("array<string>"))

    last = F.array_max(F.transform(F.col("__pii_all"), lambda s: s["end"]))
    masked = F.concat(F.array_join(folds.collected(F.col("__pii_all"), F.lit(0), "string", step), ""), F.substring(body, last + 1, F.length(body)))
    out = found.withColumn("__pii_all", spans).withColumn(text, F.when(body.isNull() | (F.size("__pii_all") == 0), body).otherwise(masked))
    return out.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, all spans, and the highest confidence."""
    found = find(docs.select("doc_id", "text"))
    every = lambda kinds: F.concat(*(F.col(f"pii_{k}") for k in kinds))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]
    highest = F.coalesce(F.array_max(F.transform(every(PATTERNS), lambda s: s["confidence"])), F.lit(0))
    return found.select(
        "doc_id", *counts,
        F.sha2(joined(every(BASE_KINDS)), 256).alias("base_sha256"),
        joined(every(PATTERNS)).alias("spans"),
        highest.alias("confidence"),
    )
