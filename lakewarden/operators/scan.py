"""Detection: candidates of every detector, gates, and the resolution of overlaps.

All of it is one narrow stage. One pass over a batch of texts (:mod:`hints`)
tells the detectors whose needs a text has: a literal, words and a few
properties, which are derived from the pattern. Only the patterns of these are
searched for, by built-in expressions, one gate for each detector that the
policy leaves on. What is known of the detectors is data: the gates yield the
numbers of those that match, and all that follows is written once, over the
rows of a constant table that these numbers name. The plan thus stays small,
and texts without matches cost little more than that one pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import cache, lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import folds, hints
from lakewarden.functions import text as texts
from lakewarden.functions.catalogue import DETECTORS
from lakewarden.functions.detector import PROPERTIES, WITHIN, Detector, java_pattern, needs, words
from lakewarden.functions.validators import VALIDATORS

FINDING = "struct<start:int,rank:int,low:boolean,room:int,ordinal:int,end:int,rule_id:string,label:string,category:string,classification:string,severity:string,secret:boolean,evidence:string,token:string>"
_SPACE = r"[\s   -     　﻿]"
#: Fixed value: what is stripped from the ends of what is left beside a mask.
_EDGES = r"^[\s:=;,.@#+/\\|'\"()\[\]{}<>-]+|[\s:=;,.@#+/\\|'\"()\[\]{}<>-]+\z"


#: What is known of a detector.
_ATTRIBUTES = "ordinal:int,rule_id:string,label:string,category:string,classification:string,severity:string,rank:int,secret:boolean,low:boolean,heuristic:boolean,guarded:boolean,check:string,pattern:string,group:int"
_SPAN = "struct<start:int,end:int,value:string>"


def _table(detectors: Sequence[tuple[int, Detector]]) -> Column:
    """The detectors as a constant array of structs."""
    rows = []
    for ordinal, d in detectors:
        pattern, group = java_pattern(d)
        rows.append({
            "ordinal": ordinal, "rule_id": d.id, "label": d.label, "category": d.category or d.family, "classification": d.data_class, "severity": d.severity, "rank": d.rank, "secret": d.secret, "low": d.low,
            "heuristic": d.low or d.level == "candidate", "guarded": bool(d.group) or d.low, "check": d.id if d.inline or not d.validator else d.validator, "pattern": pattern, "group": group,
        })
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_ATTRIBUTES}>>")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gate(d: Detector, text: str, lower: str) -> str:
    """The SQL of a detector's gate. As SQL, the gates of all detectors are one expression to build instead of thousands."""
    parts = [f"contains({lower}, {_quoted(d.literal)})"] if d.literal else []
    if words(d) and d.literal not in words(d):
        parts.append(f"({' OR '.join(f'contains({lower}, {_quoted(w)})' for w in words(d))})")
    parts += [f"__has_{name}" for name in sorted(needs(d))]
    return " AND ".join([*parts, f"{text} RLIKE {_quoted(java_pattern(d)[0])}"])


#: A predicate of a detector: of a value, its text and where it starts, whether the value counts.
Predicate = Callable[[Column, Column, Column], Column]


def candidates(text: str, lower: str | None, detectors: Sequence[tuple[int, Detector]], switches: str | None = None, possible: str | None = None) -> Column:
    """Of the columns of a text and its lower-case form: the detectors that match anywhere in it, each with the pieces between its matches, the matches, and the values of those that have a group.

    ``possible`` names a column of the places, from 1, of the detectors that may match, in the place of gates that look for words and properties.
    """
    gate = lambda place, d: _gate(d, text, lower) if possible is None else f"array_contains({possible}, {place}) AND {text} RLIKE {_quoted(java_pattern(d)[0])}"
    gates = ", ".join(f"CASE WHEN {gate(place, d)} THEN {place} END" for place, (_, d) in enumerate(detectors, 1))
    numbers, text = F.expr(f"array_compact(array({gates}))" if possible is None else f"CASE WHEN size({possible}) > 0 THEN array_compact(array({gates})) ELSE array() END"), F.col(text)
    known = folds.let(_table(detectors), lambda t: F.transform(numbers, lambda k: F.element_at(t, k)))
    if switches is not None:
        known = F.filter(known, lambda d: F.coalesce(F.try_element_at(F.col(switches), d["rule_id"])["enabled"], F.lit(False)))
    values = lambda d: F.when(d["group"] > 0, F.regexp_extract_all(text, d["pattern"], d["group"]))
    return F.transform(known, lambda d: F.struct(d.alias("d"), F.split(text, d["pattern"], -1).alias("pieces"), F.regexp_extract_all(text, d["pattern"], F.lit(0)).alias("matches"), values(d).alias("values")))


def _placed(c: Column, most: int | None) -> Column:
    """(start, end, value) of each match of a detector; a value ends its match."""
    pairs = F.arrays_zip(F.slice(c["pieces"], 1, F.size(c["matches"])).alias("b"), c["matches"].alias("m"), F.coalesce(c["values"], c["matches"]).alias("v"))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        end = at + F.length(p["b"]) + F.length(p["m"])
        return end, F.array(F.struct((end - F.length(p["v"])).alias("start"), end.alias("end"), p["v"].alias("value")))

    return folds.collected(pairs if most is None else F.slice(pairs, 1, most), F.lit(0), _SPAN, step)


def _inline(rule: str, value: Column, text: Column, start: Column, countries: Sequence[str]) -> Column:
    """Predicates of single detectors; fixed values: their word lists."""
    if rule == "IPV6_CANDIDATE":
        filled = F.size(F.filter(F.split(value, ":"), lambda x: x != ""))
        return (F.length(value) >= 6) & (filled > 0) & (F.contains(value, F.lit("::")) | value.rlike("[a-fA-F]") | (filled >= 4))
    if rule == "SWIFT_BIC":
        return F.substring(value, 5, 2).isin(*countries)
    if rule == "HEALTH_CONTEXT":
        words = F.size(F.split(F.trim(value), r"\s+"))
        stop = r"(?i)(?<![A-Za-z0-9_])(?:was|were|is|are|be|been|the|and|with|by|for|from|that|this|will|should|can)(?![A-Za-z0-9_])"
        return (words <= 6) & ~value.rlike(stop) & ~value.rlike(r"[(){}\[\]<>]|=>|(?<![A-Za-z0-9_])return(?![A-Za-z0-9_])")
    if rule == "CRED_AWS_SECRET_BARE":
        return ~value.rlike(r"^[0-9a-fA-F]{40}\z") & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    if rule == "CRED_ENV_VALUE":
        return ~value.rlike(r"^\d+\z|^(?i:true|false|null|none|undefined|yes|no)\z|^[a-z]+\z|^[A-Z]+\z|^[/.$~]")
    if rule == "CRED_HEX_ENCODED_PRIVATE_KEY":
        first = F.greatest(start - 60, F.lit(0))
        near = F.lower(F.substring(text, first + 1, start + 130 - first))
        return ~(near.rlike("sha[-_]?256|sha[-_]?512|checksum|hash|digest|integrity|etag|commit") & ~near.rlike("private|secret|wallet|seed|mnemonic|credential|key"))
    raise KeyError(rule)


def _checked(check: Column, value: Column, text: Column, start: Column, detectors: Sequence[tuple[int, Detector]], countries: Sequence[str], predicates: Mapping[str, Predicate]) -> Column:
    """Whether a value passes the validator or predicate of its detector. A predicate that gives no answer lets a value pass."""
    out = F.lit(True)
    for name, own in predicates.items():
        out = F.when(check == name, F.coalesce(own(value, text, start), F.lit(True))).otherwise(out)
    for name in sorted({d.validator for _, d in detectors if d.validator and not d.inline}):
        out = F.when(check == name, VALIDATORS[name](value)).otherwise(out)
    for name in sorted({d.id for _, d in detectors if d.inline} - set(predicates)):
        out = F.when(check == name, _inline(name, value, text, start, countries)).otherwise(out)
    return out


def _kept(d: Column, s: Column, text: Column, masks: Column, detectors: Sequence[tuple[int, Detector]], countries: Sequence[str], predicates: Mapping[str, Predicate]) -> Column:
    """The gates of a match: not masked already, no residue of a mask, no placeholder, and valid."""
    value = s["value"]
    bare = F.regexp_replace(value, _SPACE, "")
    beside = F.exists(masks, lambda m: (s["start"] < m["end"]) & (s["end"] > m["start"]))
    left = F.regexp_replace(F.regexp_replace(value, "X{4,}", ""), _EDGES, "")
    residue = d["heuristic"] | folds.let(left, lambda v: (F.length(v) < 8) | texts.synthetic(v))
    return (
        (value != "") & ~bare.rlike(r"^X+\z")
        & ~F.when(beside, residue).otherwise(False)
        & ~F.when(d["guarded"], texts.synthetic(value)).otherwise(False)
        & _checked(d["check"], value, text, s["start"], detectors, countries, predicates)
    )


def _finding(d: Column, s: Column) -> Column:
    """A finding; its first fields order findings: by start, then severity, confidence, length and catalogue."""
    room = s["end"] - s["start"]
    fields = {
        "start": s["start"], "rank": -d["rank"], "low": d["low"], "room": -room, "ordinal": d["ordinal"], "end": s["end"], "rule_id": d["rule_id"], "label": d["label"], "category": d["category"],
        "classification": d["classification"], "severity": d["severity"], "secret": d["secret"], "evidence": texts.evidence(s["value"], d["secret"]), "token": texts.mask_of(room),
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _resolved(found: Column) -> Column:
    """Of findings that overlap the first in their order."""
    none = F.array().cast(f"array<{FINDING}>")
    step = lambda at, f: (F.when(f["start"] >= at, f["end"]).otherwise(at), F.when(f["start"] >= at, F.array(f)).otherwise(none))
    return folds.collected(F.array_sort(found), F.lit(-1), FINDING, step)


def _masks(text: Column) -> Column:
    """(start, end) of the runs of mask characters in a text."""
    runs, gaps = F.regexp_extract_all(text, F.lit("X{4,}"), F.lit(0)), F.split(text, "X{4,}", -1)

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + F.length(p["b"])
        end = start + F.length(p["m"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end")))

    return folds.collected(F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), runs, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), F.lit(0), "struct<start:int,end:int>", step)


def prepared(rows: DataFrame, text: str = "scanned") -> DataFrame:
    """Adds what gates look at: ``__lower``, the text in lower case, and whether it has each property."""
    rows = rows.withColumns({"__lower": F.lower(text)} | {f"__has_{name}": F.col(text).rlike(pattern) for name, pattern in PROPERTIES.items() if name not in WITHIN})
    for name, other in WITHIN.items():
        rows = rows.withColumn(f"__has_{name}", F.col(f"__has_{other}") & F.col(text).rlike(PROPERTIES[name]))
    return rows


def gate(d: Detector, text: str = "scanned", lower: str = "__lower") -> Column:
    """Whether a detector matches anywhere in a prepared text."""
    return F.expr(_gate(d, text, lower))


@cache
def _countries(gateway: int) -> tuple[str, ...]:
    return tuple(sorted(SparkContext._gateway.jvm.java.util.Locale.getISOCountries()))


def countries(docs: DataFrame) -> tuple[str, ...]:
    """The country codes of ISO 3166, as Java has them."""
    return _countries(id(docs.sparkSession.sparkContext._gateway))


@lru_cache(maxsize=32)
def _expressions(gateway: int, detectors: tuple[tuple[int, Detector], ...], codes: tuple[str, ...], most: int | None, predicates: tuple[tuple[str, Predicate], ...] = (), switches: str | None = None) -> tuple[Column, Column, Column]:
    """What a scan adds, over columns by name: the detectors that match, findings, and whether there were more. To build them takes as long as to plan them, so they are kept (while the JVM lives that holds them)."""
    body, empty = F.col("scanned"), F.array().cast(f"array<{FINDING}>")
    spans = lambda masks: F.transform("__matched", lambda c: F.transform(F.filter(_placed(c, most), lambda s: _kept(c["d"], s, body, masks, detectors, codes, dict(predicates))), lambda s: _finding(c["d"], s)))
    found = folds.let(_masks(body), lambda masks: _resolved(F.flatten(spans(masks)).cast(f"array<{FINDING}>")))
    more = F.lit(False) if most is None else F.exists("__matched", lambda c: F.size(c["matches"]) > most)
    return candidates("scanned", None, detectors, switches, "__possible"), F.when(F.size("__matched") > 0, found).otherwise(empty), more


def scan(docs: DataFrame, text: str = "text", enabled: Sequence[str] | None = None, normalize: bool = True, only: Sequence[Detector] = DETECTORS, most_matches: int | None = None, predicates: Mapping[str, Predicate] | None = None, switches: str | None = None) -> DataFrame:
    """Adds ``scanned`` (the text that offsets refer to), ``findings`` and ``truncated`` to a table.

    ``enabled`` names the detectors that run; by default those that are on.
    All matches count unless ``most_matches`` bounds those of one detector in
    one text; ``truncated`` tells that there were more. A null text has no
    findings. Offsets are code points. ``predicates`` gives detectors, by id, a
    predicate of the caller's. ``switches`` names a column that maps the ids of
    detectors to structs: where a row's says ``enabled`` the detector runs for
    that row; nothing of it is part of the plan.
    """
    chosen = None if enabled is None else set(enabled)
    detectors = [(k, d) for k, d in enumerate(only) if (d.on if chosen is None else d.id in chosen)]
    # marked so that the planner keeps it where it stands: merged into what a second scan takes, it could not be evaluated
    told = F.arrow_udf(hints.teller([d for _, d in detectors], normalize), hints.TOLD).asNondeterministic()
    ready = docs.withColumn("__told", told(F.col(text))).withColumns({"scanned": F.coalesce("__told.normal", F.col(text)), "__possible": F.when(F.col(text).isNotNull(), F.col("__told.possible"))}).drop("__told")
    empty = F.array().cast(f"array<{FINDING}>")
    if not detectors:
        return ready.drop("__possible").withColumns({"findings": empty, "truncated": F.lit(False)})
    codes = countries(docs) if any(d.id == "SWIFT_BIC" for _, d in detectors) else ("AD",)
    matched, found, more = _expressions(id(docs.sparkSession.sparkContext._gateway), tuple(detectors), codes, most_matches, tuple(sorted((predicates or {}).items())), switches)
    rows = ready.withColumn("__matched", matched).withColumns({"findings": found, "truncated": more})
    return rows.drop("__possible", "__matched")


def exploded(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, f): a row for each finding. Outer, and filtered after: a filter on the array itself would run the scan a second time below it."""
    return rows.select(*keys, F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull())
