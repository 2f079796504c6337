"""Policy, rewriting, summaries and risk of scanned texts: narrow expressions over the findings of a row."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions import folds
from lakewarden.functions.catalogue import DETECTORS
from lakewarden.functions.detector import SEVERITY_RANK, SHORT_NAME, Detector
from lakewarden.operators import scan as scanning


@dataclass(frozen=True)
class Switches:
    enabled: bool
    mask: bool = True
    block: bool = False
    warn: bool = True


@dataclass(frozen=True)
class Policy:
    """What is done with the findings of each detector; those that are not named follow their default."""

    rules: Mapping[str, Switches]
    labeling: bool = False
    labeler: str = "policy"


def default_policy(detectors: Sequence[Detector] = DETECTORS) -> Policy:
    return Policy({d.id: Switches(d.on, d.on, False, d.on) for d in detectors})


def normalized_policy(given: Mapping, detectors: Sequence[Detector] = DETECTORS) -> Policy:
    """A policy from loose settings: a rule is switches by name or a boolean (whether it is on); global switches give what rules leave out."""
    base = default_policy(detectors).rules
    everywhere = {new: given[old] for old, new in (("masking", "mask"), ("blocking", "block"), ("warning", "warn")) if isinstance(given.get(old), bool)}
    rules = {}
    for name, own in base.items():
        switches = {"enabled": own.enabled, "mask": own.mask, "block": own.block, "warn": own.warn} | everywhere
        found = (given.get("patterns") or {}).get(name)
        if isinstance(found, bool):
            switches["enabled"] = found
        elif isinstance(found, Mapping):
            switches |= {k: v for k, v in found.items() if k in switches and isinstance(v, bool)}
        rules[name] = Switches(**switches)
    return Policy(rules, bool(given.get("labeling", False)), str(given.get("labeler", "policy")))


def enforced(policy: Policy, posture: str) -> Policy:
    """The policy with every rule that is on set to monitor, mask or block."""
    kinds = {"monitor": (False, False), "mask": (True, False), "block": (False, True)}
    mask, block = kinds[posture]
    return Policy({k: Switches(True, mask, block, True) if s.enabled else s for k, s in policy.rules.items()}, policy.labeling, policy.labeler)


def _those(policy: Policy, switch: str) -> list[str]:
    return [name for name, s in policy.rules.items() if s.enabled and getattr(s, switch)]


def summarized(rows: DataFrame) -> DataFrame:
    """Adds ``n_findings``, ``classifications``, ``counts`` by label and ``max_severity``."""
    f = F.col("findings")
    labels = F.array_distinct(F.transform(f, lambda x: x["label"]))
    counts = F.map_from_entries(F.transform(labels, lambda v: F.struct(v, F.size(F.filter(f, lambda x: x["label"] == v)))))
    worst = F.array_max(F.transform(f, lambda x: F.struct((-x["rank"]).alias("rank"), x["severity"].alias("severity"))))["severity"]
    return rows.withColumns({"n_findings": F.size(f).cast("long"), "classifications": F.array_distinct(F.transform(f, lambda x: x["classification"])), "counts": counts, "max_severity": worst})


def spliced(text: Column, findings: Column) -> Column:
    """A text with each finding's mask in its place; the findings are in order and do not overlap.

    The findings are taken in parts, each with its own stretch of the text: to
    find a place in a text takes time that grows with it.
    """

    def part(all_parts: Column, some: Column, k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.element_at(F.get(all_parts, k - 1), -1)["end"])
        stretch = F.substring(text, begin + 1, F.element_at(some, -1)["end"] - begin)

        def masked(own: Column, x: Column, j: Column) -> Column:
            before = F.when(j == 0, begin).otherwise(F.get(some, j - 1)["end"])
            return F.concat(F.substring(own, before - begin + 1, x["start"] - before), x["token"])

        return folds.let(stretch, lambda own: F.array_join(F.transform(some, lambda x, j: masked(own, x, j)), ""))

    made = lambda f: folds.let(folds.parts(f), lambda p: F.array_join(F.transform(p, lambda some, k: part(p, some, k)), ""))
    return folds.let(findings, lambda f: F.when(F.size(f) == 0, text).otherwise(F.concat(made(f), F.substring(text, F.element_at(f, -1)["end"] + 1, F.length(text)))))


def sanitize(docs: DataFrame, text: str = "text", policy: Policy | None = None, detectors: Sequence[Detector] = DETECTORS, most_matches: int | None = None, predicates: Mapping[str, scanning.Predicate] | None = None) -> DataFrame:
    """Scans a table and adds what the policy does with each row.

    ``action`` is allow, warn, mask or block. A row with any finding that
    blocks is blocked and its text left as it is; else the findings that are
    masked are, in ``sanitized``. A row whose matches ``most_matches`` cuts off
    is blocked: what was not looked at is not let through. A null text is
    allowed and stays null.
    """
    policy = policy or default_policy(detectors)
    rows = summarized(scanning.scan(docs, text, [k for k, s in policy.rules.items() if s.enabled], only=detectors, most_matches=most_matches, predicates=predicates))
    by = lambda switch: (lambda x: x["rule_id"].isin(_those(policy, switch)) if _those(policy, switch) else F.lit(False))
    return _acted(rows, text, by, F.lit(policy.labeling), policy.labeler)


def _acted(rows: DataFrame, text: str, by: Callable[[str], Callable[[Column], Column]], labeling: Column, labeler: str) -> DataFrame:
    """Adds what is done with scanned rows: ``by`` gives for a switch the test whether a finding has it on."""
    f = F.col("findings")
    masked = F.filter(f, by("mask"))
    action = F.when(F.col("truncated"), "block").when(F.size(f) == 0, "allow").when(F.exists(f, by("block")), "block").when(F.size(masked) > 0, "mask").when(F.exists(f, by("warn")), "warn").otherwise("allow")
    rows = rows.withColumns({"action": action, "warn": F.exists(f, by("warn"))})
    names = F.create_map(*(F.lit(x) for pair in SHORT_NAME.items() for x in pair))
    shown = F.array_join(F.transform(F.array_distinct(F.transform(masked, lambda x: x["classification"])), lambda c: F.coalesce(names[c], c)), ", ")
    banner = F.when(labeling, F.concat(F.lit("\n\n[Data Classification: "), shown, F.lit(f" — sanitized by {labeler}]"))).otherwise("")
    return rows.withColumn("sanitized", F.when(F.col("action") == "mask", F.concat(spliced(F.col("scanned"), masked), banner)).otherwise(F.col(text)))


#: Policies that are sent to every task; a table of more is shuffled by tenant.
MOST_POLICIES = 2_000
RULES = "map<string,struct<enabled:boolean,mask:boolean,block:boolean,warn:boolean>>"


def policy_rows(spark: SparkSession, policies: Sequence[tuple[str, object, Policy]]) -> DataFrame:
    """(tenant, since, labeling, rules): policies as a table, from (tenant, since when, policy)."""
    rows = [(tenant, since, p.labeling, {k: (s.enabled, s.mask, s.block, s.warn) for k, s in p.rules.items()}) for tenant, since, p in policies]
    return spark.createDataFrame(rows, f"tenant string, since timestamp, labeling boolean, rules {RULES}")


def sanitize_by(docs: DataFrame, policies: DataFrame, tenant: str, ts: str | None = None, text: str = "text", labeler: str = "policy", detectors: Sequence[Detector] = DETECTORS, most_matches: int | None = None) -> DataFrame:
    """The same for rows of many tenants, each by the policy of its own: that of ``policies`` (tenant, since, labeling, rules) which is the newest as of ``ts``, or of all.

    What a policy does not name, and a tenant without one, follows the default.
    Policies are data that is joined, so a change of one changes no plan. The
    join sends them to the rows if they are few, and else shuffles both sides.
    A policy without ``since`` holds from the beginning.
    """
    default = F.from_json(F.lit(json.dumps({k: vars(s) for k, s in default_policy(detectors).rules.items()})), RULES)
    whole = F.map_concat("rules", F.map_filter(default, lambda k, v: ~F.map_contains_key("rules", k)))
    entry = F.struct(F.coalesce("since", F.lit(datetime.min)).alias("since"), F.coalesce("labeling", F.lit(False)).alias("labeling"), whole.alias("rules"))
    known = policies.where("tenant is not null and rules is not null").groupBy(F.col("tenant").alias("__tenant")).agg(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["since"] < b["since"], -1).when(a["since"] > b["since"], 1).otherwise(0)).alias("__history"))
    known = F.broadcast(known) if policies.count() <= MOST_POLICIES else known
    current = F.col("__history") if ts is None else F.filter("__history", lambda p: p["since"] <= F.col(ts))
    joined = docs.join(known, F.col(tenant).cast("string") == F.col("__tenant"), "left").withColumn("__policy", F.try_element_at(current, F.lit(-1)))
    joined = joined.withColumns({"__rules": F.coalesce("__policy.rules", default), "__labeling": F.coalesce("__policy.labeling", F.lit(False))}).drop("__tenant", "__history", "__policy")
    rows = summarized(scanning.scan(joined, text, [d.id for d in detectors], only=detectors, most_matches=most_matches, switches="__rules"))
    by = lambda switch: (lambda x: F.coalesce(F.try_element_at(F.col("__rules"), x["rule_id"])[switch], F.lit(False)))
    return _acted(rows, text, by, F.col("__labeling"), labeler).drop("__rules", "__labeling")


def stored(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``stored``: what history keeps of a sanitized row: the masked text where something was masked, nothing where it was blocked, else the text."""
    return rows.withColumn("stored", F.when(F.col("action") == "mask", F.col("sanitized")).when(F.col("action") != "block", F.col(text)))


def verified(rows: DataFrame, policy: Policy | None = None, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Adds ``held`` to sanitized rows: whether what was rewritten has to be held back, as a second scan of it still finds something that the policy masks or blocks."""
    policy = policy or default_policy(detectors)
    acted = [d for d in detectors if d.id in set(_those(policy, "mask")) | set(_those(policy, "block"))]
    masked = rows.withColumn("__again", F.when(F.col("action") == "mask", F.col("sanitized"))).withColumnsRenamed({c: f"__first_{c}" for c in ("scanned", "findings", "truncated")})
    again = scanning.scan(masked, "__again", [d.id for d in acted], normalize=False, only=detectors).withColumn("held", (F.col("action") == "mask") & (F.size("findings") > 0))
    return again.drop("__again", "scanned", "findings", "truncated").withColumnsRenamed({f"__first_{c}": c for c in ("scanned", "findings", "truncated")})


def logged(rows: DataFrame, key: str, as_of, tool: str = "Unknown AI", url: str = "") -> DataFrame:
    """Audit entries of sanitized rows that were not allowed: one a row, its findings rolled up by label in the order in which they are first found."""
    f = F.col("findings")

    def item(label: Column) -> Column:
        own = F.filter(f, lambda x: x["label"] == label)
        return folds.let(own, lambda o: F.struct(label.alias("label"), o[0]["classification"].alias("classification"), o[0]["severity"].alias("severity"), F.size(o).cast("long").alias("count"), o[0]["evidence"].alias("evidence")))

    items = F.transform(F.array_distinct(F.transform(f, lambda x: x["label"])), item)
    entry = F.struct(F.col(key).cast("string").alias("id"), F.lit(as_of).alias("ts"), "action", F.lit(tool).alias("tool"), F.lit(url).alias("url"), "max_severity", "classifications", F.col("n_findings").alias("total_findings"), items.alias("items"))
    # outer, and filtered after: a filter on the action would run the scan a second time below it
    return rows.select(F.explode_outer(F.when(F.col("action") != "allow", F.array(entry))).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def log_items(rows: DataFrame, key: str) -> DataFrame:
    """(key, label, classification, severity, evidence, n): findings of each row by label, each as its first one has it."""
    long = scanning.exploded(rows, key)
    order = F.struct("f.start", "f.ordinal")
    first = F.min_by(F.struct("f.classification", "f.severity", "f.evidence"), order).alias("r")
    return long.groupBy(key, F.col("f.label").alias("label")).agg(first, F.count("*").alias("n")).select(key, "label", "r.*", "n")


#: Points by severity, labels that tell who someone is, and the least score of each band.
POINTS = {"CRITICAL": 40, "HIGH": 25, "MEDIUM": 10, "LOW": 3}
IDENTITY = (
    "EMAIL", "PHONE", "DOB", "PAN", "AADHAAR", "PASSPORT", "VOTER_ID", "DL", "PINCODE", "BANK_ACCOUNT", "UPI_ID",
    "US_SSN", "UK_NINO", "IBAN", "PAYMENT_CARD", "VEHICLE_REG", "HEALTH", "BIOMETRIC", "GEO_COORDS",
)
BANDS = (("CRITICAL", 80), ("HIGH", 50), ("MODERATE", 25), ("LOW", 0))
FILE_ACTIONS = {"LOW": "notify", "MODERATE": "notify", "HIGH": "quarantine", "CRITICAL": "quarantine"}
ACTION_RANK = {"allow": 0, "notify": 1, "quarantine": 2, "block": 3}


def measures(labels: str = "label") -> dict[str, Column]:
    """Aggregates of a long table of findings that a score takes: they combine map-side, however many findings a file has."""
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY_RANK.items() for x in pair)), F.col("severity"))
    secret = F.col("classification") == "AUTHENTICATION_SECRET"
    return {
        "n": F.count("rule_id"), "worst": F.coalesce(F.max(rank), F.lit(0)), "secrets": F.count_if(secret), "firm": F.count_if(secret & ~F.col("low")),
        "identities": F.count_distinct(F.when(F.col(labels).isin(*IDENTITY), F.col(labels))),
    }


def scored(rows: DataFrame) -> DataFrame:
    """Adds ``score`` (0 to 100), ``band``, ``density`` and ``file_action`` to (n, worst, secrets, firm, identities, n_bytes, masquerade)."""
    n, distinct = F.col("n"), F.col("identities")
    by_rank = F.element_at(F.array(*(F.lit(POINTS[k]) for k in SEVERITY_RANK)), F.greatest(F.col("worst").cast("int"), F.lit(1)))
    secrets = F.when(F.col("secrets") > 0, F.least(F.lit(30), 20 + F.col("secrets") * 2)).otherwise(0)
    who = F.when(distinct >= 3, F.least(F.lit(30), 15 + (distinct - 3) * 5)).when(distinct == 2, 6).otherwise(0)
    bulk = F.when(n >= 25, F.least(F.lit(25), F.floor(F.log2(n.cast("double")) * 4 + 0.5))).otherwise(0)
    points = F.least(F.lit(100), by_rank + secrets + who + bulk + F.when(F.col("masquerade"), 15).otherwise(0))
    floor = F.when((F.col("firm") > 0) | ((n >= 100) & (distinct >= 2)), 80).otherwise(0)
    rows = rows.withColumn("score", F.when(n == 0, 0).otherwise(F.greatest(points, floor)).cast("int"))
    band = F.lit(None)
    for name, least in reversed(BANDS):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    rows = rows.withColumns({"band": band, "density": F.when(n == 0, 0.0).otherwise(F.round(n / F.greatest(F.lit(1.0), F.col("n_bytes") / 1024), 2))})
    action = F.element_at(F.create_map(*(F.lit(x) for pair in FILE_ACTIONS.items() for x in pair)), F.col("band"))
    return rows.withColumn("file_action", F.when(n == 0, "allow").otherwise(action))


def risk(rows: DataFrame, key: str, n_bytes: Column, masquerade: Column | None = None) -> DataFrame:
    """A row for each key of scanned rows (segments of a file share one): its measures, score, band and action.

    Findings and sizes go through one aggregation, so the texts are scanned
    once; a row's size counts with its first finding.
    """
    sized = rows.select(key, n_bytes.alias("__bytes"), (masquerade if masquerade is not None else F.lit(False)).alias("__masquerade"), F.posexplode_outer("findings").alias("__place", "__f"))
    long = sized.select(key, "__bytes", "__masquerade", "__place", "__f.*")
    size = F.sum(F.when(F.coalesce("__place", F.lit(0)) == 0, F.col("__bytes")).otherwise(0))
    found = long.groupBy(key).agg(size.alias("n_bytes"), F.bool_or("__masquerade").alias("masquerade"), *(c.alias(k) for k, c in measures().items()))
    return scored(found)
