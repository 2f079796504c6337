"""Policies as tables: summaries, group states, posture, search among detectors; signatures; settings of inspection."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions.catalogue import DETECTORS
from lakewarden.operators import files, sanitize

COLUMNS = ("enabled", "mask", "block", "warn")


def table(spark: SparkSession, policy: sanitize.Policy, detectors=DETECTORS) -> DataFrame:
    """(rule_id, label, classification, level, enabled, mask, block, warn), a row a detector; one that the policy does not name follows its default."""
    base = sanitize.default_policy(detectors).rules
    rows = []
    for d in detectors:
        s = policy.rules.get(d.id, base[d.id])
        rows.append((d.id, d.label, d.data_class, d.level, s.enabled, s.mask, s.block, s.warn))
    return spark.createDataFrame(rows, "rule_id string, label string, classification string, level string, enabled boolean, mask boolean, block boolean, warn boolean")


def by_tenant(policies: DataFrame, detectors=DETECTORS) -> DataFrame:
    """(tenant, rule_id, label, classification, level, enabled, mask, block, warn): policies of many tenants (tenant, rules; as :func:`sanitize.policy_rows` has them), a row a tenant and detector; what a policy does not name follows the default."""
    base = sanitize.default_policy(detectors).rules
    known = F.from_json(F.lit(json.dumps([{"rule_id": d.id, "label": d.label, "classification": d.data_class, "level": d.level} | asdict(base[d.id]) for d in detectors])), "array<struct<rule_id:string,label:string,classification:string,level:string,enabled:boolean,mask:boolean,block:boolean,warn:boolean>>")
    catalogue = policies.sparkSession.range(1).select(F.inline(known))
    # a look into a map goes through its keys one by one: its entries, and the detectors that it does not name, find the catalogue instead
    named = policies.select("tenant", F.map_entries("rules").alias("own"), F.array_except(F.lit([d.id for d in detectors]).cast("array<string>"), F.coalesce(F.map_keys("rules"), F.lit([]).cast("array<string>"))).alias("others"))
    unnamed = F.transform("others", lambda k: F.struct(k.alias("key"), F.lit(None).cast(policies.schema["rules"].dataType.valueType).alias("value")))
    rows = named.select("tenant", F.explode(F.concat(F.coalesce("own", F.slice(unnamed, 1, 0)), unnamed)).alias("e")).join(F.broadcast(catalogue.alias("d")), F.col("e.key") == F.col("d.rule_id"))
    return rows.select("tenant", *(F.col(f"d.{c}") for c in ("rule_id", "label", "classification", "level")), *(F.coalesce(F.col(f"e.value.{c}"), F.col(f"d.{c}")).alias(c) for c in COLUMNS))


def summary(rules: DataFrame, *keys: str) -> DataFrame:
    """How many detectors there are, are on, and of these mask and block; and how many have the block switch at all. By tenant, or other keys, if they are given."""
    on = F.col("enabled")
    return rules.groupBy(*keys).agg(F.count("*").alias("n_rules"), F.count_if(on).alias("detecting"), F.count_if(on & F.col("mask")).alias("masking"), F.count_if(on & F.col("block")).alias("blocking"), F.count_if("block").alias("block_switches"))


def groups(rules: DataFrame, *keys: str) -> DataFrame:
    """The state of each switch by class of data (and keys): ``on``, ``off`` or ``mixed``, and how many rules have it."""
    states = []
    for c in COLUMNS:
        states += [F.when(F.bool_and(c), "on").when(F.bool_or(c), "mixed").otherwise("off").alias(c), F.count_if(c).alias(f"n_{c}")]
    return rules.groupBy(*keys, "classification").agg(F.count("*").alias("n_rules"), *states)


def posture(rules: DataFrame, *keys: str) -> DataFrame:
    """What the detectors that are on do together: block if one blocks, else mask if one masks, else monitor; and whether all warn. A tenant none of whose detectors is on monitors."""
    on, off = F.col("enabled"), F.lit(False)
    found = rules.groupBy(*keys).agg(F.coalesce(F.bool_or(on & F.col("block")), off).alias("b"), F.coalesce(F.bool_or(on & F.col("mask")), off).alias("m"), F.coalesce(F.bool_and(F.when(on, F.col("warn"))), off).alias("all_warn"))
    return found.select(*keys, F.when(F.col("b"), "block").when(F.col("m"), "mask").otherwise("monitor").alias("posture"), "all_warn")


def matching(rules: DataFrame, q: str = "", tier: str = "all") -> DataFrame:
    """Detectors whose name or label holds a piece of text: all, those that are on, or candidates."""
    found = rules
    if q.strip():
        low = q.strip().lower()
        found = found.where(F.contains(F.lower("rule_id"), F.lit(low)) | F.contains(F.lower("label"), F.lit(low)))
    if tier == "on":
        return found.where("enabled")
    return found.where(F.col("level") == "candidate") if tier == "candidate" else found


def _plain(policy: sanitize.Policy) -> bytes:
    return json.dumps(asdict(policy) | {"rules": {k: asdict(s) for k, s in policy.rules.items()}}, sort_keys=True).encode()


def signature(policy: sanitize.Policy, key: str) -> str:
    return hmac.new(key.encode(), _plain(policy), hashlib.sha256).hexdigest()


def verified(policy: sanitize.Policy, key: str, signed: str | None) -> sanitize.Policy:
    """A policy whose signature holds, or that has none; the default one if it was changed."""
    return policy if signed is None or hmac.compare_digest(signature(policy, key), signed) else sanitize.default_policy()


def saved(policy: sanitize.Policy, path: str, spark: SparkSession, key: str | None = None) -> None:
    """Writes a policy as one JSON row, with its signature where there is a key: what a stream reads again with every batch."""
    signed = signature(policy, key) if key else None
    spark.createDataFrame([(_plain(policy).decode(), signed)], "policy string, signature string").coalesce(1).write.mode("overwrite").json(path)


def loaded(path: str, spark: SparkSession, key: str | None = None) -> sanitize.Policy:
    """The policy at a path; the default one if its signature does not hold."""
    row = spark.read.schema("policy string, signature string").json(path).first()
    given = json.loads(row.policy)
    policy = sanitize.Policy({k: sanitize.Switches(**s) for k, s in given["rules"].items()}, given["labeling"], given["labeler"])
    return verified(policy, key, row.signature or "") if key else policy


#: What is done with files, from the weakest on, and the depths of an inspection.
ACTIONS = ("allow", "notify", "quarantine", "block")
DEPTHS = ("off", "shallow", "deep")


@dataclass(frozen=True)
class Inspection:
    """How files are inspected, and what is done by band of risk."""

    enabled: bool = True
    depth: str = "deep"
    most_kb: float = 4096
    most_depth: int = 3
    most_entries: int = 400
    archives: bool = True
    documents: bool = True
    masquerade: bool = True
    fingerprint: bool = True
    actions: Mapping[str, str] = field(default_factory=lambda: {"CRITICAL": "notify", "HIGH": "notify", "MODERATE": "notify", "LOW": "allow"})

    @property
    def budget(self) -> files.Budget:
        return files.Budget(int(self.most_kb * 1024), int(self.most_kb * 4096), int(self.most_entries), int(self.most_depth))


#: Settings by the names that they have from outside.
_NAMES = {"maxSizeKB": "most_kb", "maxDepth": "most_depth", "maxEntries": "most_entries", "inspectArchives": "archives", "inspectDocuments": "documents", "flagMasquerade": "masquerade", "fingerprint": "fingerprint", "enabled": "enabled"}


def inspection(given: Mapping | None) -> Inspection:
    """Settings of an inspection from loose ones: numbers count if they are above zero, words if they are known."""
    base = Inspection()
    if not isinstance(given, Mapping):
        return base
    out: dict = {}
    for name, own in _NAMES.items():
        value = given.get(name)
        if isinstance(getattr(base, own), bool):
            out[own] = bool(value) if value is not None else getattr(base, own)
        else:
            try:
                number = float(value)
            except (TypeError, ValueError):
                number = 0.0
            out[own] = number if 0 < number < float("inf") else getattr(base, own)
    said = given.get("actions") if isinstance(given.get("actions"), Mapping) else {}
    actions = {band: said.get(band) if said.get(band) in ACTIONS else own for band, own in base.actions.items()}
    return Inspection(**out, depth=given.get("depth") if given.get("depth") in DEPTHS else base.depth, actions=actions)
