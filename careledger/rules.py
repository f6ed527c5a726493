"""Escalation rules and contradictions over a session's facts."""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.ledger import condition_expr

_ROS = "review_of_systems."


def _has(path: str, *options: str) -> dict:
    return {"path": path, "in": list(options)}


def _is(path: str, value: str) -> dict:
    return {"path": path, "eq": value}


def _least(path: str, number: int) -> dict:
    return {"path": path, "gte": number}


def _any(*groups: list[dict]) -> dict:
    return {"any": [{"all": g} for g in groups]}


_CHEST, _BELLY, _SUDDEN = _is("hpi.site", "chest"), _is("hpi.site", "abdomen"), _is("hpi.onset", "sudden")
_COUGH, _PREGNANT = _has(_ROS + "respiratory", "cough_3wk"), _has("personal_history.pregnancy", "yes", "maybe")
# The escalation rules by id, with the level that they raise to.
ESCALATIONS: list[dict] = [
    {"id": "RF-CARD-01", "level": "immediate", "when": _any([_CHEST, _has("hpi.associated", "sweating", "breathlessness", "palpitations")], [_CHEST, _has("hpi.radiation", "left_arm", "jaw_neck")], [_CHEST, _SUDDEN, _least("hpi.severity", 7)])},
    {"id": "RF-CARD-02", "level": "urgent", "when": _any([_has(_ROS + "cardiovascular", "chest_pain_exertion")], [_CHEST, _has("hpi.exacerbating", "worse_effort")])},
    {"id": "RF-CARD-03", "level": "urgent", "when": {"all": [_has(_ROS + "cardiovascular", "orthopnoea"), _has(_ROS + "cardiovascular", "ankle_swelling")]}},
    {"id": "RF-NEURO-01", "level": "immediate", "when": _any(*[[_has(_ROS + "neurological", x)] for x in ("limb_weakness", "facial_droop", "speech", "vision_loss")], *[[_has("hpi.associated", x)] for x in ("weakness_limb", "speech_trouble")])},
    {"id": "RF-NEURO-02", "level": "immediate", "when": _any([_has(_ROS + "neurological", "thunderclap")], [_is("hpi.site", "head"), _SUDDEN, _least("hpi.severity", 8)])},
    {"id": "RF-NEURO-03", "level": "immediate", "when": {"all": [_has(_ROS + "neurological", "neck_stiff")]}},
    {"id": "RF-NEURO-04", "level": "urgent", "when": {"all": [_has(_ROS + "neurological", "fits")]}},
    {"id": "RF-BLEED-01", "level": "immediate", "when": _any([_has(_ROS + "gastrointestinal", "haematemesis")], [_has(_ROS + "gastrointestinal", "melaena")])},
    {"id": "RF-BLEED-02", "level": "urgent", "when": {"all": [_has(_ROS + "respiratory", "haemoptysis")]}},
    {"id": "RF-BLEED-03", "level": "urgent", "when": _any([_has("hpi.associated", "bleeding")], [_has(_ROS + "general", "bleeding_any")], [_has(_ROS + "genitourinary", "haematuria")])},
    {"id": "RF-RESP-01", "level": "immediate", "when": {"all": [_has("hpi.associated", "breathlessness")]}},
    {"id": "RF-RESP-02", "level": "urgent", "when": _any([_COUGH, _has(_ROS + "respiratory", "night_sweats")], [_COUGH, _has(_ROS + "general", "weight_loss")], [_COUGH, _has(_ROS + "general", "fever_persistent")])},
    {"id": "RF-ABDO-01", "level": "immediate", "when": {"all": [_BELLY, _SUDDEN, _least("hpi.severity", 7)]}},
    {"id": "RF-ABDO-02", "level": "urgent", "when": {"all": [_BELLY, _has("hpi.radiation", "back")]}},
    {"id": "RF-ABDO-03", "level": "urgent", "when": {"all": [_has(_ROS + "gastrointestinal", "jaundice")]}},
    {"id": "RF-SYS-01", "level": "urgent", "when": _any([_has("hpi.associated", "weight_loss")], [_has(_ROS + "general", "weight_loss")], [_has(_ROS + "gastrointestinal", "weight_loss")])},
    {"id": "RF-SYS-02", "level": "immediate", "when": _any(*[[_is("drug_allergy.allergy_reaction", x)] for x in ("swelling", "breathing", "collapse")])},
    {"id": "RF-SYS-03", "level": "urgent", "when": _any([_has(_ROS + "neurological", "fainting")], [_has("hpi.associated", "dizziness")])},
    {"id": "RF-SYS-04", "level": "urgent", "when": {"all": [_has(_ROS + "gastrointestinal", "swallowing")]}},
    {"id": "RF-SYS-05", "level": "immediate", "when": {"all": [_has(_ROS + "genitourinary", "retention")]}},
    {"id": "RF-OBS-01", "level": "immediate", "when": _any([_PREGNANT, _BELLY], [_PREGNANT, _has("hpi.associated", "bleeding")])},
    {"id": "RF-PAIN-01", "level": "urgent", "when": {"all": [_least("hpi.severity", 9)]}},
]
RANK = {"routine": 0, "urgent": 1, "immediate": 2}


def rank_of(priority: Column) -> Column:
    return F.when(priority == "immediate", 2).when(priority == "urgent", 1).otherwise(0)


def priority_of(rank: Column) -> Column:
    return F.when(rank == 2, "immediate").when(rank == 1, "urgent").otherwise("routine")


def conditions_of(rule: dict | list) -> list[dict]:
    """All single conditions of a rule."""
    parts = rule if isinstance(rule, list) else rule.get("all", rule.get("any"))
    return [rule] if parts is None else [c for r in parts for c in conditions_of(r)]


def groups_of(rule: dict | list) -> list[list[dict]]:
    """The groups of conditions any of which, when all of it holds, makes the rule hold; empty lists count as in rule_expr."""
    if isinstance(rule, list):
        return [[c for group in groups for c in group] for groups in product(*map(groups_of, rule))]
    if "all" in rule:
        return groups_of(rule["all"])
    if "any" in rule:
        return [group for r in rule["any"] if r.get("all") != [] for group in groups_of(r)]
    return [[rule]]


_RULES = "array<struct<rule_id: string, level: string, groups: array<array<int>>, by_path: array<struct<path: string, at: array<int>>>>>"


def evaluate_red_flags(session_values: DataFrame, rules: list[dict]) -> DataFrame:
    """Every rule for every session, fired or not; of a fired one the paths whose conditions hold, sorted, and the ids of the active facts there.

    Each different condition is evaluated once per session; the rules are a constant table that names conditions by position. No shuffle.
    """
    name = lambda c: json.dumps(c, sort_keys=True)
    clauses = {name(c): c for r in rules for c in conditions_of(r["when"])}
    place = {key: i for i, key in enumerate(clauses)}
    known = []
    for r in rules:
        by_path: dict[str, list[int]] = {}
        for c in conditions_of(r["when"]):
            by_path.setdefault(c["path"], []).append(place[name(c)])
        groups = [[place[name(c)] for c in group] for group in groups_of(r["when"])]
        known.append({"rule_id": r["id"], "level": r["level"], "groups": groups, "by_path": [{"path": p, "at": sorted(set(by_path[p]))} for p in sorted(by_path)]})
    holds = F.array(*[condition_expr(c, F.col("values")) for c in clauses.values()]).cast("array<boolean>")
    marked = session_values.select("session_id", "fact_ids", holds.alias("holds"))
    rows = marked.select("session_id", "fact_ids", "holds", F.inline(F.from_json(F.lit(json.dumps(known)), _RULES)))
    held = lambda i: F.get("holds", i)
    rows = rows.withColumn("fired", F.exists("groups", lambda g: F.forall(g, held)))
    paths = F.transform(F.filter("by_path", lambda p: F.exists(p["at"], held)), lambda p: p["path"])
    none = F.array().cast("array<string>")
    rows = rows.select("session_id", "rule_id", "level", "fired", "fact_ids", F.when(F.col("fired"), paths).otherwise(none).alias("p"))
    of = F.flatten(F.transform("p", lambda p: F.coalesce(F.try_element_at("fact_ids", p), none)))
    return rows.select("session_id", "rule_id", "level", "fired", F.array_join("p", ",").alias("paths"), F.array_join(of, ",").alias("fact_ids"))


def session_priority(sessions: DataFrame, flags: DataFrame) -> DataFrame:
    """The highest of a session's own priority and its fired rules'; a session without any keeps its own."""
    top = flags.filter("fired").groupBy("session_id").agg(F.max(rank_of(F.col("level"))).alias("top"))
    rank = F.greatest(rank_of(F.col("priority")), F.coalesce("top", F.lit(0)))
    return sessions.join(top, "session_id", "left").select("session_id", priority_of(rank).alias("priority"))


def adjudicate_candidates(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """External proposals (session_id, rule_id): unknown rule, agreed with a fired one, or logged as not fired."""
    known = flags.select("rule_id").distinct().withColumn("known", F.lit(True))
    fired = flags.filter("fired").select("session_id", "rule_id").distinct().withColumn("hit", F.lit(True))
    rows = candidates.join(known, "rule_id", "left").join(fired, ["session_id", "rule_id"], "left")
    return rows.select("session_id", "rule_id", F.when(F.col("known").isNull(), "discarded").when(F.col("hit"), "agreed").otherwise("not fired").alias("outcome"))


def contradiction_id(*parts: Column) -> Column:
    return F.concat(F.lit("cx_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 10))


# Denials, when they deny, and what contradicts them: a field of the entries of a group, or a path.
DENIALS = [
    {"id": "CX-MED-01", "path": "drug_allergy.taking_medicines", "equals": "false", "group": "medications", "field": "name"},
    {"id": "CX-MED-02", "path": "drug_allergy.taking_medicines", "equals": "false", "other_path": "drug_allergy.medicines"},
    {"id": "CX-ALG-01", "path": "drug_allergy.has_allergy", "equals": "false", "group": "allergies", "field": "substance"},
    {"id": "CX-PMH-01", "path": "past_medical.conditions", "contains_value": "none", "group": "problems", "field": "reported_term"},
    {"id": "CX-SURG-01", "path": "past_surgical.any", "equals": "false", "group": "procedures", "field": "name"},
]


def _contradicts(rule: dict) -> Column:
    if "group" in rule:
        return F.col("path").startswith(f"{rule['group']}[") & F.col("path").endswith(f".{rule['field']}")
    return F.col("path") == rule["other_path"] if "other_path" in rule else F.col("path").rlike(rule["other"])


def detect_denials(facts: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Facts that deny what another active fact of the session states in other words.

    A rule (DENIALS) has id, path and equals, or contains_value for values that may be lists (arrays); what contradicts it is ``group`` with ``field``, ``other_path`` or, as a
    pattern of paths, ``other``. Only the last active fact of the path denies (by seq), and superseded facts of either side are left out, where facts have superseded_by.
    Both sides are cut down to the rules' paths before they meet on the session, once for all rules.
    """
    rules = DENIALS if rules is None else rules
    listed = dict(facts.dtypes)["value"].startswith("array")
    active = facts.filter("superseded_by is null") if "superseded_by" in facts.columns else facts

    def denies(rule: dict) -> Column:
        if "contains_value" in rule:
            return F.array_contains("value", rule["contains_value"]) if listed else F.col("value") == rule["contains_value"]
        return F.col("value") == (F.array(F.lit(rule["equals"])) if listed else F.lit(rule["equals"]))

    one_of = lambda of: F.filter(F.array(*[F.when(of(r), F.lit(r["id"])) for r in rules]), lambda x: x.isNotNull())
    sides = active.filter(F.col("path").isin([r["path"] for r in rules]))
    last = sides.groupBy("session_id", "path").agg(F.max_by(F.struct("value", "fact_id", "verbatim"), "seq").alias("l")).select("session_id", "path", "l.*")
    deny = last.select("session_id", F.col("fact_id").alias("denial_id"), F.col("verbatim").alias("denied_as"), F.explode(one_of(lambda r: (F.col("path") == r["path"]) & denies(r))).alias("rule_id"))
    other = active.select("session_id", "fact_id", "verbatim", F.explode(one_of(_contradicts)).alias("rule_id"))
    hits = deny.join(other, ["session_id", "rule_id"]).filter("verbatim <> denied_as and fact_id <> denial_id")
    return hits.select("session_id", "rule_id", "denial_id", "fact_id", contradiction_id(F.col("rule_id"), F.col("denial_id"), F.col("fact_id")).alias("contradiction_id"))


def detect_cross_tier(facts: DataFrame, paths: list[str]) -> DataFrame:
    """Sessions whose listed paths differ between tiers: the first fact of each of the two alphabetically first tiers."""
    first = facts.filter(F.col("path").isin(paths)).groupBy("session_id", "path", "tier").agg(F.min_by(F.struct("fact_id", "value"), "seq").alias("f"))
    two = first.groupBy("session_id", "path").agg(F.slice(F.sort_array(F.collect_list(F.struct("tier", "f"))), 1, 2).alias("t")).filter("size(t) = 2")
    sides = two.select("session_id", "path", *[F.col("t")[i]["f"][k].alias(f"{k}_{n}") for i, n in ((0, "a"), (1, "b")) for k in ("fact_id", "value")])
    return sides.filter("value_a <> value_b")


def open_contradictions(contradictions: DataFrame) -> DataFrame:
    """Contradictions that nobody has resolved."""
    return contradictions.filter("status = 'open'")
