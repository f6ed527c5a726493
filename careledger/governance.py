"""Audit chains, provenance, consent, retention, policy and terminology."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careledger.canonical import canonical_json
from careledger.evidence import words_of

GENESIS = "0" * 64
# Keys that never reach an audit row, and field names that would state an assessment.
FORBIDDEN_KEYS = [
    "name", "patient", "patientName", "birthDate", "address", "telecom", "identifier", "entry", "resource", "contained", "photo", "gender", "verbatim", "verbatim_translated", "transcript", "utterance",
    "value", "text", "chief_complaint", "symptom", "medication", "note", "ocr_text", "summary",
]
ASSESSMENT_FIELDS = [
    "diagnosis", "diagnoses", "differential", "differential_diagnosis", "assessment", "impression", "probability", "likelihood", "suspected_condition", "provisional", "icd_suggestion", "disease_probability",
    "prognosis", "treatment", "prescription", "plan", "recommendation", "advice", "therapy", "management", "specialty_referral",
]
#: What stands for a payload that isn't JSON: nothing of it can be known to be safe.
UNREADABLE = '"<unreadable>"'


def _scrub(x):
    if isinstance(x, dict):
        return {k: "<redacted>" if k in FORBIDDEN_KEYS else _scrub(v) for k, v in x.items()}
    return f"<{len(x)} item(s)>" if isinstance(x, list) else x


@F.pandas_udf(T.StringType())
def _scrub_json(rows: pd.Series) -> pd.Series:
    def scrub(s):
        try:
            return None if s is None else json.dumps(_scrub(json.loads(s)), sort_keys=True)
        except ValueError:
            return UNREADABLE

    return rows.map(scrub)


def scrub_payload(payload: Column) -> Column:
    """JSON text with forbidden keys redacted at any depth and lists as their length; flat objects without either pass by unparsed.

    Escapes may spell a key, so texts with any are parsed; a text that isn't an object and can't be read is withheld.
    """
    risky = payload.rlike('"(' + "|".join(FORBIDDEN_KEYS) + r')"|\[|\\|\{[\s\S]*\{') | ~payload.rlike(r"^\s*\{[\s\S]*\}\s*$")
    return F.when(risky, _scrub_json(payload)).otherwise(payload)


def _walk(x, trail: str, out: list):
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        if isinstance(k, str) and k.casefold() in ASSESSMENT_FIELDS:
            out.append(f"{k}@{trail}")
        _walk(v, f"{trail}[{k}]" if isinstance(x, list) else f"{trail}.{k}", out)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _assessment_fields(rows: pd.Series) -> pd.Series:
    def walk(s):
        try:
            return [] if s is None else _walk(json.loads(s), "$", [])
        except ValueError:
            return ["<unreadable>@$"]

    return rows.map(walk)


def scan_assessment_fields(payload: Column) -> Column:
    """field@trail of every assessment-shaped key in JSON text; texts that name none of them, escaped or not, aren't parsed."""
    return F.when(F.lower(payload).rlike("|".join(ASSESSMENT_FIELDS) + r"|\\"), _assessment_fields(payload)).otherwise(F.array().cast("array<string>"))


# The fields of an audit row that its hash covers.
AUDIT_FIELDS = [
    "ts", "actor", "actor_role", "purpose_of_use", "abha_ref", "consent_ref", "action", "request_summary", "response_summary", "versions_used", "outcome", "model_name", "model_version", "prompt_hash",
]


def audit_payload(rows: DataFrame, fields: list[str] | None = None) -> Column:
    """Canonical JSON of an audit row's ``fields``, by name, nulls kept; of any types, nested ones too."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = AUDIT_FIELDS if fields is None else fields
    of = T.StructType([T.StructField(c, kinds[c]) for c in fields])
    return canonical_json(F.struct(*[F.col(f"`{c}`") for c in fields]), of)


def audit_hash(prev_hash: Column, payload: Column) -> Column:
    """Hash of an audit row: of the hash before it and its canonical text."""
    return F.sha2(F.concat(prev_hash, payload), 256)


def append_chain(rows: DataFrame, chain: str, order: str, payload: Column) -> DataFrame:
    """``rows`` with prev_hash and hash: a sequential chain per key over its payloads in order.

    A chain's rows stream through one task, which keeps only the last hash. Payloads are made after the rows are dealt, as a few files may hold them all.
    """
    items = rows.repartition(chain).select(F.col(chain), F.col(order).cast("long").alias(order), payload.alias("payload")).sortWithinPartitions(chain, order, "payload")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = object(), None
        for batch in batches:
            before, after = [], []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not (k == key or (k != k and key != key)):  # NaN is one key
                    key, last = k, GENESIS
                before.append(last)
                last = None if last is None or p is None else hashlib.sha256((last + p).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names, "prev_hash", "hash"])

    return items.mapInArrow(link, T.StructType([*items.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())]))


def _segments(rows: DataFrame, chain: str, order: str) -> DataFrame:
    """One row per chain and range of its rows: part, n, first_prev, last_hash, and the first break inside (at: place in the segment; kind)."""
    items = rows.select(F.col(chain), F.col(order).alias("_order"), "prev_hash", "hash", "payload")
    # By ranges of chain and order, so that a chain with most of the rows is read by many tasks.
    items = items.repartitionByRange(chain, "_order").sortWithinPartitions(chain, "_order")
    columns = ["part", "n", "first_prev", "last_hash", "at", "kind"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, now, done = TaskContext.get().partitionId(), object(), None, []

        def out(key_type: pa.DataType) -> pa.RecordBatch:
            keys = pa.array([k for k, _ in done], key_type)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([keys, *[pa.array([x[c] for _, x in done], t) for c, t in zip(columns, kinds, strict=True)]], [chain, *columns])

        for batch in batches:
            names, _, before, after, payload = (c.to_pylist() for c in batch.columns)
            for k, p, h, text in zip(names, before, after, payload, strict=True):
                if not (k == key or (k != k and key != key)):  # NaN is one key
                    if now:
                        done.append((key, now))
                    key, now = k, {"part": part, "n": 0, "first_prev": p, "last_hash": None, "at": None, "kind": None}
                if now["at"] is None:
                    if now["n"] and p is not None and p != (GENESIS if now["last_hash"] is None else now["last_hash"]):
                        now["at"], now["kind"] = now["n"], "inserted or removed"
                    elif None not in (p, h, text) and h != hashlib.sha256((p + text).encode()).hexdigest():
                        now["at"], now["kind"] = now["n"], "modified"
                now["n"] += 1
                now["last_hash"] = h
            if done:
                yield out(batch.schema.field(0).type)
                done.clear()
        if now:
            done.append((key, now))
            yield out(batch.schema.field(0).type)

    kind = T.StructType([rows.schema[chain], *[T.StructField(c, T.StringType() if c in ("first_prev", "last_hash", "kind") else T.LongType()) for c in columns]])
    return items.mapInArrow(walk, kind)


def verify_chain(rows: DataFrame, chain: str, order: str) -> DataFrame:
    """Per chain: rows, and the first index and kind of break (a wrong link: inserted or removed; a wrong hash: modified); null if intact.

    ``rows`` (chain, order, prev_hash, hash, payload) are dealt by ranges of chain and order and checked there; a table of the ranges' first links and last hashes, one
    row per range and chain, joins the ranges. ``rows`` is read twice, once to find the ranges, so it should be a stored table. A null hash counts
    as none before; null links and payloads can't be held against anything.
    """
    by = Window.partitionBy(chain).orderBy("part")
    before = F.coalesce(F.lag("last_hash").over(by), F.lit(GENESIS))
    offset = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = _segments(rows, chain, order).select(chain, "n", F.coalesce(offset, F.lit(0)).alias("offset"), (F.col("first_prev") != before).alias("cut"), "at", "kind")
    first = F.when(F.col("cut"), F.struct(F.col("offset").alias("at"), F.lit("inserted or removed").alias("kind"))).when(F.col("at").isNotNull(), F.struct((F.col("offset") + F.col("at")).alias("at"), F.col("kind").alias("kind")))
    return joined.groupBy(chain).agg(F.sum("n").alias("rows"), F.min(first).alias("f")).select(chain, "rows", F.col("f.at").alias("first_break"), F.col("f.kind").alias("kind"))


#: Parts into which the pairs of a consent are dealt at most, and pairs that are worth a part of their own; encounters and audit rows of a consent that travel in one row.
TRAIL_PARTS, TRAIL_PAIRS = 24, 1 << 20
TRAIL_VISITS, TRAIL_ROWS = 512, 64


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two lists (encounters, audit rows) a row, by audit row; some 2^16 pairs a batch."""
    for batch in batches:
        visits, rows = batch.column(0), batch.column(1)
        v, r = visits.value_lengths().to_numpy(), rows.value_lengths().to_numpy()
        visits, rows = visits.flatten(), rows.flatten()
        first_v, first_r, upto = np.cumsum(v) - v, np.cumsum(r) - r, np.cumsum(v.astype("int64") * r)
        at = 0
        while at < len(v):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 65536, "right")))
            n, m = v[at:end].astype("int64"), r[at:end].astype("int64")
            # Each audit row of these lists, as often as its list has encounters.
            row = np.arange(first_r[at], first_r[at] + m.sum())
            times = np.repeat(n, m)
            begin = np.repeat(np.repeat(first_v[at:end], m) - (np.cumsum(times) - times), times)
            given = rows.take(pa.array(np.repeat(row, times)))
            yield pa.RecordBatch.from_arrays([visits.take(pa.array(np.arange(len(begin)) + begin)), *given.flatten()], ["encounter_id", "id", "action", "place"])
            at = end


def encounter_audit_trail(encounters: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit rows under an encounter's consent, with their place in time order; encounters without one have none.

    All encounters of a consent have the same rows in the same order, so places are counted once a consent and the pairs, which are what is asked for, are only
    emitted: neither shuffled nor sorted. An encounter given by several rows has the rows of all of them in one order.

    A consent's pairs are a grid of ranges of places by groups of encounters, cut so that few rows are sent to several parts: the longer side is cut more often. Pairs
    come by audit row, each with hundreds of encounters, so that columnar files hold runs of its columns and repeats of the encounters. A batch is all that a task holds of them.
    """
    rows = audit.select("consent_ref", "id", "ts", "action").filter("consent_ref is not null")
    sizes = rows.groupBy("consent_ref").agg(F.count(F.lit(1)).alias("_rows"))
    given = encounters.select("encounter_id", "consent_ref").filter("consent_ref is not null").join(sizes, "consent_ref").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("encounter_id")))
    once = given.filter("_n = 1 and encounter_id is not null")
    grid = once.groupBy("consent_ref", "_rows").agg(F.count(F.lit(1)).alias("_visits"))
    parts = F.least(F.lit(TRAIL_PARTS), F.ceil(F.col("_rows") * F.col("_visits").cast("double") / TRAIL_PAIRS).cast("int"))
    columns = F.greatest(F.lit(1), F.least(F.col("_parts"), F.round(F.sqrt(F.col("_parts") * F.col("_visits") / F.col("_rows"))).cast("int")))
    grid = grid.withColumn("_parts", parts).withColumn("_columns", columns).withColumn("_ranges", F.floor(F.col("_parts") / F.col("_columns")).cast("int")).drop("_parts")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = (F.col("_range") * F.col("_columns") + F.col("_column")).alias("_cell")

    tile = F.pmod(F.xxhash64("encounter_id"), F.ceil(F.col("_visits") / TRAIL_VISITS))
    tiles = once.drop("_rows").join(grid, "consent_ref").groupBy("consent_ref", tile.alias("_tile"), "_columns", "_ranges").agg(F.collect_list("encounter_id").alias("_visits"))
    tiles = tiles.withColumn("_column", F.pmod("_tile", "_columns").cast("int")).withColumn("_range", upto("_ranges")).select("consent_ref", cell, "_visits")
    order = Window.partitionBy("consent_ref").orderBy("ts", "id")
    placed = rows.withColumn("place", F.row_number().over(order).cast("long")).join(grid, "consent_ref")
    span = F.floor((F.col("place") - 1) * F.col("_ranges") / F.col("_rows")).cast("int")
    placed = placed.groupBy("consent_ref", span.alias("_range"), F.floor((F.col("place") - 1) / TRAIL_ROWS).alias("_block"), "_columns").agg(F.collect_list(F.struct("id", "action", "place")).alias("_trail"))
    placed = placed.withColumn("_column", upto("_columns")).select("consent_ref", cell, "_trail")
    # Few bytes make many pairs, so their parts aren't gathered by size.
    n = int(encounters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(n, "consent_ref", "_cell").join(placed.repartition(n, "consent_ref", "_cell"), ["consent_ref", "_cell"])
    kind = T.StructType([encounters.schema["encounter_id"], rows.schema["id"], rows.schema["action"], T.StructField("place", T.LongType())])
    each = dealt.select("_visits", "_trail").mapInArrow(_paired, kind)
    several = given.filter("_n > 1 or encounter_id is null").join(rows, "consent_ref")
    order = Window.partitionBy("encounter_id").orderBy("ts", "id")
    return each.unionByName(several.select("encounter_id", "id", "action", F.row_number().over(order).cast("long").alias("place")))


def provenance_completeness(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per encounter: facts, those with evidence, and those without."""
    backed = evidence.select("fact_id").distinct().withColumn("b", F.lit(1))
    rows = facts.join(backed, "fact_id", "left")
    return rows.groupBy("encounter_id").agg(F.count(F.lit(1)).alias("facts"), F.count("b").alias("with_evidence"), F.count_if(F.col("b").isNull()).alias("offenders"))


def check_traceability(lines: DataFrame, vocabulary: DataFrame, static: list[str]) -> DataFrame:
    """Per session: words of three letters or more in its lines, of any kept script, that neither its vocabulary (session_id, token) nor the static list has.

    Each distinct word is asked for once a session.
    """
    words = lines.select("session_id", F.explode(words_of(F.col("text"))).alias("token")).distinct()
    loose = words.filter(~F.col("token").isin(static)).join(vocabulary.select("session_id", "token").distinct(), ["session_id", "token"], "left_anti")
    bad = loose.groupBy("session_id").agg(F.count(F.lit(1)).alias("untraced"))
    return lines.select("session_id").distinct().join(bad, "session_id", "left").select("session_id", F.coalesce("untraced", F.lit(0)).cast("long").alias("untraced"), F.col("untraced").isNull().alias("traceable"))


def supported_words(facts: DataFrame) -> DataFrame:
    """session_id, token: every word that a session's facts license, by value, verbatim, translation, path or document."""
    parts = [F.col(c).cast("string") for c in ("value", "verbatim", "verbatim_translated", "document_id") if c in facts.columns]
    chunks = F.concat_ws(" ", *parts, F.translate("path", "._", "  "))
    return facts.select("session_id", F.explode(words_of(chunks)).alias("token")).distinct()


def trace_lines(lines: DataFrame, facts: DataFrame, static: list[str]) -> DataFrame:
    """Per session the whole check of its lines (session_id, kind, text, fact_ids): fact_lines, untraced_lines (without a fact id), dangling_ids (of no fact of the
    session), unsupported (words that no fact, nor ``static``, has) and ok, which a session is only with none of these.

    Lines of another kind than ``fact`` claim nothing; of a line without ids the words aren't asked for, as it fails as it is. ``static`` are the words of
    authored texts, which are few.
    """
    # One pass: each line by its ids, with the facts of the session beside them. A line without ids has one row, with its place null. Lines and facts are dealt
    # apart, so that no task holds what makes both.
    claim, ids = F.col("kind") == "fact", F.when(F.col("kind") == "fact", F.col("fact_ids"))
    asked = lines.select("session_id", claim.alias("claim"), F.posexplode_outer(ids).alias("at", "fact_id"))
    asked = asked.select("session_id", "fact_id", F.when(F.col("claim") & (F.coalesce("at", F.lit(0)) == 0), 1).alias("line"), F.when(F.col("claim") & F.col("at").isNull(), 1).alias("untraced"), F.when(F.col("at").isNotNull(), 1).alias("n"), F.lit(False).alias("held"))
    known = facts.filter("fact_id is not null").select("session_id", "fact_id", *[F.lit(None).cast("int").alias(c) for c in ("line", "untraced", "n")], F.lit(True).alias("held"))
    by_id = asked.repartition("session_id", "fact_id").unionByName(known.repartition("session_id", "fact_id")).groupBy("session_id", "fact_id")
    by_id = by_id.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("line", "untraced", "n")], F.max("held").alias("held"), (~F.min("held")).alias("seen"))
    dangling = F.when(F.col("held"), 0).otherwise(F.col("n"))
    every = by_id.groupBy("session_id").agg(F.sum("line").alias("fact_lines"), F.sum("untraced").alias("untraced_lines"), F.sum(dangling).alias("dangling_ids"), F.max("seen").alias("seen"))
    every = every.filter("seen").drop("seen")
    claims, held = lines.filter(claim).select("session_id", "text", "fact_ids"), F.size("fact_ids") > 0
    words = claims.filter(held).select("session_id", F.explode(words_of(F.col("text"))).alias("token"))
    words = words.groupBy("session_id", "token").agg(F.count(F.lit(1)).alias("n")).filter(~F.col("token").isin(static))
    loose = words.join(supported_words(facts), ["session_id", "token"], "left_anti").groupBy("session_id").agg(F.sum("n").alias("unsupported"))
    every = every.join(loose, "session_id", "left")
    counts = ["fact_lines", "untraced_lines", "dangling_ids", "unsupported"]
    every = every.fillna(0, counts)
    return every.select("session_id", *counts, (F.col("untraced_lines") + F.col("dangling_ids") + F.col("unsupported") == 0).alias("ok"))


def prompt_fingerprint(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def grant_consent(requests: DataFrame, known: list[str], required: list[str], ttl_seconds: int) -> DataFrame:
    """Requests (session_id, scopes, at) with granted, refused, whether the required scopes are there, and expiry."""
    every, need = (F.array(*[F.lit(s) for s in x]) for x in (known, required))
    granted = F.array_sort(F.array_intersect("scopes", every))
    text = lambda c: F.array_join(c, ",")
    return requests.select(
        "session_id", text(granted).alias("granted"), text(F.array_sort(F.array_except(every, "scopes"))).alias("refused"), (F.size(F.array_except(need, "scopes")) == 0).alias("valid"),
        (F.col("at") + F.make_dt_interval(secs=F.lit(float(ttl_seconds)))).alias("expires_at"),
    )


def _owned(has: Column) -> Column:
    """Whether a scope, as ``has`` tells of one, owns a fact."""
    return (has("documents") & (F.col("tier") == "document")) | (has("voice") & F.coalesce(F.col("modality") == "speech", F.lit(False))) | (has("ayush") & F.col("path").startswith("ayush."))


def revoke_consent(facts: DataFrame, revocations: DataFrame) -> DataFrame:
    """Facts that survive: 'documents' takes document facts, 'voice' spoken ones, 'ayush' paths under ayush.; other scopes take none."""
    gone = facts.join(revocations.select("session_id", "scope").distinct(), "session_id").filter(_owned(lambda s: F.col("scope") == s))
    return facts.join(gone.select("session_id", "fact_id").distinct(), ["session_id", "fact_id"], "left_anti")


def withdraw_consent(consents: DataFrame, facts: DataFrame, required: list[str]) -> DataFrame:
    """What is left of each consent (session_id, granted, refused, scopes: those withdrawn; null or none: all): revoked_scopes, remaining_scopes and refused_scopes, each sorted, facts_purged
    (that revoke_consent takes), and session_ended: no required scope is left. One row per row of ``consents``, which has a session once.
    """
    all_ = F.size(F.coalesce("scopes", F.array().cast("array<string>"))) == 0
    targets = F.array_sort(F.array_distinct(F.when(all_, F.col("granted")).otherwise(F.col("scopes"))))
    rows = consents.select("session_id", targets.alias("revoked_scopes"), F.array_sort(F.array_except("granted", targets)).alias("remaining_scopes"), F.array_sort(F.array_union("refused", targets)).alias("refused_scopes"))
    owned = facts.join(rows.select("session_id", "revoked_scopes"), "session_id").filter(_owned(lambda s: F.array_contains("revoked_scopes", s)))
    purged = owned.groupBy("session_id").agg(F.count(F.lit(1)).alias("facts_purged"))
    ended = ~F.arrays_overlap("remaining_scopes", F.array(*[F.lit(s) for s in required]))
    return rows.join(purged, "session_id", "left").fillna(0, ["facts_purged"]).withColumn("session_ended", ended)


def active_consents(consents: DataFrame, scope: str, now: Column) -> DataFrame:
    """Consents that aren't revoked, haven't expired and grant ``scope``."""
    return consents.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now) & F.array_contains("scopes", scope))


def expired_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter((F.col("expires_at") < now) & F.col("purged_at").isNull())


def purge_sessions(facts: DataFrame, victims: DataFrame) -> DataFrame:
    """Facts of the sessions that aren't purged."""
    return facts.join(victims.select("session_id").distinct(), "session_id", "left_anti")


def purge_counts(facts: DataFrame, victims: DataFrame) -> DataFrame:
    """Per purged session the number of facts that go."""
    gone = facts.join(victims.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("removed"))
    return victims.select("session_id").distinct().join(gone, "session_id", "left").fillna(0, ["removed"])


def sweep_synthetic(patients: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """What a sweep would remove of each child table: rows of patients that are both synthetic and guests by their reference."""
    victims = patients.filter(F.col("is_synthetic") & F.col("patient_ref").startswith("pat_guest_")).select("patient_id")
    out = victims.select(F.lit("patient").alias("table_name"), "patient_id")
    for name, child in children.items():
        out = out.unionByName(child.join(victims, "patient_id", "left_semi").select(F.lit(name).alias("table_name"), "patient_id"))
    return out.groupBy("table_name").agg(F.count(F.lit(1)).alias("rows"))


def orphan_report(consents: DataFrame, *live: DataFrame) -> DataFrame:
    """Consents whose session is in none of the live tables."""
    for table in live:
        consents = consents.join(table.select("session_id").distinct(), "session_id", "left_anti")
    return consents


def table_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows per key in each table, side by side."""
    out = None
    for name, df in tables.items():
        by = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = by if out is None else out.join(by, key, "full_outer")
    return out.fillna(0, list(tables))


def apply_policy(requests: DataFrame, grants: DataFrame, purposes: DataFrame) -> DataFrame:
    """Requests (role, purpose, action) with allowed and the first reason against: unknown role, wrong purpose, wrong action.

    ``grants``: role, purpose, action; ``purposes``: purpose, strip_identifiers, aggregate_only. Both are configuration.
    """
    small = lambda *c: grants.select(*c).distinct().withColumn("_" + c[-1], F.lit(True))
    rows = requests.join(small("role"), "role", "left").join(small("role", "purpose"), ["role", "purpose"], "left").join(small("role", "purpose", "action"), ["role", "purpose", "action"], "left")
    reason = F.when(F.col("_role").isNull(), "unknown role").when(F.col("_purpose").isNull(), "wrong purpose").when(F.col("_action").isNull(), "wrong action")
    return rows.withColumns({"reason": reason, "allowed": reason.isNull()}).join(purposes, "purpose", "left").drop("_role", "_purpose", "_action")


@F.pandas_udf(T.StringType())
def _fold(rows: pd.Series) -> pd.Series:
    def fold(s):
        if s is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() else " " for c in bare).split())

    return rows.map(fold)


def fold_text(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with the folded form of a column: case and marks dropped, punctuation as a space. Each distinct value is folded once."""
    distinct = df.select(F.col(column).alias("_v")).distinct().withColumn(to, _fold("_v"))
    return df.join(distinct, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


def newest_concepts(systems: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts (url, version, ...) of the newest active version of each code system (url, version, is_active, created_at)."""
    newest = systems.filter("is_active").groupBy("url").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))
    return concepts.join(newest, ["url", "version"], "left_semi")


def _pieces(text: Column, n: int = 3) -> Column:
    """All stretches of n letters of a text, each once; a shorter text is its own."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))


def _hits_by_rare_piece(inner: DataFrame, outer: DataFrame, n: int) -> DataFrame:
    """Pairs of ``inner`` (a text of n letters or more) and ``outer`` texts that contain them, both tables of distinct texts.

    What contains a text contains its rarest piece; so an inner text stands under that piece only, and the outer ones meet it by their pieces that some
    inner text stands under. Pieces that are common among outer texts serve an inner text only if it has no rarer one.
    """
    each = outer.select("outer", F.explode(_pieces(F.col("outer"), n)).alias("piece"))
    common = each.groupBy("piece").agg(F.count(F.lit(1)).alias("held"))
    own = inner.select("inner", F.explode(_pieces(F.col("inner"), n)).alias("piece"))
    # A piece that no outer text has rules the inner text out: it is the rarest, and meets nothing.
    rarest = own.join(common, "piece", "left").groupBy("inner").agg(F.min_by("piece", F.struct(F.coalesce("held", F.lit(0)), "piece")).alias("piece"))
    return rarest.join(each, "piece").filter(F.col("outer").contains(F.col("inner")) & (F.col("outer") != F.col("inner"))).select("inner", "outer")


def lookup_terms(terms: DataFrame, concepts: DataFrame, limit: int = 5) -> DataFrame:
    """Terms (term, key) against concepts (code, display_normalized): exact, display contains term, term contains display; five at most.

    Each class is an equi-join: on the whole text, or on the rarest piece of three letters of what is to be contained, so that texts which all begin alike don't meet; containment is verified on
    the pairs that meet. Displays of one or two letters are few; they are looked for among a key's stretches of their length. Empty displays match nothing.
    """
    keys = terms.select("key").distinct().filter("length(key) >= 3")
    shown = concepts.select("code", "display_normalized").filter("display_normalized <> ''")
    displays = shown.select("display_normalized").distinct()
    exact = keys.join(shown, F.col("key") == F.col("display_normalized")).select("key", "code", F.lit(0).alias("class"))
    pairs = _hits_by_rare_piece(keys.select(F.col("key").alias("inner")), displays.select(F.col("display_normalized").alias("outer")), 3).select(F.col("inner").alias("key"), F.col("outer").alias("display_normalized"), F.lit(1).alias("class"))
    long_ = displays.filter(F.length("display_normalized") >= 3).select(F.col("display_normalized").alias("inner"))
    pairs = pairs.unionByName(_hits_by_rare_piece(long_, keys.select(F.col("key").alias("outer")), 3).select(F.col("outer").alias("key"), F.col("inner").alias("display_normalized"), F.lit(2).alias("class")))
    for n in (1, 2):
        short = displays.filter(F.length("display_normalized") == n)
        pairs = pairs.unionByName(keys.select("key", F.explode(_pieces(F.col("key"), n)).alias("display_normalized"), F.lit(2).alias("class")).join(short, "display_normalized", "left_semi").select("key", "display_normalized", "class"))
    hits = exact.unionByName(pairs.join(shown, "display_normalized").select("key", "code", "class"))
    order = Window.partitionBy("key").orderBy("class", "code")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).select("key", "code", "class", "rank")


def code_terms(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """Only an exact hit codes a term; else it is unmapped."""
    exact = concepts.groupBy("display_normalized").agg(F.min("code").alias("code"))
    return terms.join(exact, F.col("key") == F.col("display_normalized"), "left").select("term", "code", F.when(F.col("code").isNull(), "unmapped").otherwise("coded").alias("status"))


def verify_codes(items: DataFrame, systems: DataFrame, concepts: DataFrame) -> DataFrame:
    """Items (url, version, code): unknown system, version mismatch, unknown code, not selectable, or ok."""
    known = systems.select("url", F.col("version").alias("active_version"))
    rows = items.join(known, "url", "left").join(concepts.select("url", "code", "is_selectable"), ["url", "code"], "left")
    verdict = (
        F.when(F.col("active_version").isNull(), "unknown system")
        .when(F.col("version").isNotNull() & (F.col("version") != F.col("active_version")), "version mismatch")
        .when(F.col("is_selectable").isNull(), "unknown code")
        .when(~F.col("is_selectable"), "not selectable")
        .otherwise("ok")
    )
    return rows.select("url", "version", "code", verdict.alias("verdict"))
