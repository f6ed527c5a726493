"""Document bundles whose entries refer to one another by fullUrls that follow from keys, so that a bundle built again is the same bundle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code of the note by which the Composition is known, and of an unconfirmed condition. Fixed values of public code systems.
NOTE = ("http://loinc.org", "34117-2", "History and physical note")
UNCONFIRMED = ("http://terminology.hl7.org/CodeSystem/condition-ver-status", "unconfirmed", "Unconfirmed")
ABHA = "https://healthid.abdm.gov.in/"
DEVICE = "Device/intake"
#: Kinds of entries in the order of a bundle.
PLACES = ["Composition", "Patient", "Consent", "Condition", "MedicationStatement", "Observation", "Flag", "DocumentReference"]


def full_url(*key: Column) -> Column:
    """A name for what has these keys, alike whenever it is built."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), 256)
    return F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "urn:uuid:$1-$2-8$3-8$4-$5")


def _concept(text: Column, coding: Column | None = None) -> Column:
    return F.struct(text.alias("text"), coding.alias("coding")) if coding is not None else F.struct(text.alias("text"))


def _coding(system: Column, code: Column, display: Column) -> Column:
    return F.when(code.isNotNull(), F.array(F.struct(system.alias("system"), code.alias("code"), display.alias("display"))))


def _narrative(text: Column) -> Column:
    """Text in a div, with what XHTML reserves escaped and line ends as breaks."""
    for c, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        text = F.replace(text, F.lit(c), F.lit(to))
    return F.struct(F.lit("generated").alias("status"), F.concat(F.lit('<div xmlns="http://www.w3.org/1999/xhtml">'), text, F.lit("</div>")).alias("div"))


def _ref(url: Column) -> Column:
    return F.struct(url.alias("reference"))


def _quantity(value: Column, unit: Column) -> Column:
    """An absent unit is left out, never empty."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.nullif(F.trim(unit), F.lit("")).alias("unit")))


def _alike_once(df: DataFrame, key: list[Column]) -> DataFrame:
    """One row of those alike in encounter and key, chosen while rows are still short: before names and texts are built of them."""
    return df.withColumn("_key", F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])).dropDuplicates(["encounter_id", "_key"]).drop("_key")


#: A row's columns, or the fields of a struct that holds them.
Get = Callable[[str], Column]


def _place(kind: str, order: Column, after: Column, url: Column, target: Column, resource: Column) -> Column:
    return F.struct(F.lit(PLACES.index(kind)).alias("place"), order.cast("string").alias("at"), after.alias("after"), url.alias("full_url"), target.alias("target"), resource.alias("resource"))


def _entry(kind: str, url: Column, order: Column, *fields: Column) -> list[Column]:
    """place, at, after, full_url, target and resource (JSON) of one kind, of a row whose key differs from others'."""
    resource = F.to_json(F.struct(F.lit(kind).alias("resourceType"), *fields))
    return [_place(kind, order, F.lit(""), url, F.lit(None).cast("string"), resource)]


def _claim(kind: str, url: Column, order: Column, fact_id: Column, fact: Column, patient: Column, *fields: Column) -> list[Column]:
    """The entry of what rests on a fact, and if there is one its Provenance (else null): the fact's tier, and what was said, where and how surely."""
    said = F.concat(fact["verbatim"], F.lit(" ["), fact["location"], F.lit(", confidence "), F.format_number(fact["confidence"], 2), F.lit("]"))
    agent = F.array(F.struct(F.struct(F.lit(DEVICE).alias("reference"), F.lit("Intake device").alias("display")).alias("who"), _ref(patient).alias("onBehalfOf")))
    source = F.array(F.struct(F.lit("source").alias("role"), F.struct(said.alias("display")).alias("what")))
    backed = F.to_json(F.struct(F.lit("Provenance").alias("resourceType"), F.array(_ref(url)).alias("target"), F.date_format(fact["recorded_at"], "yyyy-MM-dd'T'HH:mm:ss").alias("recorded"), _concept(F.concat(fact["tier"], F.lit(" (provenance tier)"))).alias("activity"), agent.alias("agent"), source.alias("entity")))
    entry = _place(kind, order, F.lit(""), url, F.lit(None).cast("string"), F.to_json(F.struct(F.lit(kind).alias("resourceType"), *fields)))
    return [entry, F.when(fact.isNotNull(), _place(kind, order, fact_id, full_url(F.lit("Provenance"), url, fact_id), url, backed))]


#: What an entry of each kind is made of, besides its encounter and patient.
PARTS = {
    "Patient": ["patient_id", "abha_ref", "gender"], "Consent": ["consent_ref", "committed_at"], "Condition": ["term", "fact_id", "system", "code", "display", "_fact"],
    "MedicationStatement": ["name", "dose", "frequency", "route", "ongoing", "fact_id", "system", "code", "display", "_fact"], "Observation": ["name", "text", "unit", "low", "high", "system", "code", "display"],
    "Flag": ["level", "label", "rationale"], "DocumentReference": ["title", "pages", "backend", "confidence"],
}
#: What tells two entries of a kind and encounter apart.
KEYS = {
    "Patient": ["patient_id"], "Consent": ["consent_ref"], "Condition": ["term", "fact_id"], "MedicationStatement": ["name", "dose", "frequency", "route", "ongoing", "fact_id"],
    "Observation": ["name", "text", "unit", "low", "high"], "Flag": ["level", "label"], "DocumentReference": ["title"],
}


def _name(kind: str, of: Get) -> Column:
    return full_url(F.lit(kind), F.col("encounter_id"), *[of(c) for c in KEYS[kind]])


def _built(kind: str, of: Get, url: Column, patient: Column) -> list[Column]:
    """The entries of a row of one kind; ``of`` gives its parts, ``url`` and ``patient`` are the names of it and its patient."""
    subject = _ref(patient).alias("subject")
    coding = lambda: _coding(of("system"), of("code"), of("display"))
    note = lambda text: F.array(F.struct(F.lit(text).alias("text"))).alias("note")
    status = lambda x: F.lit(x).alias("status")
    if kind == "Patient":
        return _entry(kind, url, F.lit(""), F.array(F.struct(F.lit(ABHA).alias("system"), F.coalesce(of("abha_ref"), F.lit("unlinked")).alias("value"))).alias("identifier"), F.lit(True).alias("active"), F.nullif(of("gender"), F.lit("")).alias("gender"), _narrative(F.lit("Identified by ABHA reference only.")).alias("text"))
    if kind == "Consent":
        return _entry(kind, url, F.lit(""), status("active"), _concept(F.lit("Patient privacy consent")).alias("scope"), F.array(_concept(F.lit("Intake consent"))).alias("category"), _ref(patient).alias("patient"), F.date_format(of("committed_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"), _concept(F.concat(F.lit("Consent policy "), of("consent_ref"))).alias("policyRule"))
    if kind == "Condition":
        unconfirmed = F.struct(F.array(F.struct(*[F.lit(v).alias(k) for k, v in zip(("system", "code", "display"), UNCONFIRMED, strict=True)])).alias("coding"))
        return _claim(kind, url, of("term"), of("fact_id"), of("_fact"), patient, subject, unconfirmed.alias("verificationStatus"), F.array(_concept(F.lit("Problem reported by the patient at intake"))).alias("category"), _concept(of("term"), coding()).alias("code"), _narrative(F.concat(F.lit("Patient-reported: "), of("term"))).alias("text"))
    if kind == "MedicationStatement":
        dosage = F.nullif(F.concat_ws(" ", of("dose"), of("frequency"), of("route")), F.lit(""))
        return _claim(kind, url, of("name"), of("fact_id"), of("_fact"), patient, F.when(of("ongoing"), "active").otherwise("unknown").alias("status"), subject, _concept(of("name"), coding()).alias("medicationCodeableConcept"), F.when(dosage.isNotNull(), F.array(F.struct(dosage.alias("text")))).alias("dosage"), note("Reported by the patient at intake; not verified."))
    if kind == "Observation":
        number, low, high = of("text").try_cast("double"), of("low"), of("high")
        bounds = F.when(low.isNotNull() | high.isNotNull(), F.array(F.struct(_quantity(low, of("unit")).alias("low"), _quantity(high, of("unit")).alias("high"))))
        return _entry(kind, url, F.concat_ws("|", of("name"), of("text"), of("unit")), status("final"), subject, _concept(of("name"), coding()).alias("code"), note("Transcribed from a document the patient brought."), _quantity(number, of("unit")).alias("valueQuantity"), F.when(number.isNull(), of("text")).alias("valueString"), bounds.alias("referenceRange"))
    if kind == "Flag":
        return _entry(kind, url, F.concat_ws("|", of("level"), of("label")), status("active"), F.array(_concept(F.lit("Intake escalation"))).alias("category"), _concept(F.concat_ws(" — ", of("label"), of("rationale"))).alias("code"), subject, _narrative(F.concat(F.lit("["), F.upper(of("level")), F.lit("] "), of("label"))).alias("text"))
    read = F.format_string("%s — %d page(s), read by %s at %d%% mean confidence", of("title"), of("pages"), of("backend"), F.round(of("confidence") * 100).cast("int"))
    return _entry(kind, url, of("title"), status("current"), subject, read.alias("description"), F.array(F.struct(F.struct(F.lit("application/pdf").alias("contentType"), of("title").alias("title")).alias("attachment"))).alias("content"))


def _rows(encounters: DataFrame, facts: DataFrame, problems: DataFrame, medications: DataFrame, observations: DataFrame, flags: DataFrame, papers: DataFrame) -> dict[str, DataFrame]:
    """Per kind the rows that have an entry of their own: encounter_id, patient_id and PARTS.

    Every table meets the visits by encounter_id alone, and stays dealt by it. Claims and facts meet in a window by encounter and fact, which leaves both dealt by encounter; a join by both would deal them anew.
    """
    who = encounters.select("encounter_id", "patient_id")
    given = {
        "Patient": encounters.drop("patient_id"), "Consent": encounters.filter("consent_ref is not null").drop("patient_id"), "Condition": problems.filter("term is not null"), "MedicationStatement": medications.filter("name is not null"),
        "Observation": observations.filter("name is not null"), "Flag": flags, "DocumentReference": papers,
    }
    backing = facts.filter("fact_id is not null").select("encounter_id", "fact_id", F.struct("tier", "verbatim", "location", "confidence", "recorded_at").alias("_fact"))
    found = {}
    for kind, df in given.items():
        rows = _alike_once(df.join(who, "encounter_id"), [F.col(c) for c in KEYS[kind]])
        if "_fact" in PARTS[kind]:
            every = rows.withColumn("_own", F.lit(True)).unionByName(backing, allowMissingColumns=True)
            rows = every.withColumn("_fact", F.max("_fact").over(Window.partitionBy("encounter_id", "fact_id"))).filter("_own")
        found[kind] = rows.select("encounter_id", "patient_id", *[c for c in PARTS[kind] if c != "patient_id"])
    return found


def bundle_entries(encounters: DataFrame, facts: DataFrame, problems: DataFrame, medications: DataFrame, observations: DataFrame, flags: DataFrame, papers: DataFrame) -> DataFrame:
    """The entries of each encounter's bundle but its Composition: encounter_id, place, at, after, full_url, target, resource.

    encounters: encounter_id, patient_id, abha_ref, gender, consent_ref, committed_by, committed_at. facts: encounter_id, fact_id, tier, verbatim, location, confidence, recorded_at. problems: encounter_id,
    term, fact_id, system, code, display. medications: name, dose, frequency, route, ongoing, fact_id, system, code, display. observations: name, text (the value as read), unit, low, high, and a code. flags:
    level, label, rationale. papers: title, pages, backend, confidence. All by encounter_id. Problems and medicines without a term or name, and readings without a name, are left out; a reading that isn't a number goes
    as its text; absent elements are left out.

    Names and JSON are made after the rows were dealt by encounter, so that neither is shuffled nor sorted.
    """
    rows, patient = _rows(encounters, facts, problems, medications, observations, flags, papers), full_url(F.lit("Patient"), F.col("encounter_id"), F.col("patient_id"))
    made = []
    for kind, df in rows.items():
        entries = _built(kind, F.col, F.col("_url"), patient)
        # Names are columns only where they are asked for several times; several entries are columns first, as a generator evaluates what it is given by interpretation.
        if len(entries) > 1:
            both = df.withColumn("_url", _name(kind, F.col)).select("encounter_id", *[e.alias(f"made{n}") for n, e in enumerate(entries)])
            made.append(both.select("encounter_id", F.inline(F.array(*both.columns[1:]))).filter("place is not null"))
        else:
            entry, = _built(kind, F.col, _name(kind, F.col), patient)
            made.append(df.select("encounter_id", entry.alias("made")).select("encounter_id", "made.*"))
    return reduce(DataFrame.unionByName, made)


def link_bundles(encounters: DataFrame, entries: DataFrame, summaries: DataFrame, profile: str) -> DataFrame:
    """encounter_id, bundle (JSON): a Composition, whose section lists the clinical entries in order, and all entries of the encounter. Entries of a visit are few.

    summaries: encounter_id, text; encounters without one have an empty text, and encounters without entries still have their Composition.
    """
    item = F.struct("place", "at", "after", "full_url", "resource")
    by = entries.groupBy("encounter_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = encounters.select("encounter_id", "patient_id", "committed_by", "committed_at").join(by, "encounter_id", "left").join(summaries.select("encounter_id", F.col("text").alias("_text")), "encounter_id", "left")
    return _linked(rows, F.coalesce("items", F.array().cast(by.schema["items"].dataType)), profile)


def document_bundles(encounters: DataFrame, facts: DataFrame, problems: DataFrame, medications: DataFrame, observations: DataFrame, flags: DataFrame, papers: DataFrame, summaries: DataFrame, profile: str) -> DataFrame:
    """``link_bundles`` of ``bundle_entries``. An encounter's short rows are gathered and its names and JSON made of these, so that no task gathers and sorts the JSON of all its encounters."""
    parts = _rows(encounters, facts, problems, medications, observations, flags, papers)
    parts = {kind: df.select("encounter_id", F.struct(*PARTS[kind]).alias(kind)) for kind, df in parts.items()}
    # All columns in one order, as a plain union keeps the dealing.
    none = {kind: F.lit(None).cast(df.schema[kind].dataType).alias(kind) for kind, df in parts.items()}
    short = reduce(DataFrame.union, [df.select("encounter_id", *[kind if kind == k else none[k] for k in PARTS]) for kind, df in parts.items()])
    by = short.groupBy("encounter_id").agg(F.collect_list(F.struct(*PARTS)).alias("_short"))
    rows = encounters.select("encounter_id", "patient_id", "committed_by", "committed_at").join(by, "encounter_id", "left").join(summaries.select("encounter_id", F.col("text").alias("_text")), "encounter_id", "left")
    rows = rows.withColumn("_patient", full_url(F.lit("Patient"), F.col("encounter_id"), F.col("patient_id")))

    def each(of: Callable[[str], Column], e: Column) -> Column:
        found = F
        for kind in PARTS:
            found = found.when(e[kind].isNotNull(), of(kind))
        return found

    # Names first, as they are asked for several times.
    named = F.transform("_short", lambda e: F.struct(each(lambda kind: _name(kind, lambda c: e[kind][c]), e).alias("url"), e.alias("of")))
    made = F.transform(named, lambda e: each(lambda kind: F.array(*_built(kind, lambda c: e["of"][kind][c], e["url"], F.col("_patient"))), e["of"]))
    items = F.coalesce(F.flatten(made), F.array())
    # Of each entry what is sorted and linked.
    items = F.sort_array(F.transform(F.filter(items, lambda e: e.isNotNull()), lambda e: F.struct(*[e[c].alias(c) for c in ("place", "at", "after", "full_url", "resource")])))
    return _linked(rows.withColumn("items", items), F.col("items"), profile)


def _linked(rows: DataFrame, items: Column, profile: str) -> DataFrame:
    """encounter_id and bundle of rows of encounter_id, patient_id, committed_by, committed_at and _text, and of their entries in order."""
    listed = F.transform(F.filter(items, lambda e: (e["place"] > 2) & (e["after"] == "")), lambda e: _ref(e["full_url"]))
    day, by_whom = F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss"), F.struct(F.col("committed_by").alias("display"))
    coding = F.array(F.struct(*[F.lit(v).alias(k) for k, v in zip(("system", "code", "display"), NOTE, strict=True)]))
    section = F.struct(F.lit("Structured intake history").alias("title"), _narrative(F.coalesce("_text", F.lit(""))).alias("text"), F.when(F.size(listed) > 0, listed).alias("entry"))
    composition = F.to_json(F.struct(
        F.lit("Composition").alias("resourceType"), F.lit("preliminary").alias("status"), F.struct(coding.alias("coding"), F.lit("Pre-consultation intake history").alias("text")).alias("type"), _ref(full_url(F.lit("Patient"), F.col("encounter_id"), F.col("patient_id"))).alias("subject"),
        day.alias("date"), F.array(by_whom).alias("author"), F.lit("Pre-consultation intake history").alias("title"), F.array(F.struct(F.lit("legal").alias("mode"), day.alias("time"), by_whom.alias("party"))).alias("attester"), F.array(section).alias("section"),
        _narrative(F.concat(F.lit("Patient-reported intake history confirmed by "), F.coalesce("committed_by", F.lit("nobody")), F.lit(". Contains no assessment, diagnosis or treatment recommendation."))).alias("text"),
    ))
    entry = lambda url, resource: F.concat(F.lit('{"fullUrl":"'), url, F.lit('","resource":'), resource, F.lit("}"))
    first = entry(full_url(F.lit("Composition"), F.col("encounter_id")), composition)
    body = F.array_join(F.concat(F.array(first), F.transform(items, lambda e: entry(e["full_url"], e["resource"]))), ",")
    head = F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("document").alias("type"), day.alias("timestamp"), F.struct(F.lit("urn:careledger:bundle").alias("system"), F.concat(F.lit("bundle-"), F.col("encounter_id").cast("string")).alias("value")).alias("identifier"), F.struct(F.array(F.lit(profile)).alias("profile")).alias("meta")))
    return rows.select("encounter_id", F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"entry":['), body, F.lit("]}")).alias("bundle"))


_REFERENCE = r'"reference":"(urn:uuid:[0-9a-f-]+)"'
_FULL_URL = r'"fullUrl":"(urn:uuid:[0-9a-f-]+)"'


def bundle_links(bundles: DataFrame) -> DataFrame:
    """Per bundle: entries, references inside it, how many of these resolve to none of its entries, and whether a fullUrl occurs twice."""
    urls, refs = (F.regexp_extract_all("bundle", F.lit(p), F.lit(1)) for p in (_FULL_URL, _REFERENCE))
    return bundles.select("encounter_id", F.size(urls).cast("long").alias("entries"), F.size(refs).cast("long").alias("refs"), F.size(F.array_except(refs, urls)).cast("long").alias("unresolved"), (F.size(urls) != F.size(F.array_distinct(urls))).alias("doubled"))


def register(query) -> None:
    """The queries of this module."""

    def parts(t):
        facts = t("clinical_fact").select("encounter_id", "fact_id", "tier", F.concat(F.lit("said "), F.col("value")).alias("verbatim"), F.lit("turn 1").alias("location"), F.lit(0.875).alias("confidence"), F.col("recorded_at"), "path", "value")
        none, key = F.lit(None).cast("string"), F.col("encounter_id").cast("string")
        coded = [F.lit("urn:s").alias("system"), F.when(F.col("encounter_id") % 2 == 0, "C1").alias("code"), F.lit("Coded").alias("display")]
        visits = t("encounter").join(t("patient").select("patient_id", "abha_ref", "gender"), "patient_id", "left").select("encounter_id", "patient_id", "abha_ref", "gender", "consent_ref", F.col("confirmed_by").alias("committed_by"), F.col("occurred_at").cast("timestamp").alias("committed_at"))
        problems = facts.filter("path = 'hpi.associated'").select("encounter_id", F.when(F.col("value") != "none", F.col("value")).alias("term"), "fact_id", *coded)
        medicines = t("medication").select("encounter_id", "name", F.col("dose").cast("string").alias("dose"), none.alias("frequency"), F.lit("oral").alias("route"), (F.col("status") == "patient-reported-current").alias("ongoing"), F.concat(F.lit("f"), key, F.lit("-"), F.col("line_no").cast("string")).alias("fact_id"), *coded)
        readings = t("observation").select("encounter_id", F.col("analyte_key").alias("name"), F.coalesce(F.col("value").cast("double").cast("string"), F.lit("trace")).alias("text"), "unit", F.when(F.col("range_flag") == "low", 10.0).alias("low"), F.lit(None).cast("double").alias("high"), *coded)
        flags = t("encounter").filter("priority <> 'routine'").select("encounter_id", F.col("priority").alias("level"), F.lit("R2").alias("label"), F.lit("a < b").alias("rationale"))
        papers = t("document_record").select("encounter_id", F.concat(F.lit("paper "), F.col("doc_no").cast("string")).alias("title"), F.lit(2).alias("pages"), F.lit("ocr").alias("backend"), F.lit(0.5).alias("confidence"))
        return visits, facts, problems, medicines, readings, flags, papers

    url = lambda *k: "regexp_replace(sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '')" for x in k) + ")), '^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$', 'urn:uuid:\\1-\\2-8\\3-8\\4-\\5')"
    coded = "CASE WHEN encounter_id % 2 = 0 THEN 'C1' END"
    reading = "coalesce(CAST(CAST(value AS DOUBLE) AS VARCHAR), 'trace')"
    keys = {
        "Patient": ("e", ["encounter_id", "patient_id"], "CASE WHEN gender IS NULL THEN 'unknown' ELSE gender END", "NULL"), "Consent": ("(SELECT * FROM e WHERE consent_ref IS NOT NULL)", ["encounter_id", "consent_ref"], "'Consent policy ' || consent_ref", "NULL"),
        "Condition": ("(SELECT *, value AS term FROM clinical_fact WHERE path = 'hpi.associated' AND value <> 'none')", ["encounter_id", "term", "fact_id"], "term", coded),
        "MedicationStatement": ("(SELECT *, 'f' || encounter_id || '-' || line_no AS fact_id, NULL AS frequency, 'oral' AS route, status = 'patient-reported-current' AS ongoing FROM medication)", ["encounter_id", "name", "dose", "frequency", "route", "ongoing", "fact_id"], "name || ' ' || dose || ' oral'", coded),
        "Observation": (f"(SELECT *, {reading} AS text, CASE WHEN range_flag = 'low' THEN '10.0' END AS low, NULL AS high FROM observation)", ["encounter_id", "analyte_key", "text", "unit", "low", "high"], f"analyte_key || ' ' || text || coalesce(' ' || unit, '') || coalesce(' from ' || low, '')", coded),
        "Flag": ("(SELECT *, priority AS level, 'R2' AS label FROM encounter WHERE priority <> 'routine')", ["encounter_id", "level", "label"], "'R2 — a < b'", "NULL"),
        "DocumentReference": ("(SELECT *, 'paper ' || doc_no AS title FROM document_record)", ["encounter_id", "title"], "title || ' — 2 page(s), read by ocr at 50% mean confidence'", "NULL"),
    }
    kinds = [f"SELECT DISTINCT encounter_id, '{k}' AS kind, {url(repr(k), *key)} AS full_url, {text} AS text, {code} AS code, CAST(NULL AS VARCHAR) AS target FROM {source}" for k, (source, key, text, code) in keys.items()]
    backed = [f"SELECT DISTINCT x.encounter_id, 'Provenance' AS kind, {url(repr('Provenance'), url(repr(k), *[f'x.{c}' for c in keys[k][1]]), 'x.fact_id')} AS full_url, 'said ' || f.value || ' [turn 1, confidence 0.88]' AS text, CAST(NULL AS VARCHAR) AS code, {url(repr(k), *[f'x.{c}' for c in keys[k][1]])} AS target FROM {keys[k][0]} x JOIN clinical_fact f ON x.encounter_id = f.encounter_id AND x.fact_id = f.fact_id" for k in ("Condition", "MedicationStatement")]
    every = f"e AS (SELECT c.*, abha_ref, gender FROM encounter c LEFT JOIN patient p ON c.patient_id = p.patient_id), n AS ({' UNION ALL '.join(kinds + backed)})"

    @query(f"WITH {every} SELECT * FROM n")
    def bundle_entries(t):
        of = lambda path: F.get_json_object("resource", path)
        found, kind = globals()["bundle_entries"](*parts(t)).withColumn("kind", of("$.resourceType")), F.col("kind")
        number = F.concat_ws(" ", F.concat(of("$.code.text"), F.lit(" "), F.coalesce(of("$.valueQuantity.value"), of("$.valueString"))), of("$.valueQuantity.unit"), F.concat(F.lit("from "), of("$.referenceRange[0].low.value")))
        # A text has no quantity and so no unit of its own.
        number = F.when(of("$.valueString").isNotNull(), F.concat_ws(" ", of("$.code.text"), of("$.valueString"), F.col("_unit"), F.concat(F.lit("from "), of("$.referenceRange[0].low.value")))).otherwise(number)
        text = (
            F.when(kind == "Patient", F.coalesce(of("$.gender"), F.lit("unknown"))).when(kind == "Consent", of("$.policyRule.text")).when(kind == "MedicationStatement", F.concat_ws(" ", of("$.medicationCodeableConcept.text"), of("$.dosage[0].text")))
            .when(kind == "Observation", number).when(kind == "Provenance", of("$.entity[0].what.display")).when(kind == "DocumentReference", of("$.description")).otherwise(of("$.code.text"))
        )
        code = F.coalesce(of("$.code.coding[0].code"), of("$.medicationCodeableConcept.coding[0].code"))
        unit = F.nullif(F.split_part("at", F.lit("|"), F.lit(3)), F.lit(""))
        return found.withColumn("_unit", F.when(F.col("place") == 5, unit)).select("encounter_id", "kind", "full_url", text.alias("text"), code.alias("code"), "target")

    @query(f"""WITH {every}, g AS (SELECT encounter_id, count(*) AS n, count(*) FILTER (kind NOT IN ('Patient', 'Provenance')) AS subjects, count(*) FILTER (kind NOT IN ('Patient', 'Consent', 'Provenance')) AS listed, count(*) FILTER (kind = 'Provenance') AS provenance FROM n GROUP BY 1)
        SELECT e.encounter_id, n + 1 AS entries, 1 + subjects + listed + 2 * provenance AS refs, 0 AS unresolved, false AS doubled FROM e JOIN g ON e.encounter_id = g.encounter_id""")
    def linked_bundles(t):
        visits, *rest = parts(t)
        texts = t("encounter").select("encounter_id", F.concat(F.lit("Headline: "), F.coalesce("headline", F.lit("none"))).alias("text"))
        return bundle_links(document_bundles(visits, *rest, texts, "urn:careledger:intake"))
