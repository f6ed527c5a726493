"""Promotion of confirmed sessions into the durable star, and briefs, evaluation and activity over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careledger.rules import rank_of
from careledger.shared import shared_path
from careledger.streams import stream_priority


def upsert_patients(old: DataFrame, new: DataFrame) -> DataFrame:
    """Match on abha_ref; missing names and genders are filled, known ones never overwritten; a null reference is always new."""
    known = new.filter("abha_ref is not null").groupBy("abha_ref").agg(F.min("display_name").alias("new_name"), F.min("gender").alias("new_gender"))
    both = old.filter("abha_ref is not null").select("abha_ref", "display_name", "gender").join(known, "abha_ref", "full_outer")
    both = both.select("abha_ref", F.coalesce("display_name", "new_name").alias("display_name"), F.coalesce("gender", "new_gender").alias("gender"))
    bare = lambda df: df.filter("abha_ref is null").select("abha_ref", "display_name", "gender")
    return both.unionByName(bare(old)).unionByName(bare(new))


def promote_encounters(encounters: DataFrame, traceable: DataFrame) -> DataFrame:
    """Encounters of sessions that are traceable and confirmed."""
    rows = encounters.filter(F.coalesce("confirmed_by", F.lit("")) != "")
    return rows.join(traceable.select("encounter_id").distinct(), "encounter_id", "left_semi").select("encounter_id", "patient_id", "consent_ref", "headline", "priority")


def promote_facts(facts: DataFrame) -> DataFrame:
    """Durable facts: state is the tier, valid from when it was recorded; the confidence of speech without one is unavailable."""
    status = F.when((F.col("modality") == "speech") & F.col("confidence").isNull(), "unavailable").otherwise("measured")
    return facts.select("fact_id", "path", "value", F.col("tier").alias("state"), F.col("recorded_at").alias("valid_from"), status.alias("confidence_status"))


def promote_evidence(facts: DataFrame) -> DataFrame:
    """One evidence row for each fact: its span's kind, verbatim, turn or page, and how it was given."""
    source = F.when(F.col("tier") == "document", "document").otherwise("utterance")
    return facts.select(F.concat(F.lit("ev-"), "fact_id").alias("evidence_id"), "fact_id", source.alias("source_type"), "verbatim", F.when(source == "utterance", F.col("turn_id")).alias("turn_id"), F.when(source == "utterance", F.col("modality")).alias("modality"))


def link_consent(encounters: DataFrame, consents: DataFrame) -> DataFrame:
    """Encounters with the latest consent of their session where they have none."""
    last = consents.groupBy("session_ref").agg(F.max_by("consent_ref", F.struct("granted_at", "consent_ref")).alias("found"))
    return encounters.join(last, "session_ref", "left").select("encounter_id", F.coalesce("consent_ref", "found").alias("consent_ref"))


def promotion_counts(encounters: DataFrame, **children: DataFrame) -> DataFrame:
    """Rows of each child table per encounter, each counted alone."""
    out = encounters.select("encounter_id")
    for name, df in children.items():
        out = out.join(df.groupBy("encounter_id").agg(F.count(F.lit(1)).alias(name)), "encounter_id", "left")
    return out.fillna(0, list(children))


def snapshot_lines(facts: DataFrame, evidence: DataFrame, fields: list[str]) -> DataFrame:
    """Live facts of the listed fields, in that order, with their evidence's number and kinds; facts without evidence dropped."""
    by = evidence.groupBy("fact_id").agg(F.count(F.lit(1)).alias("sources"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("kinds"))
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("path"))
    rows = facts.filter(F.col("superseded_by").isNull() & F.col("invalidated_reason").isNull()).withColumn("place", place).filter("place > 0")
    return rows.join(by, "fact_id").select("encounter_id", "fact_id", "place", "value", "sources", "kinds")


def unresolved(facts: DataFrame) -> DataFrame:
    """Superseded, invalidated and declined facts by class."""
    kind = F.when(F.col("invalidated_reason").isNotNull(), "invalidated").when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("value") == "none", "declined")
    return facts.withColumn("class", kind).filter("class is not null").select("fact_id", "encounter_id", "class")


def assemble_brief(encounters: DataFrame, facts: DataFrame, evidence: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON document per encounter with its lines in fixed order; encounters without lines have an empty list."""
    lines = snapshot_lines(facts, evidence, fields).groupBy("encounter_id").agg(F.sort_array(F.collect_list(F.struct("place", "fact_id", "value"))).alias("lines"))
    body = F.struct("encounter_id", "priority", F.coalesce("lines", F.array().cast("array<struct<place:bigint,fact_id:string,value:string>>")).alias("lines"))
    return encounters.join(lines, "encounter_id", "left").select("encounter_id", F.to_json(body).alias("brief"))


def write_snapshots(briefs: DataFrame, path: str, version: str, generated_at, batch_id: str | None = None) -> None:
    """Add rendered briefs with their version. A batch (by default that of the version) that is written again replaces itself."""
    rows = briefs.select("*", F.lit(version).alias("version"), F.lit(generated_at).cast("timestamp").alias("generated_at"))
    write_batch(rows, path, batch_id or version)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per encounter and audience, by the time of writing, then id."""
    newest = Window.partitionBy("encounter_id", "audience").orderBy(F.desc("generated_at"), F.desc("id"))
    return snapshots.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def triage_queue(sessions: DataFrame, now) -> DataFrame:
    """Sessions that aren't purged with priority rank and minutes waited."""
    waited = F.floor((F.lit(now).cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")) / 60).cast("long")
    return sessions.filter("purged_at is null").select("session_id", rank_of(F.col("priority")).alias("rank"), waited.alias("waiting_minutes"))


def per_field_accuracy(pairs: DataFrame) -> DataFrame:
    """Expected, matched and accuracy per path, from rows (path, expected, actual)."""
    by = pairs.groupBy("path").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("expected_value").eqNullSafe(F.col("actual_value"))).alias("matched"))
    return by.withColumn("accuracy", F.round(F.col("matched") / F.col("expected"), 4))


def by_difficulty(pairs: DataFrame) -> DataFrame:
    """Accuracy per difficulty and in total (difficulty null), by grouping sets."""
    by = pairs.rollup("difficulty").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("expected_value").eqNullSafe(F.col("actual_value"))).alias("matched"))
    return by.withColumn("accuracy", F.round(F.col("matched") / F.col("expected"), 4))


def fhir_observations(observations: DataFrame) -> DataFrame:
    """One Observation resource as JSON per reading with a value; an absent unit is left out."""
    resource = F.struct(F.lit("Observation").alias("resourceType"), F.col("analyte_key").alias("code"), F.struct("value", "unit").alias("valueQuantity"))
    return observations.filter("value is not null").select("patient_id", F.to_json(resource).alias("resource"))


def fhir_bundles(encounters: DataFrame, facts: DataFrame, medications: DataFrame, observations: DataFrame, problems: DataFrame, flags: DataFrame, papers: DataFrame) -> DataFrame:
    """One document bundle as JSON per encounter: Composition, Patient, Consent, Conditions (problems: term, fact_id; never confirmed), MedicationStatements (fact_id beside the usual columns), Observations,
    Flags (level, label), DocumentReferences (papers: title). A problem or medicine whose fact_id is not null is followed by the Provenance of that fact, with its
    tier and value; facts that back neither have none.

    Absent elements are left out, never empty. Entries of a visit are few. What comes dealt by encounter_id stays so, and the short tables are dealt likewise, so that
    entries aren't shuffled as JSON; facts meet what they back in a window, as a join by two keys would deal both anew.
    """
    kind = lambda name: F.lit(name).alias("resourceType")
    of = lambda df, place, order, *fields, after=0: df.select("encounter_id", F.lit(place).alias("place"), order.alias("at"), F.lit(after).alias("after"), F.to_json(F.struct(F.struct(*fields).alias("resource"))).alias("entry"))
    key, subject = F.col("encounter_id").cast("string"), F.struct(F.concat(F.lit("Patient/"), F.col("patient_id").cast("string")).alias("reference")).alias("subject")
    taken = F.when(F.col("status") == "patient-reported-current", "active").otherwise("unknown").alias("status")
    encounters, flags, papers = (df.repartition("encounter_id") for df in (encounters, flags, papers))
    backing = facts.filter("fact_id is not null").select("encounter_id", "fact_id", F.struct(F.col("tier").alias("activity"), F.col("value").alias("entity")).alias("_fact"))
    by_fact = F.collect_list("_fact").over(Window.partitionBy("encounter_id", "fact_id"))
    backed = lambda df: df.withColumn("_own", F.lit(True)).unionByName(backing, allowMissingColumns=True).withColumn("_facts", by_fact).filter("_own").withColumn("_fact", F.explode("_facts"))
    term, medicine = F.concat_ws("|", "term", "fact_id"), F.concat_ws("|", "name", "status", "fact_id")
    of_fact = lambda df, place, order, target: of(backed(df), place, order, kind("Provenance"), F.concat(F.lit(f"{target}/"), "fact_id").alias("target"), F.col("_fact.activity"), F.col("_fact.entity"), after=1)
    identity = F.col("fact_id").alias("id")
    entries = (
        of(encounters, 0, F.lit(""), kind("Composition"), F.lit("preliminary").alias("status"), subject)
        .unionByName(of(encounters, 1, F.lit(""), kind("Patient"), F.col("patient_id").cast("string").alias("id")))
        .unionByName(of(encounters.filter("consent_ref is not null"), 2, F.lit(""), kind("Consent"), F.col("consent_ref").alias("id")))
        .unionByName(of(problems, 3, term, kind("Condition"), identity, F.lit("unconfirmed").alias("verificationStatus"), F.col("term").alias("code")))
        .unionByName(of_fact(problems, 3, term, "Condition"))
        .unionByName(of(medications, 4, medicine, kind("MedicationStatement"), identity, taken, F.col("name").alias("medication")))
        .unionByName(of_fact(medications, 4, medicine, "MedicationStatement"))
        .unionByName(of(observations.filter("value is not null"), 5, F.concat_ws("|", "analyte_key", F.col("value").cast("string"), "unit"), kind("Observation"), F.col("analyte_key").alias("code"), F.struct("value", "unit").alias("valueQuantity")))
        .unionByName(of(flags, 6, F.concat_ws("|", "level", "label"), kind("Flag"), F.lit("active").alias("status"), F.concat(F.lit("["), F.upper("level"), F.lit("] "), F.col("label")).alias("code")))
        .unionByName(of(papers, 7, F.col("title"), kind("DocumentReference"), F.lit("current").alias("status"), F.col("title").alias("description")))
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "at", "after", "entry"))), lambda e: e["entry"]), ",")
    bundles = entries.groupBy("encounter_id").agg(F.concat(F.lit('{"resourceType":"Bundle","type":"document","entry":['), body, F.lit("]}")).alias("bundle"))
    return encounters.select("encounter_id").join(bundles, "encounter_id", "left").select("encounter_id", "bundle")


BATCH = "batch_id"


def write_batch(df: DataFrame, path: str, batch_id: str, partition_by: str | None = None) -> None:
    """Write ``df`` as the one content of its batch's partition under ``path``: a rerun, after a failure or not, replaces what the batch wrote before,
    and other batches stay. Until the job is committed readers see the batch as it was before."""
    by = [partition_by] if partition_by else []
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{BATCH}={batch_id}")


def write_durable(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None, batch_id: str | None = None) -> None:
    """Add each durable table under ``path``, partitioned by its column in ``partition_by`` if it has one.

    With a ``batch_id`` (of the promotion) a rerun writes nothing twice; without one rows are appended as they come.
    """
    for name, df in tables.items():
        by = (partition_by or {}).get(name)
        if batch_id is None:
            (df.write.partitionBy(by) if by else df.write).mode("append").parquet(f"{path}/{name}")
        else:
            write_batch(df, f"{path}/{name}", batch_id, by)


def _committed(spark, path: str) -> list[str]:
    """Names of the finished versions under ``path``, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(p.getName() for p in found if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_patients(spark, path: str) -> DataFrame | None:
    """The newest finished version of the patients under ``path``; None where there is none."""
    versions = _committed(spark, path)
    return spark.read.parquet(f"{path}/{versions[-1]}") if versions else None


def merge_patients(new: DataFrame, path: str, batch_id: str) -> DataFrame:
    """Upsert ``new`` into the patients under ``path`` and return them: upsert_patients as a merge on disk.

    A merge writes a version of its own, named by its number and batch, and a version counts once it is finished; so a job that dies leaves
    the patients as they were, and a batch that is merged already isn't merged again. One writer at a time is expected.
    """
    spark = new.sparkSession
    done = _committed(spark, path)
    if any(v.endswith(f"-{batch_id}") for v in done):
        return read_patients(spark, path)
    old = read_patients(spark, path)
    merged = upsert_patients(new.limit(0) if old is None else old, new)
    merged.write.mode("overwrite").parquet(f"{path}/version={len(done):08d}-{batch_id}")
    return read_patients(spark, path)


def bundle_resource_counts(resources: DataFrame) -> DataFrame:
    """Resources per type, read from their JSON."""
    return resources.groupBy(F.get_json_object("resource", "$.resourceType").alias("resource_type"), "patient_id").agg(F.count(F.lit(1)).alias("n"))


# ---- streams: each works on a batch or a streaming DataFrame with an event-time column ts

def stream_dedupe(facts: DataFrame, late: str = "1 hour") -> DataFrame:
    """A span recorded once per session and path within the watermark."""
    rows = facts.withWatermark("ts", late)
    keys = ["session_id", "path", "digest"]
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def stream_sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions of activity that end after ``gap`` without any."""
    by = events.withWatermark("ts", gap).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return by.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def stream_activity(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Events per interval and kind."""
    by = events.withWatermark("ts", width).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("events"))
    return by.select(F.col("w.start").alias("started"), "kind", "events")


def register(query) -> None:
    """The queries of this module."""
    fields = ["chief_complaint.text", "hpi.site", "hpi.onset"]

    @query("""WITH n AS (SELECT 'abha:' || CAST(c_custkey * 2 AS VARCHAR) AS abha_ref, 'New ' || c_name AS nn, 'other' AS ng FROM customer), o AS (SELECT * FROM patient WHERE abha_ref IS NOT NULL)
        SELECT coalesce(o.abha_ref, n.abha_ref) AS abha_ref, coalesce(display_name, nn) AS display_name, coalesce(gender, ng) AS gender FROM o FULL JOIN n ON o.abha_ref = n.abha_ref
        UNION ALL SELECT abha_ref, display_name, gender FROM patient WHERE abha_ref IS NULL""")
    def upsert_patients(t):
        new = t("customer").select(F.concat(F.lit("abha:"), (F.col("c_custkey") * 2).cast("string")).alias("abha_ref"), F.concat(F.lit("New "), "c_name").alias("display_name"), F.lit("other").alias("gender"))
        return globals()["upsert_patients"](t("patient"), new)

    @query("SELECT encounter_id, patient_id, consent_ref, headline, priority FROM encounter WHERE coalesce(confirmed_by, '') <> '' AND encounter_id IN (SELECT encounter_id FROM clinical_fact WHERE tier = 'document')")
    def promote_encounters(t):
        return globals()["promote_encounters"](t("encounter"), t("clinical_fact").filter("tier = 'document'"))

    @query("SELECT fact_id, path, value, tier AS state, recorded_at AS valid_from, CASE WHEN modality = 'speech' AND seq % 10 = 0 THEN 'unavailable' ELSE 'measured' END AS confidence_status FROM fact")
    def promote_facts_evidence(t):
        return promote_facts(t("fact").withColumn("confidence", F.when(F.col("seq") % 10 != 0, F.col("confidence"))))

    @query("SELECT 'ev-' || fact_id AS evidence_id, fact_id, CASE WHEN tier = 'document' THEN 'document' ELSE 'utterance' END AS source_type, verbatim, CASE WHEN tier <> 'document' THEN turn_id END AS turn_id, CASE WHEN tier <> 'document' THEN modality END AS modality FROM fact")
    def promote_evidence(t):
        return globals()["promote_evidence"](t("fact"))

    @query("""WITH c AS (SELECT 's' || CAST(user_id AS VARCHAR) AS session_ref, arg_max('k' || CAST(event_id AS VARCHAR), event_id) AS found FROM events GROUP BY 1)
        SELECT encounter_id, coalesce(consent_ref, found) AS consent_ref FROM encounter e LEFT JOIN c ON e.session_ref = c.session_ref""")
    def link_consent(t):
        consents = t("events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_ref"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("consent_ref"), F.col("event_id").alias("granted_at"))
        return globals()["link_consent"](t("encounter"), consents)

    @query("""WITH f AS (SELECT encounter_id, count(*) AS n FROM clinical_fact GROUP BY 1), m AS (SELECT encounter_id, count(*) AS n FROM medication GROUP BY 1)
        SELECT e.encounter_id, coalesce(f.n, 0) AS facts, coalesce(m.n, 0) AS medications FROM encounter e LEFT JOIN f ON e.encounter_id = f.encounter_id LEFT JOIN m ON e.encounter_id = m.encounter_id""")
    def promotion_counts(t):
        return globals()["promotion_counts"](t("encounter"), facts=t("clinical_fact"), medications=t("medication"))

    lines = """e AS (SELECT fact_id, count(*) AS sources, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS kinds FROM evidence GROUP BY 1),
        s AS (SELECT encounter_id, f.fact_id, CAST(list_position(['chief_complaint.text', 'hpi.site', 'hpi.onset'], path) AS BIGINT) AS place, value, sources, kinds FROM clinical_fact f JOIN e ON f.fact_id = e.fact_id
          WHERE superseded_by IS NULL AND invalidated_reason IS NULL AND path IN ('chief_complaint.text', 'hpi.site', 'hpi.onset'))"""

    @query(f"WITH {lines} SELECT * FROM s")
    def snapshot_lines(t):
        return globals()["snapshot_lines"](t("clinical_fact"), t("evidence"), fields)

    @query(f"""WITH {lines}, j AS (SELECT encounter_id, string_agg('{{"place":' || place || ',"fact_id":"' || fact_id || '","value":"' || value || '"}}', ',' ORDER BY place, fact_id) AS x FROM s GROUP BY 1)
        SELECT e.encounter_id, '{{"encounter_id":' || e.encounter_id || ',"priority":"' || priority || '","lines":[' || coalesce(x, '') || ']}}' AS brief FROM encounter e LEFT JOIN j ON e.encounter_id = j.encounter_id""")
    def assemble_brief(t):
        return globals()["assemble_brief"](t("encounter"), t("clinical_fact"), t("evidence"), fields)

    @query("""SELECT fact_id, encounter_id, CASE WHEN invalidated_reason IS NOT NULL THEN 'invalidated' WHEN superseded_by IS NOT NULL THEN 'superseded' ELSE 'declined' END AS class FROM clinical_fact
        WHERE invalidated_reason IS NOT NULL OR superseded_by IS NOT NULL OR value = 'none'""")
    def unresolved(t):
        return globals()["unresolved"](t("clinical_fact"))

    @query("SELECT encounter_id, o_orderstatus AS audience, 'v' || CAST(2 - encounter_id % 2 AS VARCHAR) AS version, encounter_id % 2 = 1 AS outdated FROM encounter JOIN orders ON encounter_id = o_orderkey")
    def write_snapshots(t):
        path = shared_path(t("orders").sparkSession, "snapshots")
        briefs = t("orders").select(F.col("o_orderkey").alias("encounter_id"), F.col("o_orderstatus").alias("audience"), F.col("o_orderkey").alias("id"), F.col("o_comment" if "o_comment" in t("orders").columns else "o_orderstatus").alias("brief"))
        globals()["write_snapshots"](briefs, path, "v1", "2024-03-01 00:00:00")
        globals()["write_snapshots"](briefs.filter("encounter_id % 2 = 0"), path, "v2", "2024-03-02 00:00:00")
        newest = globals()["latest_snapshot"](t("orders").sparkSession.read.parquet(path))
        return newest.select("encounter_id", "audience", "version", (F.col("version") != "v2").alias("outdated"))

    @query("""SELECT 'encounter' AS name, kind, count(*) AS n FROM encounter GROUP BY 2 UNION ALL SELECT 'medication', status, count(*) FROM medication GROUP BY 2""")
    def write_durable(t):
        spark = t("encounter").sparkSession
        path = shared_path(spark, "durable")
        for _ in range(2):  # a rerun of the batch changes nothing
            globals()["write_durable"]({"encounter": t("encounter"), "medication": t("medication")}, path, {"encounter": "kind"}, "b1")
        of = lambda name, by: spark.read.parquet(f"{path}/{name}").groupBy(F.lit(name).alias("name"), F.col(by).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        return of("encounter", "kind").unionByName(of("medication", "status"))

    @query("""WITH r AS (SELECT o_custkey AS encounter_id, o_orderstatus AS audience, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT encounter_id, audience, id FROM r WHERE r = 1""")
    def latest_snapshot(t):
        rows = t("orders").select(F.col("o_custkey").alias("encounter_id"), F.col("o_orderstatus").alias("audience"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("generated_at"))
        return globals()["latest_snapshot"](rows).select("encounter_id", "audience", "id")

    @query("""WITH n AS (SELECT * FROM patient WHERE patient_id % 3 <> 0), o AS (SELECT abha_ref, display_name, CAST(NULL AS VARCHAR) AS gender FROM patient WHERE patient_id % 3 <> 1),
        k AS (SELECT coalesce(o.abha_ref, n.abha_ref) AS abha_ref, coalesce(o.display_name, n.display_name) AS display_name, coalesce(o.gender, n.gender) AS gender FROM (SELECT * FROM o WHERE abha_ref IS NOT NULL) o FULL JOIN (SELECT * FROM n WHERE abha_ref IS NOT NULL) n ON o.abha_ref = n.abha_ref)
        SELECT * FROM k UNION ALL SELECT abha_ref, display_name, gender FROM o WHERE abha_ref IS NULL UNION ALL SELECT abha_ref, display_name, gender FROM n WHERE abha_ref IS NULL""")
    def merge_patients(t):
        path = shared_path(t("patient").sparkSession, "patients")
        first = t("patient").filter("patient_id % 3 <> 1").select("abha_ref", "display_name", F.lit(None).cast("string").alias("gender"))
        second = t("patient").filter("patient_id % 3 <> 0").select("abha_ref", "display_name", "gender")
        globals()["merge_patients"](first, path, "b1")
        globals()["merge_patients"](second, path, "b2")
        return globals()["merge_patients"](second, path, "b2")  # once more: nothing changes

    @query("""SELECT session_id, CASE priority WHEN 'immediate' THEN 2 WHEN 'urgent' THEN 1 ELSE 0 END AS rank, CAST(floor((epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(created_at)) / 60) AS BIGINT) AS waiting_minutes FROM session WHERE purged_at IS NULL""")
    def triage_queue(t):
        return globals()["triage_queue"](t("session"), "2024-03-01 00:00:00")

    @query("""SELECT event_type AS path, count(*) AS expected, count(*) FILTER (event_id % 7 <> 0) AS matched, round(count(*) FILTER (event_id % 7 <> 0) / count(*), 4) AS accuracy FROM events GROUP BY 1""")
    def per_field_accuracy(t):
        rows = t("events").select(F.col("event_type").alias("path"), F.col("event_id").alias("expected_value"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("actual_value"))
        return globals()["per_field_accuracy"](rows)

    @query("""SELECT event_type AS difficulty, count(*) AS expected, count(*) FILTER (event_id % 7 <> 0) AS matched, round(count(*) FILTER (event_id % 7 <> 0) / count(*), 4) AS accuracy FROM events GROUP BY GROUPING SETS ((event_type), ())""")
    def by_difficulty(t):
        rows = t("events").select(F.col("event_type").alias("difficulty"), F.col("event_id").alias("expected_value"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("actual_value"))
        return globals()["by_difficulty"](rows)

    entry = lambda place, at, body, source, after=0: f"SELECT encounter_id, {place} AS place, {at} AS k, {after} AS after, '{{\"resource\":' || {body} || '}}' AS entry FROM {source}"
    provenance = lambda target: f"""'{{"resourceType":"Provenance","target":"{target}/' || fact_id || '","activity":"' || tier || '","entity":"' || value || '"}}'"""
    sources = [
        entry(0, "''", """'{"resourceType":"Composition","status":"preliminary","subject":{"reference":"Patient/' || patient_id || '"}}'""", "encounter"),
        entry(1, "''", """'{"resourceType":"Patient","id":"' || patient_id || '"}'""", "encounter"),
        entry(2, "''", """'{"resourceType":"Consent","id":"' || consent_ref || '"}'""", "encounter WHERE consent_ref IS NOT NULL"),
        entry(3, "term || '|' || fact_id", """'{"resourceType":"Condition","id":"' || fact_id || '","verificationStatus":"unconfirmed","code":"' || term || '"}'""", "pr"),
        entry(3, "term || '|' || fact_id", provenance("Condition"), "(SELECT pr.*, tier, value FROM pr JOIN clinical_fact f ON pr.encounter_id = f.encounter_id AND pr.fact_id = f.fact_id)", 1),
        entry(4, "name || '|' || status || '|' || fact_id", """'{"resourceType":"MedicationStatement","id":"' || fact_id || '","status":"' || CASE status WHEN 'patient-reported-current' THEN 'active' ELSE 'unknown' END || '","medication":"' || name || '"}'""", "md"),
        entry(4, "name || '|' || status || '|' || fact_id", provenance("MedicationStatement"), "(SELECT md.*, tier, value FROM md JOIN clinical_fact f ON md.encounter_id = f.encounter_id AND md.fact_id = f.fact_id)", 1),
        entry(5, "concat_ws('|', analyte_key, CAST(CAST(value AS DOUBLE) AS VARCHAR), unit)", """'{"resourceType":"Observation","code":"' || analyte_key || '","valueQuantity":{"value":' || CAST(CAST(value AS DOUBLE) AS VARCHAR) || coalesce(',"unit":"' || unit || '"', '') || '}}'""", "observation WHERE value IS NOT NULL"),
        entry(6, "level || '|R2'", """'{"resourceType":"Flag","status":"active","code":"[' || upper(level) || '] R2"}'""", "(SELECT encounter_id, priority AS level FROM encounter WHERE priority <> 'routine')"),
        entry(7, "title", """'{"resourceType":"DocumentReference","status":"current","description":"' || title || '"}'""", "(SELECT encounter_id, 'paper ' || encounter_id AS title FROM encounter WHERE kind = 'document')"),
    ]

    @query(f"""WITH pr AS (SELECT encounter_id, value AS term, fact_id FROM clinical_fact WHERE path = 'hpi.associated' AND value <> 'none'), md AS (SELECT *, 'f' || encounter_id || '-' || line_no AS fact_id FROM medication),
        x AS ({" UNION ALL ".join(sources)}), b AS (SELECT encounter_id, '{{"resourceType":"Bundle","type":"document","entry":[' || string_agg(entry, ',' ORDER BY place, k, after, entry) || ']}}' AS bundle FROM x GROUP BY 1)
        SELECT e.encounter_id, bundle FROM encounter e LEFT JOIN b ON e.encounter_id = b.encounter_id""")
    def to_fhir_bundles(t):
        problems = t("clinical_fact").filter("path = 'hpi.associated' and value <> 'none'").select("encounter_id", F.col("value").alias("term"), "fact_id")
        medications = t("medication").withColumn("fact_id", F.concat(F.lit("f"), F.col("encounter_id").cast("string"), F.lit("-"), F.col("line_no").cast("string")))
        flags = t("encounter").filter("priority <> 'routine'").select("encounter_id", F.col("priority").alias("level"), F.lit("R2").alias("label"))
        papers = t("encounter").filter("kind = 'document'").select("encounter_id", F.concat(F.lit("paper "), F.col("encounter_id").cast("string")).alias("title"))
        return fhir_bundles(t("encounter"), t("clinical_fact"), medications, t("observation"), problems, flags, papers)

    @query("SELECT 'Observation' AS resource_type, patient_id, count(*) AS n FROM observation WHERE value IS NOT NULL GROUP BY 2")
    def bundle_resource_counts(t):
        return globals()["bundle_resource_counts"](fhir_observations(t("observation")))

    @query("SELECT user_id AS session_id, max(event_id % 3) AS rank FROM events GROUP BY 1")
    def stream_priority(t):
        return globals()["stream_priority"](t("events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 3).alias("rank")))

    @query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id AS session_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS events FROM g GROUP BY user_id, g""")
    def stream_sessions(t):
        return globals()["stream_sessions"](t("events").withColumnRenamed("user_id", "session_id"))

    @query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS started, event_type AS kind, count(*) AS events FROM events GROUP BY 1, 2")
    def stream_activity(t):
        return globals()["stream_activity"](t("events").withColumnRenamed("event_type", "kind"))
