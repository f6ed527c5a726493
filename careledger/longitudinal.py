"""Read models over a patient's encounters: overview, timelines, medication threads, lab series, likeness and change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careledger.evidence import casefolded, texts_of

#: The paths by which encounters are alike.
SIMILARITY_PATHS = ["chief_complaint.text", "hpi.site", "hpi.character", "hpi.radiation", "hpi.timing", "hpi.associated", "hpi.exacerbating", "past_medical.conditions"]
HOW_WE_KNOW = {"documented": "from a document", "stopped-reported": "reported stopped", "patient-reported-current": "told by the patient"}


def normalize_name(name: Column) -> Column:
    """Join key of a medicine: lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def live_facts(facts: DataFrame) -> DataFrame:
    """Facts that are neither superseded nor invalidated."""
    return facts.filter(F.col("superseded_by").isNull() & F.col("invalidated_reason").isNull())


def confirmed_encounters(encounters: DataFrame) -> DataFrame:
    """Intake encounters that somebody confirmed."""
    return encounters.filter((F.col("kind") == "intake") & (F.coalesce("confirmed_by", F.lit("")) != ""))


def mask_identifier(ref: Column) -> Column:
    """All but the last four characters hidden; null stays null."""
    return F.concat(F.lit("**** **** "), F.right(ref, F.lit(4)))


def patient_overview(patients: DataFrame, encounters: DataFrame, papers: DataFrame, medications: DataFrame, observations: DataFrame, recent: int = 6) -> DataFrame:
    """Per patient: counts of encounters, papers (encounter_id, document_kind) by kind, different medicines and observations, and the most recent encounters.

    Each child is counted by patient before it meets another, so none multiplies another; papers are counted by visit first.
    """
    what = F.when(F.col("document_kind") == "prescription", "prescriptions").when(F.col("document_kind") == "lab_report", "lab_reports").otherwise("other_documents")
    kinds = ["prescriptions", "lab_reports", "other_documents"]
    by_visit = papers.groupBy("encounter_id").agg(*[F.count_if(what == c).alias(c) for c in kinds])
    order = Window.partitionBy("patient_id").orderBy(F.desc("occurred_at"), F.desc("encounter_id"))
    visits = encounters.select("patient_id", "encounter_id", "occurred_at").join(by_visit, "encounter_id", "left")
    visits = visits.withColumn("late", F.row_number().over(order) <= recent).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("encounters"), *[F.sum(c).alias(c) for c in kinds], F.sort_array(F.collect_list(F.when(F.col("late"), F.struct("occurred_at", "encounter_id"))), asc=False).alias("last")
    )
    # Each spelling of a name is folded once.
    medicines = medications.select("patient_id", "name").distinct().groupBy("patient_id").agg(F.count_distinct(normalize_name(F.col("name"))).alias("medicines"))
    readings = observations.groupBy("patient_id").agg(F.count(F.lit(1)).alias("observations"))
    rows = patients.select("patient_id", mask_identifier(F.col("abha_ref")).alias("masked_ref"))
    for part in (visits, medicines, readings):
        rows = rows.join(part, "patient_id", "left")
    rows = rows.withColumn("recent_encounters", F.array_join(F.transform("last", lambda x: x["encounter_id"].cast("string")), ",")).drop("last")
    return rows.fillna(0, ["encounters", *kinds, "medicines", "observations"])


def patient_timeline(encounters: DataFrame, medications: DataFrame, observations: DataFrame) -> DataFrame:
    """Dated events per kind in one table with their place in the patient's timeline: newest first, undated last."""
    kinds = F.when(F.col("kind") == "encounter", 0).when(F.col("kind") == "medication", 1).otherwise(2)
    events = (
        encounters.select("patient_id", "encounter_id", F.col("occurred_at").alias("occurred_on"), F.lit("encounter").alias("kind"), F.col("priority").alias("label"))
        .unionByName(medications.select("patient_id", "encounter_id", F.col("observed_on").alias("occurred_on"), F.lit("medication").alias("kind"), normalize_name(F.col("name")).alias("label")))
        .unionByName(observations.select("patient_id", "encounter_id", F.col("observed_on").alias("occurred_on"), F.lit("observation").alias("kind"), F.col("analyte_key").alias("label")))
    )
    order = Window.partitionBy("patient_id").orderBy(F.desc_nulls_last("occurred_on"), kinds, "encounter_id", "label")
    return events.withColumn("place", F.rank().over(order))


def medication_threads(medications: DataFrame) -> DataFrame:
    """Per patient and medicine: its mentions in order, each with how we know."""
    known = F.create_map(*[F.lit(x) for kv in HOW_WE_KNOW.items() for x in kv])
    mention = F.struct("observed_on", "encounter_id", "line_no", "status", "dose")
    threads = medications.groupBy("patient_id", normalize_name(F.col("name")).alias("normalized_name")).agg(F.sort_array(F.collect_list(mention)).alias("m"))
    text = F.transform("m", lambda x: F.concat_ws(" ", x["observed_on"].cast("string"), known[x["status"]]))
    return threads.select("patient_id", "normalized_name", F.size("m").cast("long").alias("mentions"), F.array_join(text, "; ").alias("thread"))


def reconcile_medications(medications: DataFrame, encounters: DataFrame, denials: DataFrame) -> DataFrame:
    """Threads in conflict: documented and stopped, or documented though the patient's latest encounter denies medicines.

    ``denials`` holds the encounter_id of every encounter in which medicines are denied.
    """
    latest = encounters.groupBy("patient_id").agg(F.max_by("encounter_id", F.struct("occurred_at", "encounter_id")).alias("encounter_id"))
    denied = latest.join(denials.select("encounter_id").distinct(), "encounter_id", "left_semi").select("patient_id", F.lit(True).alias("denied"))
    by = medications.groupBy("patient_id", normalize_name(F.col("name")).alias("normalized_name")).agg(
        F.bool_or(F.col("status") == "documented").alias("documented"), F.bool_or(F.col("status") == "stopped-reported").alias("stopped")
    )
    by = by.join(denied, "patient_id", "left").withColumn("denied", F.coalesce("denied", F.lit(False)))
    return by.withColumn("conflict", F.col("documented") & (F.col("stopped") | F.col("denied")))


def reconcile_live(medications: DataFrame, live: DataFrame) -> DataFrame:
    """Today's answers against the record: one finding where medicines are denied, else one per documented medicine not mentioned now.

    ``live`` has patient_id, denied and name (null where nothing was mentioned).
    """
    record = medications.filter("status = 'documented'").select("patient_id", normalize_name(F.col("name")).alias("normalized_name")).distinct()
    flags = live.groupBy("patient_id").agg(F.bool_or("denied").alias("denied"))
    denied = record.join(flags.filter("denied"), "patient_id", "left_semi").groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    denied = denied.select("patient_id", F.lit("denied").alias("finding"), F.lit(None).cast("string").alias("normalized_name"), "n")
    said = live.filter("name is not null").select("patient_id", normalize_name(F.col("name")).alias("normalized_name"))
    missing = record.join(flags.filter("not denied"), "patient_id", "left_semi").join(said, ["patient_id", "normalized_name"], "left_anti")
    return denied.unionByName(missing.select("patient_id", F.lit("not mentioned").alias("finding"), "normalized_name", F.lit(1).cast("long").alias("n")))


def feature_sets(facts: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """encounter_id, path, value: distinct values of the likeness paths, of superseded facts, too; null, empty and 'none' dropped, lists (an array or a VARIANT) taken apart."""
    kind, value = dict(facts.dtypes)["value"], F.col("value")
    values = texts_of(value) if kind == "variant" else value if kind.startswith("array") else F.array(value)
    rows = facts.filter(F.col("path").isin(paths or SIMILARITY_PATHS)).select("encounter_id", "path", F.explode(values).alias("value"))
    return rows.filter(F.col("value").isNotNull() & ~F.col("value").isin("", "none")).distinct()


def live_features(facts: DataFrame) -> DataFrame:
    """encounter_id, path, value of all live facts of any path: the other set that visits are compared by."""
    return live_facts(facts).filter("value is not null").select("encounter_id", "path", F.col("value").cast("string").alias("value")).distinct()


#: Patients with up to so many visits are compared visit by visit; beyond it, and for sets of up to so many features, by what they share.
DIRECT_VISITS, SUBSET_FEATURES = 64, 10


def _near_of_few(rows: DataFrame, top: int) -> DataFrame:
    """encounter_id and ``near``, its best others, of patients with few visits: one bounded array a patient."""
    def nearest(me: Column, every: Column) -> Column:
        met = F.transform(every, lambda o: F.struct(F.array_intersect(me["f"], o["f"]).alias("both"), o["at"].alias("at"), o["id"].alias("id")))
        met = F.filter(met, lambda o: (F.size(o["both"]) > 0) & (o["id"] != me["id"]))
        order = F.array_sort(F.transform(met, lambda o: F.struct((-F.size(o["both"])).alias("less"), o["at"].alias("at"), o["id"].alias("id"), o["both"].alias("both"))))
        return F.struct(me["id"].alias("encounter_id"), F.slice(order, 1, top).alias("near"))

    visits = rows.groupBy("patient_id").agg(F.collect_list(F.struct(F.col("occurred_at").alias("at"), F.col("encounter_id").alias("id"), "f")).alias("v"))
    return visits.select(F.explode(F.transform("v", lambda me: nearest(me, F.col("v")))).alias("x")).select("x.*")


def _near_of_many(rows: DataFrame, top: int) -> DataFrame:
    """The same for patients with many visits, without pairs of them.

    Visits with the same features are one set, of which the ``top`` + 1 oldest count. The index has, for each part of a set, the ``top`` + 1 oldest visits with
    that part; what shares exactly a part with a visit and isn't among them is behind ``top`` others that share as much and are older. So
    a visit finds its nearest in the lists of its own parts. Parts are named by the exclusive or of their features' hashes, and what meets is verified on the sets.
    Sets of more than SUBSET_FEATURES features have too many parts; they meet all others by single features.
    """
    sets = rows.withColumn("set_id", F.xxhash64("f"))
    age = Window.partitionBy("patient_id", "set_id").orderBy("occurred_at", "encounter_id")
    oldest = sets.withColumn("r", F.row_number().over(age)).filter(F.col("r") <= top + 1).drop("r")
    wide = F.size("f") > SUBSET_FEATURES
    parts = F.aggregate(F.transform("f", lambda x: F.xxhash64(x)), F.array(F.lit(0).cast("long")), lambda acc, h: F.concat(acc, F.transform(acc, lambda p: p.bitwiseXOR(h))))
    part = F.explode(F.slice(parts, 2, (1 << SUBSET_FEATURES) - 1)).alias("part")
    first = Window.partitionBy("patient_id", "part").orderBy("occurred_at", "encounter_id")
    other = [F.col("encounter_id").alias("id"), F.col("occurred_at").alias("at"), F.col("f").alias("of")]
    index = oldest.filter(~wide).select("patient_id", "encounter_id", "occurred_at", "f", part).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top + 1)
    each = sets.select("patient_id", "set_id", "f").dropDuplicates(["patient_id", "set_id"])
    met = each.filter(~wide).select("patient_id", "set_id", "f", part).join(index.select("patient_id", "part", *other), ["patient_id", "part"])
    single = lambda df: df.withColumn("x", F.explode("f"))
    by_one = single(each).join(single(oldest).select("patient_id", "x", wide.alias("wide"), *other), ["patient_id", "x"]).filter(wide | F.col("wide"))
    columns = ["patient_id", "set_id", "f", "at", "id", "of"]
    met = met.select(columns).unionByName(by_one.select(columns)).dropDuplicates(["patient_id", "set_id", "id"])
    met = met.withColumn("both", F.array_intersect("f", "of")).withColumn("less", -F.size("both")).filter("less < 0")
    best = Window.partitionBy("patient_id", "set_id").orderBy("less", "at", "id")
    best = met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top + 1)
    lists = best.groupBy("patient_id", "set_id").agg(F.array_sort(F.collect_list(F.struct("less", "at", "id", "both"))).alias("all"))
    near = F.slice(F.filter("all", lambda o: o["id"] != F.col("encounter_id")), 1, top).alias("near")
    return sets.select("patient_id", "set_id", "encounter_id").join(lists, ["patient_id", "set_id"]).select("encounter_id", near)


def similar_encounters(features: DataFrame, encounters: DataFrame, top: int = 3, direct: int = DIRECT_VISITS) -> DataFrame:
    """For each encounter the same patient's encounters that share most features; ties go to the oldest.

    Patients never meet. Those with up to ``direct`` visits are compared within one bounded array, others by an index of the parts of their sets of features.
    """
    feature = F.concat_ws("=", "path", "value")
    by = features.groupBy("encounter_id").agg(F.array_sort(F.collect_set(feature)).alias("f"))
    rows = by.join(encounters.select("encounter_id", "patient_id", "occurred_at"), "encounter_id")
    many = encounters.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > direct).select("patient_id")
    near = _near_of_few(rows.join(many, "patient_id", "left_anti"), top).unionByName(_near_of_many(rows.join(many, "patient_id", "left_semi"), top))
    ranked = near.select("encounter_id", F.posexplode("near").alias("at", "o"))
    shared = (-F.col("o.less")).cast("long")
    band = F.when(shared >= 4, "many").when(shared >= 2, "some").otherwise("one")
    return ranked.select("encounter_id", F.col("o.id").alias("similar_id"), shared.alias("shared"), F.array_join(F.array_sort("o.both"), ",").alias("shared_features"), band.alias("band"), (F.col("at") + 1).cast("long").alias("rank"))


def observation_series(observations: DataFrame) -> DataFrame:
    """Per patient and analyte with two dated numbers or more: points, last value, its change from the one before, readings out of range.

    A reading without a key goes by its display in lower case, where observations have it.
    """
    points = observations.filter("value is not null and observed_on is not null")
    if "display" in points.columns:
        points = points.withColumn("analyte_key", F.coalesce(F.nullif("analyte_key", F.lit("")), casefolded(F.col("display"))))
    key = ["patient_id", "analyte_key"]
    order = Window.partitionBy(*key).orderBy("observed_on", "tie", "encounter_id", "value")
    # Only the last point is kept after the window, so nothing is collected.
    n, out_of_range = F.count(F.lit(1)).over(Window.partitionBy(*key)), F.count_if(F.col("range_flag").isin("low", "high")).over(Window.partitionBy(*key))
    last = points.select(
        *key, n.alias("points"), out_of_range.alias("out_of_range"), F.lag("value").over(order).alias("previous"), F.col("value").alias("latest"), F.lead(F.lit(1)).over(order).alias("after")
    ).filter("after is null and points >= 2")
    delta = F.col("latest") - F.col("previous")
    return last.select(*key, "points", "latest", delta.alias("delta"), F.when(delta > 0, "up").when(delta < 0, "down").otherwise("unchanged").alias("direction"), "out_of_range")


def brief_series(observations: DataFrame) -> DataFrame:
    """Per patient and analyte: chartable if all units that are given agree and there are two points; change is last less first."""
    points = observations.filter("value is not null and observed_on is not null")
    at = F.struct("observed_on", "tie", "encounter_id", "value")
    by = points.groupBy("patient_id", "analyte_key").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("unit").alias("units"), F.min(at).alias("first"), F.max(at).alias("last"))
    why = F.when(F.col("points") < 2, "single reading").when(F.col("units") > 1, "units differ").otherwise("chartable")
    return by.select("patient_id", "analyte_key", "points", why.alias("status"), F.when(why == "chartable", F.col("last.value") - F.col("first.value")).alias("delta"))


def latest_observations(observations: DataFrame) -> DataFrame:
    """The last reading per patient and analyte; an undated one is oldest."""
    at = F.struct(F.coalesce("observed_on", F.lit("0001-01-01").cast("date")), "tie", "encounter_id", F.coalesce("value", F.lit(-1.0)))
    return observations.groupBy("patient_id", "analyte_key").agg(F.max_by(F.struct("value", "observed_on"), at).alias("x")).select("patient_id", "analyte_key", "x.value", "x.observed_on")


def recurrence(encounters: DataFrame) -> DataFrame:
    """Intake encounters of a patient by folded headline: count and first day."""
    headline = F.coalesce(F.nullif(F.lower(F.trim("headline")), F.lit("")), F.lit("unspecified"))
    return encounters.filter("kind = 'intake'").groupBy("patient_id", headline.alias("headline")).agg(F.count(F.lit(1)).alias("visits"), F.min("occurred_at").alias("first_seen"))


def previous_encounter(encounters: DataFrame) -> DataFrame:
    """Each encounter with the one before it, by day and id."""
    order = Window.partitionBy("patient_id").orderBy("occurred_at", "encounter_id")
    return encounters.select("encounter_id", "patient_id", F.lag("encounter_id").over(order).alias("previous_id"))


def what_changed(features: DataFrame, encounters: DataFrame) -> DataFrame:
    """new, resolved and persisting features between each encounter and its previous one; ``features`` of either kind (feature_sets, live_features).

    Features are gathered once an encounter (they are few), and each encounter gets those of the one before it in the patient's order.
    """
    sets = features.groupBy("encounter_id").agg(F.collect_set(F.struct("path", "value")).alias("f"))
    none = F.array().cast(sets.schema["f"].dataType)
    rows = encounters.select("encounter_id", "patient_id", "occurred_at").join(sets, "encounter_id", "left").withColumn("f", F.coalesce("f", none))
    order = Window.partitionBy("patient_id").orderBy("occurred_at", "encounter_id")
    rows = rows.withColumn("then", F.lag("f").over(order)).filter("then is not null")
    told = lambda kind, items: F.transform(items, lambda x: F.struct(x["path"].alias("path"), x["value"].alias("value"), F.lit(kind).alias("change")))
    changes = F.concat(told("new", F.array_except("f", "then")), told("resolved", F.array_except("then", "f")), told("persisting", F.array_intersect("f", "then")))
    return rows.select("encounter_id", F.inline(changes))


def cohort_pairs(patients: DataFrame, key: str) -> DataFrame:
    """Counts per ``key`` of pairs of patients that may be compared: both synthetic, or neither."""
    by = patients.groupBy(key, "is_synthetic").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(key).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
