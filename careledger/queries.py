"""Queries that apply the library's operators to its bound tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careledger import bundles, documents, evaluation, evidence, governance, intake, ledger, longitudinal, promotion, rules, streams, summary, tables
from careledger.bindings import load, oracle
from careledger.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PATHS = ["hpi.click", "hpi.view", "hpi.purchase", "hpi.error"]
#: Answers of the sessions in the queries of escalation rules, several of a path joined by a comma.
ANSWERS = {
    "hpi.site": ["chest", "abdomen", "head", "knee"],
    "hpi.onset": ["sudden", "slow"],
    "hpi.severity": ["3", "7", "8", "9", "true"],
    "hpi.associated": ["sweating", "breathlessness,bleeding", "dizziness", "weight_loss", "speech_trouble", "nausea"],
    "hpi.radiation": ["left_arm", "back", "leg"],
    "hpi.exacerbating": ["worse_effort", "rest"],
    "review_of_systems.cardiovascular": ["orthopnoea,ankle_swelling", "orthopnoea", "chest_pain_exertion", "no"],
    "review_of_systems.neurological": ["thunderclap", "neck_stiff,fits", "fainting", "facial_droop,speech", "no", "tingling"],
    "review_of_systems.gastrointestinal": ["melaena", "jaundice", "swallowing,weight_loss", "no"],
    "review_of_systems.respiratory": ["cough_3wk,night_sweats", "cough_3wk", "haemoptysis", "no"],
    "review_of_systems.general": ["weight_loss", "fever_persistent", "bleeding_any", "no"],
    "review_of_systems.genitourinary": ["retention", "haematuria", "no"],
    "drug_allergy.allergy_reaction": ["swelling", "rash", "collapse"],
    "personal_history.pregnancy": ["maybe", "no", "yes"],
}


def query(sql: str | None = None):
    """Register a function of a loader as a query under its name; ``sql`` may use the bound tables."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: load(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


# ---- sources

_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"


def _read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a declared schema, per status: how many, and the last day."""
    rows = tables.read_table(spark, f"{sf_dir}/orders.parquet", _ORDERS)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last_key"), F.max(F.col("o_orderdate").cast("date")).alias("last_day"))


QUERIES["read_tables"] = _read_tables
ORACLE_SQL["read_tables"] = "SELECT o_orderstatus, count(*) AS orders, max(o_orderkey) AS last_key, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1"



#: JSON keeps milliseconds of a time unless it is told otherwise.
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _typed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound tables written as Parquet and as JSON and read again by SCHEMAS: rows, different rows, and rows that the two forms don't share."""
    path, out = shared_path(spark, "typed"), None
    for name in ("encounter", "medication", "session", "audit"):
        for form in ("parquet", "json"):
            packed = {"compression": "gzip"} if form == "json" else {}
            load(spark, sf_dir, name).write.format(form).options(timestampFormat=_MICROS + "XXX", timestampNTZFormat=_MICROS, **packed).save(f"{path}/{name}.{form}")
        one, other = (tables.read_tables(spark, path, [name], form)[name] for form in ("parquet", "json"))
        key = lambda df, in_one, in_other: df.select(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]).alias("h"), F.lit(in_one).alias("n"), F.lit(in_other).alias("m"))
        # Both forms in one aggregation: a row's hash is shuffled once a form, with nothing to join after.
        both = key(one, 1, 0).unionByName(key(other, 0, 1)).groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        row = both.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.count_if(F.col("n") != F.col("m")).alias("unshared")).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES["read_typed_tables"] = _typed_tables
ORACLE_SQL["read_typed_tables"] = oracle(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {n})) AS distinct_rows, 0 AS unshared FROM {n}" for n, c in ((n, ", ".join(f.split()[0] for f in tables.SCHEMAS[n].split(", "))) for n in ("encounter", "medication", "session", "audit"))))

# ---- longitudinal read models

@query("""WITH p AS (SELECT *, lag(value) OVER w AS previous, lead(1) OVER w AS after, count(*) OVER (PARTITION BY patient_id, analyte_key) AS points,
    sum(CASE WHEN range_flag IN ('low', 'high') THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id, analyte_key) AS oor
    FROM observation WHERE value IS NOT NULL AND observed_on IS NOT NULL WINDOW w AS (PARTITION BY patient_id, analyte_key ORDER BY observed_on, tie, encounter_id, value))
    SELECT patient_id, analyte_key, points, value AS latest, value - previous AS delta, CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'unchanged' END AS direction,
    CAST(oor AS BIGINT) AS out_of_range FROM p WHERE after IS NULL AND points >= 2""")
def observation_series(t):
    return longitudinal.observation_series(t("observation"))


@query("""WITH o AS (SELECT patient_id, encounter_id, value, observed_on, tie, range_flag, coalesce(CASE WHEN encounter_id % 3 = 0 THEN NULL WHEN encounter_id % 3 = 1 THEN '' ELSE analyte_key END, NULL) AS k, 'S. ' || upper(analyte_key) AS display FROM observation),
    q AS (SELECT *, coalesce(nullif(k, ''), lower(display)) AS analyte_key FROM o WHERE value IS NOT NULL AND observed_on IS NOT NULL),
    p AS (SELECT *, lag(value) OVER w AS previous, lead(1) OVER w AS after, count(*) OVER (PARTITION BY patient_id, analyte_key) AS points,
    sum(CASE WHEN range_flag IN ('low', 'high') THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id, analyte_key) AS oor FROM q WINDOW w AS (PARTITION BY patient_id, analyte_key ORDER BY observed_on, tie, encounter_id, value))
    SELECT patient_id, analyte_key, points, value AS latest, value - previous AS delta, CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'unchanged' END AS direction, CAST(oor AS BIGINT) AS out_of_range FROM p WHERE after IS NULL AND points >= 2""")
def observation_series_by_display(t):
    key = F.when(F.col("encounter_id") % 3 == 1, "").when(F.col("encounter_id") % 3 == 2, F.col("analyte_key"))
    rows = t("observation").withColumn("display", F.concat(F.lit("S. "), F.upper("analyte_key"))).withColumn("analyte_key", key)
    return longitudinal.observation_series(rows)


@query("""SELECT patient_id, analyte_key, points, CASE WHEN points < 2 THEN 'single reading' WHEN units > 1 THEN 'units differ' ELSE 'chartable' END AS status,
    CASE WHEN points >= 2 AND units <= 1 THEN l.v - f.v END AS delta FROM (SELECT patient_id, analyte_key, count(*) AS points, count(DISTINCT unit) AS units,
    min({'d': observed_on, 't': tie, 'e': encounter_id, 'v': value}) AS f, max({'d': observed_on, 't': tie, 'e': encounter_id, 'v': value}) AS l
    FROM observation WHERE value IS NOT NULL AND observed_on IS NOT NULL GROUP BY ALL)""")
def brief_series(t):
    return longitudinal.brief_series(t("observation"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, analyte_key ORDER BY coalesce(observed_on, DATE '0001-01-01') DESC, tie DESC, encounter_id DESC, coalesce(value, -1) DESC) AS r FROM observation)
    SELECT patient_id, analyte_key, value, observed_on FROM r WHERE r = 1""")
def latest_observations(t):
    return longitudinal.latest_observations(t("observation"))


@query("""WITH e AS (SELECT patient_id, count(*) AS encounters FROM encounter GROUP BY 1),
    d AS (SELECT patient_id, count(*) FILTER (document_kind = 'prescription') AS prescriptions, count(*) FILTER (document_kind = 'lab_report') AS lab_reports,
      count(*) FILTER (coalesce(document_kind, '') NOT IN ('prescription', 'lab_report')) AS other_documents FROM document_record r JOIN encounter c ON r.encounter_id = c.encounter_id GROUP BY 1),
    m AS (SELECT patient_id, count(DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))) AS medicines FROM medication GROUP BY 1),
    o AS (SELECT patient_id, count(*) AS observations FROM observation GROUP BY 1),
    l AS (SELECT patient_id, string_agg(CAST(encounter_id AS VARCHAR), ',' ORDER BY r) AS recent_encounters FROM
      (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY occurred_at DESC, encounter_id DESC) AS r FROM encounter) WHERE r <= 6 GROUP BY 1)
    SELECT p.patient_id, '**** **** ' || right(abha_ref, 4) AS masked_ref, coalesce(encounters, 0) AS encounters, coalesce(prescriptions, 0) AS prescriptions, coalesce(lab_reports, 0) AS lab_reports, coalesce(other_documents, 0) AS other_documents,
    coalesce(medicines, 0) AS medicines, coalesce(observations, 0) AS observations, recent_encounters
    FROM patient p LEFT JOIN e ON p.patient_id = e.patient_id LEFT JOIN d ON p.patient_id = d.patient_id LEFT JOIN m ON p.patient_id = m.patient_id LEFT JOIN o ON p.patient_id = o.patient_id LEFT JOIN l ON p.patient_id = l.patient_id""")
def patient_overview(t):
    return longitudinal.patient_overview(t("patient"), t("encounter"), t("document_record"), t("medication"), t("observation"))


@query("""WITH v AS (SELECT patient_id, encounter_id, occurred_at AS occurred_on, 'encounter' AS kind, priority AS label, 0 AS k FROM encounter
    UNION ALL SELECT patient_id, encounter_id, observed_on, 'medication', trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), 1 FROM medication
    UNION ALL SELECT patient_id, encounter_id, observed_on, 'observation', analyte_key, 2 FROM observation)
    SELECT patient_id, encounter_id, occurred_on, kind, label, CAST(rank() OVER (PARTITION BY patient_id ORDER BY occurred_on DESC NULLS LAST, k, encounter_id, label) AS INT) AS place FROM v""")
def patient_timeline(t):
    return longitudinal.patient_timeline(t("encounter"), t("medication"), t("observation"))


@query("""WITH m AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n, CASE status WHEN 'documented' THEN 'from a document' WHEN 'stopped-reported' THEN 'reported stopped' ELSE 'told by the patient' END AS how FROM medication)
    SELECT patient_id, n AS normalized_name, count(*) AS mentions, string_agg(CAST(observed_on AS VARCHAR) || ' ' || how, '; ' ORDER BY observed_on, encounter_id, line_no, status, dose) AS thread FROM m GROUP BY 1, 2""")
def medication_threads(t):
    return longitudinal.medication_threads(t("medication"))


@query("""WITH l AS (SELECT patient_id, encounter_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY occurred_at DESC, encounter_id DESC) AS r FROM encounter) WHERE r = 1),
    d AS (SELECT DISTINCT patient_id FROM l WHERE encounter_id IN (SELECT encounter_id FROM clinical_fact WHERE path = 'hpi.site' AND value = 'none')),
    m AS (SELECT patient_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, bool_or(status = 'documented') AS documented, bool_or(status = 'stopped-reported') AS stopped FROM medication GROUP BY 1, 2)
    SELECT m.*, d.patient_id IS NOT NULL AS denied, documented AND (stopped OR d.patient_id IS NOT NULL) AS conflict FROM m LEFT JOIN d ON m.patient_id = d.patient_id""")
def reconcile_medications(t):
    return longitudinal.reconcile_medications(t("medication"), t("encounter"), t("clinical_fact").filter("path = 'hpi.site' and value = 'none'"))


@query("""WITH r AS (SELECT DISTINCT patient_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM medication WHERE status = 'documented'),
    s AS (SELECT DISTINCT patient_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM medication WHERE status = 'patient-reported-current')
    SELECT patient_id, 'denied' AS finding, CAST(NULL AS VARCHAR) AS normalized_name, count(*) AS n FROM r WHERE patient_id % 3 = 0 GROUP BY 1
    UNION ALL SELECT patient_id, 'not mentioned', n, 1 FROM r WHERE patient_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.patient_id = r.patient_id AND s.n = r.n)""")
def reconcile_live(t):
    said = t("medication").filter("status = 'patient-reported-current'").select("patient_id", "name")
    live = t("patient").select("patient_id", F.lit(None).cast("string").alias("name")).unionByName(said).withColumn("denied", F.col("patient_id") % 3 == 0)
    return longitudinal.reconcile_live(t("medication"), live)


_FEATURES = "f AS (SELECT DISTINCT encounter_id, path, value FROM clinical_fact WHERE value NOT IN ('none', '') AND path <> 'hpi.onset')"


@query(f"WITH {_FEATURES} SELECT * FROM f")
def feature_sets(t):
    return longitudinal.feature_sets(t("clinical_fact"))


@query(f"""WITH {_FEATURES}, r AS (SELECT f.*, patient_id, occurred_at FROM f JOIN encounter e ON f.encounter_id = e.encounter_id),
    p AS (SELECT a.encounter_id, b.encounter_id AS similar_id, b.occurred_at AS similar_at, count(*) AS shared, string_agg(a.path || '=' || a.value, ',' ORDER BY a.path || '=' || a.value) AS shared_features
      FROM r a JOIN r b ON a.patient_id = b.patient_id AND a.path = b.path AND a.value = b.value AND a.encounter_id <> b.encounter_id GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY shared DESC, similar_at, similar_id) AS rank FROM p)
    SELECT encounter_id, similar_id, shared, shared_features, CASE WHEN shared >= 4 THEN 'many' WHEN shared >= 2 THEN 'some' ELSE 'one' END AS band, rank FROM k WHERE rank <= 3""")
def similar_encounters(t):
    return longitudinal.similar_encounters(longitudinal.feature_sets(t("clinical_fact")), t("encounter"))


@query("""SELECT patient_id, coalesce(nullif(lower(trim(headline)), ''), 'unspecified') AS headline, count(*) AS visits, min(occurred_at) AS first_seen FROM encounter WHERE kind = 'intake' GROUP BY 1, 2""")
def recurrence(t):
    return longitudinal.recurrence(t("encounter"))


@query("SELECT encounter_id, patient_id, lag(encounter_id) OVER (PARTITION BY patient_id ORDER BY occurred_at, encounter_id) AS previous_id FROM encounter")
def previous_encounter(t):
    return longitudinal.previous_encounter(t("encounter"))


@query(f"""WITH {_FEATURES}, v AS (SELECT encounter_id, lag(encounter_id) OVER (PARTITION BY patient_id ORDER BY occurred_at, encounter_id) AS pid FROM encounter),
    n AS (SELECT f.* FROM f JOIN v ON f.encounter_id = v.encounter_id WHERE pid IS NOT NULL), b AS (SELECT v.encounter_id, path, value FROM v JOIN f ON f.encounter_id = pid)
    SELECT coalesce(n.encounter_id, b.encounter_id) AS encounter_id, coalesce(n.path, b.path) AS path, coalesce(n.value, b.value) AS value,
    CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'resolved' ELSE 'persisting' END AS change
    FROM n FULL JOIN b ON n.encounter_id = b.encounter_id AND n.path = b.path AND n.value = b.value""")
def what_changed(t):
    return longitudinal.what_changed(longitudinal.feature_sets(t("clinical_fact")), t("encounter"))


@query("""WITH f AS (SELECT DISTINCT encounter_id, path, value FROM clinical_fact WHERE superseded_by IS NULL AND invalidated_reason IS NULL), v AS (SELECT encounter_id, lag(encounter_id) OVER (PARTITION BY patient_id ORDER BY occurred_at, encounter_id) AS pid FROM encounter),
    n AS (SELECT f.* FROM f JOIN v ON f.encounter_id = v.encounter_id WHERE pid IS NOT NULL), b AS (SELECT v.encounter_id, path, value FROM v JOIN f ON f.encounter_id = pid)
    SELECT coalesce(n.encounter_id, b.encounter_id) AS encounter_id, coalesce(n.path, b.path) AS path, coalesce(n.value, b.value) AS value,
    CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'resolved' ELSE 'persisting' END AS change
    FROM n FULL JOIN b ON n.encounter_id = b.encounter_id AND n.path = b.path AND n.value = b.value""")
def what_changed_live(t):
    return longitudinal.what_changed(longitudinal.live_features(t("clinical_fact")), t("encounter"))


@query("SELECT fact_id, encounter_id, path, value FROM clinical_fact WHERE superseded_by IS NULL AND invalidated_reason IS NULL")
def live_facts(t):
    return longitudinal.live_facts(t("clinical_fact")).select("fact_id", "encounter_id", "path", "value")


@query("SELECT encounter_id, patient_id, occurred_at FROM encounter WHERE kind = 'intake' AND coalesce(confirmed_by, '') <> ''")
def confirmed_encounters(t):
    return longitudinal.confirmed_encounters(t("encounter")).select("encounter_id", "patient_id", "occurred_at")


@query("SELECT patient_id, '**** **** ' || right(abha_ref, 4) AS masked FROM patient")
def mask_identifier(t):
    return t("patient").select("patient_id", longitudinal.mask_identifier(F.col("abha_ref")).alias("masked"))


@query("""WITH n AS (SELECT year_of_birth, is_synthetic, count(*) AS n FROM patient GROUP BY 1, 2) SELECT year_of_birth, CAST(sum(n * (n - 1)) AS BIGINT) AS pairs FROM n GROUP BY 1""")
def cohort_filter(t):
    return longitudinal.cohort_pairs(t("patient"), "year_of_birth")


# ---- ledger

_DIGEST = "substr(sha256('utt|' || turn_id || '|' || verbatim), 1, 16)"
_ACTIVE = "a AS (SELECT *, min(CASE WHEN supersede THEN seq END) OVER (PARTITION BY session_id, path ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS by_seq FROM fact)"
_VALUES = f"{_ACTIVE}, l AS (SELECT session_id, path, arg_max(value, seq) AS value FROM a WHERE by_seq IS NULL GROUP BY 1, 2), s AS (SELECT session_id, " + ", ".join(f"max(CASE WHEN path = '{p}' THEN value END) AS {p[4:]}" for p in [*PATHS, "hpi.signup"]) + " FROM l GROUP BY 1)"


def _digested(t):
    return t("fact").withColumn("digest", ledger.span_digest(F.lit("utt"), F.col("turn_id"), F.col("verbatim")))


def _superseded(t):
    return ledger.supersede_facts(t("fact"))


def _values(t):
    return ledger.session_values(_superseded(t))


@query(f"SELECT fact_id, {_DIGEST} AS digest FROM fact")
def span_digest(t):
    return _digested(t).select("fact_id", "digest")


@query(f"SELECT session_id, path, digest, min(seq) AS seq FROM (SELECT *, {_DIGEST} AS digest FROM fact) GROUP BY 1, 2, 3")
def dedupe_facts(t):
    return ledger.dedupe_facts(_digested(t)).select("session_id", "path", "digest", "seq")


@query(f"WITH {_ACTIVE} SELECT fact_id, 'f' || CAST(by_seq AS VARCHAR) AS superseded_by FROM a")
def supersede_facts(t):
    return _superseded(t).select("fact_id", "superseded_by")


_ECHO = r"""(trim(regexp_replace(lower(verbatim), '[^a-z0-9]+', ' ', 'g')) = '' OR contains(trim(regexp_replace(lower(verbatim), '[^a-z0-9]+', ' ', 'g')), value)
    OR contains(value, trim(regexp_replace(lower(verbatim), '[^a-z0-9]+', ' ', 'g'))) OR list_contains(regexp_extract_all(verbatim, '-?[0-9]+(?:\.[0-9]+)?'), value))"""


@query(f"""WITH {_VALUES} SELECT session_id, coalesce(error = '3', false) OR (coalesce(view IN ('1', '2'), false) AND coalesce(click <> '4', false)) AS any_group, false AS any_of_none, true AS all_of_none,
    error IS NOT NULL AND (coalesce(view = '5', false) OR purchase IS NULL) AS nested FROM s""")
def rule_expr(t):
    r = lambda name, rule: ledger.rule_expr(rule, F.col("values")).alias(name)
    groups = {"any": [{"all": [{"path": "hpi.error", "eq": "3"}]}, {"all": [{"path": "hpi.view", "in": ["1", "2"]}, {"path": "hpi.click", "ne": "4"}]}, {"all": []}]}
    nested = [{"path": "hpi.error", "recorded": True}, {"any": [{"path": "hpi.view", "eq": "5"}, {"path": "hpi.purchase", "not_recorded": True}]}]
    return _values(t).select("session_id", r("any_group", groups), r("any_of_none", {"any": [{"all": []}]}), r("all_of_none", {"all": []}), r("nested", nested))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Pressed' WHEN 'view' THEN 'Yes' WHEN 'error' THEN 'No' ELSE event_type END AS shown FROM events")
def display_values(t):
    value = F.when(F.col("event_type") == "view", "true").when(F.col("event_type") == "error", "false").otherwise(F.col("event_type"))
    return t("events").select("event_id", ledger.display_values(value, {"click": "Pressed"}).alias("shown"))


@query(f"SELECT fact_id, {_ECHO} AS echoed FROM fact")
def value_is_echoed(t):
    return t("fact").select("fact_id", evidence.value_is_echoed(F.col("value"), F.col("verbatim")).alias("echoed"))


#: Typed values (JSON, the list of their entries, and of which type), and what patients said, in several scripts.
_TYPED = [('"cancer"', ["cancer"], "text"), ('["chest pain","fever"]', ["chest pain", "fever"], "list"), ("true", ["True"], "bare"), ("34.0", ["34.0"], "bare"), ('"34.0"', ["34.0"], "text"), ('["fever",2]', ["fever", "2"], "list"), ("[]", [], "list"), ('"छाती में दर्द"', ["छाती में दर्द"], "text"), ("null", ["null"], "null")]
_SAID = ["मुझे छाती में दर्द है", "Fever and Chest-Pain since 2 days", "ESR 34 mm/hr", "fever", "कैंसर (cancer) नहीं"]


def _pick_sql(n: str, values: list[str]) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_FOLD_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9\\x{{0900}}-\\x{{0DFF}}]+', ' ', 'g'))"
_TYPED_ECHO = f"""t AS (SELECT fact_id, seq, path, {_pick_sql("seq", [repr(e) for _, e, _ in _TYPED])} AS entries, {_pick_sql("seq", [repr(k) for _, _, k in _TYPED])} AS kind, {_pick_sql("(seq // 3)", [repr(x) for x in _SAID])} AS verbatim FROM fact),
    e AS (SELECT *, kind = 'bare' OR (len(entries) > 0 AND len(list_filter(entries, lambda x: NOT (x = '2' OR contains({_FOLD_SQL.format("verbatim")}, {_FOLD_SQL.format("x")}) OR contains({_FOLD_SQL.format("x")}, {_FOLD_SQL.format("verbatim")})
      OR CASE WHEN x = '34.0' THEN contains(verbatim, '34') ELSE len(list_filter(string_split({_FOLD_SQL.format("x")}, ' '), lambda w: length(w) > 2)) > 0 AND len(list_filter(string_split({_FOLD_SQL.format("x")}, ' '), lambda w: length(w) > 2 AND NOT contains({_FOLD_SQL.format("verbatim")}, w))) = 0 END))) = 0) AS echoed FROM t)"""


def _typed_facts(t):
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    return t("fact").withColumns({"value": F.parse_json(pick(F.col("seq"), [j for j, _, _ in _TYPED])), "verbatim": pick(F.floor(F.col("seq") / 3), _SAID)})


@query(f"WITH {_TYPED_ECHO} SELECT fact_id, CASE WHEN kind = 'null' THEN true ELSE echoed END AS echoed FROM e")
def typed_value_is_echoed(t):
    return _typed_facts(t).select("fact_id", evidence.typed_value_is_echoed(F.col("value"), F.col("verbatim")).alias("echoed"))


@query(f"""WITH {_TYPED_ECHO} SELECT fact_id, CASE WHEN kind = 'null' THEN 'null value' WHEN path = 'hpi.click' AND len(list_filter(entries, lambda x: x NOT IN ('fever', 'chest pain', '34.0', 'True'))) > 0 THEN 'not in vocabulary'
    WHEN path <> 'hpi.click' AND NOT echoed THEN 'value not in span' END AS reject_reason FROM e""")
def validate_typed_facts(t):
    facts = _typed_facts(t).withColumns({"tier": F.lit("stated"), "span_kind": F.lit("utterance"), "modality": F.lit("speech")})
    return ledger.validate_facts(facts, [*PATHS, "hpi.signup"], None, {"hpi.click": ["fever", "chest pain", "34.0", "True"]}).select("fact_id", "reject_reason")


_SPAN = "CASE WHEN seq % 43 = 0 THEN NULL WHEN seq % 53 = 0 THEN 'picture' WHEN (tier = 'document') <> (seq % 47 = 0) THEN 'document' ELSE 'utterance' END"


@query(f"""WITH f AS (SELECT *, {_SPAN} AS kind FROM fact) SELECT fact_id, CASE WHEN kind IS NULL OR kind = 'picture' THEN 'no source span' WHEN trim(verbatim) = '' THEN 'blank verbatim' WHEN tier = 'document' AND kind <> 'document' THEN 'document tier without document span'
    WHEN tier <> 'document' AND kind <> 'utterance' THEN 'tier without utterance span' WHEN tier = 'confirmed' AND question_id IS NULL THEN 'confirmed without question'
    WHEN path NOT IN ('hpi.click', 'hpi.view', 'hpi.purchase', 'hpi.error') THEN 'unknown path' WHEN session_id % 6 = 0 THEN 'scope not granted' WHEN path = 'hpi.click' AND value NOT IN ('1', '2', '3', '10') THEN 'not in vocabulary'
    WHEN path <> 'hpi.click' AND CASE WHEN modality = 'touch' THEN value <> '7' ELSE NOT {_ECHO} END THEN 'value not in span' END AS reject_reason FROM f""")
def validate_facts(t):
    facts = t("fact").withColumns({"span_kind": F.expr(_SPAN), "selected_values": F.array(F.lit("7"), F.lit("x"))})
    return ledger.validate_facts(facts, PATHS, t("session").filter("purged_at is null"), {"hpi.click": ["1", "2", "3", "10"]}).select("fact_id", "reject_reason")


@query("""WITH u AS (SELECT session_id, path AS grp, max(seq) AS top FROM fact WHERE tier = 'document' GROUP BY 1, 2)
    SELECT f.session_id, path AS grp, seq AS ord, coalesce(top + 1, 0) + row_number() OVER (PARTITION BY f.session_id, path ORDER BY seq) - 1 AS idx
    FROM fact f LEFT JOIN u ON f.session_id = u.session_id AND path = grp WHERE tier = 'stated'""")
def number_group_entries(t):
    rows = t("fact").select("session_id", F.col("path").alias("grp"), "seq", "tier")
    return ledger.number_group_entries(rows.filter("tier = 'stated'").select("session_id", "grp", F.col("seq").alias("ord")), rows.filter("tier = 'document'").select("session_id", "grp", F.col("seq").alias("idx")))


@query("""SELECT session_id, turn_id, CASE WHEN strpos(text, 'the ') > 0 THEN strpos(text, 'the ') - 1 WHEN strpos(lower(text), 'the ') > 0 THEN strpos(lower(text), 'the ') - 1 ELSE 0 END AS char_start FROM utterance""")
def locate_span(t):
    return t("utterance").select("session_id", "turn_id", ledger.locate_span(F.lit("the "), F.col("text"))[0].alias("char_start"))


@query("""WITH q AS (SELECT * FROM (VALUES ('q1', 'hpi.click'), ('q2', 'hpi.signup'), ('q3', 'hpi.error'), ('q4', 'hpi.purchase')) v(question_id, path)),
    m AS (SELECT s.session_id, q.question_id FROM session s CROSS JOIN q WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.session_id = s.session_id AND f.path = q.path AND tier = 'stated' AND seq % 2 = 0))
    SELECT session_id, question_id, CASE WHEN session_id % 3 = 0 AND question_id = 'q2' THEN 'declined' ELSE 'not_asked' END AS reason FROM m""")
def absences(t):
    questions = [{"id": i, "path": p} for i, p in (("q1", "hpi.click"), ("q2", "hpi.signup"), ("q3", "hpi.error"), ("q4", "hpi.purchase"))]
    declined = t("session").filter("session_id % 3 = 0").select("session_id", F.lit("q2").alias("question_id"))
    return ledger.absences(t("session"), questions, t("fact").filter("tier = 'stated' and seq % 2 = 0"), declined)


@query(f"""WITH {_ACTIVE} SELECT session_id, path, (max({{'t': recorded_at, 's': -seq, 'v': value, 'f': fact_id}}) FILTER (by_seq IS NULL)).v AS value,
    (max({{'t': recorded_at, 's': -seq, 'v': value, 'f': fact_id}}) FILTER (by_seq IS NULL)).f AS fact_id, CASE WHEN count(*) FILTER (by_seq IS NULL) > 0 THEN 'recorded' ELSE 'declined' END AS status,
    count(*) FILTER (by_seq IS NULL) AS active, coalesce(string_agg(fact_id, ',' ORDER BY seq) FILTER (by_seq IS NOT NULL), '') AS superseded FROM a GROUP BY 1, 2""")
def project_slots(t):
    return ledger.project_slots(_superseded(t))


@query(f"""WITH {_ACTIVE} SELECT session_id, count(*) FILTER (tier = 'stated') AS stated, count(*) FILTER (tier = 'confirmed') AS confirmed, count(*) FILTER (tier = 'document') AS document,
    count(*) FILTER (by_seq IS NULL) AS active, count(*) FILTER (by_seq IS NOT NULL) AS superseded, count(*) FILTER (trim(verbatim) = '') AS without_source FROM a GROUP BY 1""")
def inspect_counts(t):
    return ledger.inspect_counts(_superseded(t))


@query("""WITH s AS (SELECT session_id, path AS section, CASE seq % 4 WHEN 0 THEN 'recorded' WHEN 1 THEN 'declined' ELSE 'not_asked' END AS status FROM fact),
    g AS (SELECT session_id, section, count(*) FILTER (status = 'recorded') AS recorded, count(*) FILTER (status <> 'not_asked') AS asked, count(*) AS slots, grouping(section) AS g FROM s GROUP BY GROUPING SETS ((session_id, section), (session_id)))
    SELECT session_id, section, recorded, coalesce(round(recorded / CASE WHEN asked > 0 THEN asked WHEN g = 0 THEN slots END, 4), 0.0) AS completeness FROM g""")
def completeness(t):
    status = F.when(F.col("seq") % 4 == 0, "recorded").when(F.col("seq") % 4 == 1, "declined").otherwise("not_asked")
    return ledger.completeness(t("fact").select("session_id", F.col("path").alias("section"), status.alias("status")))


@query(f"""WITH {_VALUES} SELECT session_id, CAST(1 + (click IS NOT NULL)::INT + (coalesce(view IN ('1', '2', '3'), false))::INT AS BIGINT) AS askable,
    CAST((click IS NOT NULL)::INT + (click IS NOT NULL AND error IS NOT NULL)::INT + (coalesce(view IN ('1', '2', '3'), false) AND purchase IS NOT NULL)::INT AS BIGINT) AS answered,
    round(100.0 * ((click IS NOT NULL)::INT + (click IS NOT NULL AND error IS NOT NULL)::INT + (coalesce(view IN ('1', '2', '3'), false) AND purchase IS NOT NULL)::INT) / (1 + (click IS NOT NULL)::INT + (coalesce(view IN ('1', '2', '3'), false))::INT)::DOUBLE, 4) AS percent FROM s""")
def askable_progress(t):
    return ledger.askable_progress(_values(t), QUESTIONS)


@query(f"""WITH {_VALUES}, o AS (SELECT session_id, 'first' AS section, 1 + (click IS NOT NULL)::INT AS total, (click IS NOT NULL)::INT + (click IS NOT NULL AND (error IS NOT NULL OR session_id % 3 = 0))::INT AS answered FROM s
    UNION ALL SELECT session_id, 'second', coalesce(view IN ('1', '2', '3'), false)::INT, (coalesce(view IN ('1', '2', '3'), false) AND (purchase IS NOT NULL OR session_id % 4 = 0))::INT FROM s)
    SELECT session_id, section, CAST(answered AS BIGINT) AS answered, CAST(total AS BIGINT) AS total, total > 0 AND total = answered AS complete FROM o""")
def section_progress(t):
    declined = F.array_compact(F.array(F.when(F.col("session_id") % 3 == 0, "q2"), F.when(F.col("session_id") % 4 == 0, "q3")))
    sections = [{**q, "section": "first" if q["id"] < "q3" else "second"} for q in QUESTIONS] + [{"id": "q4", "path": "hpi.signup", "kind": "derived", "section": "second"}]
    return ledger.section_progress(_values(t).withColumn("declined", declined), sections)


QUESTIONS = [
    {"id": "q1", "path": "hpi.click"},
    {"id": "q2", "path": "hpi.error", "ask_if": [{"path": "hpi.click", "recorded": True}]},
    {"id": "q3", "path": "hpi.purchase", "ask_if": [{"path": "hpi.view", "in": ["1", "2", "3"]}]},
]


@query(f"""WITH {_VALUES} SELECT session_id, CASE WHEN click IS NULL THEN 'q1' WHEN error IS NULL AND click IS NOT NULL AND session_id % 6 < 4 THEN 'q2' WHEN view IN ('1', '2', '3') AND purchase IS NULL THEN 'q3' END AS next_question FROM s""")
def next_open_question(t):
    return ledger.next_open_question(_values(t), QUESTIONS, F.create_map(F.lit("q2"), F.col("session_id") % 6))


@query(f"""WITH {_VALUES} SELECT session_id, CASE WHEN try_cast(error AS DOUBLE) < 3 THEN 'mild' WHEN try_cast(error AS DOUBLE) <= 7 THEN 'moderate' WHEN try_cast(error AS DOUBLE) > 7 THEN 'severe' END AS band FROM s""")
def derive_bands(t):
    number = F.get(ledger.value_of(F.col("values"), "hpi.error"), F.lit(0)).try_cast("double")
    return _values(t).select("session_id", ledger.derive_bands(number, [("lt", 3, "mild"), ("lte", 7, "moderate"), ("gt", 7, "severe")]).alias("band"))


@query(f"""WITH {_VALUES} SELECT session_id, coalesce(error = '3', false) AS c_eq, coalesce(error <> '3', false) AS c_ne, coalesce(error IN ('1', '5'), false) AS c_in, coalesce(error NOT IN ('1', '5'), false) AS c_not_in,
    coalesce(try_cast(error AS DOUBLE) >= 4, false) AS c_gte, coalesce(try_cast(error AS DOUBLE) > 4, false) AS c_gt, coalesce(try_cast(error AS DOUBLE) < 4, false) AS c_lt, coalesce(try_cast(error AS DOUBLE) <= 4, false) AS c_lte,
    coalesce(contains(error, '1'), false) AS c_contains, error IS NOT NULL AS c_recorded, error IS NULL AS c_unrecorded, error IS NULL AS c_not_recorded, coalesce(error = '3', false) AS c_first FROM s""")
def condition_expr(t):
    c = lambda name, **k: ledger.condition_expr({"path": "hpi.error", **k}, F.col("values")).alias(name)
    return _values(t).select("session_id", c("c_eq", eq="3"), c("c_ne", ne="3"), c("c_in", **{"in": ["1", "5"]}), c("c_not_in", not_in=["1", "5"]), c("c_gte", gte=4), c("c_gt", gt=4), c("c_lt", lt=4), c("c_lte", lte=4), c("c_contains", contains="1"), c("c_recorded", recorded=True), c("c_unrecorded", recorded=False), c("c_not_recorded", not_recorded=True), c("c_first", gte=0, eq="3"))


def _answer_sql() -> str:
    """Facts (session_id, seq, fact_id, path, value) with the answers above, for either dialect."""
    paths = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(ANSWERS))
    values = " ".join(f"WHEN {i} THEN CASE CAST(floor(event_id / {len(ANSWERS)}) AS INT) % {len(v)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(v)) + " END" for i, v in enumerate(ANSWERS.values()))
    return f"SELECT user_id AS session_id, event_id AS seq, 'f' || CAST(event_id AS STRING) AS fact_id, CASE event_id % {len(ANSWERS)} {paths} END AS path, CASE event_id % {len(ANSWERS)} {values} END AS value FROM {{events}}"


def _answers(t):
    events = t("events")
    rows = events.sparkSession.sql(_answer_sql(), events=events).withColumns({"value": F.split("value", ","), "superseded_by": F.lit(None).cast("string")})
    return ledger.session_values(rows)


def _flags_sql() -> str:
    """x: every escalation rule for every session, in SQL over one row a session with a list per path."""
    name = {p: f"p{i}" for i, p in enumerate(ANSWERS)}

    def holds(c: dict) -> str:
        at = name[c["path"]]
        if "gte" in c:
            return f"coalesce(len({at}) = 1 AND try_cast({at}[1] AS DOUBLE) >= {c['gte']}, false)"
        options = c["in"] if "in" in c else [c["eq"]]
        return f"coalesce(list_has_any({at}, [{', '.join(repr(o) for o in options)}]), false)"

    parts = []
    for r in rules.ESCALATIONS:
        groups = [g["all"] for g in r["when"]["any"]] if "any" in r["when"] else [r["when"]["all"]]
        fired = " OR ".join("(" + " AND ".join(holds(c) for c in g) + ")" for g in groups)
        held = ", ".join(f"CASE WHEN {holds(c)} THEN '{c['path']}' END" for g in groups for c in g)
        parts.append(f"SELECT session_id, '{r['id']}' AS rule_id, '{r['level']}' AS level, {fired} AS fired, CASE WHEN {fired} THEN list_sort(list_distinct([{held}])) ELSE [] END AS held FROM s")
    lists = ", ".join(f"max(CASE WHEN path = '{p}' THEN v END) AS {n}" for p, n in name.items())
    return f"""a AS ({_answer_sql().replace("{events}", "events")}), l AS (SELECT session_id, path, string_split(arg_max(value, seq), ',') AS v, string_agg(fact_id, ',' ORDER BY seq) AS ids FROM a GROUP BY 1, 2),
        s AS (SELECT session_id, {lists} FROM l GROUP BY 1), y AS ({" UNION ALL ".join(parts)}),
        i AS (SELECT session_id, rule_id, string_agg(ids, ',' ORDER BY path) AS fact_ids FROM (SELECT session_id, rule_id, unnest(held) AS path FROM y) u JOIN l USING (session_id, path) GROUP BY 1, 2),
        x AS (SELECT y.session_id, y.rule_id, level, fired, array_to_string(held, ',') AS paths, coalesce(fact_ids, '') AS fact_ids FROM y LEFT JOIN i ON y.session_id = i.session_id AND y.rule_id = i.rule_id)"""


_FLAGS = _flags_sql()


@query(f"WITH {_FLAGS} SELECT * FROM x")
def evaluate_red_flags(t):
    return rules.evaluate_red_flags(_answers(t), rules.ESCALATIONS)


@query(f"""WITH {_FLAGS} SELECT z.session_id, CASE greatest(CASE z.priority WHEN 'immediate' THEN 2 WHEN 'urgent' THEN 1 ELSE 0 END, coalesce(max(CASE WHEN fired THEN CASE level WHEN 'immediate' THEN 2 ELSE 1 END END), 0))
    WHEN 2 THEN 'immediate' WHEN 1 THEN 'urgent' ELSE 'routine' END AS priority FROM session z LEFT JOIN x ON z.session_id = x.session_id GROUP BY z.session_id, z.priority""")
def session_priority(t):
    return rules.session_priority(t("session"), rules.evaluate_red_flags(_answers(t), rules.ESCALATIONS))


_PROPOSED = ["RF-CARD-01", "RF-SYS-02", "RF-PAIN-01", "RF-NONE-01"]


@query(f"""WITH {_FLAGS}, c AS (SELECT session_id, {_PROPOSED}[1 + session_id % 4] AS rule_id FROM session)
    SELECT c.*, CASE WHEN c.rule_id = 'RF-NONE-01' THEN 'discarded' WHEN fired THEN 'agreed' ELSE 'not fired' END AS outcome FROM c LEFT JOIN x ON c.session_id = x.session_id AND c.rule_id = x.rule_id""")
def adjudicate_candidates(t):
    rule = F.element_at(F.array(*[F.lit(r) for r in _PROPOSED]), (1 + F.col("session_id") % 4).cast("int"))
    candidates = t("session").select("session_id", rule.alias("rule_id"))
    return rules.adjudicate_candidates(candidates, rules.evaluate_red_flags(_answers(t), rules.ESCALATIONS))


@query(f"""WITH {_ACTIVE}, l AS (SELECT session_id, arg_max(fact_id, seq) AS fact_id, arg_max(value, seq) AS value, arg_max(verbatim, seq) AS verbatim FROM a WHERE by_seq IS NULL AND path = 'hpi.error' GROUP BY 1)
    SELECT d.session_id, 'CX1' AS rule_id, d.fact_id AS denial_id, f.fact_id, 'cx_' || substr(sha256('CX1|' || d.fact_id || '|' || f.fact_id), 1, 10) AS contradiction_id
    FROM l d JOIN a f ON d.session_id = f.session_id AND d.verbatim <> f.verbatim AND d.fact_id <> f.fact_id WHERE d.value IN ('0', '3', '7') AND f.path = 'hpi.purchase' AND by_seq IS NULL""")
def detect_denials(t):
    facts = _superseded(t).withColumn("value", F.when(F.col("value").isin("0", "3", "7"), "0").otherwise(F.col("value")))
    return rules.detect_denials(facts, [{"id": "CX1", "path": "hpi.error", "equals": "0", "other": "^hpi\\.purchase$"}])


#: Answers and papers that deny and contradict one another: paths, and the values of each, several joined by a comma.
_DENIED = {"drug_allergy.taking_medicines": ["false", "true"], "medications[0].name": ["aspirin"], "drug_allergy.medicines": ["yes"], "drug_allergy.has_allergy": ["false", "true"], "allergies[1].substance": ["dust"], "past_medical.conditions": ["asthma,none", "asthma"], "problems[0].reported_term": ["fever"], "past_surgical.any": ["false"], "procedures[2].name": ["bypass"], "procedures[2].year": ["2001"]}
_DENIED_SQL = "f AS (SELECT user_id AS session_id, event_id AS seq, 'f' || event_id AS fact_id, verbatim, CASE WHEN event_id % 6 = 5 THEN 'x' END AS superseded_by, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_DENIED)) + " END AS path, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN CASE (event_id // 10) % {len(v)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v)) + " END" for k, v in enumerate(_DENIED.values())) + " END AS value FROM (SELECT *, 'v' || CAST(event_id % 3 AS VARCHAR) AS verbatim FROM events))"
_RULES_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{r['id']}', '{r['path']}', '{r.get('equals', '')}', '{r.get('contains_value', '')}', '" + (r["group"] + "[[][0-9]+[]][.]" + r["field"] if "group" in r else r["other_path"]) + "')" for r in rules.DENIALS) + ") v(rule_id, path, equals, has, other))"


@query(f"""WITH {_DENIED_SQL}, {_RULES_SQL}, a AS (SELECT * FROM f WHERE superseded_by IS NULL), l AS (SELECT session_id, path, arg_max(fact_id, seq) AS fact_id, arg_max(value, seq) AS value, arg_max(verbatim, seq) AS verbatim FROM a GROUP BY 1, 2)
    SELECT l.session_id, rule_id, l.fact_id AS denial_id, a.fact_id, 'cx_' || substr(sha256(rule_id || '|' || l.fact_id || '|' || a.fact_id), 1, 10) AS contradiction_id FROM l JOIN r ON l.path = r.path AND (value = equals OR list_contains(string_split(value, ','), has))
    JOIN a ON a.session_id = l.session_id AND regexp_full_match(a.path, other) AND a.verbatim <> l.verbatim AND a.fact_id <> l.fact_id""")
def detect_denials_by_rules(t):
    events, key = t("events"), (F.col("event_id") % 10).cast("int")
    value = F.get(F.array(*[F.array(*[F.lit(x) for x in v]) for v in _DENIED.values()]), key)
    value = F.get(value, (F.floor(F.col("event_id") / 10) % F.size(value)).cast("int"))
    facts = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fact_id"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("verbatim"),
        F.when(F.col("event_id") % 6 == 5, "x").alias("superseded_by"), F.get(F.array(*[F.lit(p) for p in _DENIED]), key).alias("path"), F.split(value, ",").alias("value"))
    return rules.detect_denials(facts)


@query("""WITH f AS (SELECT session_id, path, tier, arg_min(fact_id, seq) AS fact_id, arg_min(value, seq) AS value FROM fact WHERE path IN ('hpi.click', 'hpi.view') GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY tier) AS r FROM f)
    SELECT a.session_id, a.path, a.fact_id AS fact_id_a, a.value AS value_a, b.fact_id AS fact_id_b, b.value AS value_b FROM r a JOIN r b ON a.session_id = b.session_id AND a.path = b.path AND a.r = 1 AND b.r = 2 WHERE a.value <> b.value""")
def detect_cross_tier(t):
    return rules.detect_cross_tier(t("fact"), ["hpi.click", "hpi.view"])


@query("SELECT 's' || session_id AS id, session_id FROM fact WHERE path = 'hpi.error' AND seq % 3 <> 0")
def open_contradictions(t):
    rows = t("fact").filter("path = 'hpi.error'").withColumn("status", F.when(F.col("seq") % 3 == 0, "resolved").otherwise("open"))
    return rules.open_contradictions(rows).select(F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("id"), "session_id")


@query("""WITH n AS (SELECT session_id, max(seq) + 1 AS seq FROM fact GROUP BY 1 HAVING session_id % 4 = 0), u AS (SELECT session_id, seq, fact_id, path, supersede FROM fact UNION ALL SELECT session_id, seq, 'e' || session_id || '-' || seq, 'hpi.click', true FROM n),
    a AS (SELECT *, min(CASE WHEN supersede THEN seq END) OVER (PARTITION BY session_id, path ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS by_seq FROM u)
    SELECT a.session_id, a.fact_id, u.fact_id AS superseded_by FROM a LEFT JOIN u ON a.session_id = u.session_id AND a.path = u.path AND a.by_seq = u.seq""")
def physician_edit(t):
    edits = t("session").filter("session_id % 4 = 0").select("session_id", F.lit("hpi.click").alias("path"), F.lit("3").alias("value"), F.lit("dr").alias("actor"), F.lit(1).alias("at"))
    return ledger.physician_edit(t("fact"), edits).select("session_id", "fact_id", "superseded_by")


@query("""WITH p AS (SELECT session_id, CASE WHEN tier = 'stated' THEN 'medications' ELSE 'problems' END AS grp, seq % 5 AS idx, CASE WHEN seq % 2 = 0 THEN 'name' ELSE 'dose' END AS field, {'t': recorded_at, 's': -seq, 'v': value} AS x FROM fact)
    SELECT session_id, grp, idx, (max(x) FILTER (field = 'name')).v AS name, (max(x) FILTER (field = 'dose')).v AS dose FROM p GROUP BY 1, 2, 3""")
def project_groups(t):
    path = F.concat(F.when(F.col("tier") == "stated", "medications").otherwise("problems"), F.lit("["), (F.col("seq") % 5).cast("string"), F.lit("]."), F.when(F.col("seq") % 2 == 0, "name").otherwise("dose"))
    return ledger.project_groups(t("fact").withColumn("path", path), ["name", "dose"])


@query("SELECT DISTINCT session_id, path, " + _DIGEST + " AS digest FROM fact")
def stream_dedupe(t):
    return promotion.stream_dedupe(_digested(t).withColumnRenamed("recorded_at", "ts")).select("session_id", "path", "digest")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS folded FROM part")
def fold_text(t):
    return governance.fold_text(t("part"), "p_name", "folded").select("p_partkey", "folded")


# ---- audit, consent, retention, policy

def _json_sql(x: str) -> str:
    """A text as a canonical JSON string, in DuckDB's SQL."""
    code = r"""CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(9) THEN '\t' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
        WHEN unicode(c) > 65535 THEN printf('\u%04x\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) ELSE printf('\u%04x', unicode(c)) END"""
    return f"""coalesce('"' || array_to_string(list_transform(string_split({x}, ''), lambda c: {code}), '') || '"', 'null')"""


_ACTORS = ['Dr. "Ann" O\\N', "Zoë\t", "डॉ. सिंह", "x😀\x01\x7f", 'v","b":"w']
#: Audit rows with all 14 fields: texts with quotes, accents and control characters, numbers, nulls and nested summaries.
_EVENT_SQL = f"""SELECT id, chain, '{{"abha_ref":' || {_json_sql("CASE WHEN id % 3 = 0 THEN 'abha:' || chain END")} || ',"action":' || {_json_sql("action")} || ',"actor":' || {_json_sql("CASE id % 6 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(_ACTORS)) + " END")}
    || ',"actor_role":"physician","consent_ref":' || {_json_sql("consent_ref")} || ',"model_name":null,"model_version":' || {_json_sql("CASE WHEN id % 2 = 0 THEN '1.0' END")} || ',"outcome":"ok","prompt_hash":' || {_json_sql("sha256(action)")}
    || ',"purpose_of_use":"care","request_summary":' || CASE WHEN id % 4 = 0 THEN 'null' ELSE '{{"inner":{{"note":' || {_json_sql("summary || ' mg/dl “é”'")} || ',"tags":["a",null]}},"n":' || id || ',"ok":' || CASE WHEN id % 5 < 2 THEN 'true' ELSE 'false' END || ',"score":' || CASE WHEN id % 5 = 4 THEN 'null' ELSE
      CASE id % 5 WHEN 0 THEN '0.00025' WHEN 1 THEN '1.25e+20' WHEN 2 THEN '-12500000.0' ELSE '2.5e-07' END END || '}}' END || ',"response_summary":' || CASE WHEN id % 7 = 0 THEN 'null' ELSE '{{"a":{{"b":1,"z":"\\u00e9\\u000b\\\\u000B"}},"k":[true,null,"x"],"n":' || id || '}}' END
    || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","versions_used":{{"ontology":"2","rules":"' || id % 3 || '"}}}}' AS payload FROM audit"""


def _audit_events(t):
    pick = lambda n, values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("id") % n).cast("int"))
    note = F.struct(F.concat("summary", F.lit(" mg/dl “é”")).alias("note"), F.array(F.lit("a"), F.lit(None).cast("string")).alias("tags"))
    request = F.struct(F.col("id").alias("n"), (F.col("id") % 5 < 2).alias("ok"), note.alias("inner"), pick(5, [0.00025, 1.25e20, -1.25e7, 2.5e-7]).alias("score"))
    response = F.parse_json(F.concat(F.lit('{"n": '), F.col("id").cast("string"), F.lit(', "k": [true, null, "x"], "a": {"z": "é\\u000b\\\\u000B", "b": 1}}')))
    return t("audit").withColumns({
        "actor": pick(6, _ACTORS), "actor_role": F.lit("physician"), "purpose_of_use": F.lit("care"), "abha_ref": F.when(F.col("id") % 3 == 0, F.concat(F.lit("abha:"), F.col("chain").cast("string"))),
        "request_summary": F.when(F.col("id") % 4 != 0, request), "response_summary": F.when(F.col("id") % 7 != 0, response), "versions_used": F.create_map(F.lit("rules"), (F.col("id") % 3).cast("string"), F.lit("ontology"), F.lit("2")),
        "outcome": F.lit("ok"), "model_name": F.lit(None).cast("string"), "model_version": F.when(F.col("id") % 2 == 0, "1.0"), "prompt_hash": F.sha2("action", 256),
    })


_CHAIN = f"""r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY id) AS n FROM ({_EVENT_SQL})),
    h AS (SELECT chain, id, n, payload, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || payload) AS hash FROM r WHERE n = 1
      UNION ALL SELECT r.chain, r.id, r.n, r.payload, h.hash, sha256(h.hash || r.payload) FROM h JOIN r ON r.chain = h.chain AND r.n = h.n + 1)"""


def _chain(t):
    events = _audit_events(t)
    return governance.append_chain(events, "chain", "id", governance.audit_payload(events))


@query(f"SELECT id, payload FROM ({_EVENT_SQL})")
def audit_payload(t):
    events = _audit_events(t)
    return events.select("id", governance.audit_payload(events).alias("payload"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT chain, id, prev_hash, hash FROM h")
def append_chain(t):
    return _chain(t).select("chain", "id", "prev_hash", "hash")


@query(f"""WITH RECURSIVE {_CHAIN}, k AS (SELECT chain, id, prev_hash, hash, payload || CASE WHEN id % 997 = 5 THEN '!' ELSE '' END AS payload FROM h WHERE id % 499 <> 7),
    m AS (SELECT chain, row_number() OVER w - 1 AS pos, CASE WHEN prev_hash <> coalesce(lag(hash) OVER w, repeat('0', 64)) THEN 'inserted or removed' WHEN hash <> sha256(prev_hash || payload) THEN 'modified' END AS kind FROM k WINDOW w AS (PARTITION BY chain ORDER BY id))
    SELECT chain, count(*) AS rows, min(pos) FILTER (kind IS NOT NULL) AS first_break, arg_min(kind, pos) FILTER (kind IS NOT NULL) AS kind FROM m GROUP BY 1""")
def verify_chain(t):
    spark, path = t("audit").sparkSession, shared_path(t("audit").sparkSession, "chain")
    _chain(t).write.parquet(path)
    tampered = spark.read.parquet(path).filter("id % 499 <> 7").withColumn("payload", F.when(F.col("id") % 997 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return governance.verify_chain(tampered, "chain", "id")


@query("""SELECT encounter_id, id, action, row_number() OVER (PARTITION BY encounter_id ORDER BY ts, id) AS place FROM encounter e JOIN audit a ON e.consent_ref = a.consent_ref""")
def encounter_audit_trail(t):
    return governance.encounter_audit_trail(t("encounter"), t("audit"))


@query("""WITH b AS (SELECT DISTINCT fact_id FROM evidence) SELECT encounter_id, count(*) AS facts, count(b.fact_id) AS with_evidence, count(*) - count(b.fact_id) AS offenders FROM clinical_fact f LEFT JOIN b ON f.fact_id = b.fact_id GROUP BY 1""")
def provenance_completeness(t):
    return governance.provenance_completeness(t("clinical_fact"), t("evidence"))


@query("""WITH w AS (SELECT DISTINCT session_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM utterance),
    v AS (SELECT DISTINCT conv_id AS session_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM conversations WHERE role = 'assistant'),
    l AS (SELECT session_id, count(*) AS n FROM w WHERE token NOT IN ('the', 'and') AND NOT EXISTS (SELECT 1 FROM v WHERE v.session_id = w.session_id AND v.token = w.token) GROUP BY 1)
    SELECT s.session_id, coalesce(n, 0) AS untraced, n IS NULL AS traceable FROM (SELECT DISTINCT session_id FROM utterance) s LEFT JOIN l ON s.session_id = l.session_id""")
def check_traceability(t):
    said = t("conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    return governance.check_traceability(t("utterance"), said, ["the", "and"])


@query("SELECT session_id, turn_id, sha256(text) AS fingerprint FROM utterance")
def prompt_fingerprint(t):
    return t("utterance").select("session_id", "turn_id", governance.prompt_fingerprint(F.col("text")).alias("fingerprint"))


@query("""SELECT session_id, CASE session_id % 3 WHEN 0 THEN 'history,voice' WHEN 1 THEN 'voice' ELSE 'history' END AS granted, CASE session_id % 3 WHEN 0 THEN 'documents' WHEN 1 THEN 'documents,history' ELSE 'documents,voice' END AS refused,
    session_id % 3 <> 1 AS valid, created_at + INTERVAL 3600 SECOND AS expires_at FROM session""")
def grant_consent(t):
    scopes = F.when(F.col("session_id") % 3 == 0, F.array(F.lit("voice"), F.lit("history"))).when(F.col("session_id") % 3 == 1, F.array(F.lit("voice"), F.lit("odd"))).otherwise(F.array(F.lit("history")))
    return governance.grant_consent(t("session").select("session_id", scopes.alias("scopes"), F.col("created_at").alias("at")), ["history", "voice", "documents"], ["history"], 3600)


@query("""SELECT fact_id FROM fact WHERE NOT ((session_id % 3 = 0 AND tier = 'document') OR (session_id % 4 = 0 AND modality = 'speech'))""")
def revoke_consent(t):
    s = t("session")
    gone = s.filter("session_id % 3 = 0").select("session_id", F.lit("documents").alias("scope")).unionByName(s.filter("session_id % 4 = 0").select("session_id", F.lit("voice").alias("scope"))).unionByName(s.select("session_id", F.lit("history").alias("scope")))
    return governance.revoke_consent(t("fact"), gone).select("fact_id")


@query("""WITH c AS (SELECT session_id, CASE session_id % 3 WHEN 0 THEN ['history', 'voice'] WHEN 1 THEN ['documents', 'voice'] ELSE ['history'] END AS granted, CASE WHEN session_id % 4 = 0 THEN NULL WHEN session_id % 4 = 1 THEN ['voice'] ELSE ['history', 'documents'] END AS asked FROM session),
    w AS (SELECT session_id, list_filter(granted, lambda x: asked IS NOT NULL AND NOT list_contains(asked, x)) AS left_, list_sort(coalesce(asked, granted)) AS targets, asked IS NULL OR list_contains(asked, 'voice') AND true AS v FROM c),
    p AS (SELECT f.session_id, count(*) AS n FROM fact f JOIN w ON f.session_id = w.session_id WHERE (list_contains(targets, 'documents') AND tier = 'document') OR (list_contains(targets, 'voice') AND modality = 'speech') GROUP BY 1)
    SELECT w.session_id, array_to_string(targets, ',') AS revoked_scopes, array_to_string(left_, ',') AS remaining_scopes, coalesce(n, 0) AS facts_purged, NOT list_contains(left_, 'history') AS session_ended FROM w LEFT JOIN p ON w.session_id = p.session_id""")
def withdraw_consent(t):
    key, arr = F.col("session_id"), lambda *x: F.array(*[F.lit(v) for v in x])
    granted = F.when(key % 3 == 0, arr("history", "voice")).when(key % 3 == 1, arr("voice", "documents")).otherwise(arr("history"))
    asked = F.when(key % 4 == 1, arr("voice")).when(key % 4 > 1, arr("history", "documents"))
    consents = t("session").select("session_id", granted.alias("granted"), F.array().cast("array<string>").alias("refused"), asked.alias("scopes"))
    found = governance.withdraw_consent(consents, t("fact"), ["history"])
    text = lambda c: F.array_join(c, ",").alias(c)
    return found.select("session_id", text("revoked_scopes"), text("remaining_scopes"), "facts_purged", "session_ended")


@query("SELECT session_id FROM session WHERE purged_at IS NULL AND last_at > TIMESTAMP '2024-01-30 00:00:00' AND session_id % 2 = 0")
def active_consents(t):
    scopes = F.when(F.col("session_id") % 2 == 0, F.array(F.lit("voice"))).otherwise(F.array(F.lit("history")))
    rows = t("session").select("session_id", F.col("purged_at").alias("revoked_at"), F.col("last_at").alias("expires_at"), scopes.alias("scopes"))
    return governance.active_consents(rows, "voice", F.lit("2024-01-30").cast("timestamp")).select("session_id")


@query("SELECT session_id FROM session WHERE purged_at IS NULL AND last_at < TIMESTAMP '2024-01-30 00:00:00'")
def expired_sessions(t):
    return governance.expired_sessions(t("session").withColumn("expires_at", F.col("last_at")), F.lit("2024-01-30").cast("timestamp")).select("session_id")


@query("SELECT session_id, count(*) AS facts FROM fact WHERE session_id NOT IN (SELECT session_id FROM session WHERE purged_at IS NOT NULL) GROUP BY 1")
def purge_sessions(t):
    return governance.purge_sessions(t("fact"), t("session").filter("purged_at is not null")).groupBy("session_id").agg(F.count(F.lit(1)).alias("facts"))


@query("SELECT s.session_id, count(f.fact_id) AS removed FROM session s LEFT JOIN fact f ON s.session_id = f.session_id WHERE purged_at IS NOT NULL GROUP BY 1")
def purge_counts(t):
    return governance.purge_counts(t("fact"), t("session").filter("purged_at is not null"))


@query("""WITH v AS (SELECT patient_id FROM patient WHERE is_synthetic AND starts_with(patient_ref, 'pat_guest_')) SELECT 'patient' AS table_name, count(*) AS rows FROM v HAVING count(*) > 0
    UNION ALL SELECT 'encounter', count(*) FROM encounter JOIN v USING (patient_id) HAVING count(*) > 0 UNION ALL SELECT 'medication', count(*) FROM medication JOIN v USING (patient_id) HAVING count(*) > 0""")
def sweep_synthetic(t):
    return governance.sweep_synthetic(t("patient"), {"encounter": t("encounter"), "medication": t("medication")})


@query("SELECT user_id AS session_id, count(*) AS consents FROM events WHERE user_id % 6 = 0 AND user_id % 5 <> 0 GROUP BY 1")
def orphan_report(t):
    consents = t("events").select(F.col("user_id").alias("session_id"))
    return governance.orphan_report(consents, t("session").filter("purged_at is null"), t("session").filter("session_id % 5 = 0")).groupBy("session_id").agg(F.count(F.lit(1)).alias("consents"))


@query("""WITH e AS (SELECT patient_id, count(*) AS n FROM encounter GROUP BY 1), m AS (SELECT patient_id, count(*) AS n FROM medication GROUP BY 1)
    SELECT coalesce(e.patient_id, m.patient_id) AS patient_id, coalesce(e.n, 0) AS encounters, coalesce(m.n, 0) AS medications FROM e FULL JOIN m ON e.patient_id = m.patient_id""")
def table_counts(t):
    return governance.table_counts({"encounters": t("encounter"), "medications": t("medication")}, "patient_id")


@query("""SELECT event_id, CASE WHEN user_id % 4 >= 2 THEN 'unknown role' WHEN NOT ((user_id % 4 = 0 AND event_type IN ('click', 'view')) OR (user_id % 4 = 1 AND event_type = 'view')) THEN 'wrong purpose'
    WHEN NOT (event_id % 2 = 0) THEN 'wrong action' END AS reason FROM events""")
def apply_policy(t):
    spark = t("events").sparkSession
    grants = spark.createDataFrame([("role0", "click", "read"), ("role0", "view", "read"), ("role1", "view", "read")], "role string, purpose string, action string")
    purposes = spark.createDataFrame([("click", True, False), ("view", False, True)], "purpose string, strip_identifiers boolean, aggregate_only boolean")
    requests = t("events").select("event_id", F.concat(F.lit("role"), (F.col("user_id") % 4).cast("string")).alias("role"), F.col("event_type").alias("purpose"), F.when(F.col("event_id") % 2 == 0, "read").otherwise("write").alias("action"))
    return governance.apply_policy(requests, grants, purposes).select("event_id", "reason")


# The keys that never reach an audit row and the assessment's field names, written out here once more, so that a lost one shows.
_KEYS = "name patient patientName birthDate address telecom identifier entry resource contained photo gender verbatim verbatim_translated transcript utterance value text chief_complaint symptom medication note ocr_text summary".split()
_FIELDS = "diagnosis diagnoses differential differential_diagnosis assessment impression probability likelihood suspected_condition provisional icd_suggestion disease_probability prognosis treatment prescription plan recommendation advice therapy management specialty_referral".split()


def _nth(words: list[str]):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % len(words) + 1).cast("int"))


@query(f"""WITH k AS (SELECT event_id, '{{"' || {_KEYS}[1 + event_id % {len(_KEYS)}] || '": "<redacted>", "~": ' || CAST(user_id AS VARCHAR) || '}}' AS x FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN x WHEN 1 THEN '{{"a": ' || x || '}}' WHEN 2 THEN '{{"a": {{"b": ' || x || '}}, "l": "<2 item(s)>"}}' WHEN 3 THEN '{{"~": "ok"}}' ELSE '"<unreadable>"' END AS scrubbed FROM k""")
def scrub_payload(t):
    x = F.concat(F.lit('{"'), _nth(_KEYS), F.lit('": {"secret": "x"}, "~": '), F.col("user_id").cast("string"), F.lit("}"))
    x = F.when(F.col("event_id") % 2 == 0, x).otherwise(F.concat(F.lit('{"'), _nth(_KEYS), F.lit('": "x", "~": '), F.col("user_id").cast("string"), F.lit("}")))
    kind = F.col("event_id") % 5
    payload = F.when(kind == 0, x).when(kind == 1, F.concat(F.lit('{"a": '), x, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"l": [1, 2], "a": {"b": '), x, F.lit("}}"))).when(kind == 3, F.lit('{"~": "ok"}')).otherwise(F.lit('{"name": '))
    return t("events").select("event_id", governance.scrub_payload(payload).alias("scrubbed"))


@query(f"""WITH k AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper({_FIELDS}[1 + event_id % {len(_FIELDS)}]) ELSE {_FIELDS}[1 + event_id % {len(_FIELDS)}] END AS f FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN f || '@$' WHEN 1 THEN f || '@$.k' WHEN 2 THEN f || '@$.k[1]' ELSE '' END AS found FROM k""")
def scan_assessment_fields(t):
    field = F.when(F.col("event_id") % 2 == 0, F.upper(_nth(_FIELDS))).otherwise(_nth(_FIELDS))
    x, kind = F.concat(F.lit('{"'), field, F.lit('": 1}')), F.col("event_id") % 4
    payload = F.when(kind == 0, x).when(kind == 1, F.concat(F.lit('{"k": '), x, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"k": [0, '), x, F.lit("]}"))).otherwise(F.col("props"))
    return t("events").select("event_id", F.array_join(governance.scan_assessment_fields(payload), ",").alias("found"))


@query("SELECT event_id, sha256(sha256(event_type) || '{\"id\":' || CAST(event_id AS VARCHAR) || '}') AS hash FROM events")
def audit_hash(t):
    payload = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}"))
    return t("events").select("event_id", governance.audit_hash(F.sha2("event_type", 256), payload).alias("hash"))


# ---- terminology

_CONCEPTS = "k AS (SELECT DISTINCT 'C-' || p_type AS code, lower(p_type) AS display_normalized FROM part), d AS (SELECT DISTINCT lower(p_brand) AS key FROM part UNION SELECT lower(substr(p_type, 1, 4)) FROM part UNION SELECT lower(p_type) FROM part)"


def _concepts(t):
    return t("part").select(F.concat(F.lit("C-"), "p_type").alias("code"), F.lower("p_type").alias("display_normalized")).distinct()


def _terms(t):
    p = t("part")
    return p.select(F.lower("p_brand").alias("key")).union(p.select(F.lower(F.substring("p_type", 1, 4)))).union(p.select(F.lower("p_type"))).distinct().withColumn("term", F.col("key"))


@query(f"""WITH {_CONCEPTS}, h AS (SELECT key, code, CASE WHEN key = display_normalized THEN 0 WHEN contains(display_normalized, key) THEN 1 ELSE 2 END AS class FROM d JOIN k ON contains(display_normalized, key) OR contains(key, display_normalized) WHERE length(key) >= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY class, code) AS rank FROM h) SELECT key, code, class, rank FROM r WHERE rank <= 5""")
def lookup_terms(t):
    return governance.lookup_terms(_terms(t), _concepts(t))


@query("""WITH s AS (SELECT DISTINCT p_brand AS url, 'v' || CAST(p_size % 5 AS VARCHAR) AS version, p_size % 5 <> 4 AS is_active FROM part), n AS (SELECT url, max(version) AS version FROM s WHERE is_active GROUP BY 1),
    c AS (SELECT DISTINCT p_brand AS url, 'v' || CAST(p_size % 5 AS VARCHAR) AS version, p_type AS code FROM part) SELECT c.* FROM c JOIN n ON c.url = n.url AND c.version = n.version""")
def newest_concepts(t):
    version = F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string")).alias("version")
    systems = t("part").select(F.col("p_brand").alias("url"), version, (F.col("p_size") % 5 != 4).alias("is_active"), (F.col("p_size") % 5).alias("created_at")).distinct()
    return governance.newest_concepts(systems, t("part").select(F.col("p_brand").alias("url"), version, F.col("p_type").alias("code")).distinct())


@query(f"WITH {_CONCEPTS} SELECT key AS term, min(code) AS code, CASE WHEN min(code) IS NULL THEN 'unmapped' ELSE 'coded' END AS status FROM d LEFT JOIN k ON key = display_normalized GROUP BY 1")
def code_terms(t):
    return governance.code_terms(_terms(t), _concepts(t))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'unknown system' WHEN p_partkey % 5 = 0 THEN 'version mismatch' WHEN p_partkey % 7 = 0 THEN 'unknown code' WHEN p_type = 'ECONOMY' THEN 'not selectable' ELSE 'ok' END AS verdict FROM part""")
def verify_codes(t):
    systems = t("part").sparkSession.createDataFrame([("s1", "v1")], "url string, version string")
    concepts = t("part").select(F.lit("s1").alias("url"), F.col("p_type").alias("code"), (F.col("p_type") != "ECONOMY").alias("is_selectable")).distinct()
    key = F.col("p_partkey")
    items = t("part").select("p_partkey", F.when(key % 4 == 0, "s0").otherwise("s1").alias("url"), F.when(key % 5 == 0, "v0").otherwise("v1").alias("version"), F.when(key % 7 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(F.col("p_type")).alias("code"))
    verdicts = governance.verify_codes(items.select("url", "version", "code").distinct(), systems, concepts)
    return items.join(verdicts, ["url", "version", "code"]).select("p_partkey", "verdict")


bundles.register(query)
documents.register(query)
evaluation.register(query)
intake.register(query)
promotion.register(query)
streams.register(query)
summary.register(query)
