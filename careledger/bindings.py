"""The library's tables, bound to the tables of a data folder by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BINDINGS: dict[str, str] = {
    "patient": """SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'abha:' || CAST(c_custkey AS STRING) END AS abha_ref,
        CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender, c_mktsegment = 'MACHINERY' AS is_synthetic,
        CASE WHEN c_custkey % 4 = 0 THEN 'pat_guest_' ELSE 'pat_' END || CAST(c_custkey AS STRING) AS patient_ref,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS display_name, CAST(1930 + c_custkey % 80 AS INT) AS year_of_birth FROM {customer}""",
    "encounter": """SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS occurred_at,
        CASE o_orderstatus WHEN 'P' THEN 'document' ELSE 'intake' END AS kind,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '' ELSE 'dr' || CAST(o_orderkey % 7 AS STRING) END AS confirmed_by,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'immediate' WHEN '2' THEN 'urgent' ELSE 'routine' END AS priority,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE '  ' || o_orderpriority || ' ' END AS headline,
        CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'c' || CAST(o_orderkey % 500 AS STRING) END AS consent_ref,
        's' || CAST(o_orderkey AS STRING) AS session_ref FROM {orders}""",
    "observation": """SELECT o_custkey AS patient_id, o_orderkey AS encounter_id, 'a' || CAST(l_partkey % 20 AS STRING) AS analyte_key,
        CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity END AS value, l_extendedprice AS tie,
        CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS observed_on,
        CASE l_returnflag WHEN 'A' THEN 'mg/dL' WHEN 'R' THEN 'mg/dL' ELSE NULL END AS unit,
        CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity > 40 THEN 'high' ELSE 'in_range' END AS range_flag
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "medication": """SELECT o_custkey AS patient_id, o_orderkey AS encounter_id, upper(p_name) || '.' AS name, CAST(o_orderdate AS DATE) AS observed_on,
        CASE l_returnflag WHEN 'A' THEN 'documented' WHEN 'R' THEN 'stopped-reported' ELSE 'patient-reported-current' END AS status,
        CAST(l_quantity AS INT) AS dose, l_linenumber AS line_no
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "fact": """SELECT user_id AS session_id, event_id AS seq, 'f' || CAST(event_id AS STRING) AS fact_id, 'hpi.' || event_type AS path,
        CASE event_id % 4 WHEN 0 THEN 'number' ELSE 'string' END AS value_kind, CAST(CAST(floor(value) AS INT) % 12 AS STRING) AS value,
        CASE event_id % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'confirmed' ELSE 'document' END AS tier, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
        ts AS recorded_at, event_id % 3 <> 2 AS supersede,
        CASE WHEN event_id % 31 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN 'Some other Words' ELSE 'It is ' || CAST(CAST(floor(value) AS INT) % 12 AS STRING) || ', I think' END AS verbatim,
        't' || CAST(event_id % 40 AS STRING) AS turn_id, CASE WHEN event_id % 37 = 0 THEN NULL ELSE 'q' || event_type END AS question_id,
        CASE event_id % 5 WHEN 0 THEN 'speech' WHEN 1 THEN 'touch' ELSE 'typed' END AS modality FROM {events}""",
    "clinical_fact": """SELECT 'f' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS fact_id, l_orderkey AS encounter_id,
        CASE l_linenumber % 4 WHEN 0 THEN 'hpi.site' WHEN 1 THEN 'hpi.onset' WHEN 2 THEN 'hpi.associated' ELSE 'chief_complaint.text' END AS path,
        CASE WHEN min(l_partkey) % 9 = 0 THEN 'none' ELSE 'v' || CAST(min(l_partkey) % 6 AS STRING) END AS value,
        CASE min(l_suppkey) % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'confirmed' ELSE 'document' END AS tier,
        CASE WHEN min(l_suppkey) % 10 = 0 THEN 'f0' END AS superseded_by, CASE WHEN min(l_suppkey) % 14 = 1 THEN 'error' END AS invalidated_reason,
        min(l_shipdate) AS recorded_at FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "evidence": """SELECT 'f' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS fact_id,
        CASE WHEN l_partkey % 2 = 0 THEN 'utterance' ELSE 'document' END AS source_type, CASE l_suppkey % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'touch' END AS modality,
        l_partkey AS evidence_id FROM {lineitem} WHERE (l_orderkey + l_linenumber) % 5 <> 0""",
    "session": """SELECT user_id AS session_id, 'c' || CAST(user_id AS STRING) AS consent_ref, min(ts) AS created_at, max(ts) AS last_at,
        CASE WHEN user_id % 6 = 0 THEN max(ts) END AS purged_at, CASE user_id % 3 WHEN 0 THEN 'immediate' WHEN 1 THEN 'urgent' ELSE 'routine' END AS priority
        FROM {events} GROUP BY user_id""",
    "script_result": """SELECT o_orderkey AS script_id, CASE WHEN o_orderkey % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split, o_orderkey % 9 AS facts, CASE WHEN o_orderkey % 45 = 8 THEN 1 ELSE 0 END AS unsourced, o_orderkey % 3 AS flags_expected,
        CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 3 END AS flags_caught, o_orderkey % 4 AS slots_expected, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 4 END AS slots_matched, o_custkey % 3 AS priority_rank,
        CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE o_custkey % 3 END AS expected_rank, CAST(o_orderkey % 8 AS DOUBLE) / 8 AS completeness, o_custkey % 400 AS ms FROM {orders}""",
    "audit": """SELECT event_id AS id, user_id AS chain, ts, event_type AS action, CAST(CAST(floor(value) AS INT) AS STRING) AS summary, 'c' || CAST(user_id % 20 AS STRING) AS consent_ref FROM {events}""",
    "utterance": """SELECT conv_id AS session_id, turn AS turn_id, 'q' || CAST(turn % 3 AS STRING) AS question_id, text,
        CASE WHEN turn % 4 = 0 THEN NULL ELSE CAST((conv_id * 7 + turn) % 100 AS DOUBLE) / 100 END AS asr_confidence FROM {conversations} WHERE role = 'user'""",
    "drug_line": """SELECT p_partkey AS doc_id, CAST(1 AS INT) AS page, CAST(1 AS INT) AS line_no, 'TAB. ' || upper(replace(p_name, ' ', '-')) || ' ' || CAST(p_size AS STRING) || 'MG ' ||
        CASE p_partkey % 5 WHEN 0 THEN '1-0-1' WHEN 1 THEN 'OD' WHEN 2 THEN '1-1-1-0' WHEN 3 THEN '0-0-0' ELSE 'BD' END ||
        CASE WHEN p_partkey % 3 = 0 THEN ' x ' || CAST(p_size AS STRING) || ' days' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' oral' ELSE '' END AS text,
        CAST(50 + p_partkey % 50 AS DOUBLE) / 100 AS confidence, p_partkey % 41 = 0 AS handwritten FROM {part}""",
    "lab_line": """SELECT p_partkey AS doc_id, CAST(1 AS INT) AS page, CAST(2 AS INT) AS line_no,
        CASE p_partkey % 6 WHEN 0 THEN 'HbA1c' WHEN 1 THEN 'S. Creatinine' WHEN 2 THEN 'Haemoglobin' WHEN 3 THEN 'Fasting Glucose' WHEN 4 THEN 'Serum Urea' ELSE 'Reg No' END || ': ' ||
        CAST(p_size AS STRING) || CASE p_partkey % 4 WHEN 0 THEN '.5 % (4.0 - 5.6)' WHEN 1 THEN ' mg/dL < 20' WHEN 2 THEN ' mg/dL > 40' ELSE ' mg/dL' END AS text,
        CASE p_partkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex, CAST(50 + p_partkey % 50 AS DOUBLE) / 100 AS confidence, p_partkey % 41 = 0 AS handwritten FROM {part}""",
    "document_record": """SELECT l_orderkey AS encounter_id, l_linenumber AS doc_no,
        CASE l_suppkey % 4 WHEN 0 THEN 'prescription' WHEN 1 THEN 'lab_report' WHEN 2 THEN 'discharge_summary' END AS document_kind FROM {lineitem} WHERE l_linenumber < 4""",
    "ocr_entity": """SELECT l_orderkey AS doc_id, l_linenumber AS place, CASE l_linenumber % 3 WHEN 1 THEN 'medication' WHEN 2 THEN 'investigation' ELSE 'diagnosis' END AS kind, p_name AS text,
        CASE l_linenumber % 3 WHEN 1 THEN CAST(p_size AS STRING) || ' mg' WHEN 2 THEN 'high' END AS detail,
        'TAB. ' || upper(replace(p_name, ' ', '-')) || ' x' AS read_text, CASE l_linenumber % 3 WHEN 1 THEN CAST(p_size + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS STRING) || 'MG' WHEN 2 THEN CASE WHEN l_suppkey % 5 = 0 THEN 'low' ELSE 'high' END END AS read_detail,
        l_suppkey % 7 <> 0 AS is_true, l_suppkey % 3 <> 0 AS is_read, l_suppkey % 10 < 3 AS needs_check
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS l JOIN {part} ON l_partkey = p_partkey""",
    "date_line": """SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS page, CAST(o_orderkey % 5 AS INT) AS line_no, CASE o_orderkey % 7 WHEN 0 THEN 'Date: ' || strftime(o_orderdate, '%d/%m/%Y')
        WHEN 1 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'seen 12 March ' || strftime(o_orderdate, '%Y') WHEN 3 THEN 'since March ' || strftime(o_orderdate, '%Y')
        WHEN 4 THEN 'operated in ' || strftime(o_orderdate, '%Y') WHEN 5 THEN 'on 31/02/' || strftime(o_orderdate, '%Y') ELSE 'no day given' END AS text FROM {orders}""",
}
#: Spark has date_format where DuckDB has strftime. Visits are joined last, so that medicines stay dealt by visit.
_SPARK = [(re.compile(r"(JOIN \{orders\} ON [\w =]+?) (JOIN \{part\} ON [\w =]+)"), r"\2 \1"), (re.compile(r"strftime\((\w+), '([^']*)'\)"), lambda m: f"date_format({m[1]}, '{m[2].replace('%d', 'dd').replace('%m', 'MM').replace('%Y', 'yyyy')}')")]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The bound table ``name``, or the Parquet table of that name."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = BINDINGS[name]
    for pattern, to in _SPARK:
        sql = pattern.sub(to, sql)
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name == "clinical_fact":  # one shuffle, by visit, serves both the facts and what meets them by visit
        found["lineitem"] = found["lineitem"].repartition("l_orderkey")
    return spark.sql(sql, **found)


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the bound tables that it names put before it."""
    used = [n for n in BINDINGS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', BINDINGS[n])})" for n in used)
    sql = sql.strip()
    if not ctes:
        return sql
    start = re.match(r"WITH (RECURSIVE )?", sql)
    return f"{start[0]}{ctes}, {sql[start.end():]}" if start else f"WITH {ctes} {sql}"
