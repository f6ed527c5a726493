"""Every query of the library against its SQL, on the smallest tables; single operators on small cases."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from careledger import documents, evaluation, evidence, governance, intake, ledger, longitudinal, promotion, queries, rules, streams, tables

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents conversations labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.execute(queries.ORACLE_SQL[name])
    at = [c[0] for c in want.description]
    assert sorted(at) == columns
    rows = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in found.select(*columns).collect()), key=repr) == rows


def test_conditions_are_false_for_a_missing_path(spark):
    df = spark.createDataFrame([({"a": ["3"]},), ({},)], "values map<string,array<string>>")
    for op, arg in (("eq", "3"), ("ne", "4"), ("in", ["3"]), ("not_in", ["4"]), ("gte", 3), ("recorded", True)):
        assert [r[0] for r in df.select(ledger.condition_expr({"path": "a", op: arg}, F.col("values"))).collect()] == [True, False]
    assert [r[0] for r in df.select(ledger.condition_expr({"path": "a", "not_recorded": True}, F.col("values"))).collect()] == [False, True]


def test_numbers_echo_whatever_their_form(spark):
    df = spark.createDataFrame([("34.0", "ESR 34 mm/hr"), ("34.0", "ESR 340 mm/hr")], "v string, t string")
    assert [r[0] for r in df.select(evidence.value_is_echoed(F.col("v"), F.col("t"))).collect()] == [True, False]


def test_negation_stops_at_a_clause(spark):
    df = spark.createDataFrame([("heavy, not sharp", 11), ("no fever but chest pain", 13)], "t string, at int")
    assert [r[0] for r in df.select(documents.is_negated(F.col("t"), F.col("at"))).collect()] == [True, False]


def test_scrub_redacts_at_any_depth(spark):
    df = spark.createDataFrame([('{"a": {"name": "x"}, "l": [1, 2]}',)], "p string")
    assert df.select(governance.scrub_payload(F.col("p"))).first()[0] == '{"a": {"name": "<redacted>"}, "l": "<2 item(s)>"}'


def test_chains_are_streamed(spark):
    n = 25_000  # more rows than an Arrow batch holds
    df = spark.range(n).selectExpr("nullif(id % 5 div 4, 1) as chain", "id", "concat('p', id) as p").repartition(3)
    found = governance.append_chain(df, "chain", "id", F.col("p"))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    want = []
    for chain, ids in ((0, (i for i in range(n) if i % 5 != 4)), (None, range(4, n, 5))):
        last = governance.GENESIS
        for i in ids:
            want.append((chain, i, f"p{i}", last, last := hashlib.sha256(f"{last}p{i}".encode()).hexdigest()))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
    assert {tuple(r) for r in governance.verify_chain(found, "chain", "id").collect()} == {(0, 20_000, None, None), (None, 5000, None, None)}


def test_folding_drops_case_and_marks(spark):
    df = spark.createDataFrame([("Méningite-À",), (None,)], "t string")
    assert {r[1] for r in governance.fold_text(df, "t", "f").collect()} == {"meningite a", None}


def test_gold_scripts_are_read_by_id(spark, tmp_path):
    for name in ("s01-x", "s02-y"):
        (tmp_path / f"{name}.json").write_text('{\n"id": "%s", "turns": [{"question_id": "q", "asr_confidence": 0.5}], "expected": {"p": "[1]"}}' % name)
    rows = intake.read_gold_scripts(spark, str(tmp_path), "y").collect()
    assert [(r.id, r.turns[0].question_id, r.expected) for r in rows] == [("s02-y", "q", {"p": "[1]"})]


def test_scale_anchors(spark):
    df = spark.createDataFrame([(0,), (5,), (10,)], "n int")
    assert [r[0] for r in df.select(intake.scale_anchor(F.col("n"), 10, ["low", "mid", "high"])).collect()] == ["low", "mid", "high"]


def test_choices_are_extracted_unless_negated(spark):
    u = spark.createDataFrame([(1, 1, "q", "heavy like pressure, not sharp"), (2, 1, "q", "nothing")], "session_id int, turn_id int, question_id string, text string")
    phrases = spark.createDataFrame([("q", "heavy", "heavy"), ("q", "pressure", "pressure"), ("q", "sharp", "sharp")], "question_id string, option_value string, phrase string")
    hits = documents.match_options(u, phrases)
    of = lambda kind: {r.session_id: (r.value, r.unplaced) for r in intake.extract_slots(u, spark.createDataFrame([("q", kind)], "question_id string, kind string"), hits).collect()}
    assert of("multi") == {1: ("heavy,pressure", None), 2: (None, "nothing")}
    assert of("single")[1] == ("heavy", None)


def test_absence_options_are_not_negated(spark):
    u = spark.createDataFrame([(1, 1, "q", "no, I never smoke"), (2, 1, "q", "no, not daily")], "session_id int, turn_id int, question_id string, text string")
    phrases = spark.createDataFrame([("q", "never", "never smoke"), ("q", "daily", "daily")], "question_id string, option_value string, phrase string")
    hits = documents.match_options(u, phrases)
    assert [tuple(r) for r in hits.collect()] == [(1, 1, "never", 0.61, 6, "never smoke", 1)]
    slots = intake.extract_slots(u, spark.createDataFrame([("q", "single")], "question_id string, kind string"), hits).collect()
    assert {r.session_id: r.value for r in slots} == {1: "never", 2: None}


def run_stream(spark, df, tmp_path, mode, make):
    """``df`` read as a stream of files through ``make``; the rows of the sink."""
    df.write.parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("found").outputMode(mode).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("found").collect()


def test_failed_speech_forces_touch(spark, tmp_path):
    turns = [(1, "a", 1, "failed"), (1, "a", 2, "answered"), (1, "b", 1, "failed"), (2, "a", 1, "heard"), *[(2, "b", i, "failed") for i in range(6)]]
    df = spark.createDataFrame(turns, "session_id int, question_id string, seq int, outcome string").coalesce(1)
    rows = run_stream(spark, df, tmp_path, "update", streams.stream_touch_fallback)
    assert {(r.session_id, r.question_id): (r.presentations, r.mode) for r in rows} == {(1, "a"): (2, "answered"), (1, "b"): (1, "touch"), (2, "a"): (1, "voice"), (2, "b"): (4, "given up")}


def test_old_papers_are_not_late(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP '2024-03-01 10:00:00' AS ts, DATE '1999-01-01' AS document_date UNION ALL SELECT TIMESTAMP '2024-03-01 12:00:00', DATE '2024-02-01'").coalesce(1)
    rows = run_stream(spark, df, tmp_path, "complete", streams.stream_documents)
    assert {(r.document_year, r.documents) for r in rows} == {(1999, 1), (2024, 1)}


def day(s):
    import datetime

    return datetime.datetime.fromisoformat(f"2024-03-01 {s}")


def test_stream_dedupe_equals_its_batch(spark, tmp_path):
    rows = [(1, "p", "d1", day("10:00:00")), (1, "p", "d1", day("10:05:00")), (1, "p", "d2", day("10:06:00")), (2, "p", "d1", day("10:07:00"))]
    df = spark.createDataFrame(rows, "session_id int, path string, digest string, ts timestamp").coalesce(1)
    keys = lambda found: sorted((r.session_id, r.path, r.digest) for r in found)
    assert keys(run_stream(spark, df, tmp_path, "append", promotion.stream_dedupe)) == keys(promotion.stream_dedupe(df).collect()) == [(1, "p", "d1"), (1, "p", "d2"), (2, "p", "d1")]


def in_order(spark, parts, schema, tmp_path, mode, make):
    """Files that arrive one after another as a stream through ``make``; the rows of the sink."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    stream = None
    source = tmp_path / "in"
    for i in range(len(parts)):
        df = spark.read.parquet(str(tmp_path / f"part{i}"))
        df.write.mode("append").parquet(str(source))
        if stream is None:
            out = make(spark.readStream.schema(df.schema).parquet(str(source)))
            stream = out.writeStream.format("memory").queryName(f"seen_{mode}_{make.__name__}").outputMode(mode).option("checkpointLocation", str(tmp_path / "at")).start()
        stream.processAllAvailable()
    stream.stop()
    return spark.table(f"seen_{mode}_{make.__name__}").collect()


def test_priority_only_rises_as_turns_arrive(spark, tmp_path):
    found = in_order(spark, [[(1, 0)], [(1, 2), (2, 1)], [(1, 1)]], "session_id int, rank int", tmp_path, "update", promotion.stream_priority)
    assert [r["rank"] for r in found if r.session_id == 1] == [0, 2, 2][: len([r for r in found if r.session_id == 1])] and max(r["rank"] for r in found if r.session_id == 1) == 2


def test_late_rows_do_not_reopen_a_session(spark, tmp_path):
    parts = [[(1, day("08:00:00")), (1, day("08:20:00"))], [(2, day("13:00:00"))], [(1, day("08:30:00"))], [(3, day("18:00:00"))]]
    found = in_order(spark, parts, "session_id int, ts timestamp", tmp_path, "append", promotion.stream_sessions)
    assert {(r.session_id, r.events) for r in found} == {(1, 2), (2, 1)}


def test_late_rows_do_not_reopen_an_interval(spark, tmp_path):
    parts = [[("a", day("01:00:00")), ("a", day("02:00:00"))], [("b", day("23:00:00"))], [("a", day("03:00:00"))], [("b", day("23:30:00"))]]
    found = in_order(spark, parts, "kind string, ts timestamp", tmp_path, "append", promotion.stream_activity)
    assert {(r.kind, r.events) for r in found} == {("a", 2)}


@pytest.mark.parametrize("key", governance.FORBIDDEN_KEYS)
def test_no_forbidden_key_passes(spark, key):
    escaped = "".join(f"\\u{ord(c):04x}" for c in key)
    rows = [(f'{{"{key}": "secret"}}',), (f'{{"a": {{"b": {{"{key}": {{"x": "secret"}}}}}}}}',), (f'{{"{escaped}": "secret"}}',), (f'{{"{key}": "secret"',), (f'{{"l": [{{"{key}": "secret"}}]}}',)]
    found = spark.createDataFrame(rows, "p string").select(governance.scrub_payload(F.col("p"))).collect()
    assert not any("secret" in r[0] for r in found)


def test_lists_are_no_numbers_and_contains_is_within(spark):
    df = spark.createDataFrame([({"a": ["Chest pain", "7"]},), ({"a": ["7"]},), ({"a": ["true"]},)], "values map<string,array<string>>")
    of = lambda **c: [r[0] for r in df.select(ledger.condition_expr({"path": "a", **c}, F.col("values"))).collect()]
    assert of(gte=1) == [False, True, False] and of(contains="EST") == [True, False, False]


def test_typed_sources(spark, tmp_path):
    (tmp_path / "audit.json").write_text('{"id": 1, "chain": 2, "ts": "2024-01-01T00:00:00Z", "action": "read", "other": 3}\n{"id": "x"}\n')
    found = tables.read_tables(spark, str(tmp_path), ["audit"], "json")["audit"]
    assert found.columns == ["id", "chain", "ts", "action", "summary", "consent_ref"] and [r.id for r in found.orderBy("id").collect()] == [None, 1]


def test_parsers_know_the_forms_of_the_trade(spark):
    lines = ["TAB. AMLODIPINE 5MG OD", "Inj Ceftriaxone 1 g Q12H iv for 5 days", "SYP. Cough Relief 10 ml 1-1-1 x 3 days po", "Date: 14/03/2024 1-0-1", "Reg No 12345", "k/c/o diabetes mellitus.", "s/p appendectomy;", "TLC: 8000 cells/cu.mm", "Platelets - 2.5 lakh/cumm low"]
    df = spark.createDataFrame([(i, 1, 1, t, 0.95, False) for i, t in enumerate(lines)], "doc_id int, page int, line_no int, text string, confidence double, handwritten boolean")
    meds = {r.doc_id: (r.form, r.name, r.strength, r.frequency, r.duration, r.route) for r in documents.parse_medications(df).collect()}
    assert meds == {0: ("TAB", "AMLODIPINE", "5MG", "once daily", None, None), 1: meds[1], 2: ("SYP", "Cough Relief", "10 ml", "3× daily (morning, afternoon, night)", "3 days", "oral")}
    assert meds[1][3] == "Q12H" and meds[1][5] == "intravenous"
    assert {r.doc_id: (r.kind, r.term) for r in documents.parse_diagnoses_procedures(df).collect()} == {5: ("diagnosis", "diabetes mellitus"), 6: ("procedure", "appendectomy")}
    assert {r.doc_id: (r.analyte, r.value, r.unit) for r in documents.parse_investigations(df).collect()} == {7: ("wbc", 8000.0, "cells/cu.mm"), 8: ("platelets", 2.5, "lakh/cumm")}


def test_likeness_of_many_visits(spark):
    visits = [(i, 1, i) for i in range(60)] + [(100, 2, 1)]
    facts = [(i, "hpi.site", f"v{i % 3}") for i in range(60)] + [(i, "hpi.timing", f"t{i % 2}") for i in range(60)] + [(100, "hpi.site", "v0")]
    found = longitudinal.similar_encounters(spark.createDataFrame(facts, "encounter_id int, path string, value string"), spark.createDataFrame(visits, "encounter_id int, patient_id int, occurred_at int")).collect()
    sets = {}
    for e, p, v in facts:
        sets.setdefault(e, set()).add((p, v))
    want = {}
    for e, p, _ in visits:
        near = sorted((-len(sets[e] & sets[o]), at, o) for o, q, at in visits if o != e and q == p and sets[e] & sets[o])[:3]
        want[e] = [(o, -n) for n, _, o in near]
    got = {e: [] for e in want}
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.encounter_id].append((r.similar_id, r.shared))
    assert got == want


def test_durable_tables_are_appended(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string")
    for _ in range(2):
        promotion.write_durable({"patient": df, "fact": df}, str(tmp_path), {"fact": "kind"})
    assert spark.read.parquet(str(tmp_path / "patient")).count() == 4
    assert spark.read.parquet(str(tmp_path / "fact" / "kind=a")).count() == 2


def test_readings_are_scored_by_kind(spark):
    truth = [
        (1, 1, "medication", "Metformin Hcl", "500 mg"), (1, 2, "medication", "--", "1"), (1, 3, "investigation", "HbA1c", "high"), (1, 4, "diagnosis", "Type 2 diabetes mellitus", None),
        (2, 1, "medication", "Aspirin", "75mg"), (3, 1, "investigation", "Urea", None),
    ]
    found = [
        (1, 1, "medication", "TAB. MET-FORMIN", "500MG", True), (1, 2, "medication", "metformin", "850 mg", False), (1, 3, "investigation", "HbA1c 7", "low", False), (1, 4, "diagnosis", "type-2 DIABETES", None, False),
        (3, 1, "investigation", "s. urea 30", None, False), (4, 1, "medication", "x", None, True),
    ]
    truth = spark.createDataFrame(truth, "doc_id int, item int, kind string, text string, detail string")
    found = spark.createDataFrame(found, "doc_id int, place int, kind string, text string, detail string, needs_check boolean")
    rows = evaluation.score_ocr(truth, found, ["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, 4, 0.5, 1.0, 1.0, 0.0, 1.0, 0.25), (2, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0), (3, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0), (4, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert evaluation.score_ocr(truth.limit(0), found.limit(0), ["doc_id"]).count() == 0


def test_nested_rules_as_groups_equal_their_expression(spark):
    a, b, c = ({"path": p, "eq": "1"} for p in "abc")
    whens = [{"all": []}, {"any": []}, {"any": [{"all": []}, a]}, {"all": [{"any": [a, b]}, c]}, {"any": [{"all": [a, {"any": [b, c]}]}, {"all": [b, c]}]}, [a, {"all": [b]}]]
    known = [{"id": f"r{i}", "level": "urgent", "when": w} for i, w in enumerate(whens)]
    rows = [(n, {p: ["1" if n >> i & 1 else "0"] for i, p in enumerate("abc")}, {p: [f"f{p}"] for p in "abc"}) for n in range(8)] + [(8, {}, {})]
    df = spark.createDataFrame(rows, "session_id long, values map<string,array<string>>, fact_ids map<string,array<string>>")
    plain_rules = df.select("session_id", *[ledger.rule_expr(r["when"], F.col("values")).alias(r["id"]) for r in known]).collect()
    want = {(r["session_id"], k["id"]): r[k["id"]] for r in plain_rules for k in known}
    found = {(r["session_id"], r["rule_id"]): r for r in rules.evaluate_red_flags(df, known).collect()}
    assert {k: r["fired"] for k, r in found.items()} == want
    assert (found[7, "r3"]["paths"], found[7, "r3"]["fact_ids"], found[5, "r3"]["paths"], found[2, "r3"]["paths"]) == ("a,b,c", "fa,fb,fc", "a,c", "")


def test_dates_of_all_forms(spark):
    said = {
        "on 3/4/2021": ("2021-04-03", "exact"), "2021.04.03": ("2021-04-03", "exact"), "12th Sept, 2019": ("2019-01-01", "year"), "since December 2018": ("2018-12-01", "month"), "in 1999": ("1999-01-01", "year"),
        "31/02/2020 then": ("2020-01-01", "year"), "31 Feb 2020": ("2020-02-01", "month"), "": (None, "unknown"), "1/2/20": (None, "unknown"), "may 5": (None, "unknown"),
    }
    df = spark.createDataFrame([(t,) for t in [*said, None]], "t string")
    day, precision = documents.parse_dates(F.col("t"))
    found = {r["t"]: (r["day"] and str(r["day"]), r["precision"]) for r in df.select("t", day.alias("day"), precision.alias("precision")).collect()}
    assert found == {**said, None: (None, "unknown")}
