"""Dates, ranges, options, slots, denials, progress and withdrawal on small cases."""

import datetime

from pyspark.sql import functions as F

from careledger import documents, governance, intake, ledger, rules


def test_a_cued_line_dates_a_document(spark):
    lines = ["Surgery in 2011", "Collected on 14/03/2024", "Reported on 15/03/2024"]
    others = [["2019 then", "Dt: 02/01/2020"], ["VISIT DATE 03/02/2021", "2010"], ["common cold 2012", "conduct 2013"], ["no day"]]
    rows = [(1, 1, i, t) for i, t in enumerate(lines)] + [(k + 2, 1, i, t) for k, x in enumerate(others) for i, t in enumerate(x)]
    found = {r.doc_id: r.document_date for r in documents.document_date(spark.createDataFrame(rows, "doc_id int, page int, line_no int, text string")).collect()}
    assert found == {1: datetime.date(2024, 3, 14), 2: datetime.date(2020, 1, 2), 3: datetime.date(2021, 2, 3), 4: datetime.date(2012, 1, 1)}


def test_entities_take_the_cued_date(spark):
    rows = [(1, 1, 1, "Surgery in 2011", 0.95, False), (1, 1, 2, "Collected on 14/03/2024", 0.95, False), (1, 1, 3, "HbA1c: 7.1 %", 0.95, False)]
    df = spark.createDataFrame(rows, "doc_id int, page int, line_no int, text string, confidence double, handwritten boolean")
    assert [(r.kind, str(r.observed_on)) for r in intake.extract_entities(df).collect()] == [("procedure", "2011-01-01"), ("investigation", "2024-03-14")]


def test_ordinals_and_commas_leave_the_year(spark):
    df = spark.createDataFrame([(t,) for t in ("12 March 2019", "12 March, 2019", "12th March 2019", "March 2019", "Sept. 2019")], "t string")
    day, precision = documents.parse_dates(F.col("t"))
    assert [tuple(map(str, r)) for r in df.select(day, precision).collect()] == [("2019-03-12", "exact"), ("2019-01-01", "year"), ("2019-03-01", "month"), ("2019-03-01", "month"), ("2019-01-01", "year")]


def test_each_form_of_a_printed_range(spark):
    texts = ["4.0 - 5.6", "4.0–5.6", "0.4 TO 4", "< 200", "up to 150", "upto 150", "Less than 7", "> 40", "above 3.5", "greater than 2", "> 40 (5 - 9)", "5-9 or > 40", "none", "7 < 9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [tuple(r) for r in df.select(*documents.printed_range(F.col("t"))).collect()]
    want = [(4.0, 5.6), (4.0, 5.6), (0.4, 4.0), (None, 200.0), (None, 150.0), (None, 150.0), (None, 7.0), (40.0, None), (3.5, None), (2.0, None), (40.0, None), (5.0, 9.0), (None, None), (None, 9.0)]
    assert found == [(*w, w != (None, None)) for w in want]


def test_options_by_their_labels(spark):
    options = [("q", 1, "pain", ["dard"], ["Chest pain", None]), ("q", 2, "breath", None, ["Breathlessness at rest", "साँस की तकलीफ़"]), ("q", 3, "other", [], [])]
    phrases = documents.option_phrases(spark.createDataFrame(options, "question_id string, option_no int, option_value string, lexicon array<string>, labels array<string>"))
    assert [(r.option_value, r.phrase) for r in phrases.orderBy("option_no", "phrase_no").collect()][:6] == [("pain", "dard"), ("pain", "Chest pain"), ("pain", "chest"), ("breath", "Breathlessness at rest"), ("breath", "breathlessness"), ("breath", "साँस की तकलीफ़")]
    said = [(1, 1, "q", "Some CHEST  PAIN, chest tight"), (2, 1, "q", "मुझे साँस की तकलीफ़ और dard"), (3, 1, "q", "breathlessness and chest pain"), (4, 1, "q", "no chest pain")]
    u = spark.createDataFrame(said, "session_id int, turn_id int, question_id string, text string")
    hits = {}
    for r in documents.match_options(u, phrases).orderBy("session_id", "rank").collect():
        hits.setdefault(r.session_id, []).append((r.option_value, r.quote, r.score))
    assert hits == {1: [("pain", "CHEST", 0.58)], 2: [("breath", "साँस की तकलीफ़", 0.64), ("pain", "dard", 0.58)], 3: [("breath", "breathlessness", 0.58), ("pain", "chest pain", 0.61)]}


def test_ties_go_by_the_order_of_options(spark):
    u = spark.createDataFrame([(1, 1, "q", "ache")], "session_id int, turn_id int, question_id string, text string")
    phrases = spark.createDataFrame([("q", "z", "ache", 0, 0), ("q", "a", "Ache", 0, 1)], "question_id string, option_value string, phrase string, phrase_no int, option_no int")
    assert [r.option_value for r in documents.match_options(u, phrases).orderBy("rank").collect()] == ["z", "a"]


def test_every_slot_has_a_quote_of_its_turn(spark):
    said = [(1, "m", "First it was Pressure, later my left arm felt Heavy indeed"), (2, "s", "a HEAVY feeling"), (3, "b", "Well, Haan"), (4, "b", "no, yes"), (5, "n", "about 7 of 10"), (6, "o", "  my words "), (7, "m", "nothing"), (8, "b", "maybe")]
    u = spark.createDataFrame([(i, 1, q, t) for i, q, t in said], "session_id int, turn_id int, question_id string, text string")
    phrases = spark.createDataFrame([(q, o, o) for q in "ms" for o in ("heavy", "pressure", "arm")] + [("m", "none", "indeed")], "question_id string, option_value string, phrase string")
    kinds = spark.createDataFrame([("m", "multi"), ("s", "single"), ("b", "boolean"), ("n", "scale"), ("o", "open")], "question_id string, kind string")
    found = {r.session_id: (r.value, r.quote) for r in intake.extract_slots(u, kinds, documents.match_options(u, phrases)).collect()}
    assert found == {1: ("pressure,arm,heavy", "Pressure, later my left arm felt Heavy"), 2: ("heavy", "HEAVY"), 3: ("true", "Haan"), 4: ("false", "no"), 5: ("7", "7"), 6: ("my words", "my words"), 7: (None, None), 8: (None, None)}
    assert all(q is None or q in t for (_, q), (_, _, t) in zip([found[i] for i in range(1, 9)], said, strict=True))


def denials(spark, rows, rules_=None):
    df = spark.createDataFrame(rows, "session_id int, seq int, fact_id string, path string, value array<string>, verbatim string, superseded_by string")
    return {(r.rule_id, r.denial_id, r.fact_id) for r in rules.detect_denials(df, rules_).collect()}


def test_only_the_last_active_fact_denies(spark):
    med = "drug_allergy.taking_medicines"
    entry = (1, 9, "m", "medications[3].name", ["aspirin"], "paper", None)
    assert denials(spark, [(1, 1, "a", med, ["false"], "no", "b"), (1, 2, "b", med, ["true"], "yes", None), entry]) == set()
    assert denials(spark, [(1, 1, "a", med, ["true"], "yes", None), (1, 2, "b", med, ["false"], "no", None), entry]) == {("CX-MED-01", "b", "m")}
    assert denials(spark, [(1, 2, "b", med, ["false"], "no", None), (*entry[:6], "z")]) == set()
    assert denials(spark, [(1, 2, "b", med, ["false"], "paper", None), entry]) == set()  # the same words


def test_denials_within_lists_and_by_fields(spark):
    rows = [(1, 1, "c", "past_medical.conditions", ["asthma", "none"], "said", None), (1, 2, "p", "problems[0].reported_term", ["fever"], "paper", None), (1, 3, "q", "problems[0].year", ["2001"], "paper", None), (2, 1, "d", "past_medical.conditions", ["asthma"], "said", None), (2, 2, "r", "problems[0].reported_term", ["fever"], "paper", None)]
    assert denials(spark, rows) == {("CX-PMH-01", "c", "p")}


def test_progress(spark):
    questions = [{"id": "a", "path": "p.a", "section": "x"}, {"id": "b", "path": "p.b", "section": "x", "ask_if": [{"path": "p.a", "eq": "yes"}]}, {"id": "c", "path": "p.c", "section": "y", "kind": "derived"}]
    rows = [(1, {"p.a": ["yes"]}, None), (2, {"p.a": ["no"], "p.c": ["1"]}, []), (3, {}, ["a"]), (4, {"p.a": ["yes"]}, ["b"])]
    df = spark.createDataFrame(rows, "session_id int, values map<string,array<string>>, declined array<string>")
    assert {r[0]: tuple(r)[1:] for r in ledger.askable_progress(df, questions).collect()} == {1: (2, 1, 50.0), 2: (1, 1, 100.0), 3: (1, 1, 100.0), 4: (2, 2, 100.0)}
    assert ledger.askable_progress(df, questions[2:]).first()["percent"] == 100.0
    assert {(r.session_id, r.section): (r.answered, r.total, r.complete) for r in ledger.section_progress(df, questions).collect()} == {(1, "x"): (1, 2, False), (2, "x"): (1, 1, True), (3, "x"): (1, 1, True), (4, "x"): (2, 2, True), **{(i, "y"): (0, 0, False) for i in (1, 2, 3, 4)}}


def test_what_is_left_after_a_withdrawal(spark):
    facts = spark.createDataFrame([(1, "f1", "document", None, "p"), (1, "f2", "stated", "speech", "p"), (1, "f3", "stated", "touch", "ayush.x"), (2, "f4", "stated", "speech", "p")], "session_id int, fact_id string, tier string, modality string, path string")
    consents = spark.createDataFrame([(1, ["voice", "history", "documents"], [], ["voice", "documents"]), (2, ["history"], ["voice"], None), (3, ["history", "ayush"], [], ["history"])], "session_id int, granted array<string>, refused array<string>, scopes array<string>")
    found = {r[0]: tuple(r)[1:] for r in governance.withdraw_consent(consents, facts, ["history"]).collect()}
    assert found == {1: (["documents", "voice"], ["history"], ["documents", "voice"], 2, False), 2: (["history"], [], ["history", "voice"], 0, True), 3: (["history"], ["ayush"], ["history"], 0, True)}
