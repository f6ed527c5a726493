"""Echoes in several scripts and of typed values, traceability, and likeness of visits."""

import json
import random

from pyspark.sql import functions as F

from careledger import evidence, governance, ledger, longitudinal

HINDI = "मुझे छाती में दर्द है"


def echoed(spark, *cases):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, v string, t string, o string")
    return [r[0] for r in df.orderBy("k").select(evidence.value_is_echoed(F.col("v"), F.col("t"), F.col("o"))).collect()]


def test_a_text_needs_its_own_words_in_any_script(spark):
    cases = [("cancer", HINDI, None), ("छाती", HINDI, None), ("छाती में बहुत दर्द", HINDI, None), ("cancer", HINDI, "it is cancer"), ("STRASSE", "an der Straße", None), ("ﬁt", "FIT", None), ("burning pain", "burning", None), ("!!", "anything", None), (None, "x", None)]
    assert echoed(spark, *cases) == [False, True, False, True, True, True, True, False, False]


def test_numbers_count_as_quantities(spark):
    assert echoed(spark, ("34.0", "ESR 34 mm/hr", None), ("34.0", "ESR 340", None), ("3.4e1", "34", None), ("nan", "some text", None), ("7", "x", "reads 7.0")) == [True, False, True, False, True]


def test_typed_values(spark):
    cases = [(["fever", "cough"], "fever and cough", None, True), (["fever", "cough"], "fever", None, False), ([], "fever", None, False), (True, HINDI, None, True), (5, HINDI, None, True), (None, HINDI, None, True), ("cancer", HINDI, None, False), ([1, "fever"], "Fever!", None, True), (["a", True], "zzz", ["a", "True"], True), (["a", "b"], "a b", ["a"], False), ("a", "a", [], False), ([], "a", ["a"], False)]
    df = spark.createDataFrame([(k, json.dumps(v), t, s) for k, (v, t, s, _) in enumerate(cases)], "k int, v string, t string, s array<string>").withColumn("v", F.parse_json("v"))
    found = df.orderBy("k").select(evidence.typed_value_is_echoed(F.col("v"), F.col("t"), selected=F.col("s"))).collect()
    assert [r[0] for r in found] == [x for *_, x in cases]


def test_validation_of_typed_values(spark):
    rows = [(1, '["a","c"]', "speech", None), (2, '["a","b"]', "speech", None), (3, "null", "speech", None), (4, '"a"', "touch", ["a"]), (5, '"a"', "touch", ["b"]), (6, '"a"', "touch", None)]
    df = spark.createDataFrame(rows, "seq int, value string, modality string, selected_values array<string>").withColumn("value", F.parse_json("value"))
    df = df.withColumns({"session_id": F.lit(1), "path": F.when(F.col("seq") < 3, "closed").otherwise("open"), "tier": F.lit("stated"), "verbatim": F.lit("a or b"), "question_id": F.lit("q")})
    found = {r["seq"]: r["reject_reason"] for r in ledger.validate_facts(df, ["closed", "open"], None, {"closed": ["a", "b"]}).collect()}
    assert found == {1: "not in vocabulary", 2: None, 3: "null value", 4: None, 5: "value not in span", 6: "value not in span"}


def test_every_way_that_a_line_can_fail(spark):
    facts = spark.createDataFrame([(s, "f1", "hpi.site", "chest", f"{HINDI}") for s in (1, 2, 3, 4, 5)], "session_id int, fact_id string, path string, value string, verbatim string")
    lines = [(1, "fact", "Site: chest", ["f1"]), (1, "structural", "Anything goes", []), (2, "fact", "Site: chest", []), (3, "fact", "Site: chest", ["f1", "f9"]), (4, "fact", "Site: कैंसर chest", ["f1"]), (5, "fact", "दर्द chest 12", ["f1"]), (6, "fact", "x", ["f1"])]
    df = spark.createDataFrame(lines, "session_id int, kind string, text string, fact_ids array<string>")
    found = {r[0]: tuple(r)[1:] for r in governance.trace_lines(df, facts, ["site"]).collect()}
    assert found == {1: (1, 0, 0, 0, True), 2: (1, 1, 0, 0, False), 3: (1, 0, 1, 0, False), 4: (1, 0, 0, 1, False), 5: (1, 0, 0, 0, True), 6: (1, 0, 1, 0, False)}
    assert governance.check_traceability(df.filter("session_id = 4"), governance.supported_words(facts), ["site"]).first()["untraced"] == 1


def test_features_of_lists_and_superseded_facts(spark):
    rows = [(1, "hpi.site", '["chest","none",null]', None), (1, "hpi.associated", '"None"', "f9"), (1, "hpi.onset", '"sudden"', None), (2, "hpi.site", '""', None)]
    df = spark.createDataFrame(rows, "encounter_id int, path string, value string, superseded_by string").withColumn("value", F.parse_json("value"))
    assert {tuple(r) for r in longitudinal.feature_sets(df).collect()} == {(1, "hpi.site", "chest"), (1, "hpi.associated", "None")}


def plain_nearest(visits):
    out = set()
    for p, e, at, f in visits:
        others = sorted((-len(f & g), b, o, ",".join(sorted(f & g))) for q, o, b, g in visits if q == p and o != e and f & g)
        out |= {(e, o, -n, words, k + 1) for k, (n, _, o, words) in enumerate(others[:3])}
    return out


def nearest(spark, visits, direct):
    facts = [(e, *x.split("=")) for _, e, _, f in visits for x in f]
    features = spark.createDataFrame(facts, "encounter_id int, path string, value string")
    encounters = spark.createDataFrame([(e, p, at) for p, e, at, _ in visits], "encounter_id int, patient_id int, occurred_at int")
    return longitudinal.similar_encounters(features, encounters, direct=direct)


def test_nearest_visits_match_brute_force_by_either_way(spark):
    rng = random.Random(3)
    visits = [(k % 3, k, rng.randrange(20), frozenset(f"p{rng.randrange(4)}={rng.randrange(3)}" for _ in range(rng.randrange(1, 7)))) for k in range(150)]
    visits += [(4, 200 + k, 1, frozenset(f"w={x}" for x in range(k, k + 13))) for k in range(6)] + [(4, 210, 0, frozenset({"w=3", "w=4"}))]
    want = plain_nearest(visits)
    for direct in (0, 1000):
        found = nearest(spark, visits, direct).collect()
        assert {(r["encounter_id"], r["similar_id"], r["shared"], r["shared_features"], r["rank"]) for r in found} == want


def test_a_patient_of_very_many_visits_makes_no_pairs(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("encounter_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(F.concat(F.lit("p"), k.cast("string")).alias("path"), F.pmod(F.xxhash64("id", k), F.lit(7)).cast("string").alias("value")))).alias("x"))
    encounters = spark.range(n).select(F.col("id").alias("encounter_id"), F.lit(1).alias("patient_id"), F.col("id").alias("occurred_at"))
    found = longitudinal.similar_encounters(rows.select("encounter_id", "x.*"), encounters)
    assert found.count() == 3 * n


def test_texts_that_begin_alike_do_not_meet(spark):
    n = 20_000
    shown = spark.range(n).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("code"), F.concat(F.lit("chronic disease number "), F.lower(F.lpad(F.hex("id"), 6, "0"))).alias("display_normalized"))
    terms = spark.createDataFrame([("chronic disease number 000fff",), ("number 0000aa",), ("chronic",), ("of chronic disease number 000001 again",), ("zzz",), ("er",)], "key string").withColumn("term", F.col("key"))
    found = {}
    for r in governance.lookup_terms(terms, shown.unionByName(spark.createDataFrame([("S1", "o"), ("S2", "of")], shown.schema))).collect():
        found.setdefault(r.key, []).append((r["class"], r.code))
    assert {k: sorted(v)[:2] for k, v in found.items()} == {
        "chronic disease number 000fff": [(0, f"C{0xFFF}"), (2, "S1")], "number 0000aa": [(1, f"C{0xAA}")], "chronic": [(1, "C0"), (1, "C1")],
        "of chronic disease number 000001 again": [(2, "C1"), (2, "S1")],
    }
    rare = governance._hits_by_rare_piece(terms.filter("key like 'number%'").select(F.col("key").alias("inner")), shown.select(F.col("display_normalized").alias("outer")), 3)
    assert rare.count() == 1
