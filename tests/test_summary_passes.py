import re

from pyspark.sql import functions as F

from careledger import queries, summary

SF = "/root/testdata/sf0.001"


def test_facts_are_read_once_for_lines_and_once_for_gaps(spark):
    plan = queries.QUERIES["build_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_", plan)) <= 5


def test_lines_by_path_are_those_of_slots_problems_and_sides(spark):
    side = ("Site", "chest", "paper", "abdomen", "f1", "f9")
    rows = [(1, "hpi.site", "chest", ["f1", None, "f1"], None, [side, ("Site", "x", "paper", "y", None, None)]), (1, "hpi.associated", "fever", ["f2"], ("fever", 2001, "c1", "Fever"), []), (2, "hpi.onset", None, [], (None, 1999, None, None), []), (2, "hpi.pain", "no", None, None, None)]
    paths = spark.createDataFrame(rows, """session_id int, path string, value string, fact_ids array<string>, problem struct<term string, year int, code string, display string>,
        sides array<struct<label string, patient_verbatim string, origin string, document_verbatim string, patient_fact_id string, document_fact_id string>>""")
    labels = {"hpi.site": "Site"}
    sides = paths.select("session_id", F.inline("sides"))
    apart = summary.slot_lines(paths, labels).unionByName(summary.problem_lines(paths.select("session_id", "fact_ids", "problem.*"))).unionByName(summary.contradiction_lines(sides))
    assert sorted(map(repr, summary.path_lines(paths, labels).collect())) == sorted(map(repr, apart.collect())) and apart.count() == 6
