import re

from careledger import governance, queries


def test_lines_are_made_once_to_be_traced(spark):
    plan = queries.QUERIES["trace_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_", plan)) <= 6


def test_tracing_counts_lines_without_ids_and_ids_that_are_null(spark):
    facts = spark.createDataFrame([(1, "f1", "a", "x", "x"), (1, None, "a", "x", "x"), (9, "f1", "a", "x", "x")], "session_id int, fact_id string, path string, value string, verbatim string")
    rows = [(1, "fact", "x", ["f1", None, "f2", "f2"]), (1, "fact", "x", None), (1, "fact", "x", []), (2, "structural", "x", ["f7"]), (3, None, "x", ["f7"])]
    lines = spark.createDataFrame(rows, "session_id int, kind string, text string, fact_ids array<string>")
    found = {tuple(r)[:4] for r in governance.trace_lines(lines, facts, []).collect()}
    assert found == {(1, 3, 2, 3), (2, 0, 0, 0), (3, 0, 0, 0)}
