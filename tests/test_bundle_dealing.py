import re

import pytest

from careledger import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["linked_bundles", "to_fhir_bundles"])
def test_bundles_are_not_shuffled_once_built(spark, name):
    """Names and JSON of entries are made after the last exchange; only what meets them by encounter is dealt by it."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries.QUERIES[name](spark, SF)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    depth = lambda line: len(re.match(r"[ :|+-]*", line)[0])
    for n, line in enumerate(plan):
        if "Exchange" in line:
            under = [x for x in plan[n + 1 :]]
            end = next((k for k, x in enumerate(under) if depth(x) <= depth(line)), len(under))
            assert not any("to_json" in x or "structstojson" in x.lower() or "sha2" in x for x in under[:end])


def test_json_of_bundles_is_not_gathered(spark):
    """an encounter's rows are gathered and sorted while they are short, and names and JSON made of them after that."""
    plan = queries.QUERIES["linked_bundles"](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[ :|+-]*", line)[0])
    assert any("sha2" in x for x in plan)
    for n, line in enumerate(plan):
        if re.match(r"[ :|+-]*(\*?\(\d+\) )?(ObjectHashAggregate|SortAggregate|Sort|Window)\b", line):
            under = plan[n + 1 :]
            end = next((k for k, x in enumerate(under) if depth(x) <= depth(line)), len(under))
            assert not any("to_json" in x or "structstojson" in x.lower() or "sha2" in x for x in under[:end])
