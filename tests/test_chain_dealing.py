from pyspark.sql import functions as F

from careledger import governance
from careledger.canonical import json_string


def test_payloads_are_made_after_rows_are_dealt(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("chain"))
    linked = governance.append_chain(rows, "chain", "id", F.concat(F.lit("payload of "), F.col("id").cast("string")))
    above, below = linked._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning", 1)
    assert "payload of " in above and "payload of " not in below
    assert linked.filter("hash = sha2(concat(prev_hash, payload), 256)").count() == 100


def test_each_escape_is_made_from_the_text_alone(spark):
    import json

    texts = ["\\u0001", '\\"', "\u0001\\u0001\"", "é\\é\n\\n", "😀\u007f\t", "", "퟿\\", '"' * 3 + "\\" * 3]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(json_string(F.col("t"))).collect()
    assert [r[0] for r in found] == [json.dumps(t).replace("\x7f", "\\u007f") for t in texts]
