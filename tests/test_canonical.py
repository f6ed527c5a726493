"""Canonical JSON and chains against Python's own."""

import datetime
import decimal
import hashlib
import json
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from careledger import canonical, governance

ODD = ['v","b":"w', "a\\", "\x00\x1f\x0b\x0c\b\r\n\t", "\x7f\x80", "é डॉ 中 😀𝒳", "", " plain ~", '\\"', "\\u000B"]


def test_strings_are_escaped_as_python_does(spark):
    df = spark.createDataFrame([(s,) for s in [*ODD, None]], "s string")
    assert [r[0] for r in df.select(canonical.canonical_json(F.col("s"), T.StringType())).collect()] == [json.dumps(s) for s in [*ODD, None]]


def test_numbers(spark):
    xs = [0.0, -0.0, 1.0, 100.0, 1e7, 12345678.5, 1e15, 123456789012345680.0, 1e16, 1.5e300, 1e-3, 1e-4, 1.5e-4, 9.9e-5, -2.5e-7, 185.22, 0.1, math.inf, -math.inf, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(canonical.canonical_json(F.col("x"), T.DoubleType())).collect()] == [json.dumps(x) for x in xs]


def test_nested_values(spark):
    inner = T.StructType().add("z", T.LongType()).add("a b", T.ArrayType(T.BooleanType())).add("m", T.MapType(T.StringType(), T.DoubleType()))
    schema = T.StructType().add("s", inner).add("d", T.DecimalType(5, 2)).add("day", T.DateType()).add("l", T.ArrayType(inner))
    values = [({"z": 1, "a b": [True, None], "m": {"ü": 1.5, "b": None}}, decimal.Decimal("1.50"), datetime.date(2024, 2, 29), [{"z": None, "a b": [], "m": {}}, None]), (None, None, None, None)]
    df = spark.createDataFrame(values, schema)
    found = [r[0] for r in df.select(canonical.canonical_json(F.struct(*df.columns), df.schema)).collect()]
    plain = lambda row: json.dumps(dict(zip(["s", "d", "day", "l"], row, strict=True)), sort_keys=True, separators=(",", ":"), default=str)
    assert found == [plain(v) for v in values]


def test_variants_keep_their_types_and_sort_their_keys(spark):
    texts = [json.dumps(x) for x in ({"b": 1, "a": {"z": [1, 2.5, True, None, "é\x0b\x1f\\u000B😀"], "c": "x"}}, [], {}, "é", None, {"A": 1, "Z": 2, "a": 3, "é": 4})]
    df = spark.createDataFrame([(s,) for s in texts], "s string").select(F.parse_json("s").alias("v"))
    assert [r[0] for r in df.select(canonical.canonical_json(F.col("v"), T.VariantType())).collect()] == [json.dumps(json.loads(s), sort_keys=True, separators=(",", ":")) for s in texts]


def test_different_rows_have_different_payloads(spark):
    rows = [('v","b":"w', None), ("v", "w"), (None, "null"), ("null", None), ("v", 'w","c":"'), ("1", "1")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = [r[0] for r in df.select(governance.audit_payload(df, ["b", "a"])).collect()]
    assert found == [json.dumps({"a": a, "b": b}, separators=(",", ":")) for a, b in rows] and len(set(found)) == len(rows)


def test_timestamps_are_naive_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        df = spark.sql("SELECT timestamp '2024-03-01 05:30:00.000012' AS t, timestamp_ntz '2024-03-01 00:00:00' AS n")
        assert df.select(governance.audit_payload(df, ["t", "n"])).first()[0] == '{"n":"2024-03-01T00:00:00.000000","t":"2024-03-01T00:00:00.000012"}'
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def plain_break(rows):
    last = governance.GENESIS
    for k, (prev, h, payload) in enumerate(rows):
        if prev != last:
            return k, "inserted or removed"
        if h != hashlib.sha256((prev + payload).encode()).hexdigest():
            return k, "modified"
        last = h
    return None, None


def test_one_chain_is_verified_by_many_tasks(spark):
    n = 3000
    links, last = [], governance.GENESIS
    for i in range(n):
        h = hashlib.sha256((last + f"p{i}").encode()).hexdigest()
        links.append((last, h, f"p{i}"))
        last = h
    cases = {"whole": links, "first changed": [(links[0][0], links[0][1], "x"), *links[1:]], "one removed": links[:1500] + links[1501:], "one changed": links[:2100] + [(*links[2100][:2], "y")] + links[2101:], "none at the start": links[1:], "last changed": links[:-1] + [(*links[-1][:2], "z")]}
    cases |= {f"cut {k}": links[:k] + links[k + 1 :] for k in range(700, 760, 7)}
    rows = [(name, i, *r) for name, x in cases.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "chain string, id long, prev_hash string, hash string, payload string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = {r[0]: tuple(r)[1:] for r in governance.verify_chain(df, "chain", "id").collect()}
        parts = {r["chain"]: r["n"] for r in governance._segments(df.filter("chain = 'whole'"), "chain", "id").groupBy("chain").agg(F.count("part").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {name: (len(x), *plain_break(x)) for name, x in cases.items()}
    assert parts["whole"] > 8
    assert governance.verify_chain(df.limit(0), "chain", "id").count() == 0
