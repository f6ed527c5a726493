from pyspark.sql import functions as F

from careledger import governance


def _trail(spark, encounters, audit):
    e = spark.createDataFrame(encounters, "encounter_id long, consent_ref string")
    a = spark.createDataFrame(audit, "id long, consent_ref string, ts long, action string")
    return governance.encounter_audit_trail(e, a)


def test_a_trail_keeps_its_order(spark):
    audit = [(1, "a", 5, "x"), (2, "a", 3, "y"), (3, "b", 4, "z"), (4, None, 1, "n"), (5, "c", 1, "c")]
    found = _trail(spark, [(1, "a"), (2, "a"), (3, None), (4, "b"), (4, "a"), (None, "a"), (None, "b"), (6, "none")], audit).collect()
    of = lambda k: sorted((r.place, r.id, r.action) for r in found if r.encounter_id == k)
    assert of(1) == of(2) == [(1, 2, "y"), (2, 1, "x")]
    assert of(4) == of(None) == [(1, 2, "y"), (2, 3, "z"), (3, 1, "x")]
    assert len(found) == 10


def test_pairs_of_a_trail_are_not_shuffled(spark):
    """Visits and audit rows of a consent are many; only they, not their pairs, may meet an exchange."""
    n = 400
    found = _trail(spark, [(k, "a") for k in range(n)], [(k, "a", -k, "x") for k in range(n)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line]
    first = plan.splitlines().index(joined[0])
    assert not any("Window" in line for line in plan.splitlines()[:first])
    assert found.agg(F.count(F.lit(1)), F.sum("place"), F.max("place")).first() == (n * n, n * n * (n + 1) // 2, n)


def test_rows_of_a_trail_are_sent_once(spark):
    """a consent of many visits and rows, one with more visits than rows, and many small ones; no side is sent to all parts, whatever its length."""
    visits = spark.range(3000).selectExpr("id AS encounter_id", "CASE WHEN id < 2000 THEN 'a' WHEN id < 2900 THEN 'b' ELSE CAST(id AS STRING) END AS consent_ref")
    audit = spark.range(2400).selectExpr("id * 7919 AS id", "CASE WHEN id < 2000 THEN 'a' WHEN id < 2200 THEN 'b' ELSE CAST(id + 700 AS STRING) END AS consent_ref", "id % 9 AS ts", "CAST(id % 5 AS STRING) AS action")
    sc = spark.sparkContext
    listed = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = lambda: (lambda x: [x.apply(k) for k in range(x.size())])(listed())
    of = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    before = {s.stageId() for s in stages()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = of(governance.encounter_audit_trail(visits, audit))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert 0 < sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before) < 40_000
    place = F.expr("row_number() OVER (PARTITION BY encounter_id ORDER BY ts, id)").cast("long")
    assert found == of(visits.join(audit, "consent_ref").select("encounter_id", "id", "action", place.alias("place")))
