"""State that ends, and writes that can be repeated."""

import datetime

import pytest

from careledger import promotion, streams


def at(minutes):
    return datetime.datetime(2024, 3, 1) + datetime.timedelta(minutes=minutes)


def feed(spark, tmp_path, name, schema, parts, make):
    """Files that arrive one after another; the sink's rows and the number of keys in state after each."""
    source, counts, query = str(tmp_path / "in"), [], None
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if query is None:
            out = make(spark.readStream.schema(schema).parquet(source))
            query = out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).start()
        query.processAllAvailable()
        counts.append([p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["customMetrics"])
    query.stop()
    return spark.table(name).collect(), counts


def test_state_of_idle_questions_goes(spark, tmp_path):
    schema = "session_id int, question_id string, seq int, outcome string, ts timestamp"
    many = [(s, "q", 1, "answered" if s % 2 else "failed", at(s % 5)) for s in range(40)]
    parts = [many, [(0, "q", 2, "failed", at(100))], [(99, "q", 1, "heard", at(400))], [(98, "q", 1, "heard", at(401))], [(1, "q", 1, "heard", at(402))]]
    rows, _ = feed(spark, tmp_path, "touch", schema, parts, lambda df: streams.stream_touch_fallback(df, "1 minute", 60))
    held = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "at"))
    left = {r[0]["session_id"] for r in held.select("key").collect()}
    assert left == {99, 98, 1}  # of 43 keys
    last = {}
    for r in rows:
        last[r.session_id] = (r.presentations, r.mode)
    assert last[0] == (2, "touch") and last[3] == (1, "answered")
    assert last[1] == (1, "voice")  # asked anew after its state went


def test_state_of_idle_sessions_goes_and_ranks_only_rise(spark, tmp_path):
    schema = "session_id int, rank int, ts timestamp"
    parts = [[(s, s % 3, at(0)) for s in range(30)], [(1, 0, at(10)), (2, 1, at(20))], [(77, 1, at(500))], [(78, 1, at(501))]]
    rows, _ = feed(spark, tmp_path, "ranks", schema, parts, lambda df: streams.stream_priority(df, "1 minute", 60))
    assert [r["rank"] for r in rows if r.session_id == 1] == [1, 1] and [r["rank"] for r in rows if r.session_id == 2] == [2, 2]
    held = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "at"))
    assert {r[0]["session_id"] for r in held.select("key").collect()} == {77, 78}


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string"), spark.createDataFrame([(3, "a")], "id int, kind string")
    for df, batch in ((one, "p1"), (two, "p2"), (one.filter("id = 1"), "p1"), (one, "p1"), (two, "p2")):
        promotion.write_durable({"fact": df, "patient": df}, str(tmp_path), {"fact": "kind"}, batch)
        promotion.write_snapshots(df, str(tmp_path / "briefs"), batch, "2024-03-01 00:00:00")
    for name in ("fact", "patient", "briefs"):
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == [1, 2, 3]


def test_patients_are_merged_once_a_batch(spark, tmp_path):
    path, schema = str(tmp_path / "patients"), "abha_ref string, display_name string, gender string"
    first = spark.createDataFrame([("a", None, "male"), ("b", "B", None), (None, "guest", None)], schema)
    second = spark.createDataFrame([("a", "A", "female"), ("c", "C", None), (None, "guest 2", None)], schema)
    want = {("a", "A", "male"), ("b", "B", None), ("c", "C", None), (None, "guest", None), (None, "guest 2", None)}
    for _ in range(2):
        promotion.merge_patients(first, path, "x")
        found = promotion.merge_patients(second, path, "y").collect()
        assert len(found) == 5 and {tuple(r) for r in found} == want
    # An unfinished version doesn't count.
    second.write.parquet(f"{path}/version=00000002-z")
    (tmp_path / "patients" / "version=00000002-z" / "_SUCCESS").unlink()
    assert promotion.read_patients(spark, path).count() == 5
    assert promotion.merge_patients(first, path, "z").count() == 6  # the guest of the new batch is a new guest


def test_no_patients_yet(spark, tmp_path):
    assert promotion.read_patients(spark, str(tmp_path / "none")) is None


@pytest.fixture(autouse=True)
def _provider(spark):
    before = spark.conf.get(streams._PROVIDER)
    yield
    spark.conf.set(streams._PROVIDER, before)
