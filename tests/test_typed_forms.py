import glob

from careledger import queries

SF = "/root/testdata/sf0.001"


def test_json_is_written_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_path", lambda spark, what: str(tmp_path / what))
    rows = {r.name: (r.rows, r.unshared) for r in queries.QUERIES["read_typed_tables"](spark, SF).collect()}
    assert set(rows) == {"encounter", "medication", "session", "audit"} and all(n > 0 and not m for n, m in rows.values())
    parts = glob.glob(f"{tmp_path}/typed/*.json/part-*")
    assert parts and all(p.endswith(".json.gz") for p in parts)
