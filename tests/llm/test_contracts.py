"""The queries' results against brute force, and row-keeping stages on tables whose columns have the names that operators use themselves."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from careledger.llm import exact, mixing, ngram_join, packing, quality, queries, sharding, toxicity, warc
from careledger.llm.storage import shared_dir

CLASHES = ["_id", "_rank", "_sha", "_cell", "_chars", "_again", "_source", "_size", "_nth", "_copy", "rid", "row", "gid", "digits", "cell", "lane", "rank", "shard0", "class_id", "copies", "node", "n", "up", "h"]


def words(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(0, 4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i % 7 if i % 5 else None, words(i % 12), "ab"[i % 2]) for i in range(40)] + [(1, None, None), (1, "", None), (None, words(99, 20_000), "a")]
    return spark.createDataFrame([(*r, *[f"{c}{k % 3}" for c in CLASHES]) for k, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))


def whole(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("stage", [exact.keep_first_copies, ngram_join.keep_one_per_class, mixing.repeat_rows], ids=lambda f: f.__name__)
def test_stages_keep_rows_as_they_are(clashing, stage):
    found = stage(clashing)
    assert found.schema == clashing.schema
    assert set(whole(found)) <= set(whole(clashing))


def test_sharding_and_toxicity_keep_rows_as_they_are(spark, clashing):
    placed = sharding.bounded_ring_shards(clashing, "doc_id", 4)
    assert whole(placed.drop("shard", "slot")) == whole(clashing)
    model = toxicity.OrdinalModel({"w1": 1.0}, [4.0, 8.0])
    assert whole(toxicity.drop_toxic(clashing, model)) == whole(clashing)


def test_rows_that_share_an_id_do_not_swap(clashing):
    again = clashing.repartition(5)
    for f in (mixing.repeat_rows, lambda df: sharding.bounded_ring_shards(df, "doc_id", 4)):
        assert whole(f(clashing)) == whole(f(again))


def test_shards_of_one_hot_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "id AS v")
    by = defaultdict(list)
    for r in sharding.bounded_ring_shards(df, "doc_id", 7).collect():
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and {len(s) for s in by.values()} <= {428, 429}


def test_one_more_shard_moves_little(spark):
    df = spark.range(60_000).withColumnRenamed("id", "doc_id")
    a, b = (sharding.bounded_ring_shards(df, "doc_id", n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (16, 17))
    assert a.join(b, "doc_id").filter("s16 <> s17").count() < 2.5 * 60_000 / 17


def test_op1_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op1_ring_sharding(spark, sf).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    count = Counter(r.shard for r in found)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1


@pytest.fixture(scope="module")
def tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def test_op8_against_the_tokenizer(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows, seen, place = queries.op8_packing(spark, sf).collect(), defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        place[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(seen[i], len(x)) for i, x in ids.items()] + [(place[s], 1024 if s < max(place) else None) for s in place]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert total is None or at == total


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aAbé 1\n\t'’<|>_-·日本🙂́", max_size=60))
def test_ids_are_those_of_the_tokenizer(tokenizer, text):
    assert packing._encoder(packing.default_tokenizer()).encode(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    walk = grid[np.argsort(packing.hilbert_keys(grid, 4))]
    assert sorted(packing.hilbert_keys(grid, 4)) == list(range(256))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_archives_of_odd_pages(spark, tmp_path):
    schema = "page_id long, url string, html string, digest string, offset long"
    big = "<p>" + "é" * 3_000_000
    rows = [(None, None, None, "d", 1), (None, "u", big, "d", 1), (5, "u", big, None, 2), (5, "u", big, None, 2), (6, "v", big, "d", 3), (7, "w", "", "d", 4)]
    found = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_round_trip(spark.createDataFrame(rows, schema)).collect())
    assert found == Counter([(None, "response", None, 0), (None, "response", None, 6_000_003), (5, "response", None, 6_000_003), (5, "response", None, 6_000_003), (6, "revisit", 5, 6_000_003), (7, "response", None, 0)])
    assert warc.archive_round_trip(spark.createDataFrame([], schema)).count() == 0
    index = warc.write_warc(warc.plan_records(spark.createDataFrame(rows, schema)), str(tmp_path / "w"))
    assert [r.page_id for r in warc.read_warc(index.filter("page_id = 6"), str(tmp_path / "w")).collect()] == [6]


def test_rules_score_as_written_out(spark):
    texts = [None, "", "A b. c", words(1), "!!! $$$ 111", "x\n\nx\nx"]
    model = quality.RuleEnsemble(0.3, [(quality.Rule(((2, False, 0.1), (3, True, 0.2))), 1.5), (quality.Rule(((9, True, 1.2),)), -0.7)])
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in df.select(*[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).select(model.score()).collect()]
    for t, s in zip(texts, found, strict=True):
        t = t or ""
        n = max(len(t), 1)
        bang, digit = sum(c in "!?" for c in t) / n, sum(c.isdigit() for c in t) / n
        logit = 0.3 + 1.5 * (bang > 0.1 and digit <= 0.2) - 0.7 * (math.log1p(len(re.split(r"[ \n]+", t))) <= 1.2)
        assert abs(s - 1 / (1 + math.exp(-logit))) < 1e-12


def test_no_labels_mean_no_verdict(spark, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(clashing.withColumn("doc_id", F.monotonically_increasing_id()), labels).collect()} == {0.5}
    assert toxicity.drop_toxic(clashing, toxicity.fit(clashing, labels)).count() == clashing.count()


def test_severity_against_brute_force(spark):
    model = toxicity.OrdinalModel({"vile": 2.0, "slur": 1.0, "slur-": 0.5, "kind": -1.0}, [1.0, 2.5], 0.4)
    texts = [None, "", "Vile vile slurs", "kind words", "slurry vile " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(df, model).collect():
        counts = Counter(f for w in re.findall(r"\w+", (texts[r.doc_id] or "").lower()) for f in (w, w[:4] + "-" if len(w) > 4 else None, w[:5] + "-" if len(w) > 5 else None) if f)
        logit = sum(model.weights.get(f, 0) * math.log1p(n) for f, n in counts.items())
        p = [1 / (1 + math.exp(-max(-40, min(40, logit - t)))) for t in model.thresholds]
        assert abs(r.severity - sum(p)) < 1e-9 and abs(r.p_toxic - p[0]) < 1e-9 and r.grade == sum(x >= 0.5 for x in p) and r.toxic == (p[0] >= 0.4)


def test_candidates_share_a_band(spark):
    """Links are those pairs of the full sets that share a band, whatever the size of their buckets."""
    base = words(5, 120).split()
    rows = [(i, " ".join(base[: i % 30] + [f"x{i}"] + base[i % 30 + 1 :])) for i in range(90)] + [(200 + i, words(300 + i // 2, 30) + f" e{i % 2}") for i in range(20)]
    sets = {i: ngram_join.shingles(t) for i, t in rows}
    bands, per = ngram_join.bands_and_rows(0.8)
    sig = {i: ngram_join.band_hashes(x, bands, per) for i, x in sets.items()}
    want = Counter()
    for i, a in sets.items():
        want[i] = sum(1 for j, b in sets.items() if i != j and (sig[i] == sig[j]).any() and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)))
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in found} == dict(want)


def test_intermediates_need_a_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
