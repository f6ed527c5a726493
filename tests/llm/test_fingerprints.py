"""SimHash components against brute force over all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from careledger.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_components(fps, bits=2):
    """Smallest index reachable from each of ``fps``."""
    fps = np.array(fps, np.uint64)
    root = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    while True:
        new = np.where(near, root[None, :], len(fps)).min(axis=1)
        if (new == root).all():
            return root
        root = new


def compare(rows, found):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True)), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want


def test_given_documents_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    compare(rows, queries.op11_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 400, 900)]
    rows = [(7, None), (3, ""), (9, " \x0b\t\r\n\x0c"), (4, "One"), (4, "one"), (5, "one two"), (None, "ONE TWO"), (6, "Élan ÉLAN élan x"), (8, "x" * 400_000), (11, " ".join(words) * 40), (2, "b a"), (2, "b a"), (None, "lone and null")]
    rows += [(100 + k, " ".join(words[:k] + ["new"] + words[k + 1 :])) for k in range(0, 900, 15)]
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, fp long, slot int, component_id string")
    compare(rows, simhash.simhash_components(docs).collect())
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 2])
def test_links_of_dense_fingerprints_match_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 62, 12)
    fps = {int(b) for b in base} | {int(base[k % 3] ^ (1 << int(x)) ^ (1 << int(y))) for k, (x, y) in enumerate(rng.integers(0, 63, (900, 2)))} | set(range(300))
    fps = sorted(fps)
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits).collect()]
    assert all((a ^ b).bit_count() <= bits * 64 for a, b in edges)
    at = {f: k for k, f in enumerate(fps)}
    up = simhash._roots(len(fps), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert (up == plain_components(fps, bits)).all()
    assert len(edges) <= 28 * len(fps)  # a forest per posting, not all pairs


def test_more_bits_have_no_bounded_postings(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).select(F.col("id").alias("fp")), 3)
