"""Periodic runs against brute force over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from careledger.llm import queries, runs

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in out.items())


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, q, length in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, q, length in found), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, q, length in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def check(rows, found):
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)


def test_given_documents_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len((r[1] or "").split()) <= 1500]  # brute force is quadratic
    found = {r["doc_id"]: r for r in queries.op13_runs(spark, SF).collect()}
    assert len(found) == len(rows) and len(short) > 100
    check(short, [found[i] for i, _ in short])


def test_odd_rows(spark, tmp_path):
    block = "a b c d e f g h i j k l m"
    rows = [(1, None), (2, ""), (3, "\x0b \t"), (4, "x " * 11), (5, "x " * 12), (6, "a b " * 6), (7, f"{block} {block}"), (7, f"{block} {block}"), (None, "ab cd " * 9), (8, "É é " * 8), (9, "A a " * 6 + "A A " * 6), (10, "y " * 30)]
    rows += [(20 + k, "p q r " * 20 + "s " * k) for k in range(40)]
    docs = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, runs int, collapsed string")
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    check(rows, queries.op13_runs(spark, path).collect())
    docs.limit(0).write.parquet(f"{path}/none/documents.parquet")
    assert queries.op13_runs(spark, f"{path}/none").count() == 0
    by = {r["doc_id"]: r for r in runs.detect_runs(docs).collect()}
    assert by[5]["collapsed"] == "x" and by[4]["collapsed"] == " ".join(["x"] * 11) and by[7]["collapsed"] == block and by[1]["n_words"] == 0
    assert [tuple(r) for r in by[6]["runs"]] == [(0, 12, 2)]


def test_many_small_alphabets_match_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(150):
        texts = []
        for _ in range(4):
            n = int(rng.integers(0, 150))
            w = np.concatenate([np.resize(rng.integers(0, rng.integers(1, 4), rng.integers(1, 12)), rng.integers(1, 50)) for _ in range(4)])[:n]
            if len(w) and rng.random() < 0.5:
                w[rng.integers(0, len(w), 2)] = rng.integers(0, 3, 2)
            texts.append([b"abc"[x : x + 1] for x in w])
        count, found, kept = runs._search(texts, 12)
        got, at = [(r["start"], r["period"], r["length"]) for r in found.to_pylist()], 0
        for words, c in zip(texts, count, strict=True):
            assert got[at : at + c] == plain_runs(words)
            at += c


def test_a_long_text_of_two_words(spark):
    n = 200_000
    text = "a b " * n + "b " + "a b " * n
    row = runs.detect_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = [tuple(r) for r in row["runs"]]
    # Two tails of one letter each meet in the middle, so every odd period up to theirs has a run there.
    assert (0, 2 * n, 2) in found and (2 * n, 2 * n + 1, 2) in found and len(found) == n - 3 + 2


def test_shorter_runs_need_shorter_blocks():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(20, np.int64), 6)
