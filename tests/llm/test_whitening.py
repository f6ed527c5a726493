"""Whitening against a dense eigendecomposition, and rank-one updates against it."""

import numpy as np
import pytest

from careledger.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def compare(vectors, found, components=32):
    """``vectors``: id and clean vector; ``found``: the rows of the operator."""
    x = np.array([np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for _, v in vectors])
    n, total = len(x), x.sum(axis=0)
    y = (n * x - total) / n
    values, q = np.linalg.eigh(y.T @ y / n)
    values, q = values[::-1], q[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    deviation = [sum(int(e) ** 2 for e in n * r - total) for r in x]
    assert len(found) == n * k and {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] <= 1e-9
    key = lambda z: (z[0] is None, z[0], z[1])
    assert sorted(((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1), key=key) == sorted(((i, d) for (i, _), d in zip(vectors, deviation, strict=True)), key=key)
    for c in range(k):
        rows = [r for r in found if r["component"] == c + 1]
        assert rows[0]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        want = y @ q[:, c] / np.sqrt(values[c])
        got = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (r["deviation"], r["whitened"]))])
        close = lambda w: np.allclose(got, np.array([b for _, b in sorted(zip(deviation, w, strict=True))]), atol=1e-6)  # noqa: B023, E731
        assert close(want) or close(-want)


def test_given_embeddings(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(vectors, queries.op12_whitening(spark, SF).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    clean = [(i, [float(x) for x in rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]]) for i in range(60)]
    clean += [clean[0], clean[0], (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    odd = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (93, [float("nan")] * 6), (94, [float("inf")] + [0.0] * 5), (95, [1.0, 2.0]), (96, [1e300] + [0.0] * 5)]
    frame = lambda rows: spark.createDataFrame([(i, v, 0, "w") for i, v in rows], "vec_id long, embedding array<double>, component int, v string").repartition(5)
    compare(clean, whitening.whiten(frame(clean + odd)).collect())
    compare(clean, whitening.whiten(frame(clean), components=2).collect(), 2)
    assert whitening.whiten(frame(odd)).filter("vec_id <> 95").count() == 0
    assert whitening.whiten(frame([])).count() == whitening.whiten(frame(clean[:1] * 3)).count() == 0


def test_directions_without_variance_are_not_numbered(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 8)) * 4
    rows = [(i, [float(x) for x in base[i % 3]]) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in found} == {1, 2}


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e7])
def test_rank_one_updates(scale):
    rng = np.random.default_rng(4)
    for rows in (rng.normal(size=(200, 12)) * np.linspace(0, 3, 12), np.repeat(rng.normal(size=(3, 12)), 30, axis=0), np.eye(12)[rng.integers(0, 12, 60)], np.zeros((3, 12)), rng.normal(size=(50, 1))):
        rows = rows * scale * 10.0 ** rng.integers(-3, 3, (len(rows), 1))
        d = rows.shape[1]
        values, q = whitening._apply(np.zeros(d), np.eye(d), rows)
        want = rows.T @ rows
        assert np.abs(q * values @ q.T - want).max() <= 1e-13 * max(want.max(), 1e-300) and np.abs(q.T @ q - np.eye(d)).max() < 1e-12
        assert (np.diff(values) >= 0).all()


def test_spectra_of_many_partitions_are_combined(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 4)) * [4, 3, 2, 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(70)
    v = whitening.usable(df, "vec_id", "embedding")
    n, total = whitening._sums(v, 4)
    values, q = whitening._combine(whitening._spectra(v, total, n), 4)
    x = np.array([np.floor(64 * np.array(r)) for _, r in rows])
    y = x - x.mean(axis=0)
    assert np.allclose(q * values @ q.T, y.T @ y)
