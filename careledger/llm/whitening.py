"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the spectrum (eigenvalues and eigenvectors) of the scatter of its centred rows and changes it by rank-one updates: an
update solves the secular equation for the new eigenvalues, after deflation of those that don't move. Rows of a block are first
rotated to at most as many rows as there are dimensions, with the same scatter, so that the updates' cost a row is bounded by that of
a product with a matrix. Spectra are combined in a tree, each by the rank-one updates of its scaled eigenvectors. Rounding that has
piled up goes in a last Rayleigh-Ritz step over all rows in the basis found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.storage import bounded_batches, discard, materialize, tidy

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
#: Spectra combined in one step of the tree.
FAN_IN = 8
#: Rows of a block, as a multiple of the dimensions, that are rotated together before they are applied.
BLOCK = 16
_EPS = np.finfo(float).eps
#: Entries above it are no longer whole numbers after scaling.
_LARGEST = float(1 << 52)
#: Rows of a batch that are projected at once.
_ROWS = 2048


def _secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) for rising poles d and positive z2: the pole next to each root, and the root's distance from it.

    Root j lies between d[j] and d[j + 1], the last one within sum(z2) of the last pole. Each step takes the root of a model with the two
    poles around it that agrees in value and slopes, or halves the bracket where that falls outside.
    """
    k = len(d)
    gap = np.append(np.diff(d), z2.sum())
    upper = np.append(d[1:], d[-1] + gap[-1])
    middle = (d + gap / 2)[:, None]
    right = (1 + (z2 / (d - middle)).sum(axis=1) < 0) & (np.arange(k) < k - 1)
    near = np.arange(k) + right
    poles = d[None, :] - d[near][:, None]  # seen from the near pole of each root
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(k) < k - 1, gap / 2, gap))
    left_pole, right_pole = d - d[near], upper - d[near]
    below = np.tri(k, dtype=bool)  # poles at or below root j
    t = (low + high) / 2
    with np.errstate(all="ignore"):
        for _ in range(120):
            away = poles - t[:, None]
            terms = z2 / away
            f = 1 + terms.sum(axis=1)
            low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
            settled = np.abs(f) <= _EPS * k * (1 + np.abs(terms).sum(axis=1))
            if (settled | (high - low <= 2 * _EPS * np.abs(t))).all():
                break
            slopes = terms / away
            lower = np.where(below, slopes, 0).sum(axis=1)
            higher = slopes.sum(axis=1) - lower
            p, q = left_pole - t, right_pole - t
            c = f - p * lower - q * higher
            a = (p + q) * f - p * q * (lower + higher)
            b = p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = t + step
            t = np.where(settled, t, np.where((new > low) & (new < high), new, (low + high) / 2))
    return near, t


def rank_one_update(values: np.ndarray, vectors: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of vectors @ diag(values) @ vectors.T + y @ y.T; values rise.

    Deflation: equal eigenvalues are rotated so that only one of them meets y, and an eigenpair that y doesn't meet stays as it is.
    """
    z = vectors.T @ y
    size = z @ z
    if size == 0:
        return values, vectors
    tol = 8 * _EPS * max(abs(values[-1]), size)
    vectors = vectors.copy()
    cuts = np.flatnonzero(np.diff(values) > tol) + 1
    for begin, end in zip([0, *cuts], [*cuts, len(values)], strict=True):
        if end - begin > 1:
            part = z[begin:end].copy()
            norm = np.linalg.norm(part)
            if norm > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(norm, part[-1])
                mirror /= np.linalg.norm(mirror)
                vectors[:, begin:end] -= 2 * np.outer(vectors[:, begin:end] @ mirror, mirror)
                z[begin:end] = 0
                z[end - 1] = -np.copysign(norm, part[-1])
    moves = np.abs(z) * np.sqrt(size) > tol
    if not moves.any():
        return values, vectors
    d, zm = values[moves], z[moves]
    near, t = _secular(d, zm * zm)
    away = (d[:, None] - d[near][None, :]) - t[None, :]  # pole i less root j
    between = d[:, None] - d[None, :]
    np.fill_diagonal(between, 1.0)
    # The z of which the computed roots are the exact ones keeps eigenvectors orthogonal.
    zm = np.copysign(np.sqrt(np.abs(np.prod(away / between, axis=1))), zm)
    turn = zm[:, None] / away
    turn /= np.linalg.norm(turn, axis=0)
    values = values.copy()
    values[moves] = d[near] + t
    vectors[:, moves] = vectors[:, moves] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _apply(values: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for y in rows:
        values, vectors = rank_one_update(values, vectors, y)
    return values, vectors


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _whole(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def _centred(column: pa.Array, total: np.ndarray, n: int) -> np.ndarray:
    """x - S / n, from the exact numerator."""
    return (n * _whole(_matrix(column, len(total))) - total) / n


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows whose vector is there, is not empty and holds finite entries only."""
    entry_ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < _LARGEST)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", entry_ok))


def _sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """n and the exact sums S; one number per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, np.int64), 0
        for batch in batches:
            total += _whole(_matrix(batch.column(0), d)).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total), pa.array(np.full(d, n))], ["dim", "s", "n"])

    found = rows.select("v").mapInArrow(tidy(add), "dim int, s bigint, n bigint").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    by = {r["dim"]: r for r in found}
    return (by[0]["n"], np.array([by[k]["s"] for k in range(d)], np.int64)) if by else (0, np.zeros(d, np.int64))


def _outer_sums(rows: DataFrame, turn: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the centred rows times ``turn``, itself centred; as many numbers as it has entries reach the driver."""
    d, k = turn.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, mean, some = np.zeros((k, k)), np.zeros(k), False
        for batch in batches:
            w = _centred(batch.column(0), total, n) @ turn
            outer += w.T @ w
            mean += w.sum(axis=0)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(np.column_stack([outer, mean])), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select("v").mapInArrow(tidy(add), "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("s")).collect()
    found = np.zeros((k, k + 1))
    for r in sums:
        found[r["i"], r["pos"]] = r["s"] / n
    return found[:, :k] - np.outer(found[:, k], found[:, k])


def _spectra(rows: DataFrame, total: np.ndarray, n: int) -> DataFrame:
    """part, values, vectors of each partition: the spectrum of the scatter of its centred rows."""
    d = len(total)

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        values, vectors, waiting, some = np.zeros(d), np.eye(d), np.empty((0, d)), False
        for batch in batches:
            waiting = np.concatenate([waiting, _centred(batch.column(0), total, n)])
            some = True
            while len(waiting) >= BLOCK * d:
                values, vectors = _apply(values, vectors, np.linalg.qr(waiting[: BLOCK * d], mode="r"))
                waiting = waiting[BLOCK * d :]
        if some:
            values, vectors = _apply(values, vectors, np.linalg.qr(waiting, mode="r") if len(waiting) else waiting)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([values]), pa.array([vectors.ravel()])], ["part", "values", "vectors"])

    return rows.select("v").mapInArrow(tidy(decompose), "part bigint, values array<double>, vectors array<double>")


def _combine(spectra: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """One spectrum out of many: groups of FAN_IN at each level of a tree, every level written in the shared folder."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        values, vectors = group["values"].iloc[0], group["vectors"].iloc[0].reshape(d, d)
        for more, turned in zip(group["values"].iloc[1:], group["vectors"].iloc[1:], strict=True):
            # The largest come first, so that later updates are small against what is there.
            scaled = (np.sqrt(np.maximum(more, 0)) * turned.reshape(d, d)).T[::-1]
            values, vectors = _apply(np.asarray(values), vectors, scaled)
        return pd.DataFrame({"part": [group["part"].iloc[0] // FAN_IN], "values": [values], "vectors": [vectors.ravel()]})

    now = materialize(spectra, "white-spectra")
    most = now.agg(F.max("part")).first()[0]
    while most > 0:
        after = materialize(now.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, now.schema), "white-spectra")
        discard(now)
        now, most = after, most // FAN_IN
    only = now.first()
    discard(now)
    return np.array(only["values"]), np.array(only["vectors"]).reshape(d, d)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> dict | None:
    """Mean, eigenvalues and whitening directions of ``rows`` (v of ``d`` entries); None without rows."""
    n, total = _sums(rows, d)
    if not n:
        return None
    values, vectors = _combine(_spectra(rows, total, n), d)
    basis, _ = np.linalg.qr(vectors[:, ::-1])
    # Rayleigh-Ritz: the covariance in the basis found is all but diagonal; its eigenvectors turn the basis into place.
    small = _outer_sums(rows, basis, total, n)
    ritz, turn = np.linalg.eigh((small + small.T) / 2)
    ritz, vectors = ritz[::-1], basis @ turn[:, ::-1]
    some = ritz > 64 * _EPS * d * max(ritz[0], 0)
    kept = min(components, int(some.sum()))
    vectors = vectors * np.copysign(1, vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    turn = vectors[:, :kept] / np.sqrt(ritz[:kept])
    error = float(np.abs(_outer_sums(rows, turn, total, n) - np.eye(kept)).max()) if kept else 0.0
    return {"n": n, "total": total, "eigenvalues": ritz, "vectors": vectors, "turn": turn, "explained": ritz[:kept] / ritz.sum() if kept else ritz[:0], "identity_error": error}


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and each of the first ``components``.

    Entries become x = floor(64 c) + 1000000. Rows whose vector is null, empty, holds a null, a non-finite entry or one of 2^46 or more, or hasn't the
    most common number of entries (ties: the larger) take no part. Repeated rows count as often as they occur; null ids are kept. Directions in which
    the rows don't vary have no unit variance to be scaled to and are not numbered; so a single row, or equal rows, give no rows at
    all, and neither does an empty table. A ``deviation`` beyond a long is an error. Other columns are ignored, whatever their names.
    """
    bounded_batches(df.sparkSession)
    schema = f"vec_id {df.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = usable(df, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not common:
        return df.sparkSession.createDataFrame([], schema)
    d = common["d"]
    rows = rows.filter(F.size("v") == d)
    found = fit(rows, d, components)
    n, total, turn = found["n"], found["total"], found["turn"]
    kept = turn.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if kept else 0, _ROWS):
                batch = whole.slice(at, _ROWS)
                m = batch.num_rows
                off = n * _whole(_matrix(batch.column(1), d)) - total
                # Squares are added in longs where none can overflow, else in whole numbers of any size.
                off_ = off if np.abs(off).max() < np.sqrt(float(1 << 62) / d) else off.astype(object)
                deviation = pa.array((off_ * off_).sum(axis=1).tolist(), pa.int64())
                each = pa.array(np.repeat(np.arange(m), kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(each), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)), deviation.take(each),
                        pa.array((off / n @ turn).ravel()), pa.array(np.tile(found["explained"], m)), pa.array(np.full(m * kept, found["identity_error"])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "v").mapInArrow(tidy(project), schema)
