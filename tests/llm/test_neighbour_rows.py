import numpy as np
import pytest
from pyspark.sql import functions as F

from careledger.llm import ann


def test_candidates_grow_with_queries_not_with_blocks(spark, monkeypatch):
    """Of 128 blocks that a query reaches it has one list of six candidates per group of blocks."""
    made, search = [], ann._search

    def counted(*given):
        out = search(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    monkeypatch.setattr(ann, "_search", counted)
    x = np.random.default_rng(3).standard_normal((3000, 16))
    report = {}
    found = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, report=report).toPandas()
    assert report["leaves"] > 100 and max(made) <= 60 * 32 * 6
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, own in found.groupby("query_id"):
        score = unit @ unit[q]
        score[q] = -2
        hit += len(set(np.argsort(-score)[:5].tolist()) & set(own["vec_id"]))
        assert own["score"].to_numpy() == pytest.approx(score[own["vec_id"]])
    assert len(found) == 300 and hit >= 270


def test_best_keeps_every_row_up_to_the_last_id():
    rows = [(0.9, 1, "a"), (0.9, 0, "b"), (0.5, 2, "c"), (0.8, 1, "d"), (0.7, 1, "e"), (0.4, 3, "f")]
    kept, floor = ann._best(rows, 2)
    assert [r[2] for r in kept] == ["b", "a", "d", "c"] and floor == 0.5
    assert ann._best(rows[:2], 2)[1] == -np.inf
