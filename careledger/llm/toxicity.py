"""Toxicity: severity grades by cumulative-link ordinal regression on sparse text features.

Features are words and their first four and five letters. Their counts by label over the labelled sample choose the
most telling ones; one weight per feature is shared by all thresholds: P(grade > k) = sigmoid(w.x - t_k).
The expected severity is the sum of these over k. A text is toxic from the P(grade > 0) on that errs least on the sample, one half at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.labelled import labelled_texts, sample_labels
from careledger.llm.storage import bounded_batches, discard, materialize, tidy

#: Most labelled rows that the model is fitted on, and most features that it weighs.
SAMPLE, MOST_FEATURES = 20_000, 2_000
LEAST_DOCS, RIDGE, LASSO, ROUNDS = 3, 1e-5, 2e-5, 1500
WORD = re.compile(r"\w+")
#: Words whose features a task remembers, and counts that it holds before it passes them on.
REMEMBERED, HELD = 1 << 17, 200_000


def features_of(word: str) -> tuple[str, ...]:
    """A word's features; a prefix stands for the family of words that share it."""
    return (word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class OrdinalModel:
    """weights by feature; thresholds ascending, one per step between grades."""

    weights: dict[str, float]
    thresholds: list[float]
    #: P(grade > 0) from which on a text is toxic.
    toxic_from: float = 0.5

    def logit(self, counts: dict[str, int]) -> float:
        return sum(self.weights[f] * np.log1p(n) for f, n in counts.items())

    def exceed(self, logit: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(-np.clip(logit[:, None] - np.array(self.thresholds)[None, :], -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model, by accelerated proximal gradient on a sparse matrix in coordinates."""
    n = len(grade)
    above = (grade[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    cut = np.log((1 - share) / share)
    start, w = cut.copy(), np.zeros(n_features)
    # The loss is smooth with at most a quarter of the mean squared length of a row, for each threshold.
    step = 4.0 / ((values**2).sum() / n + 1) / max(1, n_grades - 1)
    pull, (yw, yt), momentum = 0.02, (w.copy(), cut.copy()), 1.0
    for _ in range(ROUNDS):
        logit = np.bincount(rows, yw[cols] * values, minlength=n)
        error = 1 / (1 + np.exp(-np.clip(logit[:, None] - yt[None, :], -40, 40))) - above
        to_w = np.bincount(cols, error.sum(axis=1)[rows] * values, minlength=n_features) / n + RIDGE * yw
        to_t = -error.mean(axis=0) + RIDGE * pull * (yt - start)
        next_w = yw - step * to_w
        next_w = np.sign(next_w) * np.maximum(0, np.abs(next_w) - step * LASSO)
        next_t = np.sort(yt - step * to_t)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        yw, yt = next_w + (momentum - 1) / following * (next_w - w), next_t + (momentum - 1) / following * (next_t - cut)
        w, cut, momentum = next_w, next_t, following
    return w, cut


def least_errors(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability, one half at most, from which on calling rows toxic errs least; of several, the middle of the widest gap."""
    order = np.argsort(p)
    p, toxic = p[order], toxic[order]
    edges = np.concatenate([[0.0], p, [1.0]])
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(~toxic[::-1])[::-1], [0]])
    logit = np.log(np.clip(edges, 1e-9, 1 - 1e-9) / (1 - np.clip(edges, 1e-9, 1 - 1e-9)))
    gap = np.where(errors == errors.min(), logit[1:] - logit[:-1], -1)
    k = int(np.argmax(gap))
    return min(0.5, float(1 / (1 + np.exp(-(logit[k] + logit[k + 1]) / 2))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "toxic") -> OrdinalModel:
    """Fit on a sample of the labels. Without toxic ones the model holds nothing toxic.

    Labels say toxic or not. Among toxic texts the half that holds more of the telling words is graded 2, the rest 1.
    """
    bounded_batches(docs.sparkSession)
    sampled = materialize(sample_labels(labels, label_col, sample), "toxicity-labels")
    texts = materialize(labelled_texts(docs, sampled).select("label", "text"), "toxicity-texts")
    sizes = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        discard(sampled, texts)
        return OrdinalModel({}, [4.0, 8.0])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                by[label].update({f for w in set(words_of(text)) for f in features_of(w)})
            if len(by[0]) + len(by[1]) > HELD:
                yield pd.DataFrame([(f, by[1][f], by[0][f]) for f in by[0].keys() | by[1].keys()], columns=["f", "pos", "neg"])
                by[0].clear(), by[1].clear()
        yield pd.DataFrame([(f, by[1][f], by[0][f]) for f in by[0].keys() | by[1].keys()], columns=["f", "pos", "neg"])

    counts = texts.mapInPandas(tidy(count), "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (sizes[1] + 1)) - F.log((F.col("neg") + 0.5) / (sizes[0] + 1))
    telling = counts.filter(F.col("pos") + F.col("neg") >= LEAST_DOCS).withColumn("z", odds * F.sqrt(F.when(odds > 0, F.col("pos")).otherwise(F.col("neg"))))
    chosen = telling.orderBy(F.desc(F.abs("z")), "f").limit(MOST_FEATURES).collect()
    index = {r["f"]: i for i, r in enumerate(chosen)}
    strong = {r["f"] for r in chosen if r["neg"] == 0 and r["z"] > 5}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(f for w in words_of(t) for f in features_of(w) if f in index) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "cols": [[index[f] for f in c] for c in found], "n": [list(c.values()) for c in found], "hits": [sum(n for f, n in c.items() if f in strong) for c in found]})

    data = texts.mapInPandas(tidy(encode), "label int, cols array<int>, n array<int>, hits long").toPandas()
    discard(sampled, texts)
    lengths = data["cols"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(data)), lengths)
    cols, values = (np.concatenate([np.asarray(x, float) for x in data[c]] or [np.empty(0)]) for c in ("cols", "n"))
    toxic = data["label"].to_numpy() == 1
    hits = data["hits"].to_numpy()
    grade = toxic.astype(int) + (toxic & (hits > np.median(hits[toxic])))
    w, cut = fit_ordinal(rows, cols.astype(int), np.log1p(values), grade, len(index), 3)
    model = OrdinalModel({f: float(w[i]) for f, i in index.items() if w[i]}, [float(t) for t in cut])
    p = model.exceed(np.bincount(rows, w[cols.astype(int)] * np.log1p(values), minlength=len(data)))[:, 0]
    model.toxic_from = least_errors(p, toxic)
    return model


def _judge(model: OrdinalModel, texts, known: dict[str, tuple[str, ...]]) -> np.ndarray:
    """P(grade > k) of each text and k; ``known`` remembers the weighed features of words."""
    logits = []
    for text in texts:
        counts: Counter = Counter()
        for w in words_of(text):
            found = known.get(w)
            if found is None:
                if len(known) > REMEMBERED:
                    known.clear()
                found = known[w] = tuple(f for f in features_of(w) if f in model.weights)
            for f in found:
                counts[f] += 1
        logits.append(model.logit(counts))
    return model.exceed(np.array(logits, float))


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, severity (expected grade), p_toxic, grade (the likeliest by the thresholds), toxic.

    Whole texts are read, however long; a null or empty text has no features and the scores of the intercepts alone. Equal texts score alike, and
    repeated rows and null ids are rows like others. An empty table gives no rows; other columns are ignored. Narrow: one pass, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, {}
        for batch in batches:
            p = _judge(model, batch["text"], known)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "severity": p.sum(axis=1), "p_toxic": p[:, 0], "grade": (p >= 0.5).sum(axis=1).astype("int32"), "toxic": p[:, 0] >= model.toxic_from})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(tidy(score), f"doc_id {id_type}, severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns as they are; each row is judged by its own whole text.

    A null or empty text is judged by the intercepts alone; repeated rows stay or go together; columns may have any names. Batches of
    rows are filtered as they come, bounded in bytes. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            p = _judge(model, (x.as_py() for x in batch.column(at)), known)
            yield batch.filter(pa.array(p[:, 0] < model.toxic_from))

    return docs.mapInArrow(tidy(clean), docs.schema)
