"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Paths of a random forest's trees become conjunctive rules; a lasso logistic regression weighs them, and the rules that
keep a weight are compiled into one Spark column expression. Scoring is a narrow projection without Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.llm.labelled import labelled_texts, sample_labels
from careledger.llm.storage import materialize

#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.0005
FEATURES = ["upper", "symbol", "bang", "digit", "stop", "space", "word_length", "distinct_words", "distinct_lines", "log_words", "lone", "line_length"]


def statistics(text: Column) -> dict[str, Column]:
    """The features of a text as column expressions; all are numbers for an empty text, too."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words, lines = F.split(t, "[ \\n]+"), F.split(t, "\\n")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    return {
        "upper": F.regexp_count(t, F.lit("\\p{Lu}")) / n,
        "symbol": without("#$%&*|<>{}[]~^=_@+\\/"),
        "bang": without("!?"),
        "digit": without("0123456789"),
        "stop": without(".,;:"),
        "space": without(" \n\t\r"),
        "word_length": n / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "log_words": F.log1p(n_words),
        "lone": F.size(F.filter(words, lambda w: F.length(w) <= 1)) / n_words,
        "line_length": F.log1p(n / n_lines),
    }


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (feature, is at most, threshold) hold."""

    tests: tuple[tuple[int, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for k, at_most, value in self.tests:
            out = out & ((F.col(FEATURES[k]) <= value) if at_most else (F.col(FEATURES[k]) > value))
        return out


def tree_rules(debug: str) -> list[Rule]:
    """The conjunction of every path from the root of a tree, as Spark prints it, to an inner node or leaf."""
    found, path = [], []
    for line in debug.split("\n"):
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(m[3]), m[4] == "<=", float(m[5])))]
        found.append(Rule(tuple(sorted(p[1] for p in path))))
    return found


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1, over the columns FEATURES."""
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on a sample of the labels for which ``where`` holds. Without any, the score is 0.5; with one label only it is a constant on that label's side."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    sampled = materialize(sample_labels(labels, "quality", sample, where), "quality-labels")
    stats = labelled_texts(docs, sampled).select("doc_id", F.col("label").cast("double").alias("label"), *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    data = materialize(stats, "quality-statistics").repartition(8, "doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    have = {r[0]: r[1] for r in data.groupBy("label").count().collect()}
    if len(have) < 2:
        return RuleEnsemble(math.log((have.get(1.0, 0) + 1) / (have.get(0.0, 0) + 1)), [])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data).select("label", "features", *FEATURES)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, seed=3, featureSubsetStrategy="0.5").fit(vectors)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString)))
    if not rules:
        share = have[1.0] / sum(have.values())
        return RuleEnsemble(math.log(share / (1 - share)), [])
    held = materialize(data.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features")), "quality-rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(held)
    return RuleEnsemble(lasso.intercept, [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w])


def held_out(id_col: str = "doc_id") -> Column:
    """True for a fifth of the ids: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= 0.3).

    Labels of held-out ids are never learnt; labels that are null or not 0 or 1 are left out. A null text counts as empty and has a
    score like any other; a null id is not held out. An empty table gives no rows; other columns are no inputs.
    """
    model = fit(docs, labels, ~held_out("doc_id"))
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in statistics(F.col(text_col)).items()])
    scored = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
