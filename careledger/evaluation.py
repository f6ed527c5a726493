"""Scoring of runs against gold scripts, with index-style percentiles that need no sort of all rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["hallucination_rate", "flag_sensitivity", "script_recall", "priority_accuracy", "extraction_accuracy", "mean_completeness"]


def score_slots(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per script the expected and matched paths, and the mismatched ones: one value must be equal, several must be a subset."""
    both = expected.join(actual, ["script_id", "path"], "left")
    one, sub = F.col("actual_values") == F.col("expected_values"), F.size(F.array_except("expected_values", "actual_values")) == 0
    rows = both.withColumn("ok", F.coalesce(F.when(F.size("expected_values") == 1, one).otherwise(sub), F.lit(False)))
    wrong = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("path")))), ",")
    return rows.groupBy("script_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if("ok").alias("matched"), wrong.alias("mismatches"))


def score_flags(scripts: DataFrame) -> DataFrame:
    """Expected flags that didn't fire and forbidden ones that did, per script."""
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return scripts.select("script_id", listed(F.array_except("expected", "fired")).alias("missed"), listed(F.array_intersect("forbidden", "fired")).alias("forbidden_fired"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to 4 places; 1 where there was nothing to find."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.round(part / whole, 4))


def index_percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per ``by`` the element int(n * share), capped, of the sorted values: from running counts over distinct values."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = counts.withColumns({"_upto": F.sum("_n").over(Window.partitionBy(by).orderBy(value)), "_all": F.sum("_n").over(Window.partitionBy(by))})
    at = lambda s: F.least(F.floor(F.col("_all") * s), F.col("_all") - 1)
    return run.groupBy(by).agg(*[F.min(F.when(F.col("_upto") > at(s), F.col(value))).alias(name) for name, s in shares.items()])


def eval_report(results: DataFrame) -> DataFrame:
    """Per split: rates, under-calls and times. Median is element n // 2, the 95th percentile element int(0.95 n); neither interpolates."""
    s = F.sum
    by = results.groupBy("split").agg(
        F.count(F.lit(1)).alias("scripts"), F.when(s("facts") == 0, F.lit(0.0)).otherwise(F.round(s("unsourced") / s("facts"), 4)).alias("hallucination_rate"),
        ratio(s("flags_caught"), s("flags_expected")).alias("flag_sensitivity"), ratio(F.count_if(F.col("flags_caught") == F.col("flags_expected")), F.count(F.lit(1))).alias("script_recall"),
        ratio(F.count_if(F.col("priority_rank") == F.col("expected_rank")), F.count(F.lit(1))).alias("priority_accuracy"), F.count_if(F.col("priority_rank") < F.col("expected_rank")).alias("under_calls"),
        ratio(s("slots_matched"), s("slots_expected")).alias("extraction_accuracy"), F.round(F.avg("completeness"), 4).alias("mean_completeness"), F.max("ms").alias("max_ms"), F.round(F.avg("ms"), 4).alias("mean_ms"),
    )
    return by.join(index_percentiles(results, "split", "ms", {"median_ms": 0.5, "p95_ms": 0.95}), "split")


def dev_holdout_gap(report: DataFrame) -> DataFrame:
    """metric, dev, holdout and their difference."""
    rows = report.unpivot(["split"], METRICS, "metric", "value")
    by = rows.groupBy("metric").pivot("split", ["dev", "holdout"]).agg(F.first("value"))
    return by.withColumn("difference", F.round(F.col("dev") - F.col("holdout"), 4))


def letters_and_digits(text: Column) -> Column:
    """``text`` in lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def score_ocr(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per run (``keys``, such as engine, document and variant) how well the found entities meet the true ones.

    truth: keys, item (tells a run's true entities apart), kind, text, detail; found: keys, place (order of reading), kind, text, detail, needs_check.
    A true entity is met by the first found one of its kind whose text holds its first letters, compared without case, spaces and punctuation:
    6 letters of a medicine, 5 of an investigation, 12 of a diagnosis; a medicine without any letter is never met. The detail is the dose of
    medicines, compared alike, and the flag of investigations, compared as it is. Recalls are 1 where nothing was to find;
    dose and flag accuracy are taken over met entities, 0 if none of the wanted is met. Runs of either table have a row.
    """
    short = F.when(F.col("kind") == "medication", 6).when(F.col("kind") == "investigation", 5).otherwise(12)
    want = truth.select(*keys, "item", "kind", F.substring(letters_and_digits(F.coalesce("text", F.lit(""))), F.lit(1), short).alias("start"), F.col("detail").alias("wanted"))
    got = found.select(*keys, "kind", "place", letters_and_digits(F.coalesce("text", F.lit(""))).alias("read"), "detail")
    holds = F.contains("read", "start") & ((F.col("kind") != "medication") | (F.col("start") != ""))
    first = want.join(got, [*keys, "kind"]).filter(holds).groupBy(*keys, "kind", "item").agg(F.min_by(F.struct("detail"), "place")["detail"].alias("detail"), F.lit(True).alias("met"))
    plain = lambda c: letters_and_digits(F.coalesce(c, F.lit("")))
    right = F.when(F.col("kind") == "medication", plain("wanted") == plain("detail")).otherwise(F.col("wanted").eqNullSafe(F.col("detail")))
    marked = want.join(first, [*keys, "kind", "item"], "left").withColumn("right", F.col("met") & right)
    of = lambda kind, *c: F.count_if(reduce(lambda x, y: x & y, [F.col("kind") == kind, *map(F.col, c)]))
    kinds = ["medication", "investigation", "diagnosis"]
    counts = marked.groupBy(*keys).agg(*[of(k, *c).alias(f"{k}_{n}") for k in kinds for n, c in (("all", ()), ("met", ("met",)), ("right", ("met", "right")))])
    checks = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("entities_found"), F.count_if("needs_check").alias("checks"))
    rows = counts.join(checks, keys, "full").fillna(0)
    recall = lambda kind: ratio(F.col(f"{kind}_met"), F.col(f"{kind}_all"))
    accuracy = lambda kind: F.when((F.col(f"{kind}_met") == 0) & (F.col(f"{kind}_all") > 0), F.lit(0.0)).otherwise(ratio(F.col(f"{kind}_right"), F.col(f"{kind}_met")))
    return rows.select(
        *keys, "entities_found", recall("medication").alias("medication_recall"), accuracy("medication").alias("dose_accuracy"), recall("investigation").alias("lab_recall"),
        accuracy("investigation").alias("flag_accuracy"), recall("diagnosis").alias("diagnosis_recall"),
        F.when(F.col("entities_found") == 0, F.lit(0.0)).otherwise(F.round(F.col("checks") / F.col("entities_found"), 4)).alias("verification_rate"),
    )


def register(query) -> None:
    """The queries of this module."""

    @query("""WITH x AS (SELECT encounter_id AS script_id, path, list_sort(list(DISTINCT value)) AS e FROM clinical_fact WHERE tier <> 'document' GROUP BY 1, 2),
        a AS (SELECT encounter_id AS script_id, path, list_sort(list(DISTINCT value)) AS v FROM clinical_fact WHERE tier <> 'stated' GROUP BY 1, 2),
        j AS (SELECT x.script_id, x.path, coalesce(CASE WHEN len(e) = 1 THEN v = e ELSE list_has_all(v, e) END, false) AS ok FROM x LEFT JOIN a ON x.script_id = a.script_id AND x.path = a.path)
        SELECT script_id, count(*) AS expected, count(*) FILTER (ok) AS matched, coalesce(string_agg(path, ',' ORDER BY path) FILTER (NOT ok), '') AS mismatches FROM j GROUP BY 1""")
    def score_slots(t):
        sets = lambda tier, name: t("clinical_fact").filter(F.col("tier") != tier).groupBy(F.col("encounter_id").alias("script_id"), "path").agg(F.array_sort(F.collect_set("value")).alias(name))
        return globals()["score_slots"](sets("document", "expected_values"), sets("stated", "actual_values"))

    @query("""WITH s AS (SELECT user_id AS script_id, list(DISTINCT event_type) FILTER (event_id % 3 = 0) AS fired FROM events GROUP BY 1), e AS (SELECT *, CASE WHEN script_id % 2 = 0 THEN ['click', 'error'] ELSE ['purchase'] END AS x FROM s)
        SELECT script_id, array_to_string(list_filter(x, lambda q: NOT coalesce(list_contains(fired, q), false)), ',') AS missed, CASE WHEN coalesce(list_contains(fired, 'view'), false) THEN 'view' ELSE '' END AS forbidden_fired FROM e""")
    def score_flags(t):
        words = lambda *w: F.array(*[F.lit(x) for x in w])
        by = t("events").groupBy(F.col("user_id").alias("script_id")).agg(F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("fired"))
        expected = F.when(F.col("script_id") % 2 == 0, words("click", "error")).otherwise(words("purchase"))
        return globals()["score_flags"](by.withColumns({"expected": expected, "forbidden": words("view")}))

    report = """q AS (SELECT split, list_sort(list(ms)) AS l FROM script_result r GROUP BY 1), e AS (SELECT r.split, count(*) AS scripts, round(sum(unsourced) / sum(facts), 4) AS hallucination_rate, round(sum(flags_caught) / sum(flags_expected), 4) AS flag_sensitivity,
        round(count(*) FILTER (flags_caught = flags_expected) / count(*), 4) AS script_recall, round(count(*) FILTER (priority_rank = expected_rank) / count(*), 4) AS priority_accuracy, count(*) FILTER (priority_rank < expected_rank) AS under_calls,
        round(sum(slots_matched) / sum(slots_expected), 4) AS extraction_accuracy, round(avg(completeness), 4) AS mean_completeness, max(ms) AS max_ms, round(avg(ms), 4) AS mean_ms FROM script_result r GROUP BY 1),
        p AS (SELECT e.*, l[len(l) // 2 + 1] AS median_ms, l[least(CAST(floor(len(l) * 0.95) AS BIGINT), len(l) - 1) + 1] AS p95_ms FROM e JOIN q ON e.split = q.split)"""

    @query(f"WITH {report} SELECT * FROM p")
    def eval_report(t):
        return globals()["eval_report"](t("script_result"))

    @query(f"WITH {report}, u AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, split, {m} AS value FROM p" for m in METRICS) + """), v AS (SELECT metric, max(value) FILTER (split = 'dev') AS dev, max(value) FILTER (split = 'holdout') AS holdout FROM u GROUP BY 1)
        SELECT *, round(dev - holdout, 4) AS difference FROM v""")
    def dev_holdout_gap(t):
        return globals()["dev_holdout_gap"](globals()["eval_report"](t("script_result")))

    norm = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"

    @query(f"""WITH f AS (SELECT *, {norm('read_text')} AS r FROM ocr_entity WHERE is_read), w AS (SELECT *, substr({norm('text')}, 1, CASE kind WHEN 'medication' THEN 6 WHEN 'investigation' THEN 5 ELSE 12 END) AS s FROM ocr_entity WHERE is_true),
        p AS (SELECT w.doc_id, w.place, w.kind, w.detail AS wanted, f.read_detail, row_number() OVER (PARTITION BY w.doc_id, w.place ORDER BY f.place) AS n FROM w JOIN f ON w.doc_id = f.doc_id AND w.kind = f.kind AND contains(f.r, w.s)),
        h AS (SELECT w.doc_id, w.kind, p.n IS NOT NULL AS met, p.n IS NOT NULL AND CASE w.kind WHEN 'medication' THEN {norm('p.wanted')} = {norm('p.read_detail')} ELSE p.wanted = p.read_detail END AS ok FROM w LEFT JOIN p ON w.doc_id = p.doc_id AND w.place = p.place AND p.n = 1),
        c AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS {n}a, count(*) FILTER (kind = '{k}' AND met) AS {n}m, count(*) FILTER (kind = '{k}' AND ok) AS {n}r" for k, n in (("medication", "m"), ("investigation", "i"), ("diagnosis", "d")))} FROM h GROUP BY 1),
        v AS (SELECT doc_id, count(*) AS entities_found, round(count(*) FILTER (needs_check) / count(*), 4) AS rate FROM ocr_entity WHERE is_read GROUP BY 1)
        SELECT coalesce(c.doc_id, v.doc_id) AS doc_id, coalesce(entities_found, 0) AS entities_found, {", ".join(f"CASE WHEN coalesce({n}a, 0) = 0 THEN 1.0::DOUBLE ELSE round({n}m / {n}a, 4) END AS {name}" for n, name in (("m", "medication_recall"), ("i", "lab_recall"), ("d", "diagnosis_recall")))},
        {", ".join(f"CASE WHEN coalesce({n}a, 0) = 0 THEN 1.0::DOUBLE WHEN {n}m = 0 THEN 0.0::DOUBLE ELSE round({n}r / {n}m, 4) END AS {name}" for n, name in (("m", "dose_accuracy"), ("i", "flag_accuracy")))}, coalesce(rate, 0.0::DOUBLE) AS verification_rate
        FROM c FULL JOIN v ON c.doc_id = v.doc_id""")
    def score_ocr(t):
        rows = t("ocr_entity")
        found = rows.filter("is_read").select("doc_id", "place", "kind", F.col("read_text").alias("text"), F.col("read_detail").alias("detail"), "needs_check")
        return globals()["score_ocr"](rows.filter("is_true").select("doc_id", F.col("place").alias("item"), "kind", "text", "detail"), found, ["doc_id"])
