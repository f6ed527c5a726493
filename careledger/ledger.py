"""The fact ledger: conditions, validation, dedupe, supersession, and its projection to a history."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careledger.evidence import in_vocabulary, typed_value_is_echoed, value_is_echoed

# The operators of conditions, in the order in which they apply.
OPERATORS = ["recorded", "not_recorded", "eq", "ne", "in", "not_in", "contains", "gt", "lt", "gte", "lte"]


def value_of(values: Column, path: str) -> Column:
    """The values recorded under ``path`` in a map of arrays; null where the path is missing."""
    return F.try_element_at(values, F.lit(path))


def condition_expr(clause: dict, values: Column) -> Column:
    """One condition as a column that is never null: a missing path makes every operator false but not_recorded.

    Of several operators the first in OPERATORS applies. Booleans ('true', 'false') and lists never compare as numbers; contains looks for a
    text within any element, without regard to case.
    """
    found = value_of(values, clause["path"])
    op, arg = next((k, clause[k]) for k in OPERATORS if k in clause)
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    listed = lambda v: F.array(*[F.lit(text(x)) for x in (v if isinstance(v, (list, tuple)) else [v])])
    number = lambda: F.when(F.size(found) == 1, F.get(found, F.lit(0)).try_cast("double"))
    if op == "recorded":
        return found.isNotNull() if arg else found.isNull()
    if op == "not_recorded":
        return found.isNull() if arg else found.isNotNull()
    out = {
        "eq": lambda: F.array_contains(found, text(arg)),
        "contains": lambda: F.exists(found, lambda x: F.contains(F.lower(x), F.lit(text(arg).lower()))),
        "ne": lambda: ~F.array_contains(found, text(arg)),
        "in": lambda: F.arrays_overlap(found, listed(arg)),
        "not_in": lambda: ~F.arrays_overlap(found, listed(arg)),
        "gt": lambda: number() > float(arg),
        "lt": lambda: number() < float(arg),
        "gte": lambda: number() >= float(arg),
        "lte": lambda: number() <= float(arg),
    }[op]()
    return F.coalesce(out, F.lit(False))


def rule_expr(rule: dict | list, of: Column | Callable[[dict], Column]) -> Column:
    """all / any of conditions, or one condition; a list means all. An empty list holds for all, but not for any nor within one.

    ``of`` is the map of values, or a function that gives the column of a condition.
    """
    if isinstance(rule, list):
        return reduce(lambda a, b: a & b, [rule_expr(r, of) for r in rule], F.lit(True))
    if "all" in rule:
        return rule_expr(rule["all"], of)
    if "any" in rule:
        return reduce(lambda a, b: a | b, [rule_expr(r, of) for r in rule["any"] if r.get("all") != []], F.lit(False))
    return condition_expr(rule, of) if isinstance(of, Column) else of(rule)


def derive_bands(number: Column, bands: list[tuple[str, float, str]]) -> Column:
    """The value of the first band (operator, bound, value) that holds; null for a null number or none."""
    compare = {"lt": lambda b: number < b, "lte": lambda b: number <= b, "gt": lambda b: number > b, "gte": lambda b: number >= b}
    out = None
    for op, bound, value in bands:
        out = F.when(compare[op](bound), value) if out is None else out.when(compare[op](bound), value)
    return out


def display_values(value: Column, labels: dict[str, str]) -> Column:
    """Booleans as Yes or No, known keys as their labels, others as they are."""
    known = F.create_map(*[F.lit(x) for kv in ({"true": "Yes", "false": "No"} | labels).items() for x in kv])
    return F.coalesce(F.try_element_at(known, value), value)


def validate_facts(facts: DataFrame, known_paths: list[str], granted: DataFrame | None = None, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """``facts`` with reject_reason: the first check that fails, null for an accepted fact.

    Checks in order: span kind, blank verbatim, null value, tier against span (a document's fact needs a document span, others an utterance),
    confirmed without a question, unknown path, consent scope (sessions in ``granted``), closed vocabulary (of the paths in ``vocabulary``), and
    for other paths: a tapped value is among the selected ones, any other is echoed. Columns span_kind, selected_values, verbatim_translated and human_reading count where
    ``facts`` has them. A value may be a text or a VARIANT: of a list every entry must pass, numbers and booleans need no echo.
    """
    if granted is not None:
        facts = facts.join(granted.select("session_id").distinct().withColumn("_granted", F.lit(True)), "session_id", "left")
    no_scope = F.col("_granted").isNull() if granted is not None else F.lit(False)
    kind = F.col("span_kind") if "span_kind" in facts.columns else F.when(F.col("tier") == "document", "document").otherwise("utterance")
    typed, value = dict(facts.dtypes)["value"] == "variant", F.col("value")
    coded, outside = F.col("path").isin(list(vocabulary or {})), F.lit(False)
    for path, options in (vocabulary or {}).items():
        outside = outside | ((F.col("path") == path) & ~(in_vocabulary(value, options) if typed else value.isin(options)))
    more = [F.col(c) for c in ("verbatim_translated", "human_reading") if c in facts.columns]
    if typed:
        # Without the options that were pressed there is nothing to hold a tapped value against.
        pressed = F.when(F.col("modality") == "touch", F.coalesce("selected_values", F.array().cast("array<string>"))) if "selected_values" in facts.columns else None
        backed = typed_value_is_echoed(value, F.col("verbatim"), *more, selected=pressed)
        backed = backed if pressed is not None else backed | (F.col("modality") == "touch")
        missing = value.isNull() | F.is_variant_null(value)
    else:
        selected = F.array_contains("selected_values", value) if "selected_values" in facts.columns else F.lit(True)
        backed = F.when(F.col("modality") == "touch", F.coalesce(selected, F.lit(False))).otherwise(value_is_echoed(value, F.col("verbatim"), *more))
        missing = value.isNull()
    reason = (
        F.when(~F.coalesce(kind.isin("utterance", "document"), F.lit(False)), "no source span")
        .when(F.coalesce(F.trim("verbatim"), F.lit("")) == "", "blank verbatim")
        .when(missing, "null value")
        .when((F.col("tier") == "document") & (kind != "document"), "document tier without document span")
        .when(F.col("tier").isin("stated", "confirmed") & (kind != "utterance"), "tier without utterance span")
        .when((F.col("tier") == "confirmed") & F.col("question_id").isNull(), "confirmed without question")
        .when(~F.col("path").isin(known_paths), "unknown path")
        .when(no_scope, "scope not granted")
        .when(outside, "not in vocabulary")
        .when(~coded & ~backed, "value not in span")
    )
    return facts.withColumn("reject_reason", reason).drop("_granted")


def span_digest(*parts: Column) -> Column:
    """First 16 hex digits of the sha256 of the parts, joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """The first fact of each session, path and digest."""
    first = Window.partitionBy("session_id", "path", "digest").orderBy("seq")
    return facts.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def supersede_facts(facts: DataFrame) -> DataFrame:
    """``facts`` with superseded_by: the next fact of the session's path that supersedes, if there is one."""
    after = Window.partitionBy("session_id", "path").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return facts.withColumn("superseded_by", F.first(F.when(F.col("supersede"), F.col("fact_id")), ignorenulls=True).over(after))


def number_group_entries(entries: DataFrame, used: DataFrame) -> DataFrame:
    """``entries`` (session_id, grp, ord) with idx: numbered on from the largest index in ``used`` (session_id, grp, idx)."""
    top = used.groupBy("session_id", "grp").agg((F.max("idx") + 1).alias("_next"))
    order = Window.partitionBy("session_id", "grp").orderBy("ord")
    rows = entries.join(top, ["session_id", "grp"], "left")
    return rows.withColumn("idx", (F.row_number().over(order) - 1 + F.coalesce("_next", F.lit(0))).cast("long")).drop("_next")


def locate_span(quote: Column, text: Column) -> tuple[Column, Column]:
    """(start, end) of a quote in its text: exact, else without regard to case, else 0."""
    at = F.when(F.position(quote, text) > 0, F.position(quote, text))
    at = at.when(F.position(F.lower(quote), F.lower(text)) > 0, F.position(F.lower(quote), F.lower(text)))
    start = F.coalesce(at - 1, F.lit(0)).cast("long")
    return start, (start + F.length(quote)).cast("long")


def physician_edit(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """``facts`` and, per edit (session_id, path, value, actor, at), a confirmed fact that supersedes; then supersession anew."""
    last = facts.groupBy("session_id").agg(F.max("seq").alias("_top"))
    order = Window.partitionBy("session_id").orderBy("at", "path")
    new = edits.join(last, "session_id").withColumn("seq", F.col("_top") + F.row_number().over(order))
    new = new.select(
        "session_id", "seq", F.concat(F.lit("e"), F.col("session_id").cast("string"), F.lit("-"), F.col("seq").cast("string")).alias("fact_id"), "path", "value",
        F.lit("confirmed").alias("tier"), F.lit(True).alias("supersede"), F.concat_ws(" — corrected by ", "value", "actor").alias("verbatim"),
    )
    return supersede_facts(facts.select(*new.columns).unionByName(new))


def absences(sessions: DataFrame, questions: list[dict], facts: DataFrame, declined: DataFrame) -> DataFrame:
    """Per session and question (id, path) without a fact: reason declined or not_asked."""
    asked = F.array(*[F.struct(F.lit(q["id"]).alias("question_id"), F.lit(q["path"]).alias("path")) for q in questions])
    every = sessions.select("session_id").distinct().select("session_id", F.inline(asked))
    missing = every.join(facts.select("session_id", "path").distinct(), ["session_id", "path"], "left_anti")
    said = declined.select("session_id", "question_id").distinct().withColumn("_d", F.lit(1))
    return missing.join(said, ["session_id", "question_id"], "left").select("session_id", "question_id", F.when(F.col("_d") == 1, "declined").otherwise("not_asked").alias("reason"))


def project_slots(facts: DataFrame) -> DataFrame:
    """Per session and path: the latest active value (the earliest of equal times), counts, and superseded facts oldest first."""
    active = F.col("superseded_by").isNull()
    latest = F.max(F.when(active, F.struct("recorded_at", -F.col("seq"), "value", "fact_id"))).alias("l")
    old = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~active, F.struct("seq", "fact_id")))), lambda x: x["fact_id"]), ",")
    by = facts.groupBy("session_id", "path").agg(latest, F.count_if(active).alias("active"), old.alias("superseded"))
    status = F.when(F.col("active") > 0, "recorded").otherwise("declined")
    return by.select("session_id", "path", F.col("l.value").alias("value"), F.col("l.fact_id").alias("fact_id"), status.alias("status"), "active", "superseded")


def project_groups(facts: DataFrame, fields: list[str]) -> DataFrame:
    """Entries of repeating groups, from paths ``group[i].field``: one row per session, group and index, one column per field."""
    parts = lambda k: F.regexp_extract("path", r"^([a-z_]+)\[([0-9]+)\]\.([a-z_]+)$", k)
    rows = facts.withColumns({"grp": parts(1), "idx": parts(2), "field": parts(3)}).filter("grp <> ''").withColumn("idx", F.col("idx").cast("long"))
    return rows.groupBy("session_id", "grp", "idx").pivot("field", fields).agg(F.max_by("value", F.struct("recorded_at", -F.col("seq"))))


def completeness(slots: DataFrame) -> DataFrame:
    """Share of recorded slots per section and overall (section null), of those asked; all slots count where a section has none asked."""
    by = slots.rollup("session_id", "section").agg(
        F.count_if(F.col("status") == "recorded").alias("recorded"), F.count_if(F.col("status") != "not_asked").alias("asked"), F.count(F.lit(1)).alias("slots"), F.grouping_id().alias("g")
    ).filter("g < 3")
    of = F.when(F.col("asked") > 0, F.col("asked")).when(F.col("g") == 0, F.col("slots")).otherwise(None)
    return by.select("session_id", "section", "recorded", F.coalesce(F.round(F.col("recorded") / of, 4), F.lit(0.0)).alias("completeness"))


def _progress(questions: list[dict], values: Column, declined: Column | None) -> tuple[Column, Column]:
    """How many of the questions are open, and how many of these are answered or declined; derived ones are not asked."""
    zero, open_, done = F.lit(0), [], []
    for q in questions:
        if q.get("kind") != "derived":
            asked, settled = rule_expr(q.get("ask_if", []), values), value_of(values, q["path"]).isNotNull()
            if declined is not None:
                settled = settled | F.coalesce(F.array_contains(declined, q["id"]), F.lit(False))
            open_.append(asked.cast("int"))
            done.append((asked & settled).cast("int"))
    return reduce(lambda a, b: a + b, open_, zero).cast("long"), reduce(lambda a, b: a + b, done, zero).cast("long")


def askable_progress(session_values: DataFrame, questions: list[dict]) -> DataFrame:
    """Per session: how many questions are open by their ``ask_if`` (a rule), how many of these are answered or declined, and the percentage; 100 where none is open.

    Derived questions (kind) don't count. Declined ones are the ids in the column ``declined``, where the sessions have it.
    """
    declined = F.col("declined") if "declined" in session_values.columns else None
    open_, done = _progress(questions, F.col("values"), declined)
    return session_values.select("session_id", open_.alias("askable"), done.alias("answered"), F.when(open_ > 0, F.round(100 * done / open_, 4)).otherwise(100.0).alias("percent"))


def section_progress(session_values: DataFrame, questions: list[dict]) -> DataFrame:
    """askable_progress per session and section of the questions, in the order in which sections first occur; complete where all open ones, of one at least, are done."""
    declined = F.col("declined") if "declined" in session_values.columns else None
    sections: dict[str, list[dict]] = {}
    for q in questions:
        sections.setdefault(q["section"], []).append(q)
    each = []
    for section, own in sections.items():
        open_, done = _progress(own, F.col("values"), declined)
        each.append(F.struct(F.lit(section).alias("section"), done.alias("answered"), open_.alias("total"), ((open_ > 0) & (open_ == done)).alias("complete")))
    return session_values.select("session_id", F.inline(F.array(*each)))


def next_open_question(session_values: DataFrame, questions: list[dict], visits: Column, most: int = 4) -> DataFrame:
    """The first open and unanswered question in order with fewer than ``most`` visits; null where none is left."""
    values = F.col("values")
    out = [F.when(rule_expr(q.get("ask_if", []), values) & value_of(values, q["path"]).isNull() & (F.coalesce(F.try_element_at(visits, F.lit(q["id"])), F.lit(0)) < most), q["id"]) for q in questions]
    return session_values.select("session_id", F.coalesce(*out).alias("next_question"))


def session_values(facts: DataFrame) -> DataFrame:
    """session_id, values and fact_ids: the last active value of each path as map<string, array<string>>, and the ids of all its active facts in order. Paths of a session are few.

    A value may be a text or an array of texts.
    """
    value = F.col("value") if dict(facts.dtypes)["value"].startswith("array") else F.array("value")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "fact_id"))), lambda x: x["fact_id"])
    last = facts.filter("superseded_by is null").groupBy("session_id", "path").agg(F.max_by(value, "seq").alias("value"), ids.alias("ids"))
    map_of = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", c)))).alias
    return last.groupBy("session_id").agg(map_of("value")("values"), map_of("ids")("fact_ids"))


def inspect_counts(facts: DataFrame) -> DataFrame:
    """Per session: facts by tier, active, superseded and without a source."""
    tier = lambda t: F.count_if(F.col("tier") == t).alias(t)
    return facts.groupBy("session_id").agg(
        tier("stated"), tier("confirmed"), tier("document"), F.count_if(F.col("superseded_by").isNull()).alias("active"),
        F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.count_if(F.coalesce(F.trim("verbatim"), F.lit("")) == "").alias("without_source"),
    )
