"""What comes in: gold scripts, code systems, positioned text, taps, proposals, entities and their reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careledger import documents
from careledger.evidence import value_is_echoed
from careledger.shared import shared_path

GOLD_SCRIPT = """id string, title string, language string, difficulty string, expected map<string,string>, expected_red_flags array<string>, forbidden_red_flags array<string>, expected_priority string,
    turns array<struct<question_id:string,utterance:string,tap:string,asr_confidence:double,decline:boolean>>"""
CODE_SYSTEM = "url string, version string, name string, concepts array<struct<code:string,display:string,classKind:string,selectable:boolean>>"


def read_gold_scripts(spark: SparkSession, path: str, only: str | None = None, multi_line: bool = True) -> DataFrame:
    """A folder of scripts, one JSON document a file (``multi_line``) or a line; ``only`` keeps those whose id holds it."""
    scripts = spark.read.schema(GOLD_SCRIPT).option("multiLine", multi_line).json(path)
    return scripts.filter(F.contains("id", F.lit(only))) if only else scripts


def code_systems(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Concepts of files (content) that have the shape of a code system, without those whose url and version are ``loaded``.

    Files of another shape give nothing; a system that comes twice counts once. The class defaults to category, selectable to true.
    """
    rows = files.select(F.from_json("content", CODE_SYSTEM).alias("s")).select("s.*").filter("url is not null and version is not null and concepts is not null")
    rows = rows.join(loaded.select("url", "version").distinct(), ["url", "version"], "left_anti").select("url", "version", F.explode("concepts").alias("c")).filter("c.code is not null")
    rows = rows.select("url", "version", "c.code", "c.display", F.coalesce("c.classKind", F.lit("category")).alias("class_kind"), F.coalesce("c.selectable", F.lit(True)).alias("is_selectable"))
    return rows.dropDuplicates(["url", "version", "code"])


def runs_to_lines(runs: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Text runs (doc_id, page, x, y, size, text; y upwards) to lines: one per rounded baseline, from left to right, its box from the top."""
    by = runs.groupBy("doc_id", "page", F.bround("y", 0).cast("long").alias("baseline")).agg(
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda r: r["text"]), " ")).alias("text"), F.min("x").alias("left"), F.max("size").alias("size")
    ).filter("text <> ''")
    top = (page_height - (F.col("baseline") + F.col("size"))) / page_height
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("baseline"))
    return by.select("doc_id", "page", F.row_number().over(order).cast("long").alias("line_no"), "text", F.round(F.col("left") / page_width, 4).alias("x"), F.round(F.least(F.greatest(top, F.lit(0.0)), F.lit(1.0)), 4).alias("y"))


def validate_taps(taps: DataFrame, questions: DataFrame) -> DataFrame:
    """Taps (session_id, question_id, selected) against their question (kind, options, exclusive, low, high; few).

    Gives the values taken and the reason for refusal, null where accepted: a choice names listed options only, an exclusive option
    stands alone, several need at least one, a scale has bounds.
    """
    rows = taps.join(questions, "question_id", "left")
    number = F.get("selected", F.lit(0)).try_cast("long")
    choice = F.col("kind").isin("single", "multi")
    reason = (
        F.when(F.col("kind").isNull(), "unknown question").when(choice & (F.size("selected") == 0), "empty answer")
        .when(choice & (F.size(F.array_except("selected", "options")) > 0), "not an option")
        .when((F.col("kind") == "scale") & ~F.coalesce(number.between(F.col("low"), F.col("high")), F.lit(False)), "outside the scale")
    )
    alone = F.filter("selected", lambda x: F.array_contains("exclusive", x))
    taken = F.when((F.col("kind") == "multi") & (F.size(alone) > 0), F.slice(alone, 1, 1)).otherwise(F.col("selected"))
    return rows.select("session_id", "question_id", F.when(reason.isNull(), F.array_join(taken, ",")).alias("value"), reason.alias("reason"))


def scale_anchor(number: Column, high: int, anchors: list[str]) -> Column:
    """The anchor of a number on a scale that ends at ``high``, cut into as many equal parts as there are anchors."""
    at = F.least(F.floor(number * len(anchors) / (high + 1)), F.lit(len(anchors) - 1)).cast("int")
    return F.get(F.array(*[F.lit(a) for a in anchors]), at)


def gate_proposals(proposals: DataFrame, utterances: DataFrame, allowed: DataFrame) -> DataFrame:
    """Proposed slots (session_id, turn_id, path, value, quote, confidence) that their turn backs, with the reason for others.

    The quote must stand in the turn, the path be known (``allowed``: path, options; few), a choice be an option and
    free text be echoed. The confidence is at most that of the recognised speech.
    """
    turns = utterances.select("session_id", "turn_id", F.col("text").alias("_text"), "asr_confidence")
    rows = proposals.join(turns, ["session_id", "turn_id"], "left").join(allowed.select("path", "options"), "path", "left")
    free = F.size("options") == 0
    reason = (
        F.when(~F.coalesce(F.contains(F.lower("_text"), F.lower("quote")), F.lit(False)), "quote not in turn").when(F.col("options").isNull(), "unknown path")
        .when(~free & ~F.array_contains("options", F.col("value")), "not an option").when(free & ~value_is_echoed(F.col("value"), F.col("quote")), "value not in quote")
    )
    sure = F.least("confidence", F.coalesce("asr_confidence", F.lit(1.0)))
    return rows.withColumns({"reason": reason, "confidence": sure}).drop("_text", "asr_confidence", "options")


# Words of agreement and refusal in the languages that patients speak.
YES = ["yes", "yeah", "haan", "haa", "ji haan", "ho", "aan", "correct", "true", "sahi"]
NO = ["no", "nahin", "nahi", "never", "kabhi nahin", "not", "illa", "false"]


def _cue(words: list[str]) -> Column:
    """The slice of the text where the longest of these words stands that is a whole word anywhere in it; null where none is."""
    said = [F.when(F.col("text").rlike(rf"(?i)(?<!\w){w}(?!\w)"), F.substr("text", F.instr(F.lower("text"), w), F.lit(len(w)))) for w in sorted(words, key=len, reverse=True)]
    return F.coalesce(*said)


def extract_slots(utterances: DataFrame, questions: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One slot per utterance by its question's kind (few) with its quote, or none, and then the text is unplaced.

    ``hits`` (of documents.match_options) decide choices: the best one for a single choice, all but none for several, with the
    least of their scores and the smallest slice of the text that covers them all. Refusal beats agreement, as whole words; a scale takes the first whole number to 10; open text is
    itself. A quote always stands in its turn.
    """
    rows = utterances.join(questions.select("question_id", "kind"), "question_id", "left")
    none = F.lit(None).cast("string")
    if hits is not None:
        some = F.filter(F.array_sort(F.collect_list(F.struct("rank", "option_value", "score", "at", (F.col("at") + F.length("quote")).alias("end")))), lambda h: h["option_value"] != "none")
        by = hits.groupBy("session_id", "turn_id").agg(F.min_by("option_value", "rank").alias("_top"), F.min_by("quote", "rank").alias("_quote"), F.max_by("score", -F.col("rank")).alias("_score"), some.alias("_all"))
        rows = rows.join(by, ["session_id", "turn_id"], "left")
        single, several = F.col("_top"), F.when(F.size("_all") > 0, F.array_join(F.transform("_all", lambda h: h["option_value"]), ","))
        sure = F.when(F.col("kind") == "multi", F.array_min(F.transform("_all", lambda h: h["score"]))).otherwise(F.col("_score"))
        begin, end = F.array_min(F.transform("_all", lambda h: h["at"])), F.array_max(F.transform("_all", lambda h: h["end"]))
        quoted, covering = F.col("_quote"), F.substr("text", (begin + 1).cast("int"), (end - begin).cast("int"))
    else:
        single, several, sure, quoted, covering = none, none, F.lit(None).cast("double"), none, none
    word = lambda w: F.lower("text").rlike(rf"(?<!\w)(?:{'|'.join(w)})(?!\w)")
    kind, text = F.col("kind"), F.nullif(F.trim("text"), F.lit(""))
    number = F.nullif(F.regexp_extract("text", r"\b(10|[0-9])\b", 1), F.lit(""))
    value = (
        F.when(kind == "single", single).when(kind == "multi", several).when(kind == "boolean", F.when(word(NO), "false").when(word(YES), "true"))
        .when(kind == "scale", number).otherwise(F.coalesce(single, text))
    )
    quote = F.when(kind == "multi", covering).when(kind == "boolean", F.when(word(NO), _cue(NO)).otherwise(_cue(YES))).when(kind == "scale", number).when((kind == "single") | single.isNotNull(), quoted).otherwise(text)
    given = F.when(kind == "boolean", 0.8).when(kind == "scale", 0.75).when(kind.isin("single", "multi") | single.isNotNull(), sure).otherwise(0.9)
    there = value.isNotNull()
    return rows.select("session_id", "turn_id", value.alias("value"), F.when(there, quote).alias("quote"), F.when(there, given).alias("confidence"), F.when(~there, text).alias("unplaced"))


def extract_entities(lines: DataFrame) -> DataFrame:
    """At most one entity a line (a diagnosis before a procedure, an investigation, a medicine) with its document's date.

    A line without a date takes its document's, and says so in date_source; needs_check where the reading is unsure.
    """
    text = F.col("text")
    label, (diagnosis, procedure) = F.regexp_extract(text, documents.INVESTIGATION, 1), documents.cued_terms(text)
    lab = documents.once(label, lambda x: F.when(documents.match_analyte(x).isNotNull(), F.trim(x)))
    kinds = [("diagnosis", diagnosis), ("procedure", procedure), ("investigation", lab), ("medication", documents.medicine_parts(text)["name"])]
    own, _ = documents.parse_dates(text)
    rows = lines.select("doc_id", "line_no", own.alias("own"), "confidence", "handwritten", F.inline(documents.first_named(kinds, "label")))
    rows = rows.join(documents.document_date(lines).select("doc_id", "document_date"), "doc_id", "left")
    source = F.when(F.col("own").isNotNull(), "line").when(F.col("document_date").isNotNull(), "document").otherwise("none")
    check = documents.confidence_band(F.col("confidence"), F.col("handwritten")) == "verify"
    return rows.select("doc_id", "line_no", "kind", "label", F.coalesce("own", "document_date").alias("observed_on"), source.alias("date_source"), check.alias("needs_check"))


def verification_queue(entities: DataFrame) -> DataFrame:
    """All items of a document in one list: recorded ones by their number among the confident, then pending ones by theirs among all, each with its band.

    ``entities`` has doc_id, ord, text, confidence and handwritten. An item that needs checking is pending and of the band verify.
    """
    rows = entities.withColumn("band", documents.confidence_band(F.col("confidence"), F.col("handwritten"))).withColumn("pending", F.col("band") == "verify")
    lane = F.row_number().over(Window.partitionBy("doc_id", "pending").orderBy("ord")) - 1
    every = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    item = F.when(F.col("pending"), F.concat(F.lit("pending:"), every.cast("string"))).otherwise(F.concat(F.lit("recorded:"), lane.cast("string")))
    return rows.select("doc_id", "ord", item.alias("item_id"), "text", "pending", F.col("band").alias("confidence_band"))


def apply_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items (item_id, pending, text) after their last review: pending ones stay out until confirmed or corrected; a dispute rejects a pending item and only marks a recorded one."""
    last = reviews.groupBy("item_id").agg(F.max_by(F.struct("action", "corrected_text", "actor"), "at").alias("r"))
    rows = items.join(last, "item_id", "left")
    act = F.col("r.action")
    state = (
        F.when(act.isNull(), F.when(F.col("pending"), "waiting").otherwise("recorded")).when(act == "confirm", "confirmed")
        .when(act == "correct", "corrected").when(F.col("pending"), "rejected").otherwise("disputed")
    )
    reading = F.when(act == "correct", F.col("r.corrected_text"))
    return rows.select("item_id", state.alias("state"), F.coalesce(reading, F.col("text")).alias("text"), F.when(reading.isNotNull(), F.col("r.actor")).alias("read_by"), (~state.isin("waiting", "rejected")).alias("is_fact"))


def promote_entities(sources: DataFrame) -> DataFrame:
    """Entities in the JSON of documents (doc_id, entities, verified_by): rows, or warnings where a pending one has no verifier."""
    shape = "array<struct<kind:string,text:string,entityIndex:int>>"
    rows = sources.select("doc_id", "verified_by", F.explode(F.from_json("entities", shape)).alias("e"))
    pending = F.col("e.entityIndex").isNotNull()
    outcome = F.when(pending & F.col("verified_by").isNull(), "warning").when(pending, "corrected").otherwise("accepted")
    return rows.select("doc_id", "e.kind", "e.text", outcome.alias("outcome"))


def promote_medications(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Medicines (entry_id, name, document_ref) as events: dated by their document, never by today."""
    dates = sources.select(F.col("doc_id").alias("document_ref"), F.col("document_date").alias("observed_on"))
    status = F.when(F.col("document_ref").isNotNull(), "documented").otherwise("patient-reported-current")
    return entries.join(dates, "document_ref", "left").select("entry_id", documents.fold_label(F.col("name")).alias("normalized_name"), status.alias("status"), "observed_on")


def promote_observations(lines: DataFrame) -> DataFrame:
    """Readings with the report's own flag (reported_flag) where it has one, else the assessed one."""
    found = documents.assess_ranges(lines)
    rows = found.join(lines.select("doc_id", "reported_flag"), "doc_id")
    own = F.coalesce(F.col("reported_flag"), F.lit("unknown")) != "unknown"
    return rows.select("doc_id", "analyte", "value", F.when(own, F.col("reported_flag")).otherwise(F.col("flag")).alias("flag"), F.when(own, "report").otherwise(F.col("source")).alias("flag_source"))


def promote_timeline(encounters: DataFrame, medications: DataFrame, observations: DataFrame) -> DataFrame:
    """One event for each encounter and one for each of its medicines and readings."""
    of = lambda df, day, kind, label: df.select("patient_id", "encounter_id", F.col(day).alias("occurred_on"), F.lit(kind).alias("kind"), label.alias("label"))
    visits = of(encounters, "occurred_at", "encounter", F.coalesce(F.trim("headline"), F.lit("Visit")))
    return visits.unionByName(of(medications, "observed_on", "medication", F.col("name"))).unionByName(of(observations, "observed_on", "investigation", F.col("analyte_key")))


def problems_from_choices(facts: DataFrame, terms: DataFrame, start: DataFrame) -> DataFrame:
    """Chosen conditions (session_id, seq, value array) that have a term (few), numbered on from the session's ``next_idx``."""
    rows = facts.select("session_id", "seq", F.posexplode("value").alias("pos", "key")).join(terms, "key")
    order = Window.partitionBy("session_id").orderBy("seq", "pos")
    rows = rows.join(start, "session_id", "left").withColumn("idx", F.row_number().over(order) - 1 + F.coalesce("next_idx", F.lit(0)))
    return rows.select("session_id", F.col("idx").cast("long").alias("idx"), "term")


def brief_completeness(encounters: DataFrame, facts: DataFrame, paths: list[str]) -> DataFrame:
    """Per encounter the paths collected, declined and missing, each in the given order; lists, not a score."""
    live = facts.filter(F.col("superseded_by").isNull() & F.col("invalidated_reason").isNull() & F.col("path").isin(paths))
    by = live.groupBy("encounter_id", "path").agg(F.bool_or(F.col("value") != "none").alias("has"))
    known = encounters.select("encounter_id").join(by.groupBy("encounter_id").agg(F.collect_set(F.when(F.col("has"), F.col("path"))).alias("c"), F.collect_set(F.when(~F.col("has"), F.col("path"))).alias("d")), "encounter_id", "left")
    none, every = F.array().cast("array<string>"), F.array(*[F.lit(p) for p in paths])
    c, d = F.coalesce("c", none), F.coalesce("d", none)
    text = lambda a: F.array_join(a, ",")
    return known.select("encounter_id", text(F.array_intersect(every, c)).alias("collected"), text(F.array_intersect(every, d)).alias("declined"), text(F.array_except(every, F.array_union(c, d))).alias("missing"))


def evidence_for_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each fact with its evidence, in order; facts without any have an empty list. Evidence of one fact is little."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("evidence_id", "source_type"))), lambda e: F.concat_ws(":", e["evidence_id"].cast("string"), e["source_type"]))
    return facts.select("fact_id").join(evidence.groupBy("fact_id").agg(F.array_join(rows, ",").alias("evidence")), "fact_id", "left").fillna("", ["evidence"])


def patient_view(lines: DataFrame, labels: dict[str, str], medicines: DataFrame, series: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines of a brief (encounter_id, path, value, kinds, confirmed) by what a patient is shown: told us or from documents, and besides awaiting verification.

    ``medicines`` (name, dose, earlier) come from a paper or an earlier visit. Previous visits also hold ``series`` (display, first and last: value and day,
    points) of two points or more, and ``changes`` (fresh, same: numbers) since the last visit. Blank values are left out.
    """
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    groups = F.array_compact(F.array(F.when(F.array_contains("kinds", "document"), "from documents").otherwise("told us"), F.when(~F.col("confirmed"), "awaiting verification")))
    rows = lines.filter(F.coalesce("value", F.lit("")) != "")
    shown = rows.select("encounter_id", F.explode(groups).alias("part"), F.coalesce(F.try_element_at(known, F.col("path")), F.col("path")).alias("label"), "value")
    row = lambda df, part, label, value: df.select("encounter_id", part.alias("part"), label.alias("label"), value.alias("value")).filter("value <> ''")
    before, point = F.lit("previous visits"), lambda p: F.concat(F.col(p)["value"].cast("string"), F.lit(" on "), F.col(p)["day"].cast("string"))
    text = F.concat_ws(" ", F.nullif("name", F.lit("")), F.col("dose").cast("string"))
    kept = row(medicines, F.when(F.col("earlier"), before).otherwise("from documents"), F.when(F.col("earlier"), "Medicine from an earlier visit").otherwise("Medicine on your prescription"), text)
    runs = row(series.filter("points >= 2"), before, F.concat("display", F.lit(" over time")), F.concat(point("first"), F.lit(", "), point("last")))
    moved = row(changes, before, F.lit("Compared with your last visit"), F.concat(F.col("fresh").cast("string"), F.lit(" new thing(s) recorded, "), F.col("same").cast("string"), F.lit(" the same as before")))
    return shown.unionByName(kept).unionByName(runs).unionByName(moved)


def summary_lines(sections: list[tuple[str, DataFrame]], limits: dict[str, int]) -> DataFrame:
    """One summary a session: the sections in the given order, each a table (session_id, ord, text); ``limits`` is what a summary shows of a section."""
    out = None
    for place, (name, df) in enumerate(sections):
        rows = df.select("session_id", F.lit(place).cast("long").alias("section_no"), F.lit(name).alias("section"), F.row_number().over(Window.partitionBy("session_id").orderBy("ord")).cast("long").alias("line_no"), "text")
        rows = rows.filter(F.col("line_no") <= limits[name]) if name in limits else rows
        out = rows if out is None else out.unionByName(rows)
    return out


def register(query) -> None:
    """The queries of this module."""

    @query("""WITH r AS (SELECT l_orderkey AS doc_id, CAST(1 AS INT) AS page, CAST(l_partkey % 500 AS DOUBLE) AS x, l_suppkey % 5 AS b, 'w' || CAST(l_partkey AS VARCHAR) AS text FROM lineitem)
        SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC) AS line_no, string_agg(text, ' ' ORDER BY x, text) AS text, round(min(x) / 1000, 4) AS x, round((1000 - (b + 10.0)) / 1000, 4) AS y FROM r GROUP BY doc_id, page, b""")
    def runs_to_lines(t):
        runs = t("lineitem").selectExpr("l_orderkey as doc_id", "1 as page", "cast(l_partkey % 500 as double) as x", "l_suppkey % 5 + 0.3D as y", "10D as size", "'w' || cast(l_partkey as string) as text")
        return globals()["runs_to_lines"](runs, 1000.0, 1000.0)

    @query("""WITH x AS (SELECT DISTINCT 'u:' || p_brand AS url, p_type AS code FROM part WHERE NOT ends_with(p_brand, '1') AND NOT ends_with(p_brand, '2'))
        SELECT url, 'v1' AS version, code, lower(code) AS display, CASE WHEN length(code) % 2 = 0 THEN 'chapter' ELSE 'category' END AS class_kind, true AS is_selectable FROM x""")
    def load_code_systems(t):
        concept = F.struct(F.col("p_type").alias("code"), F.lower("p_type").alias("display"), F.when(F.length("p_type") % 2 == 0, "chapter").alias("classKind"))
        by = t("part").groupBy("p_brand").agg(F.collect_set(concept).alias("concepts"))
        files = by.select(F.to_json(F.struct(F.concat(F.lit("u:"), "p_brand").alias("url"), F.when(~F.endswith("p_brand", F.lit("2")), "v1").alias("version"), "concepts")).alias("content"))
        loaded = t("part").filter(F.endswith("p_brand", F.lit("1"))).select(F.concat(F.lit("u:"), "p_brand").alias("url"), F.lit("v1").alias("version"))
        return code_systems(files, loaded)

    @query("""WITH e AS (SELECT event_id, event_id % 4 AS q, event_id % 5 AS k FROM events), r AS (SELECT *, CASE WHEN q = 3 THEN 'unknown question' WHEN q IN (0, 2) AND k = 0 THEN 'empty answer' WHEN q IN (0, 2) AND (k > 2 OR (q = 2 AND k = 2)) THEN 'not an option'
        WHEN q = 1 AND k <> 4 THEN 'outside the scale' END AS reason FROM e)
        SELECT event_id AS session_id, 'q' || CAST(q AS VARCHAR) AS question_id, CASE WHEN reason IS NULL THEN CASE k WHEN 1 THEN 'a' WHEN 2 THEN 'none' ELSE '7' END END AS value, reason FROM r""")
    def validate_taps(t):
        spark, key = t("events").sparkSession, F.col("event_id")
        words = lambda *w: F.array(*[F.lit(x) for x in w])
        questions = spark.createDataFrame(
            [("q0", "multi", ["a", "b", "none"], ["none"], None, None), ("q1", "scale", [], [], 0, 10), ("q2", "single", ["a", "b"], [], None, None)],
            "question_id string, kind string, options array<string>, exclusive array<string>, low long, high long",
        )
        picked = F.when(key % 5 == 1, words("a")).when(key % 5 == 2, words("none", "a")).when(key % 5 == 3, words("12")).when(key % 5 == 4, words("7")).otherwise(F.array().cast("array<string>"))
        return globals()["validate_taps"](t("events").select(key.alias("session_id"), F.concat(F.lit("q"), (key % 4).cast("string")).alias("question_id"), picked.alias("selected")), questions)

    @query("""WITH p AS (SELECT session_id, turn_id, turn_id % 3 AS k, CASE WHEN session_id % 2 = 0 THEN 'the' ELSE 'zzz' END AS value, trim(regexp_replace(lower(substr(text, 1, 8)), '[^a-z0-9]+', ' ', 'g')) AS q, text, asr_confidence FROM utterance)
        SELECT session_id, turn_id, CASE WHEN text IS NULL OR session_id % 5 = 0 THEN 'quote not in turn' WHEN k = 2 THEN 'unknown path' WHEN k = 1 AND value = 'zzz' THEN 'not an option'
        WHEN k = 0 AND NOT (q = '' OR contains(q, value) OR contains(value, q)) THEN 'value not in quote' END AS reason, least(0.9, coalesce(asr_confidence, 1.0)) AS confidence FROM p""")
    def gate_proposals(t):
        u, turn = t("utterance"), F.col("turn_id") % 3
        path = F.when(turn == 0, "hpi.text").when(turn == 1, "hpi.site").otherwise("hpi.odd")
        quote = F.when(F.col("session_id") % 5 == 0, "not said at all").otherwise(F.substring("text", 1, 8))
        proposals = u.select("session_id", "turn_id", path.alias("path"), F.when(F.col("session_id") % 2 == 0, "the").otherwise("zzz").alias("value"), quote.alias("quote"), F.lit(0.9).alias("confidence"))
        allowed = u.sparkSession.createDataFrame([("hpi.text", []), ("hpi.site", ["the", "of"])], "path string, options array<string>")
        return globals()["gate_proposals"](proposals, u, allowed).select("session_id", "turn_id", "reason", "confidence")

    @query("""WITH e AS (SELECT p_partkey AS doc_id, 3 AS line_no, 'diagnosis' AS kind, 'type ' || p_type AS label, false AS needs_check FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT doc_id, 2, 'investigation', split_part(text, ':', 1), handwritten OR confidence <= 0.72 FROM lab_line WHERE doc_id % 6 <> 5
        UNION ALL SELECT doc_id, 1, 'medication', upper(replace(p_name, ' ', '-')), handwritten OR confidence <= 0.72 FROM drug_line JOIN part ON doc_id = p_partkey)
        SELECT *, CASE WHEN doc_id % 2 = 0 THEN DATE '2020-03-14' END AS observed_on, CASE WHEN doc_id % 2 = 0 THEN 'document' ELSE 'none' END AS date_source FROM e""")
    def extract_entities(t):
        cols = ["doc_id", "page", "line_no", "text", "confidence", "handwritten"]
        head = t("part").filter("p_partkey % 2 = 0").selectExpr("p_partkey as doc_id", "1 as page", "0 as line_no", "'Date: 14/03/2020' as text", "0.95D as confidence", "false as handwritten")
        end = t("part").filter("p_partkey % 3 = 0").selectExpr("p_partkey as doc_id", "1 as page", "3 as line_no", "'Diagnosis: type ' || p_type || '.' as text", "0.95D as confidence", "false as handwritten")
        return globals()["extract_entities"](t("drug_line").select(cols).unionByName(t("lab_line").select(cols)).unionByName(head).unionByName(end))

    @query("""WITH e AS (SELECT p_size AS doc_id, p_partkey AS ord, p_name AS text, CAST(50 + p_partkey % 50 AS DOUBLE) / 100 AS c, p_partkey % 41 = 0 AS h FROM part),
        b AS (SELECT *, h OR c <= 0.72 AS pending, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS k FROM e)
        SELECT doc_id, ord, CASE WHEN pending THEN 'pending:' || CAST(k AS VARCHAR) ELSE 'recorded:' || CAST(row_number() OVER (PARTITION BY doc_id, pending ORDER BY ord) - 1 AS VARCHAR) END AS item_id, text, pending,
        CASE WHEN pending THEN 'verify' WHEN c >= 0.9 THEN 'high' ELSE 'medium' END AS confidence_band FROM b""")
    def verification_queue(t):
        key = F.col("p_partkey")
        return globals()["verification_queue"](t("part").select(F.col("p_size").alias("doc_id"), key.alias("ord"), F.col("p_name").alias("text"), ((50 + key % 50).cast("double") / 100).alias("confidence"), (key % 41 == 0).alias("handwritten")))

    @query("""WITH i AS (SELECT p_partkey AS item_id, p_partkey % 2 = 0 AS pending, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 9 END AS a FROM part),
        s AS (SELECT *, CASE WHEN a IS NULL THEN CASE WHEN pending THEN 'waiting' ELSE 'recorded' END WHEN a = 0 THEN 'confirmed' WHEN a = 3 THEN 'corrected' WHEN pending THEN 'rejected' ELSE 'disputed' END AS state FROM i)
        SELECT item_id, state, CASE WHEN a = 3 THEN 'read ' || p_name ELSE p_name END AS text, CASE WHEN a = 3 THEN 'dr' END AS read_by, state NOT IN ('waiting', 'rejected') AS is_fact FROM s""")
    def apply_reviews(t):
        key = F.col("p_partkey")
        items = t("part").select(key.alias("item_id"), (key % 2 == 0).alias("pending"), F.col("p_name").alias("text"))
        some = t("part").filter("p_partkey % 3 = 0")
        action = F.when(key % 9 == 0, "confirm").when(key % 9 == 3, "correct").otherwise("dispute")
        of = lambda a, at: some.select(key.alias("item_id"), a.alias("action"), F.concat(F.lit("read "), "p_name").alias("corrected_text"), F.lit("dr").alias("actor"), F.lit(at).alias("at"))
        return globals()["apply_reviews"](items, of(action, 1).unionByName(of(F.lit("dispute"), 0)))

    @query("""SELECT p_partkey AS doc_id, 'medication' AS kind, p_name AS text, 'accepted' AS outcome FROM part UNION ALL SELECT p_partkey, 'diagnosis', p_type, CASE WHEN p_partkey % 3 = 0 THEN 'corrected' ELSE 'warning' END FROM part""")
    def promote_entities(t):
        entity = lambda kind, c, i: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("text"), F.lit(i).cast("int").alias("entityIndex"))
        body = F.to_json(F.array(entity("medication", "p_name", None), entity("diagnosis", "p_type", 1)))
        return globals()["promote_entities"](t("part").select(F.col("p_partkey").alias("doc_id"), body.alias("entities"), F.when(F.col("p_partkey") % 3 == 0, "dr").alias("verified_by")))

    @query("""SELECT p_partkey AS entry_id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, CASE WHEN p_partkey % 4 <> 0 THEN 'documented' ELSE 'patient-reported-current' END AS status, CAST(o_orderdate AS DATE) AS observed_on
        FROM part LEFT JOIN orders ON o_orderkey = p_partkey AND p_partkey % 4 <> 0 AND o_orderkey % 2 = 0""")
    def promote_medications(t):
        key = F.col("p_partkey")
        sources = t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("document_date"))
        return globals()["promote_medications"](t("part").select(key.alias("entry_id"), F.col("p_name").alias("name"), F.when(key % 4 != 0, key).alias("document_ref")), sources)

    @query("""WITH x AS (SELECT p_partkey AS doc_id, p_partkey % 6 AS k, p_partkey % 4 AS r, p_size + CASE p_partkey % 4 WHEN 0 THEN 0.5 ELSE 0 END::DOUBLE AS value FROM part WHERE p_partkey % 6 <> 5),
        y AS (SELECT *, ['hba1c', 'creatinine', 'haemoglobin', 'fasting_glucose', 'urea'][k + 1] AS analyte, CASE r WHEN 0 THEN 4.0 WHEN 2 THEN 40.0 WHEN 3 THEN (CASE WHEN doc_id % 3 = 1 THEN [4.0, 0.6, 12.0, 70.0, 15.0] ELSE [4.0, 0.7, 13.0, 70.0, 15.0] END)[k + 1] END AS low, CASE r WHEN 0 THEN 5.6 WHEN 1 THEN 20.0 WHEN 3 THEN (CASE WHEN doc_id % 3 = 1 THEN [5.6, 1.1, 15.0, 99.0, 40.0] ELSE [5.6, 1.3, 17.0, 99.0, 40.0] END)[k + 1] END AS high FROM x)
        SELECT doc_id, analyte, value, CASE WHEN doc_id % 7 = 0 THEN 'high' WHEN value < low THEN 'low' WHEN value > high THEN 'high' ELSE 'in_range' END AS flag, CASE WHEN doc_id % 7 = 0 THEN 'report' WHEN r = 3 THEN 'table' ELSE 'printed' END AS flag_source FROM y""")
    def promote_observations(t):
        own = F.when(F.col("doc_id") % 7 == 0, "high").when(F.col("doc_id") % 7 == 1, "unknown")
        return globals()["promote_observations"](t("lab_line").withColumn("reported_flag", own))

    @query("""SELECT patient_id, encounter_id, occurred_at AS occurred_on, 'encounter' AS kind, coalesce(trim(headline), 'Visit') AS label FROM encounter
        UNION ALL SELECT patient_id, encounter_id, observed_on, 'medication', name FROM medication UNION ALL SELECT patient_id, encounter_id, observed_on, 'investigation', analyte_key FROM observation""")
    def promote_timeline(t):
        return globals()["promote_timeline"](t("encounter"), t("medication"), t("observation"))

    @query("""WITH k AS (SELECT user_id AS session_id, event_id AS seq, 0 AS pos, event_type AS key FROM events UNION ALL SELECT user_id, event_id, 1, 'error' FROM events WHERE event_id % 2 = 0)
        SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 5 ELSE 0 END + row_number() OVER (PARTITION BY session_id ORDER BY seq, pos) - 1 AS idx, CASE key WHEN 'click' THEN 'term c' ELSE 'term e' END AS term FROM k WHERE key IN ('click', 'error')""")
    def problems_from_choices(t):
        e = t("events")
        value = F.array_compact(F.array(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "error")))
        terms = e.sparkSession.createDataFrame([("click", "term c"), ("error", "term e")], "key string, term string")
        start = t("session").filter("session_id % 2 = 0").select("session_id", F.lit(5).alias("next_idx"))
        return globals()["problems_from_choices"](e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), value.alias("value")), terms, start)

    @query("""WITH l AS (SELECT encounter_id, path, bool_or(value <> 'none') AS has FROM clinical_fact WHERE superseded_by IS NULL AND invalidated_reason IS NULL GROUP BY 1, 2),
        p AS (SELECT * FROM (VALUES (1, 'chief_complaint.text'), (2, 'hpi.site'), (3, 'hpi.onset'), (4, 'hpi.other')) v(i, path))
        SELECT e.encounter_id, coalesce(string_agg(p.path, ',' ORDER BY i) FILTER (has), '') AS collected, coalesce(string_agg(p.path, ',' ORDER BY i) FILTER (NOT has), '') AS declined, coalesce(string_agg(p.path, ',' ORDER BY i) FILTER (has IS NULL), '') AS missing
        FROM encounter e CROSS JOIN p LEFT JOIN l ON l.encounter_id = e.encounter_id AND l.path = p.path GROUP BY 1""")
    def brief_completeness(t):
        return globals()["brief_completeness"](t("encounter"), t("clinical_fact"), ["chief_complaint.text", "hpi.site", "hpi.onset", "hpi.other"])

    @query("""WITH e AS (SELECT fact_id, string_agg(CAST(evidence_id AS VARCHAR) || ':' || source_type, ',' ORDER BY evidence_id, source_type) AS x FROM evidence GROUP BY 1) SELECT f.fact_id, coalesce(x, '') AS evidence FROM clinical_fact f LEFT JOIN e ON f.fact_id = e.fact_id""")
    def evidence_for_facts(t):
        return globals()["evidence_for_facts"](t("clinical_fact"), t("evidence"))

    @query("""WITH s AS (SELECT encounter_id, analyte_key, count(*) AS points, min({'day': observed_on, 'value': CAST(value AS DOUBLE)}) AS f, max({'day': observed_on, 'value': CAST(value AS DOUBLE)}) AS g FROM observation WHERE value IS NOT NULL AND observed_on IS NOT NULL GROUP BY 1, 2),
        c AS (SELECT encounter_id, count(*) FILTER (superseded_by IS NULL) AS fresh, count(*) FILTER (superseded_by IS NOT NULL) AS same FROM clinical_fact GROUP BY 1),
        l AS (SELECT encounter_id, CASE path WHEN 'hpi.site' THEN 'Where it is' WHEN 'chief_complaint.text' THEN 'What brought you in' ELSE path END AS label, value, tier FROM clinical_fact)
        SELECT encounter_id, CASE WHEN tier = 'document' THEN 'from documents' ELSE 'told us' END AS part, label, value FROM l UNION ALL SELECT encounter_id, 'awaiting verification', label, value FROM l WHERE tier <> 'confirmed'
        UNION ALL SELECT encounter_id, CASE status WHEN 'documented' THEN 'from documents' ELSE 'previous visits' END, CASE status WHEN 'documented' THEN 'Medicine on your prescription' ELSE 'Medicine from an earlier visit' END, name || ' ' || dose FROM medication WHERE status <> 'stopped-reported'
        UNION ALL SELECT encounter_id, 'previous visits', analyte_key || ' over time', f.value || ' on ' || f.day || ', ' || g.value || ' on ' || g.day FROM s WHERE points >= 2
        UNION ALL SELECT encounter_id, 'previous visits', 'Compared with your last visit', fresh || ' new thing(s) recorded, ' || same || ' the same as before' FROM c""")
    def patient_view(t):
        lines = t("clinical_fact").select("encounter_id", "path", "value", F.array(F.when(F.col("tier") == "document", "document").otherwise("utterance")).alias("kinds"), (F.col("tier") == "confirmed").alias("confirmed"))
        medicines = t("medication").filter("status <> 'stopped-reported'").select("encounter_id", "name", "dose", (F.col("status") != "documented").alias("earlier"))
        point = F.struct(F.col("observed_on").alias("day"), F.col("value").cast("double").alias("value"))
        series = t("observation").filter("value is not null and observed_on is not null").groupBy("encounter_id", F.col("analyte_key").alias("display")).agg(F.count(F.lit(1)).alias("points"), F.min(point).alias("first"), F.max(point).alias("last"))
        changes = t("clinical_fact").groupBy("encounter_id").agg(F.count_if(F.col("superseded_by").isNull()).alias("fresh"), F.count_if(F.col("superseded_by").isNotNull()).alias("same"))
        return globals()["patient_view"](lines, {"hpi.site": "Where it is", "chief_complaint.text": "What brought you in"}, medicines, series, changes)

    @query("""SELECT session_id, 0 AS section_no, 'facts' AS section, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS line_no, value AS text FROM fact
        UNION ALL SELECT * FROM (SELECT session_id, 1, 'turns', row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS r, text FROM utterance) WHERE r <= 12""")
    def summary_lines(t):
        facts = t("fact").select("session_id", F.col("seq").alias("ord"), F.col("value").alias("text"))
        return globals()["summary_lines"]([("facts", facts), ("turns", t("utterance").select("session_id", F.col("turn_id").alias("ord"), "text"))], {"turns": 12})

    @query("""SELECT 's' || CAST(user_id AS VARCHAR) AS id, count(*) AS turns, count(*) FILTER (event_type = 'error') AS declined, round(sum(CAST(event_id % 100 AS DOUBLE) / 100), 6) AS confidence FROM events WHERE CAST(user_id AS VARCHAR) LIKE '%3%' GROUP BY 1""")
    def read_gold_scripts(t):
        spark = t("events").sparkSession
        path = shared_path(spark, "scripts")
        turn = F.struct(F.col("event_id").cast("string").alias("question_id"), F.col("event_type").alias("utterance"), (F.col("event_id") % 100 / 100).alias("asr_confidence"), (F.col("event_type") == "error").alias("decline"))
        scripts = t("events").groupBy(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        scripts.write.json(path)
        found = globals()["read_gold_scripts"](spark, path, "3", multi_line=False).select("id", F.explode("turns").alias("t"))
        return found.groupBy("id").agg(F.count(F.lit(1)).alias("turns"), F.count_if("t.decline").alias("declined"), F.round(F.sum("t.asr_confidence"), 6).alias("confidence"))

    yes, no = "|".join(YES), "|".join(NO)
    cue = lambda words: "CASE " + " ".join(f"WHEN regexp_matches(lower(whole), '\\b{w}\\b') THEN substr(whole, instr(lower(whole), '{w}'), {len(w)})" for w in sorted(words, key=len, reverse=True)) + " END"

    @query(f"""WITH v AS (SELECT session_id, turn_id, question_id, nullif(trim(text), '') AS text, CASE question_id WHEN 'q0' THEN CASE WHEN regexp_matches(lower(text), '\\b({no})\\b') THEN 'false' WHEN regexp_matches(lower(text), '\\b({yes})\\b') THEN 'true' END
        WHEN 'q1' THEN nullif(regexp_extract(text, '\\b(10|[0-9])\\b', 1), '') ELSE nullif(trim(text), '') END AS value, text AS whole FROM utterance)
        SELECT session_id, turn_id, value, CASE WHEN question_id <> 'q0' THEN value WHEN value = 'false' THEN {cue(NO)} WHEN value = 'true' THEN {cue(YES)} END AS quote, CAST(CASE WHEN value IS NOT NULL THEN CASE question_id WHEN 'q0' THEN 0.8 WHEN 'q1' THEN 0.75 ELSE 0.9 END END AS DOUBLE) AS confidence, CASE WHEN value IS NULL THEN text END AS unplaced FROM v""")
    def extract_slots(t):
        u = t("utterance")
        return globals()["extract_slots"](u, u.sparkSession.createDataFrame([("q0", "boolean"), ("q1", "scale"), ("q2", "open")], "question_id string, kind string"))

    @query("""WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS n, doc_id % 7 IN (0, 1, 5) AS cued, CASE WHEN doc_id % 7 IN (0, 1) THEN CAST(o_orderdate AS DATE) WHEN doc_id % 7 = 2 THEN make_date(year(o_orderdate), 3, 12) WHEN doc_id % 7 = 3 THEN make_date(year(o_orderdate), 3, 1) WHEN doc_id % 7 IN (4, 5) THEN make_date(year(o_orderdate), 1, 1) END AS day,
        CASE WHEN doc_id % 7 < 3 THEN 'exact' WHEN doc_id % 7 = 3 THEN 'month' ELSE 'year' END AS precision FROM date_line d JOIN orders ON d.doc_id = o_orderkey),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT cued, n) AS r FROM l WHERE day IS NOT NULL) SELECT doc_id, day AS document_date, precision FROM r WHERE r = 1""".replace("doc_id % 7", "d.doc_id % 7"))
    def document_date(t):
        lines = t("date_line").join(t("orders"), F.col("doc_id") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), "page", F.col("o_orderkey").alias("line_no"), "text")
        return documents.document_date(lines)
