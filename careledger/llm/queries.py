"""The numbered operators as queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careledger.llm import ann, exact, html, mixing, ngram_join, packing, quality, runs, sharding, simhash, toxicity, warc, whitening
from careledger.llm.storage import table

SHARDS = 16


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts of shards differ by one at most."""
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.bounded_ring_shards(rows, "doc_id", SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by a checksum of the id, is given a periodic tail first."""
    found = runs.detect_runs(table(spark, sf_dir, "documents"), prepare=runs.periodic_tail)
    found = found.select("doc_id", "runs", "collapsed", runs.longest_run(F.col("runs")).alias("best"))
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), runs.digest_of_runs(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ring_sharding": op1_ring_sharding,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_ngram_join": op6_ngram_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_runs": op13_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
        SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100""",
    "op6_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b, k = na.n AND k = nb.n AS same FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE k >= 0.8 * (na.n + nb.n - k)),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM r JOIN l ON r.doc_id = a)
        SELECT d.doc_id, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS class_id,
               (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links, 1 + (SELECT count(*) FROM l WHERE a = d.doc_id AND same) AS copies
        FROM documents d""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
        k AS (SELECT n, count(*) AS group_size, arg_min(doc_id, {'c': -length(t), 'i': doc_id}) AS keep_id FROM d GROUP BY n)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(d.n) AS text_sha256
        FROM d JOIN k ON d.n = k.n""",
}
