"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are split by successive runs of bytes of their normalised text. After each round a
group is either a single document (settled: unique), ended (all its bytes were read, so its
members are equal), or carried into the next round with the bytes not yet read. Groups are keys of
hash aggregations and joins on the bytes themselves, so equality never rests on a digest. Only a round's bytes are dealt by group;
texts move by a key of their row, so a group of any size never gathers its texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.llm.storage import discard, materialize, with_row_keys

#: White space that doesn't count when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"

FIRST_WIDTH, GROWTH, MAX_WIDTH = 32, 4, 1 << 20


def normalized(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def radix_groups(docs: DataFrame, row_col: str = "rid", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, whose ``row_col`` is unique: rid, id, chars, text_sha256, round, gid, n.

    Rows with equal (round, gid) have equal normalised texts and n is their number; a unique row has n = 1
    and a null gid. The width of the bytes read grows by GROWTH each round, so the number of
    rounds is logarithmic in the longest shared prefix and only colliding documents carry text on.
    """
    text = normalized(F.col(text_col))
    active = docs.select(
        F.col(row_col).alias("rid"),
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
        F.sha2(text, 256).alias("text_sha256"),
        F.encode(text, "UTF-8").alias("rest"),
    )
    active = materialize(active.withColumn("gid", F.lit(0).cast("long")), "radix-texts")
    settled, rounds, width, step = [], [], FIRST_WIDTH, 0
    while True:
        keyed = active.select("rid", "id", "chars", "text_sha256", "gid", F.expr(f"substring(rest, 1, {width})").alias("digits"), (F.octet_length("rest") < width).alias("ended"))
        groups = materialize(
            keyed.groupBy("gid", "digits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("next", F.monotonically_increasing_id()),
            "radix-groups",
        )
        # The groups grow with the input, so they are never broadcast: the same plan holds at every size.
        joined = keyed.join(groups.hint("merge"), ["gid", "digits"], "left")
        out = joined.select("rid", "id", "chars", "text_sha256", F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.col("next").alias("gid"), (F.col("n").isNotNull() & ~F.col("ended")).alias("open"))
        out = materialize(out, "radix-round")
        rounds.append(out)
        settled.append(out.filter("not open").select("rid", "id", "chars", "text_sha256", F.lit(step).alias("round"), "gid", "n"))
        still = out.filter("open").select("rid", "gid")
        if still.isEmpty():
            discard(groups, active)
            found = reduce(DataFrame.unionByName, settled)
            found.rests_on = rounds
            return found
        rest = active.select("rid", "id", "chars", "text_sha256", F.expr(f"substring(rest, {width + 1})").alias("rest")).join(still.hint("merge"), "rid")
        following = materialize(rest, "radix-texts")
        discard(groups, active)
        active, width, step = following, min(width * GROWTH, MAX_WIDTH), step + 1


def _with_kept(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The unique rows of radix_groups, and the others with their group's ``best``: the row (chars, id, rid) that stays; and the written table of these."""
    many = rows.filter("n > 1")
    place = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), "rid")
    # Written before it is joined: of two plain shuffles Spark can split the part of a large group.
    best = materialize(many.groupBy("round", "gid").agg(F.min(place).alias("best")), "radix-best")
    return rows.filter("n = 1"), many.join(best, ["round", "gid"]), best


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest id. Null and empty
    texts are equal to one another. A null id loses a tie against any other id; of rows that repeat both
    id and length exactly one stays. An empty table gives no rows; other columns are ignored.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    single, many, _ = _with_kept(radix_groups(keyed, "rid", "id", "text"))
    single = single.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return single.unionByName(
        many.select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns, whose names may be any.

    Rows are told apart by a key of their own, so ids may repeat or be null: of each text exactly one row stays, null and empty
    texts being one text. Very long texts are compared whole. An empty table gives no rows.
    """
    columns = docs.columns
    keyed = with_row_keys(docs, "radix-rows")
    texts = keyed.select("rid", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    groups = radix_groups(texts, "rid", "id", "text")
    single, many, best = _with_kept(groups)
    kept = materialize(single.select("rid").unionByName(many.filter("rid = best.rid").select("rid")), "radix-kept")
    discard(best, *groups.rests_on)
    return keyed.join(kept.hint("merge"), "rid", "left_semi").select(*[F.col(f"row.`{c}`") for c in columns])
