"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target / source size. Its whole
part is taken; the fraction is settled by pairing documents and moving probability mass between the two,
in words, until one of them is integral. The words of a pair stay the same, so a source's words
stay on target up to the last open document, which goes by its own
probability. Blocks of bounded size are folded in parallel; each leaves one open document, and these are combined level by level in a reduction tree. A block is
folded from its largest document to its smallest, so that large ones are settled against their like and what is left open is small. What the last one leaves over or
short is then made good by changing sides of some settled documents, a bounded choice of each order of size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careledger.llm.storage import discard, materialize, with_row_keys

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 3
#: Documents in a block of the tree, about; a block that came out larger is cut at twice as many.
BLOCK = 64

#: Documents of each order of size that may change sides in the end.
MAKE_GOOD = 64
#: Share of its target that a source may be off before other choices are tried, and how many.
NEAR, TRIES = 0.002, 1024

#: By falling size first: that is the order in which a block is folded.
ITEM = "struct<less:bigint,h:bigint,blk:bigint,rn:bigint,rid:bigint,size:bigint,m:double>"


def word_count(text: Column) -> Column:
    """Number of words; none for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source: source, n_docs, source_size, target. One row per source; ``sized`` has source and size.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at ``max_repeat`` times the source's
    size and the excess is shared again by weight: with sources ordered by the share at which they are
    full, the common share of the others is the largest of the candidates (all - full ones) / (open weights).
    """
    by = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order, every = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy(F.lit(1))
    by = by.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    full = Window.orderBy(cap / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum(cap).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("share", (F.sum("source_size").over(every) - before) / open_weight)
    return by.select("source", "n_docs", "source_size", F.least(cap, F.max("share").over(every) * F.col("weight")).alias("target"))


def _fold() -> str:
    """SQL that settles an array ``items`` of open documents down to one: struct(r: the open one, done: the settled ones)."""
    done = "struct<h:bigint,rid:bigint,size:bigint,up:int>"
    moved = "named_struct('a', acc.r.m + if(s.u * (s.d1 + s.d2) < s.d2, s.d1, -s.d2), 'b', x.m - if(s.u * (s.d1 + s.d2) < s.d2, s.d1, -s.d2))"
    settle = "named_struct('h', {0}.h, 'rid', {0}.rid, 'size', {0}.size, 'up', if({1} * 2 > {0}.size, 1, 0))"
    open_ = "named_struct('less', {0}.less, 'h', {0}.h, 'blk', {0}.blk, 'rn', {0}.rn, 'rid', {0}.rid, 'size', {0}.size, 'm', {1})"
    whole = "t.a <= 1e-9 * acc.r.size or t.a >= (1 - 1e-9) * acc.r.size"
    step = f"""if({whole},
        named_struct('r', {open_.format('x', 't.b')}, 'done', concat(acc.done, array({settle.format('acc.r', 't.a')}))),
        named_struct('r', {open_.format('acc.r', 't.a')}, 'done', concat(acc.done, array({settle.format('x', 't.b')}))))"""
    return f"""aggregate(slice(items, 2, size(items)),
        named_struct('r', items[0], 'done', cast(array() as array<{done}>)),
        (acc, x) -> transform(transform(
            array(named_struct('d1', least(acc.r.size - acc.r.m, x.m), 'd2', least(acc.r.m, x.size - x.m),
                               'u', shiftrightunsigned(xxhash64(acc.r.h, x.h), 11) / 9007199254740992D)),
            s -> {moved}), t -> {step})[0])"""


def _make_good(decided: DataFrame, gaps: DataFrame, seed: int) -> DataFrame:
    """rid, changed (true) of the documents that change sides so that what a source is ``over`` (or short, below 0) all but goes.

    Of each side and order of size MAKE_GOOD documents are looked at, by a hash. From large to small, one on the side that is too full changes if
    it is no larger than what is left to make good. Where more than NEAR of the target is left then, as in sources of few unequal documents, those that were looked
    at are taken anew in TRIES random orders, each as long as it fits or is hardly over, and the nearest outcome replaces the present one, if it is nearer.
    """
    gaps = gaps.select(F.col("source").alias("_s"), "over", "target").filter("over <> 0")
    rows = decided.join(gaps, decided["source"].eqNullSafe(F.col("_s"))).withColumn("full", F.col("up") == (F.col("over") > 0).cast("int")).withColumn("tie", F.xxhash64("h", F.lit(seed + 3)))
    some = Window.partitionBy("source", "full", F.floor(F.log2("size"))).orderBy("tie", "rid")
    rows = rows.withColumn("nth", F.row_number().over(some)).filter(F.col("nth") <= MAKE_GOOD)
    item = F.struct((-F.col("size")).alias("less"), "tie", "rid", "size")
    by = rows.groupBy("source").agg(F.first("over").alias("over"), F.first(F.abs("over")).alias("off"), F.first("target").alias("target"), F.sort_array(F.collect_list(F.when(F.col("full"), item))).alias("items"), F.sort_array(F.collect_list(F.when(~F.col("full"), item))).alias("others"))
    fold = """aggregate(items, named_struct('left', off, 'rids', cast(array() as array<bigint>)), (acc, x) ->
        if(x.size <= acc.left, named_struct('left', acc.left - x.size, 'rids', concat(acc.rids, array(x.rid))), acc))"""
    by = by.withColumn("f", F.expr(fold))
    # What is left under the smallest size can't be made good by whole documents but by chance.
    least = "array_min(transform(concat(items, others), x -> x.size))"
    by = by.withColumn("taken", F.expr("if(over > 0, items, others)")).withColumn("want", F.expr("aggregate(taken, -over, (acc, x) -> acc + x.size)"))
    order = "array_sort(transform(concat(items, others), x -> struct(xxhash64(x.tie, k) as h, x.size as size, x.rid as rid)))"
    attempt = f"""aggregate({order}, named_struct('left', want + k % 4 * {NEAR} * target, 'rids', cast(array() as array<bigint>)), (acc, x) ->
        if(x.size <= acc.left, named_struct('left', acc.left - x.size, 'rids', concat(acc.rids, array(x.rid))), acc))"""
    best = f"array_min(transform(sequence(1, {TRIES}), k -> transform(array({attempt}), t -> named_struct('off', abs(t.left - k % 4 * {NEAR} * target), 'k', k, 'rids', t.rids))[0]))"
    by = by.withColumn("best", F.when(F.expr(f"f.left > greatest({least}, {NEAR} * target)"), F.expr(best)))
    before = F.transform("taken", lambda x: x["rid"])
    other = F.concat(F.array_except(before, "best.rids"), F.array_except("best.rids", before))
    rids = F.when(F.col("best.off") < F.col("f.left"), other).otherwise(F.col("f.rids"))
    return by.select(F.explode(rids).alias("rid"), F.lit(True).alias("changed"))


def _decide(rows: DataFrame, seed: int) -> DataFrame:
    """rid, source, size, source_size, target, copies of ``rows`` (rid: unique; id, source, size, text_hash)."""
    targets = materialize(source_targets(rows), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + 1e-9)
    rated = targets.select("*", base.cast("int").alias("base"), F.greatest(rate - base, F.lit(0.0)).alias("frac"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK)).alias("nblk"))
    rows = rows.join(rated, rows["source"].eqNullSafe(rated["source"])).drop(rated["source"])
    is_open = (F.col("frac") > 1e-9) & (F.col("size") > 0)

    # Leaves: blocks by a hash of id and text; within one, rows are numbered, so that even many repeats can't make a large array.
    leaf = rows.filter(is_open).withColumn("h", F.xxhash64("id", "text_hash", F.lit(seed)))
    leaf = leaf.withColumn("blk", F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.col("nblk")))
    leaf = leaf.withColumn("rn", F.row_number().over(Window.partitionBy("source", "blk").orderBy("h", "id", "text_hash", "rid")).cast("long"))
    level = leaf.select("source", "nblk", F.col("blk").alias("at"), F.floor(F.col("rn") / (2 * BLOCK)).alias("cut"), F.struct((-F.col("size")).alias("less"), "h", "blk", "rn", "rid", "size", (F.col("frac") * F.col("size")).alias("m")).cast(ITEM).alias("item"))
    width = targets.agg(F.max("n_docs")).first()[0] or 0
    parts, levels = [], []
    while True:
        folded = level.groupBy("source", "nblk", "at", "cut").agg(F.sort_array(F.collect_list("item")).alias("items"))
        folded = materialize(folded.select("source", "nblk", "at", F.expr(_fold()).alias("f")), "mix-level")
        levels.append(folded)
        parts.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.*"))
        width = -(-width // BLOCK)
        if width <= 1 and folded.groupBy("source").count().filter("count > 1").isEmpty():
            break
        # Each level has so many fewer groups; cuts of a large leaf meet again here.
        fewer = F.greatest(F.lit(1), F.ceil(F.col("nblk") / BLOCK))
        level = folded.select("source", fewer.alias("nblk"), F.pmod(F.col("at"), fewer).alias("at"), F.lit(0).cast("long").alias("cut"), F.col("f.r").alias("item"))

    # The last open document of a source has no partner left: it is taken by its own probability.
    settled = materialize(reduce(DataFrame.unionByName, parts), "mix-settled")
    chance = F.shiftrightunsigned(F.xxhash64("h", F.lit(seed + 2)), 11) / F.lit(float(1 << 53))
    last = folded.select("source", F.col("f.r.*")).withColumn("up", (chance * F.col("size") < F.col("m")).cast("int"))
    last = materialize(last.select("source", "h", "rid", "size", "up", (F.when(F.col("up") == 1, F.col("size")).otherwise(0) - F.col("m")).alias("over")), "mix-last")
    decided_ = settled.select("source", "h", "rid", "size", "up").unionByName(last.drop("over"))
    gaps = last.select("source", "over").join(targets.select(F.col("source").alias("_t"), "target"), F.col("source").eqNullSafe(F.col("_t")))
    change = materialize(_make_good(decided_, gaps, seed), "mix-change")
    rounded = decided_.join(change.hint("merge"), "rid", "left").select("rid", F.when(F.col("changed"), 1 - F.col("up")).otherwise(F.col("up")).alias("up"))
    decided = rows.join(rounded, "rid", "left").withColumn("copies", (F.col("base") + F.coalesce("up", F.lit(0))).cast("int"))
    decided = materialize(decided.select("rid", "id", "source", "size", "source_size", "target", "copies"), "mix-decided")
    discard(targets, settled, last, change, *levels)
    return decided


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is whole and at most MAX_REPEAT; taken = copies * size. Choices depend on ids, texts and the seed only, so
    reruns agree. Null and empty texts have size 0, get the whole part of their copies and take no words.
    Null sources form a source of their own. Repeated rows are separate documents, alike in all that decides; null ids are ids like others.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    return _decide(rows, seed).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """``docs`` with each row as often as mix_sources takes it; rows that it doesn't take go. All columns are kept, whatever their names.

    Rows are told apart by a key of their own, so ids may repeat or be null. A null or empty text has no words; such a row is taken by the whole
    part of its source's rate only. An empty table gives no rows.
    """
    columns = docs.columns
    keyed = with_row_keys(docs, "mix-rows", size=word_count(F.col(text_col)), text_hash=F.xxhash64(text_col))
    rows = keyed.select("rid", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{source_col}`").alias("source"), "size", "text_hash")
    taken = _decide(rows, seed).filter("copies > 0").select("rid", "copies")
    repeated = keyed.select("rid", "row").join(taken.hint("merge"), "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"row.`{c}`") for c in columns])
