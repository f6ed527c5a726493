"""Jaccard self-join of documents on word n-grams by MinHash banding.

Documents with the same set of n-grams form one node, so copies never multiply. Band and row counts follow from the
target recall; two nodes are candidates exactly if they share a band hash, and every candidate pair is verified on
the full sets. Nodes are kept in blocks of bounded size: a node's home is the largest bucket that it is in, and
a home is cut into blocks. Buckets give pairs of blocks, each once, and a pair of blocks is compared in one step of a task
that returns counts and a spanning forest, never the pairs of nodes. Nothing is capped: the rule is the same for buckets of any size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.components import components
from careledger.llm.storage import bounded_batches, discard, materialize, tidy, with_row_keys

NGRAM, THRESHOLD = 5, 0.8
#: Share of pairs at the threshold that share a band at least; pairs above it are found more often still.
RECALL, MAX_HASHES = 0.9999, 300
#: N-gram hashes, and nodes, in a block of nodes, about; a block is what one step of a task holds of a side, and a pair of blocks makes matrices of their nodes.
BLOCK_GRAMS, BLOCK_NODES = 1 << 16, 1 << 10
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_COLUMNS = 8192
#: Up to so many candidates in a pair of blocks are intersected one by one.
_FEW = 64
#: Words whose hashes a worker remembers.
_REMEMBERED = 1 << 17


def bands_and_rows(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest false candidates, that reach ``recall`` at ``threshold``."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no banding reaches that recall")


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of lower-case words; a shorter text has one n-gram, all its words."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter((_words[w] for w in found), np.uint64, len(found))
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


@lru_cache(maxsize=4)
def _hashers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 2**32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def band_hashes(x: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature of the set ``x``."""
    a, c = _hashers(bands * rows)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    y = (x >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(y), 512):
        h = y[i : i + 512, None] * a + c
        h ^= h >> np.uint32(15)
        np.minimum(low, h.min(axis=0), out=low)
    acc = np.arange(bands, dtype=np.uint64)
    for r in low.reshape(bands, rows).T:
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + r)
    return acc.view(np.int64)


def _node_key(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, n: int) -> DataFrame:
    """doc_id, node (key of the n-gram set; null without words), grams (size of the set), bands."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, hashes, grams = [], [], []
            for text in batch["text"]:
                x = shingles(text, n)
                nodes.append(_node_key(x))
                grams.append(len(x))
                hashes.append(band_hashes(x, bands, rows) if len(x) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": nodes, "grams": grams, "bands": hashes})

    rows_ = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows_.mapInPandas(tidy(sign, _words), f"doc_id {id_type}, node binary, grams long, bands array<bigint>")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """nid, shingles (binary) of the nodes in ``wanted`` (nid, node, rep), from the texts of their representatives."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, n) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": [_node_key(x) for x in found], "shingles": [x.tobytes() for x in found]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    reps = wanted.select(F.col("rep").alias("_rep")).distinct()
    # The same plan at every size: representatives grow with the input.
    texts = rows.join(reps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    found = texts.mapInPandas(tidy(sets, _words), f"doc_id {id_type}, node binary, shingles binary")
    # A repeated id may bring other sets along; repeats of the same set are one node.
    found = found.join(wanted.select("nid", "node", F.col("rep").alias("_rep")), "node").filter(F.col("doc_id").eqNullSafe(F.col("_rep")))
    return found.dropDuplicates(["nid"]).select("nid", "shingles")


class _Block:
    """The nodes of a block as arrays: nid, n (documents), bands (one row per node) and sets."""

    def __init__(self, items: pa.StructArray):
        self.nid, self.n = (items.field(k).to_numpy(zero_copy_only=False) for k in ("nid", "n"))
        self.bands = items.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
        self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in items.field("shingles")]
        self.size = np.array([len(x) for x in self.sets])


def _candidates(left: _Block, right: _Block, threshold: float) -> np.ndarray:
    """For each pair of nodes: whether they share a band and their sizes allow the threshold."""
    hit = np.zeros((len(left.nid), len(right.nid)), bool)
    for p, q in zip(left.bands.T, right.bands.T, strict=True):
        hit |= p[:, None] == q[None, :]
    hit &= left.size[:, None] >= threshold * right.size[None, :]
    hit &= right.size[None, :] >= threshold * left.size[:, None]
    return hit


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by products of incidence matrices over slices of the shared n-grams."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(shared), _COLUMNS):
        part = shared[i : i + _COLUMNS]

        def incidence(block: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(block), len(part)), np.float32)
            for k, x in enumerate(block):
                y = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]
                at = np.searchsorted(part, y)
                m[k, at[part[at] == y]] = 1
            return m

        out += incidence(left) @ incidence(right).T
    return out


def _links(left: _Block, right: _Block, same: bool, threshold: float) -> np.ndarray:
    """For each pair of nodes whether it is a link: a candidate whose full sets reach the threshold."""
    ask = _candidates(left, right, threshold)
    if same:
        np.fill_diagonal(ask, False)
    i, j = np.nonzero(ask)
    if len(i) <= _FEW:
        both = np.array([len(np.intersect1d(left.sets[a], right.sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:
        rows, cols = np.unique(i), np.unique(j)
        both = _intersections([left.sets[k] for k in rows], [right.sets[k] for k in cols])[np.searchsorted(rows, i), np.searchsorted(cols, j)]
    hit = np.zeros_like(ask)
    if len(i):
        hit[i, j] = both >= threshold * (left.size[i] + right.size[j] - both)
    return hit


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Root of each of ``n`` members after joining i and j."""
    up = list(range(n))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(p), root(q)
        up[max(p, q)] = min(p, q)
    return [root(k) for k in range(n)]


def _linked(block_pairs: DataFrame, threshold: float) -> DataFrame:
    """nid, root, n for every node with links in a pair of blocks: its number of linked documents there, and its root in a forest that spans them."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("same")[k].as_py()
                left = _Block(batch.column("left")[k].values)
                right = left if same else _Block(batch.column("right")[k].values)
                hit = _links(left, right, same, threshold)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                names = left.nid if same else np.concatenate([left.nid, right.nid])
                count = np.bincount(i, right.n[j], len(left.nid))
                count = count if same else np.concatenate([count, np.bincount(j, left.n[i], len(right.nid))])
                root = names[_forest(i, j if same else j + len(left.nid), len(names))]
                some = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (names, root, count)], ["nid", "root", "n"])

    return block_pairs.select("same", "left", "right").mapInArrow(tidy(link), "nid bigint, root bigint, n bigint")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, copies.

    A link is a pair of documents whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more; n_links counts a document's,
    copies of the same set included. class_id is the smallest id that links reach; copies is the number of
    documents with the same set. Words are runs of anything but ASCII white space, in lower case. A null, empty or blank text has no
    n-grams and is a class of its own; a text of fewer than n words is one n-gram. Null ids are
    kept and lose against other ids. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    bands, rows = bands_and_rows(threshold, recall)
    signed = materialize(signatures(docs, id_col, text_col, bands, rows, n), "ngram-signatures")
    worded = signed.filter("node is not null")
    nodes = worded.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "ngram-nodes")

    # Buckets with at least two nodes, and the nodes in them. Copies were one node before bands are taken apart.
    occurs = nodes.select("nid", F.explode("bands").alias("band"))
    sizes = materialize(occurs.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "ngram-buckets")
    hits = materialize(occurs.join(sizes, "band").select("nid", "band", "size"), "ngram-hits")
    home = hits.groupBy("nid").agg(F.max(F.struct("size", "band")).alias("home"))
    home = home.join(nodes.select("nid", "node", "rep", "copies", "grams", "bands"), "nid").withColumn("home", F.col("home.band"))
    home = materialize(home, "ngram-home")
    cuts = materialize(home.groupBy("home").agg(F.ceil(F.greatest(F.sum("grams") / BLOCK_GRAMS, F.count(F.lit(1)) / BLOCK_NODES)).alias("cuts")), "ngram-cuts")
    # A block's name may be shared by chance; that only makes a larger block.
    named = materialize(home.select("nid", "home").join(cuts, "home").select("nid", F.xxhash64("home", F.pmod(F.xxhash64("nid"), "cuts")).alias("block")), "ngram-named")

    seen = materialize(hits.join(named, "nid").select("band", "block").distinct(), "ngram-seen")
    other = seen.select("band", F.col("block").alias("b"))
    pairs = materialize(seen.select("band", F.col("block").alias("a")).join(other, "band").filter("a <= b").select("a", "b").distinct(), "ngram-pairs")

    sets = _sets_of(docs, home.select("nid", "node", "rep"), id_col, text_col, n)
    items = home.select("nid", F.col("copies").alias("n"), "bands").join(sets, "nid").join(named, "nid")
    blocks = materialize(items.groupBy("block").agg(F.collect_list(F.struct("nid", "n", "bands", "shingles")).alias("items")), "ngram-blocks")
    left, right = (blocks.select(F.col("block").alias(k), F.col("items").alias(v)) for k, v in (("a", "left"), ("b", "right")))
    met = pairs.join(left, "a").join(right, "b").select((F.col("a") == F.col("b")).alias("same"), "left", "right")
    links = materialize(_linked(met, threshold), "ngram-links")
    discard(sizes, hits, cuts, named, seen, pairs, blocks)

    counts = links.groupBy("nid").agg(F.sum("n").alias("linked"))
    roots = components(links.select(F.col("nid").alias("a"), F.col("root").alias("b")).distinct())
    roots = materialize(roots.withColumnRenamed("node", "nid").join(nodes.select("nid", "rep"), "nid"), "ngram-roots")
    classes = materialize(roots.groupBy("root").agg(F.min("rep").alias("class_id")), "ngram-classes")
    linked = roots.join(classes, "root").join(counts, "nid").select("nid", "class_id", "linked")
    known = nodes.select("nid", "node", "rep", "copies").join(linked, "nid", "left")
    known = known.select("node", "copies", F.when(F.col("linked").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    known = materialize(known, "ngram-known")
    discard(home, links, roots, classes, nodes)
    out = worded.select("doc_id", "node").join(known, "node").select("doc_id", "class_id", "n_links", "copies")
    bare = signed.filter("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    found = out.unionByName(bare)
    found.rests_on = [signed, known]
    return found


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per class, with all columns: that of the smallest id, null ids last.

    Rows are told apart by a key of their own, so ids may repeat across different texts or be null; of rows with one id the
    smaller hash of the text decides, and repeats of one row are interchangeable. Rows without words all stay. Columns may have any
    names. An empty table gives no rows.
    """
    columns = docs.columns
    keyed = with_row_keys(docs, "ngram-rows")
    texts = keyed.select("rid", F.col(f"row.{text_col}").alias("text"))
    joined = ngram_jaccard_join(texts, "rid", "text")
    classes = joined.select(F.col("doc_id").alias("rid"), "class_id")
    place = F.struct(F.col(f"row.{id_col}").isNull().alias("no_id"), F.col(f"row.{id_col}").alias("id"), F.xxhash64(f"row.{text_col}").alias("digest"), "rid")
    first = keyed.select("rid", place.alias("place")).join(classes, "rid").groupBy("class_id").agg(F.min("place").alias("first"))
    kept = materialize(first.select(F.col("first.rid").alias("rid")), "ngram-kept")
    discard(*joined.rests_on)
    return keyed.join(kept.hint("merge"), "rid", "left_semi").select(*[F.col(f"row.`{c}`") for c in columns])
