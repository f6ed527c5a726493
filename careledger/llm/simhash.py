"""SimHash near-duplicates by an inverted index of positional bytes with count filtering.

A fingerprint has eight bytes. Two that differ in at most ``max_bits`` bits differ in at most so many bytes, so the count filter
asks for 8 - max_bits shared positional bytes at least. Postings of single bytes hold 1/256 of the corpus each and would pair
all of it, so postings are intersected before pairs are tallied: the index has one posting for each choice of 8 - max_bits positions and
their bytes, and two fingerprints meet there exactly if their tally reaches the minimum. Equal fingerprints are one entry, so
a posting holds 256 ** max_bits entries at most, whatever the corpus. Meetings are verified on the bytes that are left: each
entry looks up those that differ in few enough bits, and a posting returns a forest that spans its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.components import components
from careledger.llm.storage import bounded_batches, discard, materialize, tidy

SHINGLE, MAX_BITS, SEED = 3, 2, 42
BYTES = 8
#: Shingles whose bits are added up at once.
_CHUNK = 1 << 14
#: Lookups at once.
_LOOKUPS = 1 << 20


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a UTF-8 text: bit b is 1 if it is in over half of the XXH64 values (seed 42) of its n-word shingles.

    Words are runs of anything but ASCII white space, A-Z in lower case; shingles count as often as they occur. Fewer words than n are
    one shingle; without words the fingerprint is zero.
    """
    import xxhash

    line = b" ".join(text.lower().split())  # of bytes both know ASCII only
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begins = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    k = min(n, len(begins))
    parts = map(line.__getitem__, map(slice, begins[: len(begins) - k + 1], ends[k - 1 :]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(begins) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long) of every row; a null text has no words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", n) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(sign), f"doc_id {id_type}, fp bigint")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` members' component after joining i and j."""
    up = np.arange(n)
    while True:
        low, high = np.minimum(up[i], up[j]), np.maximum(up[i], up[j])
        if np.array_equal(low, high):
            return up
        np.minimum.at(up, high, low)
        while not np.array_equal(up, up[up]):
            up = up[up]


def _verified(posting: np.ndarray, rest: np.ndarray, flips: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries (as places) of one posting each whose other bytes ``rest`` differ by one of ``flips``."""
    code = (posting << width) | rest
    order = np.argsort(code)
    code = code[order]
    left, right = [], []
    for at in range(0, len(code), max(1, _LOOKUPS // len(flips))):
        part = code[at : at + max(1, _LOOKUPS // len(flips))]
        asked = part[:, None] ^ flips
        row, col = np.nonzero(asked > part[:, None])  # each pair from its smaller entry
        asked = asked[row, col]
        place = np.minimum(np.searchsorted(code, asked), len(code) - 1)
        hit = code[place] == asked
        left.append(row[hit] + at)
        right.append(place[hit])
    return order[np.concatenate(left)], order[np.concatenate(right)]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: edges between distinct fingerprints ``fp`` whose components are those of all pairs at most ``max_bits`` (1 or 2) bits apart."""
    if max_bits not in (1, 2):
        raise ValueError("postings are bounded for one or two bits only")
    free = list(combinations(range(BYTES), max_bits))
    whole = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(whole ^ sum(255 << 8 * p for p in left)) for left in free]
    width = 8 * max_bits
    flips = np.array(sorted({sum(1 << b for b in bits) for k in range(1, max_bits + 1) for bits in combinations(range(width), k)}), np.int64)
    shifts = np.array(free) * 8

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(slot: np.ndarray, part: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
            size = np.diff(np.append(starts, len(fp)))
            posting = np.repeat(np.arange(len(starts)), size)
            several = np.repeat(size > 1, size)
            slot, fp, posting = slot[several], fp[several], posting[several]
            if not len(fp):
                return None
            rest = sum(((fp >> shifts[slot, k]) & 255) << 8 * k for k in range(max_bits))
            i, j = _verified(posting, rest, flips, width)
            up = _roots(len(fp), i, j)
            linked = up != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[up[linked]])], ["a", "b"])

        kept = [np.empty(0, np.int64)] * 3
        for batch in batches:
            got = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True)]
            if not len(got[0]):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1])]))
            last = starts[-1]  # may go on in the next batch; a posting's size is bounded
            found = joined(*[x[:last] for x in got], starts[:-1]) if last else None
            kept = [x[last:] for x in got]
            if found:
                yield found
        if len(kept[0]) and (found := joined(*kept, np.zeros(1, np.int64))):
            yield found

    postings = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks)]))
    index = fps.select("fp", postings.alias("p")).select("p.slot", "p.part", "fp")
    return index.repartition("slot", "part").sortWithinPartitions("slot", "part").mapInArrow(tidy(meet), "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, n: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id: the smallest id that links reach.

    Fingerprints link at ``max_bits`` or fewer differing bits. Null, empty and blank texts have the fingerprint zero, which links like any other;
    texts of any length are read whole. Repeated rows and rows that share an id are rows of their own. A null id is kept and never the smallest; a
    component of null ids only has a null component_id. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    signed = materialize(fingerprints(docs, id_col, text_col, n), "simhash-signed")
    nodes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = materialize(links(nodes.select("fp"), max_bits).distinct(), "simhash-links")
    roots = materialize(components(edges), "simhash-roots")
    rooted = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    known = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-known")
    discard(nodes, edges, roots, rooted, least)
    # Both sides are written tables, so that Spark can split the share of a very common fingerprint.
    found = signed.join(known.hint("merge"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
