"""Maximal periodic runs of words by internal pattern matching.

A run of period q and length at least 2 q repeats each stretch of it that is q words away from its end. So for a block of l words out of
a run's first part, the run's period is among the distances to the block's next occurrences. Blocks of every dyadic length lie half their
length apart, and each asks for its occurrences in the window of 3 l words that follows: they are one interval of the suffix array, and a
wavelet tree over it gives the next one in text order (range successor). Occurrences that overlap make arithmetic progressions, which
are followed to their end in one step. Each distance is then extended both ways as far as words agree, which gives the run or rules it out.

Documents of a batch are handled together as arrays; words of different documents are different symbols, so nothing crosses a border.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.llm.storage import bounded_batches, tidy

LEAST_LENGTH = 12
#: The shortest block; half its length more, less one, is at most what the shortest run repeats (6 words).
_SHORTEST = 2  # as a power of two
#: Words that are searched together, about.
_WORDS = 1 << 18


class _WaveletTree:
    """The numbers 0 to m - 1 in any order; per bit from the top, the ones before each place, with numbers dealt by that bit."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest number that is x or more among places lo to hi - 1; -1 where there is none."""
        beyond = x >> self.bits > 0
        a, b, smaller = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            a1, b1 = ones[a], ones[b]
            up = (x >> bit) & 1 == 1
            smaller += np.where(up, (b - b1) - (a - a1), 0)
            a, b = np.where(up, zeros + a1, a - a1), np.where(up, zeros + b1, b - b1)
        missing = beyond | (smaller >= hi - lo)
        a, b, nth, found = lo.copy(), hi.copy(), np.where(missing, 0, smaller), np.zeros(len(lo), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            a1, b1 = ones[a], ones[b]
            low = (b - b1) - (a - a1)
            up = nth >= low
            nth = np.where(up, nth - low, nth)
            found |= up.astype(np.int64) << bit
            a, b = np.where(up, zeros + a1, a - a1), np.where(up, zeros + b1, b - b1)
        return np.where(missing, -1, found)


class _Repeats:
    """Classes of equal stretches of 1, 2, 4, ... words by prefix doubling; -1 where no other stretch is equal."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        now = np.where(np.bincount(symbols)[symbols] > 1, symbols, -1).astype(np.int64)
        self.levels, h = [now], 1
        while h < self.n:
            at = np.flatnonzero((now[:-h] >= 0) & (now[h:] >= 0))
            key = now[at] * (now.max() + 1) + now[at + h]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            name = np.cumsum(new) - 1
            several = np.bincount(name, minlength=1)[name] > 1
            if not several.any():
                break
            now = np.full(self.n, -1, np.int64)
            now[at[order[several]]] = name[several]
            self.levels.append(now)
            h *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            p, q = i + same, np.minimum(j + same, self.n - 1)
            level = self.levels[k]
            same += np.where((j + same < self.n) & (level[p] >= 0) & (level[p] == level[q]), 1 << k, 0)
        return same

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            p, q = np.maximum(i - same - (1 << k), 0), np.maximum(j - same - (1 << k), 0)
            level = self.levels[k]
            same += np.where((i - same >= 1 << k) & (level[p] >= 0) & (level[p] == level[q]), 1 << k, 0)
        return same


def _periods(text: _Repeats, tree: _WaveletTree, starts: np.ndarray, sa: np.ndarray, place: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, distance) of the occurrences that follow blocks of 2 ** k words, progression by progression."""
    length, level = 1 << k, text.levels[k]
    block = np.arange(0, text.n, length // 2)
    block = block[level[block] >= 0]
    name = level[sa]
    edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    nth = np.searchsorted(edge, place[block], "right") - 1
    lo, hi = edge[nth], np.append(edge, len(sa))[nth + 1]
    now, last = block, block + 3 * length - 2
    while len(block):
        found = tree.successor(lo, hi, np.searchsorted(starts, now + 1))
        following = starts[found]
        near = (found >= 0) & (following <= last)
        block, lo, hi, now, last, following = (x[near] for x in (block, lo, hi, now, last, following))
        if not len(block):
            return
        step = following - now
        # Occurrences that overlap or touch go on with that step up to the end of the stretch of that period.
        end = following + np.where(step <= length, text.ahead(now, following), length)
        times = (end - length - now) // step
        # Multiples of a block's own step lie in one run of that smaller period.
        told = np.where(now == block, 1, np.minimum(times, (last - now) // step))
        which = np.repeat(np.arange(len(block)), told)
        i = np.arange(len(which)) - np.repeat(np.cumsum(told) - told, told) + 1
        yield block[which], now[which] + i * step[which] - block[which]
        now = now + times * step


def find_runs(symbols: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs of at least ``least`` (12 or more) symbols and two periods, by start, then period."""
    if least < LEAST_LENGTH:
        raise ValueError("blocks are too long for runs that short")
    none = (np.empty(0, np.int64),) * 3
    if len(symbols) < least:
        return none
    text = _Repeats(symbols)
    if len(text.levels) <= _SHORTEST:
        return none
    starts = np.flatnonzero(text.levels[_SHORTEST] >= 0)
    order = np.lexsort([level[starts] for level in reversed(text.levels[_SHORTEST:])])
    sa = starts[order]
    place = np.full(text.n, -1, np.int64)
    place[sa] = np.arange(len(sa))
    tree = _WaveletTree(order)
    found = [none]
    for k in range(_SHORTEST, len(text.levels)):
        for block, period in _periods(text, tree, starts, sa, place, k):
            begin = block - text.behind(block, block + period)
            length = block + period + text.ahead(block, block + period) - begin
            long_ = length >= np.maximum(least, 2 * period)
            found.append((begin[long_], length[long_], period[long_]))
    begin, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, begin))
    begin, length, period = begin[order], length[order], period[order]
    # Of one stretch the smallest period counts.
    first = np.concatenate([[True], (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])])[: len(begin)]
    begin, length, period = begin[first], length[first], period[first]
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]


def _search(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, pa.StructArray, list[bytes]]:
    """Runs of documents searched together: number of each document's, the runs, and the words kept of each document."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    symbols, base = np.empty(begins[-1], np.int64), 0
    for words, at, end in zip(texts, begins[:-1], begins[1:], strict=True):
        names = dict.fromkeys(words)
        names = dict(zip(names, range(base, base + len(names)), strict=True))
        symbols[at:end] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        base += len(names)
    start, length, period = find_runs(symbols, least)
    doc = np.searchsorted(begins, start, "right") - 1
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change)[:-1] == 0
    count = np.bincount(doc, minlength=len(texts))
    kept = [b" ".join(compress(w, keep[a:e].tolist()) if c else w) for w, c, a, e in zip(texts, count, begins[:-1], begins[1:], strict=True)]
    return count, pa.StructArray.from_arrays([pa.array(x) for x in (start - begins[doc], length, period)], ["start", "length", "period"]), kept


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, prepare: Callable | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period by start, then period), collapsed.

    Words are runs of anything but ASCII white space in the whole text, as they are; a null, empty or blank text has none. ``prepare(id, words)``
    may change a document's words before the search. A run is a stretch of at least ``least`` words and two periods that is as long as its smallest period allows.
    ``collapsed`` holds the words, joined by one space, that no run contains after its first period. Rows are handled each by itself: repeated
    rows and ids give the same result as often, null ids stay. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            count, runs, kept = _search(texts, least)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            columns = [pa.array(ids, id_arrow), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(offsets, runs), pa.array(kept, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            id_arrow, ids, texts, held = batch.schema.field(0).type, [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []  # of bytes it knows ASCII only
                i = i.as_py()
                words = prepare(i, words) if prepare and words else words
                if held and held + len(words) > _WORDS:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(words)
                held += len(words)
            if ids:
                yield out(ids, texts)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(search), f"doc_id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def longest_run(runs: Column) -> Column:
    """Of an array of runs the longest, then the first, then that of the smallest period; null without runs."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(key)


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of documents with crc32(doc_id) % 10 == 0 the words, repeated from a place on with a period, both of which follow from that checksum; other documents
    and those without an id stay."""
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def digest_of_runs(runs: Column) -> Column:
    """SHA-256 of the lines ``start,length,period`` of an array of runs."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)
