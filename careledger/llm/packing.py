"""Packing token sequences along a Hilbert curve through hashed document vectors.

Each document is tokenised once; its hashed bag of tokens is projected to a few dimensions, which give its key on the
curve. Only (row, key, length) is range-sorted along the curve; running totals per sorted partition, and offsets of
the partitions, give each document its place in one long stream of ids that is cut every ``width`` ids. Neighbours on
the curve share sequences, and only the last sequence is padded.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careledger.llm.storage import bounded_batches, materialize, tidy

WIDTH, END_ID = 1024, 0
DIMS, BITS = 3, 10


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Encoder:
    """Ids of the byte-level BPE whose ranks ``path`` lists, as the tokenizers library gives them for the same vocabulary.

    The end-of-text mark in a text is its own id, as there. Ids come in a buffer and never become Python numbers.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        mark = {"<|endoftext|>": len(ranks)}
        self.allowed = set(mark)
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=mark)._core_bpe

    def encode(self, text: str) -> np.ndarray:
        ids = np.frombuffer(self.bpe.encode_to_tiktoken_buffer(text, self.allowed), np.uint32)
        return np.append(ids, np.uint32(END_ID))


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


@lru_cache(maxsize=2)
def _projection(size: int, dims: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, dims)).astype(np.float32)


def project(ids: np.ndarray, dims: int = DIMS, buckets: int = 1 << 16) -> np.ndarray:
    """The hashed bag of ``ids`` (one bucket per id), projected at random to ``dims`` numbers in 0..1."""
    if len(ids) == 0:
        return np.full(dims, 0.5)
    mean = _projection(buckets, dims).take(ids & np.uint32(buckets - 1), axis=0).sum(axis=0) / len(ids)
    return 0.5 + 0.5 * np.tanh(4 * mean)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys on the Hilbert curve of points (n, dims) with integer coordinates below 2**bits.

    Coordinates are undone from the highest bit down (exchange or invert the lower bits), then Gray decoded and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """doc_id, n, key, ids (binary, little-endian: 2 bytes per id where all fit, else 4), wide."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                encoder = _encoder(tokenizer)
                ids = [encoder.encode(t or "") for t in part["text"]]
                grid = np.array([project(x[:-1]) for x in ids]) * ((1 << BITS) - 1)
                wide = [bool(x.max() > 0xFFFF) for x in ids]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].values, "n": [len(x) for x in ids], "key": hilbert_keys(grid), "wide": wide, "ids": [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)]}
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(tidy(encode), f"doc_id {id_type}, n long, key long, wide boolean, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and id 0; a null or empty text is that id alone. A piece is the part of a document that lies in
    one sequence; long documents span many. Every sequence but the last is full. Ties on the curve are ordered by a hash of the id;
    repeated rows are separate documents. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    tokens = tokenized(docs, id_col, text_col, tokenizer or default_tokenizer()).withColumn("rid", F.monotonically_increasing_id())
    tokens = materialize(tokens, "pack-tokens")

    # Sorted runs along the curve; equal keys, as of copies, are dealt on by the id's hash.
    tie = F.xxhash64("doc_id", "rid")
    runs = tokens.select("rid", "key", "n", tie.alias("tie")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0
        for batch in batches:
            end = before + batch["n"].cumsum()
            yield pd.DataFrame({"rid": batch["rid"], "run": batch["run"], "before": end - batch["n"], "end": end})
            before = int(end.iloc[-1]) if len(end) else before

    places = runs.select("rid", "n", F.spark_partition_id().alias("run")).mapInPandas(tidy(total), "rid long, run int, before long, end long")
    places = materialize(places, "pack-places")
    # One row per sorted run: as many as shuffle partitions.
    ends = places.groupBy("run").agg(F.max("end").alias("total"))
    base = ends.select("run", (F.sum("total").over(Window.orderBy("run")) - F.col("total")).alias("base"))
    placed = places.join(F.broadcast(base), "run").select("rid", (F.col("before") + F.col("base")).alias("at"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, at, n, wide, raw in zip(batch["doc_id"], batch["at"], batch["n"], batch["wide"], batch["ids"], strict=True):
                ids, at, n, start = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4"), int(at), int(n), 0
                while start < n:
                    offset = (at + start) % width
                    length = min(n - start, width - offset)
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), n, (at + start) // width, offset))
                    start += length
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            yield frame.astype({"doc_id": batch["doc_id"].dtype})

    out = tokens.join(placed.hint("merge"), "rid").select("doc_id", "at", "n", "wide", "ids")
    return out.mapInPandas(tidy(cut), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
