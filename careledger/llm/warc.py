"""WARC archives: write records with an index, then read selected records by coalesced byte ranges.

Files are written and read through pyarrow's filesystems, so the target may be any store that these open.
Each record is a gzip member of its own. The index (file, offset, length, url, digest, ...) is a
Parquet table written by the same tasks; a file that a failed or speculative attempt left is in no index row.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.storage import bounded_batches, materialize, shared_path, tidy

#: Payloads shorter than this are never revisits.
MIN_REVISIT = 100
#: A file is closed at this size; ranges up to GAP apart are read at once, up to SPAN bytes.
FILE_BYTES, GAP, SPAN = 256 << 20, 64 << 10, 8 << 20
#: Bytes of archives that one task reads, about.
READ_BYTES = 128 << 20

INDEX = "page_id {id}, file string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to (null for a response).

    Of equal payloads of at least ``min_revisit`` bytes the one with the smallest id is the response. Only ids and digests
    are shuffled by digest; payloads meet the few revisits by id. A null payload is empty; rows with a null
    id, and repeats of the smallest id, are responses.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = rows.filter(F.octet_length("payload") >= min_revisit).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Written before it is joined: of two plain shuffles Spark can split the part of a payload that very many pages share.
    first = materialize(first, "warc-first")
    again = narrow.join(first, "digest").filter("page_id > refers_to").distinct()
    return rows.join(again, ["page_id", "digest"], "left")


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    urn = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}/{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers in lower case, HTTP head, payload) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _value(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of plan_records as archives under ``path``; returns the index, stored in ``path``/index."""
    bounded_batches(records.sparkSession)
    id_type = records.schema["page_id"].dataType.simpleString()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    page_id, refers_to = (None if _value(x) is None else int(x) if "int" in id_type else x for x in (page_id, refers_to))
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(f"{root}/data", recursive=True)
                        name, at = f"data/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = gzip.compress(_record(page_id, _value(url), bytes(payload), digest, refers_to), 4, mtime=0)
                    out.write(data)
                    rows.append((page_id, name, at, len(data), _value(url), digest, "response" if refers_to is None else "revisit"))
                    at += len(data)
                frame = pd.DataFrame(rows, columns=["page_id", "file", "offset", "length", "url", "digest", "record_type"])
                if "int" in id_type:
                    frame["page_id"] = frame["page_id"].astype("Int64")
                yield frame
        finally:
            if out is not None:
                out.close()

    ordered = records.select("page_id", "url", "payload", "digest", "refers_to")
    ordered.mapInPandas(tidy(write), INDEX.format(id=id_type)).write.parquet(f"{path}/index")
    return read_index(records.sparkSession, path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_warc(index: DataFrame, path: str) -> DataFrame:
    """Read the records that ``index`` lists (all, or a selection of read_index) and check their payloads' digests.

    Ranges are sorted by file and offset; neighbours are fetched by one read. Tasks share the bytes to read, not the rows of the index.
    An empty index gives no rows.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    id_type = index.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        key = (lambda x: None if x is None else int(x)) if "int" in id_type else (lambda x: x)
        for batch in batches:
            spots, i, rows = list(zip(batch["file"], batch["offset"].astype(int), batch["length"].astype(int), strict=True)), 0, []
            while i < len(spots):
                j, (file, start, n) = i + 1, spots[i]
                end = start + n
                while j < len(spots) and spots[j][0] == file and 0 <= spots[j][1] - end <= GAP and spots[j][1] + spots[j][2] - start <= max(SPAN, n):
                    end, j = max(end, spots[j][1] + spots[j][2]), j + 1
                with store.open_input_file(f"{root}/{file}") as f:
                    f.seek(start)
                    data = f.read(end - start)
                for _, at, size in spots[i:j]:
                    fields, http, payload = parse_record(gzip.decompress(data[at - start : at - start + size]))
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {at}: the payload doesn't match its digest")
                    whole = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    rows.append((key(fields.get("x-page-id")), fields.get("warc-target-uri"), whole, digest, kind, key(fields.get("x-refers-to-page"))))
                i = j
            frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            if "int" in id_type:
                frame = frame.astype({"page_id": "Int64", "refers_to": "Int64"})
            yield frame

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    ordered = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(tidy(read), RECORD.format(id=id_type))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back by their index.

    One row per row of ``pages``: page_id, url, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload, a null url
    stays null; rows with a null id and repeats of a response's id are responses. Payloads of any length are one record.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    path = shared_path(pages.sparkSession, "warc")
    return materialize(read_warc(write_warc(plan_records(pages), path), path), "warc-read")
