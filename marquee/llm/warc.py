"""WARC archives: writing, normalising monolithic gzip files, reading by index.

``write_archives`` has every task write its records as one gzip stream (a
*monolithic* archive, as plain ``gzip`` of a WARC file makes it). ``normalise``
inflates each such file once, front to back, and rewrites every record as a
gzip member of its own, with a sidecar index of offsets. ``read_records`` then
reads any range of records without touching the rest.

Archives lie in the folder named by ``spark.checkpoint.dir`` and are reached
through ``pyarrow.fs``, so the folder may be local, HDFS or S3. A task attempt
writes under a name of its own and reports it in its result row; only reported
files are read, so a lost or repeated attempt leaves nothing that counts.

Defined results: a null payload is an empty one; a null URL becomes an empty
target; a null id is kept as a null id. An empty table gives no archives. Of
repeated rows the one with the smallest id is the response, the others revisit
it; rows repeated with the same id are responses all.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from marquee.session import shared_folder

LEVEL = 5
PIECE = 1 << 20
RECORDS_PER_READ = 2_000
HEADER_LIMIT = 1 << 16
GZIP = 16 + zlib.MAX_WBITS
PAGE_URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"  # the tables carry no fetch time

RECORD = "page_id long, url string, payload binary, payload_digest string, record_type string, refers_to long"
FILES = "path string, records long, bytes long"
ENTRIES = "path string, first long, last long, start long, stop long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def deduplicated(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """The records to write: equal payloads of at least ``least_bytes`` are held once.

    The first of each payload is found from digests alone (counted up before
    the shuffle); the payloads themselves are shuffled once, for that join.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    big = F.octet_length("payload") >= least_bytes
    first = rows.filter(big).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = first.filter("n > 1").select("sha", "first")
    joined = rows.join(repeated, "sha", "left")
    revisit = big & (F.col("page_id") != F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "sha", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


# --- one record ------------------------------------------------------------


def record_bytes(page_id, url: str, payload: bytes, sha: bytes, record_type: str, refers_to) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header with the full length and drops the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}"]
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <{PAGE_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def urn_id(value: str | None):
    digits = (value or "").strip("<>").removeprefix(PAGE_URN)
    return int(digits) if digits else None


def parse(record: bytes) -> dict:
    """The fields of one uncompressed record; a digest that does not fit the payload is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[: int(h["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length")
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(body) != length or sha1_base32(body) != digest):
        raise ValueError(f"damaged payload in {h['warc-record-id']}")
    return {
        "page_id": urn_id(h["warc-record-id"]), "url": h["warc-target-uri"], "payload_bytes": length, "payload_digest": digest,
        "record_type": h["warc-type"], "refers_to": urn_id(h.get("warc-refers-to")), "payload": body}


def split_stream(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an uncompressed WARC stream; held in memory: one record and one piece."""
    held = bytearray()
    for piece in pieces:
        held += piece
        start = 0
        while True:
            at = held.find(b"\r\n\r\n", start)
            if at < 0:
                if len(held) - start > HEADER_LIMIT:
                    raise ValueError("a record header has no end")
                break
            end = at + 4 + int(headers(bytes(held[start:at]))["content-length"]) + 4
            if end > len(held):
                break
            yield bytes(held[start:end])
            start = end
        del held[:start]
    if held.strip():
        raise ValueError("the stream ends inside a record")


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, read once, in pieces."""
    z = zlib.decompressobj(GZIP)
    while data := source.read(PIECE):
        while data:
            if out := z.decompress(data, PIECE):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(GZIP)
    while out := z.decompress(z.unconsumed_tail, PIECE):
        yield out


def _open(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# --- archives --------------------------------------------------------------


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` as monolithic archives, one per task; (path, records, bytes) of each.

    The result must be written or cached by the caller: every evaluation writes new archives.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, out, count, size = f"{folder}/mono-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        for b in batches:
            for row in zip(b["page_id"], b["url"], b["payload"], b["sha"], b["record_type"], b["refers_to"]):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row[0], row[5]))
                if out is None:
                    system, where = _open(path)
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(where, compression=None)
                data = z.compress(record_bytes(page_id, *row[1:5], refers_to))
                out.write(data)
                count, size = count + 1, size + len(data)
        if out is not None:
            data = z.flush()
            out.write(data)
            out.close()
            yield pd.DataFrame({"path": [path], "records": [count], "bytes": [size + len(data)]})

    # Ids travel as text: a column of whole numbers with nulls would lose digits.
    return records.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "sha", "record_type",
        F.col("refers_to").cast("string").alias("refers_to")).mapInPandas(write, FILES)


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each archive (column ``path``) with a member per record and a sidecar index.

    Each source is inflated once as a stream and removed only by the caller.
    The sidecar ``<archive>.idx`` has one JSON line per record. The result has
    one row for every ``RECORDS_PER_READ`` records, so that reading splits.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                system, where = _open(path)
                target = f"{path.rpartition('/')[0]}/norm-{uuid.uuid4().hex}.warc.gz"
                _, there = _open(target)
                rows, offset, n = [], 0, 0
                with system.open_input_stream(where, compression=None) as source, \
                        system.open_output_stream(there, compression=None) as out, \
                        system.open_output_stream(f"{there}.idx", compression=None) as index:
                    for record in split_stream(inflated(source)):
                        h = headers(record.partition(b"\r\n\r\n")[0])
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = z.compress(record) + z.flush()
                        out.write(member)
                        index.write((json.dumps({
                            "offset": offset, "length": len(member), "type": h["warc-type"], "id": h["warc-record-id"],
                            "uri": h["warc-target-uri"], "digest": h["warc-payload-digest"]}) + "\n").encode())
                        if n % RECORDS_PER_READ == 0:
                            rows.append([target, n, n, offset, offset])
                        offset += len(member)
                        rows[-1][2], rows[-1][4] = n, offset
                        n += 1
                yield pd.DataFrame(rows, columns=["path", "first", "last", "start", "stop"])

    return archives.select("path").mapInPandas(rewrite, ENTRIES)


def index_entries(archives: DataFrame) -> DataFrame:
    """(path, offset, length, type, id, uri, digest) from the sidecars of normalised archives."""
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                system, where = _open(path)
                with system.open_input_stream(f"{where}.idx", compression=None) as f:
                    found = pd.DataFrame([json.loads(x) for x in f.read().decode().splitlines()])
                found.insert(0, "path", path)
                yield found

    return archives.select("path").distinct().mapInPandas(
        lines, "path string, offset long, length long, type string, id string, uri string, digest string")


def read_records(entries: DataFrame) -> DataFrame:
    """The records of index ranges (path, start, stop), each read by seeking to its start."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start, stop in zip(b["path"], b["start"], b["stop"]):
                system, where = _open(path)
                rows, held = [], 0
                with system.open_input_file(where) as f:
                    f.seek(start)
                    z, left = zlib.decompressobj(GZIP), stop - start
                    record = bytearray()
                    while left and (data := f.read(min(PIECE, left))):
                        left -= len(data)
                        while data:
                            record += z.decompress(data)
                            data = b""
                            if z.eof:
                                data, z = z.unused_data, zlib.decompressobj(GZIP)
                                rows.append(parse(bytes(record)))
                                held += len(record)
                                record = bytearray()
                                if held > 8 * PIECE:
                                    yield _frame(rows)
                                    rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return entries.select("path", "start", "stop").mapInPandas(
        read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to string, payload binary").withColumns(
        {c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for c in ("page_id", "refers_to"):
        out[c] = [None if x is None else str(x) for x in (r[c] for r in rows)]
    return out


def archive_folder(spark) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
