"""WARC archives: writing captures, and reading them back by transaction assembly.

A capture is three records. The response (or revisit) record is named by its id; the request and metadata
records point at it with WARC-Concurrent-To, and a revisit names its response with WARC-Refers-To. Reading parses every
record by its Content-Length, then joins the three by that identifier into one nested row per capture.

Files are WARC 1.1, a gzip member a record, of at most about FILE_BYTES bytes or one record. A task makes up a file's
bytes, and Spark's own text writer puts them down, one row a file, so they land in whatever store Spark writes to; the
line separator it adds is an empty gzip member. Files are read member by member.

Defined results: a null html is an empty payload; a null url is an empty target; rows without page_id are left out; every
other row is a capture: of rows equal in page_id and payload one is the response, the others revisit it; an empty table
gives an archive without records, and no rows. A record that lacks its request or metadata still gives a row, with nulls
there.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, record, stored

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Compressed bytes of a file, about; it ends with the record that reaches them.
FILE_BYTES = 16 << 20
#: Bytes of records that the reader hands on at once, about.
BATCH_BYTES = 4 << 20
_NOTHING = gzip.compress(b"", mtime=0)
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target string, payload_digest string, http_head string, payload_bytes long, payload binary, fields map<string,string>"
_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("payload_digest", pa.string()), ("http_head", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int, digest: str, nth: int, role: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest} {nth} {role}')}>"


def _one_line(url: str) -> str:
    return "".join(c for c in url if c >= " ")


def _record(kind: str, name: str, block: bytes, date: str, content_type: str, **headers: str | None) -> bytes:
    """A record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"Content-Type: {content_type}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest and refers_to of the rows whose payload, of at least `least_bytes` bytes, a smaller page_id has too."""
    keyed = stored(pages.where(F.octet_length("html") >= least_bytes).select("page_id", F.sha1("html").alias("digest")), "warc-digests")
    first = stored(keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last"), "warc-first")
    return keyed.join(first, "digest").where("page_id > refers_to").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))


def write_archive(pages: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> str:
    """Writes pages(page_id, url, html) as WARC files; returns the folder. Later copies of a payload of at least
    `least_bytes` bytes become revisit records of the smallest page_id."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).where("page_id is not null")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, html, refers, nth in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "nth")), strict=True):
                payload = html.encode()
                url, digest = _one_line(url), sha1_base32(payload)
                name = _name(page_id, digest, nth, "capture")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                common = {"WARC_Target_URI": url, "date": date}
                if refers is None and nth > 1 and len(payload) >= least_bytes:
                    refers = page_id
                if refers is None:
                    made = [_record("response", name, head + payload, content_type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{digest}", **common)]
                else:
                    made = [_record("revisit", name, head, content_type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{digest}", WARC_Refers_To=_name(refers, digest, 1, "capture"), WARC_Refers_To_Date=date, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **common)]
                made.append(_record("request", _name(page_id, digest, nth, "request"), b"GET / HTTP/1.1\r\nUser-Agent: tessera\r\n\r\n", content_type="application/http; msgtype=request", WARC_Concurrent_To=name, **common))
                made.append(_record("metadata", _name(page_id, digest, nth, "metadata"), f"page_id: {page_id}\r\n".encode(), content_type="application/warc-fields", WARC_Concurrent_To=name, **common))
                file += made
                size += sum(map(len, made))
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(file)], pa.binary())], ["value"])
                    file, size = [], 0
        if file:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(file)], pa.binary())], ["value"])

    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    rows = pages.withColumn("digest", F.sha1("html")).join(revisits(pages, least_bytes), ["page_id", "digest"], "left").withColumn("nth", nth)
    files = rows.mapInArrow(render, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", _NOTHING.decode("latin-1")).text(path)
    return path


def unzipped(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of gzip members, a piece at a time; plain bytes as they are."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[at : at + step]) for at in range(0, len(data), step))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data):
        part = data[at : at + step]
        yield member.decompress(part)
        at += len(part) - len(member.unused_data)
        if member.eof:
            member = zlib.decompressobj(31)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; holds one record and a piece."""
    held = bytearray()

    def more(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while more(2) and held[:2] == b"\r\n":
            del held[:2]
        if not more(5):
            if held:
                raise ValueError("an archive ends within a record")
            return
        if held[:5] != b"WARC/":
            raise ValueError("no WARC record where one should begin")
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more(len(held) + 1):
                raise ValueError("an archive ends within a record's headers")
        headers = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        if not more(end + 4 + size):
            raise ValueError("an archive ends within a record")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archive files in a folder. A response's payload is checked against its digest; with
    payloads=False it then stays behind."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = lambda rows: record(_SCHEMA, **dict(zip(_SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True)))
        for batch in batches:
            for blob in batch.column("content"):
                rows, size = [], 0
                for headers, block in parse(unzipped(memoryview(blob.as_buffer()))):
                    kind = headers["WARC-Type"]
                    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    head, payload, n, fields = None, None, None, []
                    if kind in ("response", "revisit", "request"):
                        raw, _, payload = block.partition(b"\r\n\r\n")
                        head = raw.decode()
                        n = next((int(x.split(":")[1]) for x in head.split("\r\n") if x.lower().startswith("content-length:")), None)
                    elif kind == "metadata":
                        fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x]
                    if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                    kept = payload if payloads and kind == "response" else None
                    rows.append((headers["WARC-Record-ID"], kind, headers.get("WARC-Concurrent-To"), headers.get("WARC-Refers-To"), headers.get("WARC-Target-URI"), digest, head, n, kept, fields))
                    size += 500 + len(kept or b"")
                    if size >= BATCH_BYTES:
                        yield send(rows)
                        rows, size = [], 0
                if rows:
                    yield send(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(load, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id and the structs response (or revisit), request and metadata."""
    capture = F.coalesce("concurrent_to", "record_id")
    whole = F.struct("record_id", "record_type", "refers_to", "target", "payload_digest", "payload_bytes", "http_head", "payload")
    part = lambda kinds, what: F.first(F.when(F.col("record_type").isin(*kinds), what), ignorenulls=True)
    return records.groupBy(capture.alias("capture_id")).agg(
        part(("response", "revisit"), whole).alias("response"),
        part(("request",), F.struct("record_id", "target", "http_head")).alias("request"),
        part(("metadata",), F.struct("record_id", "fields")).alias("metadata"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's rows: every page written, read back and assembled; a revisit's page is that of the record it refers to."""
    found = stored(captures(read_records(pages.sparkSession, write_archive(pages), payloads=False)), "captures")
    page = F.col("metadata.fields")["page_id"].cast("long")
    named = found.where("response.record_type = 'response'").select(F.col("response.record_id").alias("of"), page.alias("refers_to"))
    rows = found.join(named, F.col("response.refers_to") == F.col("of"), "left")
    return rows.select(page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), "refers_to", F.col("response.target").alias("target"), F.col("request.record_id").alias("request_id"))
