"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC/1.1 records, and a skippable frame with the
seek table of the public seekable format: the compressed and uncompressed size of every frame. An index maps a record's
id to (bundle, frame, offset in the uncompressed frame, length), so one record costs one frame.

Bundles are written under a temporary name and renamed, and only the names that the successful task returned are used:
a lost executor or a second attempt leaves nothing behind that is read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9
FRAME_BYTES, LEVEL, LEAST_REVISIT = 1 << 20, 3, 100
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def storage(uri: str):
    """(file system, path) for a folder uri; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def record(page_id, url, kind: str, digest: str, payload: bytes, size: int, refers_to) -> bytes:
    """One WARC record. A revisit holds no payload; its headers keep the digest and the full size."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return head, data[end + 4 : end + 4 + int(head["content-length"])]


class Writer:
    """Writes one bundle; a frame is closed once it holds `frame_bytes`, so memory is one frame plus one record."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.most, self.zip = out, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.parts, self.held, self.table = [], 0, []

    def add(self, data: bytes) -> tuple[int, int, int]:
        at = (len(self.table), self.held, len(data))
        self.parts.append(data)
        self.held += len(data)
        if self.held >= self.most:
            self.flush()
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.parts))
            self.out.write(packed)
            self.table.append((len(packed), self.held))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + FOOTER) + entries)
        self.out.write(struct.pack("<IBI", len(self.table), 0, SEEKABLE))


def seek_table(f, size: int) -> list[tuple[int, int]]:
    """(start, compressed size) of every frame, from the footer alone."""
    f.seek(size - FOOTER)
    n, _, magic = struct.unpack("<IBI", f.read(FOOTER))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - FOOTER - 8 * n)
    start, out = 0, []
    for i in range(n):
        packed, _ = struct.unpack("<II", f.read(8))
        out.append((start, packed))
        start += packed
    return out


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to): of equal payloads of at least 100 bytes the smallest id is the response.

    Which pages are revisits is settled on ids and digests alone; a digest that a third of all pages share is counted before
    the shuffle, and its rows are split by the skew join. Payloads are only joined to that list, by page: they stay where
    they are if it is small enough to send, and go to evenly filled partitions if not.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    large = p.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "payload_digest")
    seen = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("payload_digest", "first_id")
    key = lambda: F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    again = large.join(seen, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(key(), F.col("payload_digest").alias("digest"), F.col("first_id").alias("refers_to")).distinct()
    j = p.select("*", key()).withColumnRenamed("payload_digest", "digest").join(again, ["key", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    return j.select(
        "page_id", "url", F.when(revisit, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to",
    )


def write_bundles(marked: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes one bundle per task below `folder` (a uri all executors share) and returns the index (lazy: an action writes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = storage(folder)
        name, writer, out = f"{uuid.uuid4().hex}.warc.zst", None, None
        rows: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    files.create_dir(base, recursive=True)
                    writer = Writer(out := files.open_output_stream(f"{base}/.{name}", compression=None), frame_bytes)
                data = record(r["page_id"], r["url"], r["record_type"], r["payload_digest"], r["payload"] or b"", r["payload_bytes"], r["refers_to"])
                frame, offset, length = writer.add(data)
                rows.append((r["page_id"], name, frame, offset, length))
        if writer is None:
            return
        writer.close()
        out.close()
        files.move(f"{base}/.{name}", f"{base}/{name}")
        for k in range(0, len(rows), 10000):
            cols = list(zip(*rows[k : k + 10000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"])

    return marked.mapInArrow(run, INDEX)


PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the archives, through the index.

    The records of a frame are asked for together, so each frame is read and unpacked once. A response's size and
    digest are taken from the payload read back, and must agree with its headers.
    """
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("at"))  # a frame is 1 MiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = storage(folder)
        unzip, tables = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                path = f"{base}/{r['bundle']}"
                with files.open_input_file(path) as f:
                    if path not in tables:
                        tables.clear()
                        tables[path] = seek_table(f, f.size())
                    start, packed = tables[path][r["frame"]]
                    f.seek(start)
                    data = unzip.decompress(f.read(packed))
                for at in r["at"]:
                    head, body = parse(data[at["offset"] : at["offset"] + at["length"]])
                    digest, size, kind = head["warc-payload-digest"].removeprefix("sha256:"), int(head["warc-payload-length"]), head["warc-type"]
                    if kind == "response" and (len(body), hashlib.sha256(body).hexdigest()) != (size, digest):
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    number = lambda x: int(x[10:-1]) if len(x) > 11 else None  # noqa: E731  <urn:page:N>
                    rows.append((number(head["warc-record-id"]), size, digest, kind, number(head.get("warc-refers-to", ""))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PAGE, strict=True)], schema=PAGE)

    return frames.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes every page as a WARC record and reads all archives back: one row per page.

    Null html is an empty payload; payloads under 100 bytes and pages with a null id (unless their payload repeats) are
    responses. Repeated rows with one id and payload are responses alike. Empty tables write no bundle and give no rows.
    Other columns are ignored whatever their names.
    """
    folder = scratch.path("warc")
    index = scratch.save(write_bundles(mark_revisits(pages), folder), "index")
    return read_records(index, folder)
