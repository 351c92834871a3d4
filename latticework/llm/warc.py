"""WARC archives: a writer with revisits, and a reader that salvages what follows damage.

The writer makes one gzip member a record. The reader checks each member and record; where a check fails it
searches for the next valid member or version line, goes on from there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import pieces, shared_dir, written

#: Bytes after which the writer begins another file of its partition.
FILE_BYTES = 32 << 20
LEVEL = 4
#: Bytes that the reader hands to the unpacker at a time.
FEED = 1024
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
URN = "urn:latticework:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_start long, gap_bytes long, path string, problem string"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, compressed. A revisit has the HTTP head of the full payload and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = f"<{URN}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.UUID(bytes=sha1[:16])}>"
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url:
        lines.append(("WARC-Target-URI", re.sub(r"\s", "%20", url)))
    lines += [("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}")]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    whole = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(whole.encode() + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


@dataclass
class Gap:
    """Quarantined bytes of the archive, of the file for compressed ones."""

    start: int
    size: int
    problem: str


def one_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record at `at` and where the next begins; ValueError says what is wrong with it."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    headers: dict[str, str] = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without colon")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin, stop = end + 4, end + 4 + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("length doesn't lead to the record's end")
    block = data[begin:stop]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != base32(hashlib.sha1(block).digest()):
        raise ValueError("block digest differs")
    return Record(headers.get("warc-type", ""), headers, block), stop + 4


def plain_records(data: bytes, base: int | None = None) -> Iterator[Record | Gap]:
    """Records of uncompressed bytes; gaps between them."""
    at = 0
    while at < len(data):
        try:
            found, after = one_record(data, at)
            yield found
        except ValueError as e:
            after = following(data, at + 1, members=False)
            yield Gap(at if base is None else base, after - at, str(e))
        at = after


def member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at `at` holds, and where it ends. It is fed in small pieces, so that a member costs its own bytes and not the rest of the file."""
    unpacker, view, here, out = zlib.decompressobj(31), memoryview(data), at, []
    try:
        while not unpacker.eof and here < len(data):
            out.append(unpacker.decompress(view[here : here + FEED]))
            here += FEED
    except zlib.error as e:
        raise ValueError(f"member: {e}") from None
    if not unpacker.eof:
        raise ValueError("member without end")
    return b"".join(out), min(here, len(data)) - len(unpacker.unused_data)


def following(data: bytes, at: int, members: bool = True) -> int:
    """Where from `at` on the next valid member or record begins; the end without one."""
    magic, line = (data.find(MAGIC, at) if members else -1), VERSION.search(data, at)
    while magic >= 0 or line:
        here = min(x for x in (magic, line.start() if line else -1) if x >= 0)
        try:
            member(data, here) if here == magic else one_record(data, here)
            return here
        except ValueError:
            if here == magic:
                magic = data.find(MAGIC, here + 1)
            else:
                line = VERSION.search(data, here + 1)
    return len(data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every record of an archive that can be read, and the gaps between.

    An uncompressed record is as long as it says, whatever its block looks like; only where its check fails, or a member's, the
    next valid member or version line is searched for. Time grows with the bytes, but for damage with many false beginnings in a
    row, each of which is tried. An empty archive has neither. A record may be as long as memory allows.
    """
    at = 0
    while at < len(data):
        problem, after = "", len(data)
        try:
            if data.startswith(MAGIC, at):
                out, after = member(data, at)
                yield from plain_records(out, at)
            else:
                found, after = one_record(data, at)
                yield found
        except ValueError as e:
            problem, after = str(e), following(data, at + 1)
            yield Gap(at, after - at, problem)
        at = after


def write_archives(pages: DataFrame, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> str:
    """Writes a record for every row of pages (page_id, url, html) and returns the folder.

    Of equal payloads of at least least_bytes the one with the smallest page_id is a response and the
    others revisit it. A null html is an empty payload. Rows without page_id are responses. A
    file is named after its partition and place in it, in page order, so that a task that runs again
    replaces what it left.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    size = F.octet_length("html")
    first = own.where((size >= least_bytes) & F.col("page_id").isNotNull()).groupBy(F.col("sha1").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    joined = own.join(written(first, "payloads"), F.col("sha1") == F.col("d"), "left")
    refers = F.when((F.col("page_id") != F.col("first")) & (size >= least_bytes), F.col("first"))
    rows = joined.select("page_id", "url", "html", "sha1", refers.alias("refers_to")).sortWithinPartitions("page_id", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held: list[bytes] = []
        name = count = total = 0

        def close() -> tuple[str, int]:
            final = f"{root}/part-{part:06d}-{name:05d}.warc.gz"
            draft = f"{root}/_draft-{part}-{attempt}"
            with store.open_output_stream(draft, compression=None) as out:
                for x in held:
                    out.write(x)
            store.move(draft, final)
            return final, len(held)

        done: list[tuple[str, int]] = []
        for batch in pieces(batches, "html"):
            for page, url, text, sha1, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                held.append(record(page, url, text.encode(), sha1, refers_to))
                total += len(held[-1])
                if total >= file_bytes:
                    done.append(close())
                    held, total, name = [], 0, name + 1
        if held:
            done.append(close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    rows.mapInArrow(write, "path string, records long").agg(F.sum("records")).collect()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return folder


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{URN}(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(df: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for every record and gap of the archives in df (path, content), with RECORDS as columns.

    A gap's row has gap_start, gap_bytes and problem, a record's has null there. payload_bytes and
    payload_digest are those of the full payload, for a revisit too, which has no payload of its own. Responses whose payload
    doesn't have the digest that they name come as gaps.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("gap_start", pa.int64()), ("gap_bytes", pa.int64()), ("path", pa.string()), ("problem", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows: list[dict] = []
                held = 0
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        rows.append({"gap_start": x.start, "gap_bytes": x.size, "problem": x.problem, "path": path.as_py()})
                        continue
                    head, _, body = x.block.partition(b"\r\n\r\n")
                    length = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
                    said = x.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    size, digest = (int(length[1]) if length else None, said) if x.kind == "revisit" else (len(body), base32(hashlib.sha1(body).digest()))
                    if said and said != digest:
                        rows.append({"gap_bytes": len(body), "problem": "payload digest differs", "path": path.as_py()})
                        continue
                    own = {"page_id": page_of(x.headers.get("warc-record-id")), "url": x.headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": x.kind, "refers_to": page_of(x.headers.get("warc-refers-to")), "path": path.as_py()}
                    rows.append(own | ({"payload": body} if payloads and x.kind != "revisit" else {}))
                    held += len(body)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select("path", "content").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What the archives of pages hold when they are read back, gaps included."""
    spark = pages.sparkSession
    folder = write_archives(pages, least_bytes)
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder), payloads=False)


def intact(read: DataFrame) -> DataFrame:
    """The records of read_archives(); a gap among them ends the job with what it is, so that no page is lost unseen."""
    said = F.concat_ws(" ", F.lit("gap in"), "path", F.lit("at"), F.coalesce(F.col("gap_start").cast("string"), F.lit("?")), F.lit("of"), F.col("gap_bytes").cast("string"), F.lit("bytes:"), "problem")
    return read.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
