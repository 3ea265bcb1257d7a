"""WARC archives: records written as gzip members, and a sequential reader.

Writing: each task writes archives of about ARCHIVE_BYTES to the given folder (any file system URI that pyarrow opens) under names
that no other attempt uses; the list of finished archives is the job's output, so files of lost attempts are never read. Reading:
archives are dealt out over as many tasks as their bytes ask for, and each is read front to back: one gzip member per record,
inflated piece by piece, framed by its Content-Length and checked against the digests it names. Records of other writers are read
too: types that carry no page are passed over, digests and HTTP lengths may be missing, chunked bodies are put together.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import small_batches, staged

ARCHIVE_BYTES = 64_000_000
READ_BYTES = 16_000_000     # of archives that a task reads, about
MOST_SENT_NAMES = 200_000   # with more repeated payloads than this, pages meet them by a shuffle
CHUNK_BYTES = 1 << 20
PAGE_TYPES = ("response", "revisit")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class CorruptArchive(ValueError):
    """Framing or a digest of a record is wrong."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, named: str) -> str:
    """The record of a page and payload digest, the same wherever it is written; rows that repeat both share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{named}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header and no payload, and names the record and page it refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block, named = http if revisit else http + payload, digest(payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if revisit else record_id(page_id, named),
        "WARC-Date": date,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{named}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(original, named), "X-Refers-To-Page-ID": str(original)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as pieces of inflated bytes; the compressed file is never held whole."""
    rest = stream.read(CHUNK_BYTES)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while True:
                yield inflate.decompress(rest, CHUNK_BYTES)
                if inflate.eof:
                    rest = inflate.unused_data or stream.read(CHUNK_BYTES)
                    return
                rest = inflate.unconsumed_tail or stream.read(CHUNK_BYTES)
                if not rest:
                    raise CorruptArchive("the archive ends inside a member")

        yield pieces()


class _Member:
    """Line and length reads over one member's pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(len(self.held) - len(mark) + 1, 0)
            if not self._more():
                raise CorruptArchive("a header doesn't end")
        out = bytes(self.held[:found])
        del self.held[:found + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise CorruptArchive("a block is shorter than its Content-Length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def rest(self) -> bytes:
        while self._more():
            pass
        return bytes(self.held)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _joined_chunks(body: bytes) -> bytes:
    """The content of a chunked body."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            raise CorruptArchive("a chunk has no length") from None
        if n == 0:
            return b"".join(out)
        if len(body) < end + 2 + n:
            raise CorruptArchive("a chunk is shorter than its length")
        out.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def _whole_number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _payload(block: bytes) -> tuple[bytes, int | None]:
    """What follows the HTTP header (all of a block without one), and the length that the header names."""
    if not block.startswith(b"HTTP/"):
        return block, None
    http, _, body = block.partition(b"\r\n\r\n")
    head = _fields(http.split(b"\r\n")[1:])
    if "chunked" in head.get("transfer-encoding", "").lower() and body:
        return _joined_chunks(body), None
    return body, _whole_number(head.get("content-length"))


def read_records(stream) -> Iterator[dict]:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes and payload_digest of every page record.

    Other types (warcinfo, request, metadata and so on) have to be framed rightly and are passed over. Digests are checked where
    a record has SHA-1 ones; a payload that is marked as truncated is taken as it is. A record without a payload digest gets
    that of its payload, a revisit without one or without a length gets null; page_id and refers_to are null in records of
    other writers.
    """
    for pieces in members(stream):
        member = _Member(pieces)
        version, *lines = member.until(b"\r\n\r\n").split(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise CorruptArchive(f"not a WARC record: {version[:20]!r}")
        head = _fields(lines)
        size = _whole_number(head.get("content-length"))
        if size is None:
            raise CorruptArchive("a record has no Content-Length")
        block = member.exactly(size)
        if member.rest() != b"\r\n\r\n":
            raise CorruptArchive("a record doesn't end after its block")
        if head.get("warc-block-digest", "").startswith("sha1:") and head["warc-block-digest"] != f"sha1:{digest(block)}":
            raise CorruptArchive("block digest")
        if head.get("warc-type") not in PAGE_TYPES:
            continue
        payload, length = _payload(block)
        named = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        revisit = head["warc-type"] == "revisit"
        if not revisit:
            if "warc-truncated" not in head:
                if length is not None and len(payload) != length:
                    raise CorruptArchive("payload length")
                if head.get("warc-payload-digest", "").startswith("sha1:") and digest(payload) != named:
                    raise CorruptArchive("payload digest")
            length, named = len(payload), named or digest(payload)
        yield {"page_id": _whole_number(head.get("x-page-id")), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
               "refers_to": _whole_number(head.get("x-refers-to-page-id")), "payload": None if revisit else payload,
               "payload_bytes": length, "payload_digest": named}


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for every page; returns the finished archives (path, records, bytes), itself staged.

    Of pages with equal payloads of at least `least_bytes` bytes, that with the largest key is the response and the others
    revisit it; rows that repeat that key are responses too. A null html is an empty payload; a null key is smaller than any
    other (without another it is a response); no pages, no archives. `key` is an integer, `date` the WARC-Date of all records.
    """
    spark = small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"name": F.unhex(F.sha2("payload", 256)), "long": F.octet_length("payload") >= least_bytes})
    # Only payloads that occur more than once have an original; unless they are very many, pages stay where they are.
    heads = rows.filter("long").groupBy("name").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
    heads = staged(heads.filter("copies > 1 AND original IS NOT NULL").drop("copies"))
    heads = F.broadcast(heads) if heads.count() <= MOST_SENT_NAMES else heads
    marked = rows.join(heads, "name", "left").withColumn("revisit", F.col("long") & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        out, done, path, count, size = None, [], "", 0, 0
        for batch in batches:
            for page_id, link, body, original, revisit in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if out is None:
                    path, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                data = record(page_id, link, body, original, revisit, date)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                                             names=["path", "records", "bytes"])

    ready = marked.select("page_id", "url", "payload", "original", "revisit")
    return staged(ready.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True, with_errors: bool = False) -> DataFrame:
    """The page records of the listed archives (path, bytes), checked.

    A wrong digest or frame stops the job; `with_errors` instead adds a column `error` (null for records) and one row per archive
    that breaks off, with the archive as url, after the records before the fault. An empty list gives an empty result, an
    archive that is listed twice is read twice.
    """
    spark = small_batches(archives.sparkSession)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if with_payload else []), *(["error"] if with_errors else [])]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row.get(n) for row in rows], kinds.get(n, pa.string())) for n in names], names=names)

    def records(system: pafs.FileSystem, path: str) -> Iterator[dict]:
        try:
            with system.open_input_stream(path, compression=None) as stream:
                yield from read_records(stream)
        except (CorruptArchive, zlib.error) as fault:
            if not with_errors:
                raise
            yield {"url": path, "error": f"{type(fault).__name__}: {fault}"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in records(system, path):
                    held.append(row if with_payload else row | {"payload": None})
                    size += 100 + ((row.get("payload_bytes") or 0) if with_payload else 0)
                    if size > 4_000_000:
                        yield pack(held)
                        held, size = [], 0
        if held:
            yield pack(held)

    n, total = archives.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # The paths themselves weigh next to nothing, so the number of tasks is given; round robin deals archives evenly.
    tasks = max(min(n, max(-(-total // READ_BYTES), spark.sparkContext.defaultParallelism)), 1)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else "") + (", error string" if with_errors else "")
    return archives.select("path").repartition(int(tasks)).mapInArrow(read, schema)
