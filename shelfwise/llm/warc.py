"""WARC archives compressed with a Zstandard dictionary: one frame per record.

An archive file begins with a skippable frame that holds the dictionary; each
record is a frame of its own, so a reader can start at any record. Files travel as
rows (path, length, content), the columns of Spark's ``binaryFile`` source, so that
archives in any store that Spark reads can be opened, and those written here are kept
in a table without local files.

Defined results: a null html is an empty payload; records with equal payloads of
``revisit_bytes`` or more are stored once, by the smallest page_id, and the others
refer to it; repeated page_ids each get a record, and all with the smallest page_id of
a payload are responses; a page without page_id
is always a response and none refers to it; an empty table gives no archive; other
columns are passed over. Damaged input raises an error that names the file and the
record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

SKIPPABLE = 0x184D2A5D
FIRST_READ = 4096
FRAME = 0xFD2FB528
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_RECORDS = 64
LEVEL = 3
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record with the HTTP head only if ``refers_to`` is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    named = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + named + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary made of the heads of an archive's first records."""
    share = DICTIONARY_BYTES // max(1, len(samples))
    return b"".join(s[:share] for s in samples) or VERSION


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive file."""
    words = dictionary(records[:SAMPLE_RECORDS])
    head = struct.pack("<II", SKIPPABLE, len(words)) + words
    packer = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=True, write_checksum=True,
    )
    return head + b"".join(map(packer.compress, records))


def frames(content: bytes, path: str = "") -> Iterator[bytes]:
    """The records of an archive, each the content of one frame."""
    at, number = 0, 0
    unpacker = zstandard.ZstdDecompressor()
    if len(content) >= 8 and (head := struct.unpack_from("<II", content))[0] == SKIPPABLE:
        words, at = content[8 : 8 + head[1]], 8 + head[1]
        if len(words) != head[1]:
            raise ValueError(f"{path}: the dictionary frame is cut short")
        if struct.unpack_from("<I", words.ljust(4, b"\0"))[0] == FRAME:
            words = zstandard.ZstdDecompressor().decompress(words)
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    view = memoryview(content)
    while at < len(content):
        if at + 8 <= len(content) and (x := struct.unpack_from("<II", content, at))[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + x[1]
            continue
        # A frame does not tell its length, so it is fed in growing steps: what is read beyond its end is no more than the frame itself or FIRST_READ.
        reader, parts, step = unpacker.decompressobj(), [], FIRST_READ
        while not reader.eof and at < len(content):
            try:
                parts.append(reader.decompress(view[at : at + step]))
            except zstandard.ZstdError as e:
                raise ValueError(f"{path}: record {number}: {e}") from e
            at, step = min(at + step, len(content)), 2 * step
        if not reader.eof:
            raise ValueError(f"{path}: record {number} is cut short")
        at -= len(reader.unused_data)
        number += 1
        yield b"".join(parts)


def parse(data: bytes, where: str = "") -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record; raises if version, header, length or digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        raise ValueError(f"{where}: no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"{where}: bad header line {line[:60]!r}")
        fields[name.strip().decode().lower()] = value.strip().decode()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"{where}: no {sorted(missing)[0]}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{where}: content-length {fields['content-length']}, but {len(rest) - 4} bytes")
    block = rest[:-4]
    if (sha := fields.get("warc-block-digest")) and sha != f"sha1:{digest(block)}":
        raise ValueError(f"{where}: the block digest differs")
    return fields, block


def page_number(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_archives(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(path, length, content) of archives with one record per page, stored in the shared folder.

    Payloads are told apart by SHA-1 and length. Rows of hashes and page_ids alone
    find the revisits, so a payload that a third of all pages share moves narrow rows
    only; html meets them by page_id, which no group of pages shares.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", "html").withColumns({"sha": F.sha1(payload), "bytes": F.length(payload)})
    hashes = stored(own.where(F.col("page_id").isNotNull() & (F.col("bytes") >= revisit_bytes)).select("page_id", "sha", "bytes"), "hashes")
    firsts = hashes.groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = stored(hashes.join(firsts, ["sha", "bytes"]).where("page_id <> first").distinct(), "revisits")
    discard(hashes)
    keyed = own.join(revisits, ["page_id", "sha", "bytes"], "left").select("page_id", "url", "html", "first")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            content = archive(held)
            path = f"pages-{task:06d}-{number:06d}.warc.zst"
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"]
            )

        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (html or "").encode()
                refers = first if first is not None and page_id is not None and page_id != first else None
                held.append(record(page_id, url, data, digest(data), refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return stored(keyed.mapInArrow(scan, "path string, length long, content binary"), "warc")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of archives (path, content): page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    ``files`` may come from ``spark.read.format("binaryFile")``. The payload of a
    response is checked against its digest; a revisit names the length and digest of
    the payload it stands for.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for i, data in enumerate(frames(content.as_py(), path)):
                    where = f"{path}: record {i}"
                    fields, block = parse(data, where)
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    size = int(sizes[0]) if sizes else len(payload)
                    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != size or (sha and digest(payload) != sha)):
                        raise ValueError(f"{where}: the payload differs from its length or digest")
                    refers = page_number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
                    rows.append((page_number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], size, sha, refers, payload if with_payload else None))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RECORDS.split(", ")])

    found = files.select("path", "content").mapInArrow(scan, RECORDS)
    return found if with_payload else found.drop("payload")
