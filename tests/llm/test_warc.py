import base64
import hashlib
import random
import time

import pytest
import zstandard

from shelfwise.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, "http://a/\r\n3", "<p>x</p>"), (1, None, None), (3, "u", ""),
    (4, "u", "ü" * 30_000), (8, "u", "line\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>x</p>"), (7, "u", "only"), (7, "u", "only"),
]


def plain(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "") if i is not None else None
        revisit = to is not None and to != i
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), sha, "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as first", "2 as sha", "3 as n")
    back = warc.read_archives(warc.write_archives(pages, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in back.collect()), key=str) == plain(ROWS, least)


def test_payloads_come_back_from_files(spark, tmp_path):
    files = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA))
    for r in files.collect():
        (tmp_path / r.path).write_bytes(r.content)
    back = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path)), with_payload=True).where("record_type = 'response'")
    first = {r[0] for r in plain(ROWS) if r[3] == "response"}
    assert {(r.page_id, bytes(r.payload)) for r in back.collect()} == {(i, (h or "").encode()) for i, _, h in ROWS if i in first}


def test_one_frame_per_record_after_the_dictionary():
    records = [warc.record(i, "u", b"payload" * i, warc.digest(b"payload" * i), None) for i in range(5)]
    content = warc.archive(records)
    assert list(warc.frames(content)) == records
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little")


def test_compressed_dictionary_is_read():
    records = [warc.record(i, "u", b"abc" * 50, warc.digest(b"abc" * 50), None) for i in range(3)]
    words = zstandard.ZstdCompressor().compress(warc.dictionary(records))
    plain_words = zstandard.ZstdDecompressor().decompress(words)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(plain_words, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    content = warc.struct.pack("<II", warc.SKIPPABLE, len(words)) + words + b"".join(map(packer.compress, records))
    assert list(warc.frames(content)) == records


def test_a_large_archive_of_small_records_is_read_in_linear_time():
    rng = random.Random(3)
    records = [warc.record(i, "u", payload, warc.digest(payload), None) for i in range(64_000) if (payload := rng.randbytes(1024))]
    records.append(warc.record(70_000, "u", payload := rng.randbytes(9 << 20), warc.digest(payload), None))
    content = warc.archive(records)
    assert len(content) > 64 << 20
    began = time.process_time()
    assert sum(a == b for a, b in zip(warc.frames(content), records, strict=True)) == len(records)
    assert time.process_time() - began < 30


@pytest.mark.parametrize("damage", ["cut", "length", "digest", "version", "header"])
def test_damage_is_named(damage):
    good = warc.record(1, "u", b"payload", warc.digest(b"payload"), None)
    if damage == "cut":
        with pytest.raises(ValueError, match="a.zst: record 0"):
            list(warc.frames(warc.archive([good])[:-6], "a.zst"))
        return
    bad = {
        "length": good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1), "digest": good.replace(b"payload\r\n", b"PAYLOAD\r\n"),
        "version": good.replace(b"WARC/1.1", b"WXYZ/1.1"), "header": good.replace(b"WARC-Date: ", b"WARC-Date "),
    }[damage]
    with pytest.raises(ValueError, match="here"):
        warc.parse(bad, "here")


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
