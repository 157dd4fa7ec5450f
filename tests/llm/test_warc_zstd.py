import hashlib
import os
import struct

import pytest
import zstandard

from palate.llm import warc_zstd as W
from palate.session import new_path

SCHEMA = "page_id bigint, url string, html string, digest string, first string, n int"
DATE = "2026-01-02T03:04:05Z"


def rows():
    same, small = "<p>the same page</p>" * 9, "<p>small</p>"
    texts = [None, "", small, small, same, same, same, "ü" * 50, "ü" * 50, "ü" * 49, "x" * 3_000_000, "\r\n\r\nWARC/1.1\r\n\r\n" * 30, same]
    out = [(100 - i, None if i == 3 else f"http://a/{i} b\r\nWARC-Type: x\u2028", t, "d", "f", i) for i, t in enumerate(texts)]
    return out + [(None, "u", same, "", "", 1), (88, "again", same, "", "", 1)]


def want(rows):
    payloads = [(r[2] or "").encode() for r in rows]
    first = {}
    for r, p in zip(rows, payloads):
        if len(p) >= 100 and r[0] is not None:
            first[p] = min(first.get(p, r[0]), r[0])
    for r, p in zip(rows, payloads):
        to = first.get(p, r[0])
        yield r[0], len(p), hashlib.sha256(p).hexdigest(), "response" if to == r[0] else "revisit", to if to != r[0] else None


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = sorted(map(tuple, W.report(pages).collect()), key=str)
    assert got == sorted(want(rows()), key=str)


def test_texts_and_unfinished_archives(spark):
    folder = new_path(spark, "warc")
    done = W.write_archives(spark.createDataFrame(rows(), SCHEMA), folder)
    with open(os.path.join(folder.removeprefix("file:"), "left-over.warc.zst"), "wb") as f:
        f.write(b"half an archive")
    got = W.read_archives(spark, folder, done).collect()
    assert len(got) == len(rows()) == done.agg({"records": "sum"}).first()[0] and not any(r.error for r in got)
    texts = {r.page: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert all(texts[str(i)] == (t or "") for i, _, t, *_ in rows() if i is not None and str(i) in texts)
    assert {r.url for r in got if r.page == "100"} == {"http://a/0%20b%0D%0AWARC-Type:%20x%E2%80%A8"}
    assert sum(r.error is not None for r in W.read_archives(spark, folder).collect()) == 1


def test_empty(spark):
    assert W.report(spark.createDataFrame([], SCHEMA)).collect() == []


def archive(records, known=None, **options):
    known = known or W.dictionary(records)
    pack = zstandard.ZstdCompressor(dict_data=known, write_checksum=True, **options).compress
    return W.dictionary_frame(known), [pack(r) for r in records]


def one(i, text, **change):
    raw = text.encode()
    return W.record(str(i), "u", raw, hashlib.sha256(raw).hexdigest(), None, False, DATE)


def test_dictionaries():
    records = [one(i, f"page {i} " * 40) for i in range(300)]
    trained = W.dictionary(records)
    assert trained.dict_id() and zstandard.get_frame_parameters(archive(records, trained)[1][0]).dict_id == trained.dict_id()
    lead, frames = archive(records, trained)
    plain = struct.pack("<II", W.DICTIONARY_FRAME, len(trained.as_bytes())) + trained.as_bytes()
    for head in (lead, plain):
        assert [r["page"] for r in W.read_archive(head + b"".join(frames))] == [str(i) for i in range(300)]
    none = b"".join(zstandard.ZstdCompressor().compress(r) for r in records[:3])
    assert [r["error"] for r in W.read_archive(none)] == [None] * 3
    skipped = lead + frames[0] + struct.pack("<II", 0x184D2A50, 3) + b"abc" + frames[1]
    assert [r["page"] for r in W.read_archive(skipped)] == ["0", "1"]
    few = [one(1, "x")]
    lead, frames = archive(few)
    assert [r["error"] for r in W.read_archive(lead + frames[0])] == [None]


@pytest.mark.parametrize(
    "old, new",
    [
        (b"WARC/1.1", b"WARC/2.0"), (b"WARC-Date: ", b"WARC-Late: "), (b"\r\nContent-Length: ", b"\r\nContent-Length: 1"), (b"page 1", b"page 2"),
        (b"\r\n\r\n", b"\r\n"), (b"WARC-Type: response", b"WARC-Type: revisit"), (b"WARC-Type: response", b"WARC-Type: other"), (b"Content-Type: ", b"Content-Type"),
        (b"<urn:page:1>", b"<urn:uuid:1>"), (b"sha256:", b"sha1:"), (b"msgtype", b"\xff"),
    ],
)
def test_bad_records_do_not_stop_the_archive(old, new):
    records = [one(0, "page 0"), one(1, "page 1").replace(old, new), one(2, "page 2")]
    lead, frames = archive(records)
    got = list(W.read_archive(lead + b"".join(frames)))
    assert [r["error"] is None for r in got] == [True, False, True] and got[2]["page"] == "2"


def test_two_records_in_a_frame_are_refused():
    lead, frames = archive([one(0, "page 0") + one(1, "page 1")])
    assert [r["error"] is None for r in W.read_archive(lead + frames[0])] == [False]


def test_cut_or_damaged_archives():
    lead, frames = archive([one(i, f"page {i}") for i in range(3)])
    whole = lead + b"".join(frames)
    for cut in (whole[:5], whole[: len(lead) - 1], whole[: len(lead) + 10], whole[:-1]):
        got = list(W.read_archive(cut))
        assert got[-1]["error"] and all(r["error"] is None for r in got[:-1])
    changed = bytearray(whole)
    changed[len(lead) + len(frames[0]) + 20] ^= 1
    got = list(W.read_archive(bytes(changed)))
    assert got[0]["error"] is None and got[-1]["error"]
    other = W.dictionary([one(i, f"another {i} " * 30) for i in range(300)])
    assert next(W.read_archive(W.dictionary_frame(other) + archive([one(0, "page")] , W.dictionary([one(i, f"page {i} " * 40) for i in range(300)]))[1][0]))["error"]
