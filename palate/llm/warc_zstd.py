"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: pages whose payloads are equal (from LEAST_SHARED bytes on) become one response, that of the smallest id, and revisits of it. Only digests
and ids are grouped; the first ids go to the pages by a salted join, so a payload that a third of all pages share is many keys. Every
task trains a dictionary on the first SAMPLE_BYTES of its records and writes archives of about ARCHIVE_BYTES under names of their own; what
a lost or repeated task wrote is never read, as the names of finished archives are a table of the shared folder.

Reading: Spark reads the archives as binary files. An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain
or compressed, or has none. Each further frame must hold exactly one record: checked are the frame's content size, dictionary id and checksum, the version
line, the mandatory headers, Content-Length against the block, the record's end, the digests of block and payload and the HTTP length. A bad record is a
row with ``error``; where a frame cannot be delimited, the rest of its archive is one such row.

Defined results: null html is an empty payload; rows with the smallest id of their payload are all responses, also where that id is repeated; a null id is
never the smallest unless all are null, and then all are responses; white space and control characters in urls are written %-encoded; a null url has no
header; very long pages are records of their own size; an empty table gives no archive and no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.llm.common import BATCH_BYTES, bound_batches
from palate.session import fill_slots, new_path, stage

LEAST_SHARED = 100
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
LEVEL = 3
SALTS = 16
# Fixed values of the formats.
DICTIONARY_FRAME, ZSTD_FRAME, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
CHUNK = 1 << 16


# ---- writing


def _uri(page: str | None) -> str:
    return "<urn:no-page>" if page is None else f"<urn:page:{urllib.parse.quote(page, safe='')}>"


def record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: urllib.parse.quote(m[0]), url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(first)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where they are too few, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(known: zstandard.ZstdCompressionDict) -> bytes:
    content = zstandard.ZstdCompressor(level=LEVEL).compress(known.as_bytes())
    return struct.pack("<II", DICTIONARY_FRAME, len(content)) + content


def _writer(folder: str, date: str):
    def run(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "first", "revisit")]
                for page, url, payload, digest, first, revisit in zip(*columns):
                    yield record(page, url, payload.encode(), digest, first, revisit, date)

        def archive(frames: list[bytes], n: int) -> pa.RecordBatch:
            name = f"pages-{task:06d}-{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                for frame in frames:
                    out.write(frame)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [sum(map(len, frames))]})

        records, samples, size = rows(), [], 0
        for one in records:
            samples.append(one)
            size += len(one)
            if size >= SAMPLE_BYTES:
                break
        if not samples:
            return
        known = dictionary(samples)
        lead = dictionary_frame(known)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True).compress
        frames, n, size = [lead], 0, len(lead)
        for source in (samples, records):
            for one in source:
                frames.append(compress(one))
                n, size = n + 1, size + len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive(frames, n)
                    frames, n, size = [lead], 0, len(lead)
        if n:
            yield archive(frames, n)

    return run


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write every page's record below ``folder``, which all executors share; the archives: archive, records, bytes."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("payload"))
    rows = fill_slots(rows).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy(F.col("digest").alias("of"))
    shared = shared.agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = shared.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(shared, (salted["digest"] == shared["of"]) & (salted["salt"] == shared["of_salt"]), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    ready = joined.select(F.col("id").cast("string").alias("page"), "url", "payload", "digest", F.col("first").cast("string").alias("first"), revisit.alias("revisit"))
    return stage(ready.mapInArrow(_writer(folder, date), "archive string, records bigint, bytes bigint"), "archives")


# ---- reading


class Damaged(ValueError):
    """A record or archive that is not as its headers and lengths say."""


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive, and where its records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    content = bytes(data[8 : 8 + size])
    if len(content) < size:
        raise Damaged("the dictionary's frame is cut off")
    if content[:4] == struct.pack("<I", ZSTD_FRAME):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return zstandard.ZstdCompressionDict(content), 8 + size


def frames(data: memoryview):
    """The content of each frame, one after another, or a Damaged where it does not hold what its header says."""
    known, at = load_dictionary(data)
    # Without a dictionary's own id (raw content) frames carry none either.
    own_id = known.dict_id() if known else 0
    unpack = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] in SKIPPABLE:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        header = zstandard.get_frame_parameters(data[at : at + 18])
        stream, out = unpack.decompressobj(), []
        while not stream.eof:
            piece = data[at : at + CHUNK]
            if not len(piece):
                raise Damaged("the frame is cut off")
            out.append(stream.decompress(piece))
            at += len(piece)
        at -= len(stream.unused_data)
        content = b"".join(out)
        if header.dict_id not in (0, own_id):
            yield Damaged(f"the frame asks for dictionary {header.dict_id}")
        elif header.content_size != zstandard.CONTENTSIZE_UNKNOWN and header.content_size != len(content):
            yield Damaged("the frame's content size is wrong")
        else:
            yield content


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Damaged(f"not a header: {line[:80]!r}")
        out.setdefault(name.lower(), value.strip())
    return first, out


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch("[0-9]+", value):
        raise Damaged(f"not a length: {value[:80]!r}")
    return int(value)


def _digest(value: str | None, content: bytes, what: str) -> None:
    if value is not None and value != "sha256:" + hashlib.sha256(content).hexdigest():
        raise Damaged(f"the {what} digest is wrong")


def _page(uri: str | None) -> str | None:
    if uri == "<urn:no-page>":
        return None
    found = re.fullmatch("<urn:page:(.*)>", uri or "")
    if not found:
        raise Damaged(f"not a record id: {(uri or '')[:80]!r}")
    return urllib.parse.unquote(found[1])


def parse(raw: bytes) -> dict:
    """The record that a frame's content is; raises Damaged if it is not exactly one whole record."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    if not gap:
        raise Damaged("the record has no end of headers")
    version, headers = _headers(head)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise Damaged(f"not a version: {version[:80]!r}")
    for name in MANDATORY:
        if name not in headers:
            raise Damaged(f"{name} is missing")
    size = _length(headers)
    block = body[:size]
    if len(block) < size or body[size:] != b"\r\n\r\n":
        raise Damaged("the block's length is wrong")
    _digest(headers.get("warc-block-digest"), block, "block")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise Damaged(f"unexpected type: {kind[:80]!r}")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, inner = _headers(http)
    if not gap or not status.startswith("HTTP/1."):
        raise Damaged("the block is no HTTP response")
    claimed, digest = _length(inner), headers.get("warc-payload-digest", "")
    if not re.fullmatch("sha256:[0-9a-f]{64}", digest):
        raise Damaged("the payload has no digest")
    if kind == "response":
        if len(payload) != claimed:
            raise Damaged("the payload's length is wrong")
        _digest(digest, payload, "payload")
    elif payload or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers:
        raise Damaged("not a revisit of an equal payload")
    return {
        "record_type": kind, "page": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": claimed,
        "payload_digest": digest.removeprefix("sha256:"), "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None, "error": None,
    }


def read_archive(data) -> Iterator[dict]:
    """All records of one archive, in order; bad ones hold an error."""
    bad = lambda e: dict.fromkeys(_RECORD) | {"error": str(e) or type(e).__name__}
    try:
        for content in frames(memoryview(data)):
            try:
                if isinstance(content, Damaged):
                    raise content
                yield parse(content)
            except (Damaged, UnicodeDecodeError) as e:
                yield bad(e)
    except (Damaged, zstandard.ZstdError) as e:
        yield bad(e)


_RECORD = {
    "record_type": "string", "page": "string", "url": "string", "payload_bytes": "bigint", "payload_digest": "string", "refers_to": "string",
    "payload": "binary", "error": "string",
}


def read_archives(spark: SparkSession, folder: str, finished: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """(archive, position, record's fields) of all ``*.warc.zst`` below ``folder``, or of those named in ``finished`` (archive)."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if finished is not None:
        files = files.join(finished.select("archive"), "archive", "left_semi")
    fields = [c for c in _RECORD if payloads or c != "payload"]
    out = "archive string, position bigint, " + ", ".join(f"{c} {_RECORD[c]}" for c in fields)
    arrow = spark.createDataFrame([], out).toArrow().schema

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content")):
                rows, size = [], 0
                for i, one in enumerate(read_archive(content.as_buffer())):
                    size += len(one["payload"] or b"") if payloads else 0
                    rows.append({"archive": name.as_py(), "position": i, **{c: one[c] for c in fields}})
                    if size >= BATCH_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, out)


def report(pages: DataFrame) -> DataFrame:
    """Every page as read back from its archive; a damaged record fails the query."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    folder = new_path(spark, "warc")
    finished = write_archives(pages, folder)
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if finished.isEmpty():
        return spark.createDataFrame([], f"page_id {kind.simpleString()}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind.simpleString()}")
    read = read_archives(spark, folder, finished, payloads=False)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("archive", F.lit(": "), "error"))).otherwise(F.col("record_type"))
    read = read.withColumns({"record_type": sound, "page_id": F.col("page").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
    return read.select(*out)


SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, strlen(payload) AS n, sha256(payload) AS digest FROM p),
    f AS (SELECT *, CASE WHEN n >= {LEAST_SHARED} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""
