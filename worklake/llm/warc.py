"""WARC archives: a writer, and a reader that salvages what it can from damaged ones.

Each record is a gzip member of its own. Spark's text writer writes the archives and commits them, so
a lost task leaves nothing behind: a member's last byte is the top byte of its length, which is 0
(for longer records an empty member follows), and that byte is given to the writer as its line
separator.

The reader checks every member (gzip checksum) and record (version line, length, block digest).
After a failed check it looks for the next place where a member or a version line begins that can be
read, goes on from there, and logs the bytes between as a gap. Archives may be compressed or plain.
A member may hold several records; the same is done with its unpacked bytes, also with those before an
error. Such rows share `offset` and `length` and differ in `inner`, the place in the unpacked bytes.

Null html is an empty payload, a null url leaves the record without target. Pages are written row by
row, repeated ids too. Among rows with equal payloads (of at least `least` bytes) those with the
largest page_id are responses (null is the smallest), the others revisits of it. An empty table gives
no records.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.llm.tables import checkpoint_dir

VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Records in an archive; a page's html must fit in a worker's memory anyway.
PER_ARCHIVE = 2_000
CHUNK = 1 << 16
CUT_OFF = "gzip: cut off"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = (
    "file string, offset long, length long, kind string, problem string, page_id long, record_type string,"
    " payload_digest string, payload_bytes long, refers_to long, payload binary, inner long"
)
_FIELDS = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("problem", pa.string()),
     ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
     ("refers_to", pa.int64()), ("payload", pa.binary()), ("inner", pa.int64())]
)


class Damaged(ValueError):
    """Bytes that are no whole record."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def _page(name: str) -> int | None:
    part = name.strip("<>").split(":")[2]
    return None if part == "none" else int(part)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record, uncompressed."""
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id, digest)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if revisit:
        fields += [("WARC-Refers-To", _name(refers_to, digest)), ("WARC-Profile", _PROFILE)]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(data) + squeeze.flush()
    return out if out[-1] == 0 else out + member(b"")


def parse(data: bytes, at: int = 0, proven: bool = False) -> tuple[dict, int]:
    """The record at `at` and where it ends; Damaged if a check fails, or if `proven` and no digest is told."""
    if not data.startswith(b"WARC/1.", at) or (stop := data.find(b"\r\n", at)) < 0:
        raise Damaged("no version line")
    head, pos = {}, stop + 2
    while (stop := data.find(b"\r\n", pos)) != pos:  # lines of any length and number, up to an empty one
        if stop < 0:
            raise Damaged("no end of header")
        key, colon, value = data[pos:stop].partition(b":")
        if not colon:
            raise Damaged("header line")
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
        pos = stop + 2
    try:
        size = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no length") from None
    block, end = data[pos + 2 : pos + 2 + size], pos + 2 + size
    if size < 0 or len(block) < size or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not fit")
    told = head.get("warc-block-digest", "")
    if (proven or told.startswith("sha1:")) and told.removeprefix("sha1:") != digest32(block):
        raise Damaged("block digest")
    return head | {"block": block}, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at `at` unpacks to, where it ends, and the error that ended it before."""
    tool, out, pos = zlib.decompressobj(31), [], at
    try:
        while not tool.eof and pos < len(data):
            part = data[pos : pos + CHUNK]
            out.append(tool.decompress(part))
            pos += len(part)
    except zlib.error as e:
        tool = zlib.decompressobj(31)  # again, as the failed call gave nothing of what it unpacked
        for k in range(at, pos, CHUNK):
            tool.decompress(data[k : k + CHUNK])
        with contextlib.suppress(zlib.error):
            for pos in range(pos, len(data)):
                out.append(tool.decompress(data[pos : pos + 1]))
        return b"".join(out), pos, f"gzip: {e}"
    if not tool.eof:
        return b"".join(out), len(data), CUT_OFF
    return b"".join(out), pos - len(tool.unused_data), None


def _same(one: dict) -> tuple[str | None, str]:
    return one.get("warc-record-id"), digest32(one["block"])


def _plain(data: bytes, proven: bool) -> Iterator[tuple[int, int, dict | str]]:
    """Offset, end and content of the records in a member's bytes, and of the gaps between them."""
    at = 0
    while at < len(data):
        try:
            one, end = parse(data, at, proven)
        except Damaged as e:
            one, end = str(e), len(data)
            for m in _VERSION.finditer(data, at + 1):
                try:
                    parse(data, m.start(), proven)
                except Damaged:
                    continue
                end = m.start()
                break
        yield at, end, one
        at = end


def _at(data: bytes, at: int) -> tuple[list[tuple[int, int, dict | str]], int, str | None]:
    """What the member or plain record at `at` holds, where it ends, and why that end is not certain."""
    if not data.startswith(b"\x1f\x8b", at):
        try:
            one, end = parse(data, at)
        except Damaged as e:
            return [], at, str(e)
        return [(0, end - at, one)], end, None
    inner, end, problem = _inflate(data, at)
    # Bytes before a bad one may be wrong already: there, records need a digest that proves them.
    found = list(_plain(inner, problem is not None and problem != CUT_OFF))
    if problem is None:
        return found, end, None
    if not any(isinstance(one, dict) for _, _, one in found):
        return [], end, problem
    start = found.pop()[0] if isinstance(found[-1][2], str) else len(inner)
    return [*found, (start, len(inner), problem)], end, problem


def salvage(data: bytes) -> Iterator[tuple[int, int, int, dict | str]]:
    """Offset and length of a member or plain record, offset in the unpacked member, and the record found there.

    Gaps come likewise, with the problem that opened them. Of a damaged member, the records unpacked
    before the damage count; all its rows have the length up to the next place that can be read.
    """
    at, ready = 0, None
    while at < len(data):
        found, end, problem = ready or _at(data, at)
        ready = None
        if problem:
            past, end = end, len(data)
            # Deflate may store bytes as they are: what was unpacked is not to be found again.
            known = {_same(one) for _, _, one in found if isinstance(one, dict)}
            for m in _START.finditer(data, at + 1):
                ready = _at(data, m.start())
                ones = [one for _, _, one in ready[0]]
                good = [one for one in ones if isinstance(one, dict)]
                plain = data.startswith(b"W", m.start())
                if (good or not (ones or ready[2])) and not (plain and m.start() < past and _same(good[0]) in known):
                    end = m.start()
                    break
                ready = None
        for inner, _, one in found or [(0, 0, problem)] * bool(problem):
            yield at, end - at, inner, one
        at = end


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, and of revisits the page they refer to (`revisit` says which are)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("__sha", F.sha1("html")).withColumn("__n", F.octet_length("html"))
    shared = (
        p.filter(F.col("__n") >= least)
        .groupBy("__sha", "__n")
        .agg(F.count("*").alias("__copies"), F.max("page_id").alias("__best"))
        .filter("__copies > 1")
        .drop("__copies")
    )
    revisit = F.coalesce(F.col("page_id") < F.col("__best"), F.col("page_id").isNull() & F.col("__best").isNotNull())
    return p.join(shared, ["__sha", "__n"], "left").select(
        "page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("__best")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, least: int = 0, per_archive: int = PER_ARCHIVE) -> None:
    """Archives of all pages in `folder`."""

    def members(batches):
        for batch in batches:
            cols = [batch.column(n) for n in ("page_id", "url", "html", "revisit", "refers_to")]
            for k in range(0, batch.num_rows, 256):
                rows = zip(*(c.slice(k, 256).to_pylist() for c in cols), strict=True)
                out = [member(record(i, u, h.encode(), r, v))[:-1] for i, u, h, v, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    (
        roles(pages, least)
        .mapInArrow(members, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\0")
        .option("maxRecordsPerFile", per_archive)
        .text(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record (`kind` 'record') and a row for each quarantined gap (`kind` 'gap')."""

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[tuple] = []
                for offset, length, inner, one in salvage(content.as_py()):
                    rows.append(_row(file.as_py(), offset, length, inner, one))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(scan, READ)


def _row(file: str, offset: int, length: int, inner: int, one: dict | str) -> tuple:
    if isinstance(one, str):
        return (file, offset, length, "gap", one, *[None] * 6, inner)
    try:
        head, _, payload = one["block"].partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)[1])
        kind, digest = one["warc-type"], one["warc-payload-digest"].removeprefix("sha1:")
        refers = _page(one["warc-refers-to"]) if kind == "revisit" else None
        return (file, offset, length, "record", None, _page(one["warc-record-id"]), kind, digest, size, refers, payload if kind == "response" else None, inner)
    except (KeyError, IndexError, TypeError, ValueError):
        return (file, offset, length, "gap", "record of another kind", *[None] * 6, inner)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_FIELDS)


def report(pages: DataFrame) -> DataFrame:
    """Per page, from the archives: size, digest, record type and the page it refers to."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return (
        read(spark, folder)
        .filter("kind = 'record'")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
