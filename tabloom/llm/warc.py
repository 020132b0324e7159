"""WARC archives: writing with segments and revisits, and segment reassembly on reading.

Writing. Of equal payloads of at least LEAST_REVISIT bytes the one with the smallest page_id is
a response record and the others revisit it. A response's block is an HTTP message in chunked
transfer framing; a block longer than the segment limit is written as a first record and
continuation records. Archives are plain .warc text: Spark's text writer puts CR LF CR LF
between records, and each task starts a new file after FILE_BYTES, so that a reader needs no more
than a file in memory.

Reading takes archives of any writer, .warc or .warc.gz (a member for each record or not). Records
are cut by Content-Length, never by what payloads hold. Records of a segmented block are grouped by
origin identifier, ordered by segment number, checked for gaps and for the total length that the
last one states, and joined; then chunked framing is undone. Digests are computed from payloads and
compared with stated ones where their algorithm is known (sha256, sha1, md5; hex or base 32). A
revisit takes length and digest from the response that it refers to, by a join on record ids, and
its own stated digest has to agree. Only segmented blocks are shuffled. A damaged record raises
ValueError naming it. Records that bear no page (warcinfo, request, metadata, conversion) are passed over.

Defined results: null html is an empty payload; a null page_id is written and read back as null;
rows that share page_id and payload are all responses; an empty table gives no archive and no
rows. Archives of others have no page ids: theirs are null; a revisit of a response that is in none
of the archives keeps the digest that it states, if that is sha256, and has null length. Extra
columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import maybe_broadcast, scratch, stored

LEAST_REVISIT = 100
SEGMENT_BYTES = 16 << 10
FILE_BYTES = 32 << 20
CHUNK_BYTES = 4096
_DATE = "2024-01-01T00:00:00Z"
#: Extension fields, which readers pass over that don't know them: the page's id, and what tells
#: segments apart where rows share page_id and payload and so a record id.
_PAGE, _ROW = "X-Page-Id", "X-Row"
#: Record types whose block holds a page.
_PAGES = ("response", "resource", "revisit")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Undoes chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body ends inside a chunk's size")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is not as long as stated")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _id(page_id: int | None, digest: str, part: int = 1) -> str:
    """A record id that follows from page and payload, so that a revisit can name the response's."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest} {part}'.encode()).digest(), version=4)}>"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in url or "about:blank")


def records(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int) -> Iterator[bytes]:
    """The records of one page, each without the blank lines behind it."""
    own = [(_PAGE, str(page_id))] if page_id is not None else []
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), *own]
    if first is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        to = [("WARC-Refers-To", _id(first, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _id(page_id, digest)), *to, *common], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", _id(page_id, digest)), *common], block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        kind = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", _id(page_id, digest, n)), ("WARC-Segment-Number", str(n)), (_ROW, str(row))]
        more = [("WARC-Segment-Origin-ID", _id(page_id, digest))] if n > 1 else []
        total = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield _record([*kind, *more, *total, *common], part)


def parse(archive: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record. Archives may be compressed."""
    source = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    if source.read(2) == b"\x1f\x8b":
        source.seek(0)
        source = io.BufferedReader(gzip.GzipFile(fileobj=source))
    else:
        source.seek(0)
    while first := source.readline():
        if not first.strip():
            continue  # writers differ in blank lines between records
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record where {first[:40]!r} stands")
        fields: dict[str, str] = {}
        name = ""
        for line in iter(source.readline, b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if not text:
                break
            if text[0] in " \t":
                fields[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        length = int(fields["content-length"])
        block = source.read(length)
        if len(block) < length or source.readline().strip(b"\r\n") or source.readline().strip(b"\r\n"):
            raise ValueError(f"record {fields.get('warc-record-id')} is not as long as stated")
        yield fields, block


def _hex(stated: str | None) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a digest field; None for one that can't be told."""
    name, _, value = (stated or "").partition(":")
    name = name.lower().replace("-", "")
    bits = {"sha256": 256, "sha1": 160, "md5": 128}.get(name)
    if bits is None:
        return None
    if len(value) * 4 == bits:
        return name, value.lower()
    try:
        return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except binascii.Error:
        return None


def _number(v: str | None) -> int | None:
    return int(v) if v is not None and v.lstrip("-").isdigit() else None


#: page_id, payload_bytes, payload_digest, record_type, record_id, refers_id, stated, payload
Page = tuple[int | None, int | None, str | None, str, str, str | None, str | None, bytes | None]


def decode(fields: dict[str, str], block: bytes) -> Page:
    """What a whole block of a record of _PAGES holds. stated: the digest of a revisit, as algorithm:hex."""
    kind, name, page = fields["warc-type"], fields["warc-record-id"], _number(fields.get(_PAGE.lower()))
    stated = _hex(fields.get("warc-payload-digest"))
    if kind == "revisit":
        return page, None, None, kind, name, fields.get("warc-refers-to"), stated and ":".join(stated), None
    payload = block
    if kind == "response":
        head, _, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        payload = unchunked(payload) if http.get(b"transfer-encoding") == b"chunked" else payload
    if stated and (found := hashlib.new(stated[0], payload).hexdigest()) != stated[1]:
        raise ValueError(f"record {name}: payload digest {found}, stated {stated[1]}")
    return page, len(payload), hashlib.sha256(payload).hexdigest(), "response", name, None, None, payload


def join(segments: list[tuple[int, int | None, bytes]], origin: str) -> bytes:
    """segments (number, total length of the last or None, block) in any order to the whole block."""
    ordered = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in ordered] != list(range(1, len(ordered) + 1)):
        raise ValueError(f"{origin}: segments {[s[0] for s in ordered]}")
    block = b"".join(s[2] for s in ordered)
    if ordered[-1][1] != len(block):
        raise ValueError(f"{origin}: total length {len(block)}, stated {ordered[-1][1]}")
    return block


def _write(segment: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, row = 0, 0, 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out, files = [], []
                for values in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                    salt, page, url, html, digest, first = values
                    row += 1
                    for r in records(salt + row, page, url, html or b"", digest, first, segment):
                        if held and held + len(r) > file_bytes:
                            number, held = number + 1, 0
                        held += len(r) + 4
                        out.append(r)
                        files.append(number)
                yield pa.record_batch([pa.array(out, pa.binary()), pa.array(files, pa.int32())], names=["value", "file"])

    return run


def write(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Archives of pages (page_id, url, html) under path, a folder of any Hadoop file system.

    Digests are JVM expressions; only digests met more than once, and not the payloads, are
    grouped, so a payload that a third of all pages share is one row of the table joined here.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    read = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = read.filter(F.octet_length("html") >= LEAST_REVISIT)
    firsts = stored(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("_d"), "first"), "firsts")
    both = read.join(maybe_broadcast(firsts), F.col("digest") == F.col("_d"), "left")
    # a task's number and a row's number in it tell apart the segments of rows that share page and payload
    salt = F.shiftleft(F.spark_partition_id().cast("long"), 33)
    to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = both.select(salt.alias("salt"), "page_id", "url", "html", "digest", to.alias("first"))
    out = rows.mapInArrow(_write(segment, file_bytes), "value binary, file int")
    out.select(F.col("value").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", "\r\n\r\n").text(path)


_PARSED = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "record_id": "string", "refers_id": "string", "stated": "string", "payload": "binary"}
_SEGMENT = {"origin": "string", "number": "int", "total": "long", "fields": "map<string,string>", "block": "binary"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns.items())


def _whole(with_payload: bool, segments: bool):
    """Archives to their whole records of _PAGES decoded, or to their segments with origin, number, total."""
    columns = _SEGMENT if segments else _PARSED

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], _ARROW[t]) for i, t in enumerate(columns.values())], names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                rows, size = [], 0
                for fields, block in parse(io.BytesIO(archive.as_buffer())):
                    number = _number(fields.get("warc-segment-number"))
                    if segments != (number is not None):
                        continue
                    if segments:
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"]) + fields.get(_ROW.lower(), "")
                        rows.append((origin, number, _number(fields.get("warc-segment-total-length")), list(fields.items()) if number == 1 else None, block))
                    elif fields.get("warc-type") in _PAGES:
                        found = decode(fields, block)
                        rows.append(found if with_payload else (*found[:-1], None))
                    size += len(block)
                    if rows and (len(rows) == 500 or size > 8 << 20):
                        yield pack(rows)
                        rows, size = [], 0
                yield pack(rows)

    return run


def _rejoin(with_payload: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        totals = [None if pd.isna(t) else int(t) for t in rows["total"]]
        block = join(list(zip(rows["number"].tolist(), totals, rows["block"], strict=True)), rows["origin"].iloc[0])
        fields = dict(next(f for f in rows["fields"] if f is not None))
        if fields["warc-type"] not in _PAGES:
            return pd.DataFrame(columns=list(_PARSED))
        found = decode(fields, block)
        return pd.DataFrame([found if with_payload else (*found[:-1], None)], columns=list(_PARSED)).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    return run


_READ = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload; null for revisits)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    whole = files.mapInArrow(_whole(payloads, False), _ddl(_PARSED))
    parts = files.mapInArrow(_whole(payloads, True), _ddl(_SEGMENT))
    joined = parts.groupBy("origin").applyInPandas(_rejoin(payloads), _ddl(_PARSED))
    found = stored(whole.unionByName(joined), "records")
    pages, again = found.filter("record_type = 'response'"), found.filter("record_type = 'revisit'")
    # responses that share an id hold the same payload; only those that are referred to take part
    wanted = stored(again.select(F.col("refers_id").alias("record_id")).filter("record_id IS NOT NULL").distinct(), "wanted")
    named = pages.join(maybe_broadcast(wanted), "record_id", "left_semi").groupBy("record_id").agg(F.min("page_id").alias("_page"), F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest"))
    named = stored(named.withColumnRenamed("record_id", "_to"), "targets")
    met = again.join(maybe_broadcast(named), F.col("refers_id") == F.col("_to"), "left")
    own = F.when(F.col("stated").startswith("sha256:"), F.substring("stated", 8, 64))
    differs = F.raise_error(F.concat(F.lit("revisit "), "record_id", F.lit(": the response has another digest"))).cast("string")
    met = met.withColumn("payload_digest", F.when(own != F.col("_digest"), differs).otherwise(F.coalesce("_digest", own))).withColumn("payload_bytes", F.col("_bytes")).withColumn("refers_to", F.col("_page"))
    out = pages.withColumn("refers_to", F.lit(None).cast("long")).select(*_READ, "payload").unionByName(met.select(*_READ, "payload"))
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    # a folder without archives has nothing for the reader to find
    fs_path = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = fs_path.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).listStatus(fs_path)
    if not any(s.isDirectory() for s in listed):
        return pages.sparkSession.createDataFrame([], _ddl(_READ))
    return read(pages.sparkSession, path)
