"""Legacy archive converter: ARC files to WARC records, archives written and read back.

An ARC file opens with a version block; its second line gives the version, and
the version the fields of every header line (5 in version 1, 10 in version 2).
Records are cut by their declared lengths.  Each becomes a WARC record with an
identifier derived from file and offset, an ISO timestamp, a type from its
content (``warcinfo`` for the version block, ``response`` for HTTP, ``resource``
otherwise) and SHA-1 digests of block and payload.  Records whose payload
equals that of one with a smaller page id become revisits that refer to it.

Files are rows of ``path, content`` (Spark's binaryFile source) and are parsed
one at a time; those written here are closed at ``ARC_BYTES`` and ``WARC_BYTES``
(a larger record has a file of its own), others should keep usual archive sizes.
WARC files are written with Spark's text writer, whose line separator is the
record separator, so that any shared file system works; blocks may hold any bytes.
Records are numbered by their place in a file, and a task that runs again may put
rows in another order: ``with_revisits`` therefore writes them once.

A null url is written as ``about:blank``, spaces in it are escaped; null html is
an empty payload; null page ids come last in order.  A file that breaks off or
does not parse gives its records up to there and one row of type ``damaged``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.rows import place_of

SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"),
}
#: Bytes at which a file is closed; WARC before compression.
ARC_BYTES, WARC_BYTES = 8 << 20, 64 << 20
_RECORD = "path string, start bigint, page_id bigint, warc_type string, record_id string, date string, uri string, ip string, content_type string, header binary, payload binary, payload_digest string, error string"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def inflated(content: bytes) -> bytes:
    """The bytes of a file, with all gzip members unpacked."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        unzip = zlib.decompressobj(wbits=31)
        out += [unzip.decompress(content), unzip.flush()]
        content = unzip.unused_data.lstrip(b"\0")
    return b"".join(out)


def timestamp(date: str) -> str:
    """ISO form of an ARC date; missing digits are filled up."""
    d = re.sub(r"\D", "", date)[:14]
    d += "19700101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def arc_records(path: str, content: bytes) -> Iterator[dict]:
    """Records of an ARC file in order, the version block first."""
    data, at, fields = inflated(content), 0, ARC_FIELDS["1"]
    while True:
        while data[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc:")
        names = fields
        if first:  # the block itself tells the version; its own header line has as many fields
            version = re.match(rb"\s*([12])\b", data[end + 1:end + 20])
            names = fields = ARC_FIELDS[version[1].decode() if version else "1"]
        parts = line.rsplit(" ", len(names) - 1)
        if first and len(parts) == len(ARC_FIELDS["1"]) and names != ARC_FIELDS["1"]:
            names = ARC_FIELDS["1"]
        record = dict(zip(names, parts))
        size = record.get("length", "")
        if end < 0 or len(parts) != len(names) or not size.isdigit() or end + 1 + int(size) > len(data):
            yield {"path": path, "start": at, "warc_type": "damaged", "error": f"no whole record at byte {at}: {line[:200]}"}
            return
        yield _as_warc(path, at, record, data[end + 1:end + 1 + int(size)], first)
        at = end + 1 + int(size)


def _as_warc(path: str, at: int, record: dict, block: bytes, version_block: bool) -> dict:
    cut = re.search(rb"\r?\n\r?\n", block) if block[:5] == b"HTTP/" else None
    header, payload = (block[:cut.end()], block[cut.end():]) if cut else (b"", block)
    kind = "warcinfo" if version_block else "response" if cut else "resource"
    page = re.search(rb"(?im)^x-page-id:\s*(-?\d+)\s*$", header)
    return {
        "path": path, "start": at, "page_id": int(page[1]) if page else None, "warc_type": kind,
        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{at}')}", "date": timestamp(record["date"]), "uri": record["url"], "ip": record["ip"],
        "content_type": "application/http; msgtype=response" if cut else "application/warc-fields" if version_block else record["type"],
        "header": header, "payload": payload, "payload_digest": sha1(payload), "error": None,
    }


_NAMES = [f.split()[0] for f in _RECORD.split(", ")]
_KINDS = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in _RECORD.split(", ")]


def converted(files: DataFrame) -> DataFrame:
    """WARC records (``_RECORD``) of ARC files given as ``path, content``."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = list(arc_records(path, content or b""))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], k) for n, k in zip(_NAMES, _KINDS)], names=_NAMES)
    return files.select("path", "content").mapInArrow(convert, _RECORD)


def as_arc(pages: DataFrame, records: int = 200) -> DataFrame:
    """ARC files (``path, content``) of ``pages(page_id, url, html)``, in turns of version 1 and 2; at most so many records each."""
    bound = ARC_BYTES

    def opened(path: str, version: str) -> tuple[list[bytes], str]:
        info = f"{version} 0 pages\n{'URL IP-address Archive-date Content-type Archive-length' if version == '1' else 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length'}\n"
        rest = "" if version == "1" else f"200 - - 0 {path} "
        return [f"filedesc://{path} 0.0.0.0 20000101000000 text/plain {rest}{len(info)}\n{info}\n".encode()], rest

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, 0, 0
        out: list[bytes] = []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b"".join(out)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").cast(pa.binary()).to_pylist()):
                html = html or b""
                if held and (held == records or size + len(html) > bound):
                    yield closed()
                    number, held, size = number + 1, 0, 0
                if not held:
                    path = f"pages-{task:06d}-{number:06d}.arc"
                    out, rest = opened(path, "12"[number % 2])
                name = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(html)}\r\n\r\n".encode()
                where = re.sub(r"\s", "%20", url) if url else "about:blank"
                out += [f"{where} 0.0.0.0 20000101000000 text/html {rest}{len(head) + len(html)}\n".encode("utf-8", "replace"), head, html, b"\n"]
                held, size = held + 1, size + len(html)
        if held:
            yield closed()
    return pages.select("page_id", "url", "html").mapInArrow(pack, "path string, content binary")


def with_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``refers_to, refers_uri, refers_date`` of the response that holds an equal payload (null: it holds its own)."""
    path = place_of(records.sparkSession, "records")  # read twice below, with the same ids
    records.write.option("compression", "zstd").parquet(path)
    records = records.sparkSession.read.schema(records.schema).parquet(path)
    facts = records.where("warc_type = 'response'").select("record_id", "page_id", "payload_digest", "uri", "date", F.length("payload").alias("size"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "record_id", "uri", "date")
    holders = facts.where(F.col("size") >= least_bytes).groupBy("payload_digest", "size").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    refers = facts.join(holders, ["payload_digest", "size"]).where("record_id <> first.record_id").select(
        "record_id", F.col("first.record_id").alias("refers_to"), F.col("first.uri").alias("refers_uri"), F.col("first.date").alias("refers_date"))
    # Records are joined by their own id, so a payload with very many copies stays spread out.
    return records.join(refers, "record_id", "left")


def as_warc(records: DataFrame) -> DataFrame:
    """Whole WARC records without the separator that ends them (``record binary``) and the number of their file in the task (``part int``)."""
    bound = WARC_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = 0, 0
        for batch in batches:
            out, parts = [], []
            for r in batch.to_pylist():
                if r["warc_type"] == "damaged":
                    continue
                revisit = r["refers_to"] is not None
                block = r["header"] if revisit else r["header"] + r["payload"]
                lines = [
                    "WARC/1.0", f"WARC-Type: {'revisit' if revisit else r['warc_type']}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}",
                    f"WARC-{'Filename' if r['warc_type'] == 'warcinfo' else 'Target-URI'}: {r['uri']}", f"WARC-IP-Address: {r['ip']}",
                    f"WARC-Block-Digest: sha1:{sha1(block)}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Payload-Length: {len(r['payload'])}"]
                if revisit:
                    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{r['refers_to']}>", f"WARC-Refers-To-Target-URI: {r['refers_uri']}", f"WARC-Refers-To-Date: {r['refers_date']}"]
                lines += [f"Content-Type: {r['content_type']}", f"Content-Length: {len(block)}"]
                record = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block
                if size and size + len(record) > bound:
                    part, size = part + 1, 0
                size += len(record)
                out.append(record)
                parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(parts, pa.int32())], names=["record", "part"])
    wanted = [c for c in _NAMES if c not in ("path", "start", "page_id", "error")] + ["refers_to", "refers_uri", "refers_date"]
    return records.select(*wanted).mapInArrow(write, "record binary, part int")


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files (gzip) below ``path``, a folder for each number of a file within its task."""
    as_warc(records).select(F.col("record").cast("string").alias("value"), "part").write.option("lineSep", SEPARATOR).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").partitionBy("part").text(path)


def warc_records(content: bytes) -> Iterator[dict]:
    """Records of a WARC file: header fields (lower-case names) and block."""
    data, at = inflated(content), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            yield {"error": f"no record at byte {at}"}
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields.get("content-length", "0"))
        block = data[end + 4:end + 4 + size]
        if len(block) < size:
            yield {"error": f"record at byte {at} breaks off"}
            return
        yield fields | {"block": block, "error": None}
        at = end + 4 + size + len(SEPARATOR)


_READ = "page_id bigint, record_type string, record_id string, uri string, date string, payload_bytes bigint, payload_digest string, refers_to_id string, intact boolean, error string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Facts of every record of the WARC files below ``path``; ``intact``: digests and lengths hold."""
    names = [f.split()[0] for f in _READ.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in _READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                out = []
                for r in warc_records(content):
                    if r["error"]:
                        out.append({"error": r["error"]})
                        continue
                    block = r["block"]
                    cut = re.search(rb"\r?\n\r?\n", block) if block[:5] == b"HTTP/" else None
                    payload = block[cut.end():] if cut else block
                    page = re.search(rb"(?im)^x-page-id:\s*(-?\d+)\s*$", block[:cut.end()]) if cut else None
                    digest, revisit = r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"] == "revisit"
                    size = int(r.get("x-payload-length", len(payload)))
                    out.append({
                        "page_id": int(page[1]) if page else None, "record_type": r["warc-type"], "record_id": r["warc-record-id"].strip("<>"), "uri": r.get("warc-target-uri"), "date": r["warc-date"],
                        "payload_bytes": size, "payload_digest": digest, "refers_to_id": r["warc-refers-to"].strip("<>") if revisit else None,
                        "intact": sha1(block) == r["warc-block-digest"].removeprefix("sha1:") and (revisit or (sha1(payload) == digest and len(payload) == size))})
                yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in out], k) for n, k in zip(names, kinds)], names=names)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(read, _READ)


def with_referred_pages(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the page id of the response that a revisit refers to."""
    holders = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(holders, "refers_to_id", "left")
