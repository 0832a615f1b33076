"""Catalog of a landing folder: formats by content, file checks, archive members.

Only paths and sizes come from the file listing; tasks then read the first
4 KiB and the last 4 bytes of each file.  A longer JSON text is read on, block by
block, to the end of its first value: another value after it makes JSON lines.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions import vocab
from tallyscope.functions.rows import quoted

HEADER_BYTES = 4096


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of every file below the folder; no content is read.

    Spark scans skip files of zero bytes, but its listing holds them: those
    come without a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.select("path", "length", F.col("modificationTime").alias("modified"))
    # The names that Spark's own (parallel) listing already holds on the driver.
    names = [(re.sub(r"^(\w+:)/{3}(?=[^/])", r"\1/", unquote(p)),) for p in files.inputFiles()]
    listed = spark.createDataFrame(names, "path string")
    empty = listed.join(found.select("path"), "path", "left_anti")
    return found.unionByName(empty.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modified")))


_MARKS = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)


def _more_values(f, block: int = 1 << 20) -> bool:
    """Whether a JSON text goes on with another object or list after the first one; reads up to there, block by block."""
    depth, quoted_, carried = 0, False, b""
    while part := f.read(block):
        part = carried + part
        # An escape may be cut by the end of a block.
        odd = (len(part) - len(part.rstrip(b"\\"))) % 2
        carried, part = (part[-1:], part[:-1]) if odd else (b"", part)
        for m in _MARKS.finditer(part):
            mark = m.group()
            if mark == b'"':
                quoted_ = not quoted_
            elif quoted_ or len(mark) > 1:
                continue
            elif mark in b"{[":
                depth += 1
            else:
                depth -= 1
                if depth == 0:
                    rest = part[m.end():].lstrip()
                    while not rest and (more := f.read(block)):
                        rest = more.lstrip()
                    return rest[:1] in (b"{", b"[")
    return False


def open_file(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    return system.open_input_file(inner)


def _peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heads, tails, books, more = [], [], [], []
        for path, length in zip(batch["path"], batch["length"]):
            with open_file(path) as f:
                head = f.read(min(HEADER_BYTES, length))
                f.seek(max(0, length - 4))
                tail = f.read(4) if length >= 8 else b""
                book, several = False, None
                if length > HEADER_BYTES and head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] in (b"{", b"["):
                    f.seek(0)
                    several = _more_values(f)
                if head[:4] == b"PK\x03\x04":
                    f.seek(0)
                    try:
                        names = zipfile.ZipFile(f).namelist()
                        book = "[Content_Types].xml" in names and any(n.startswith("xl/") for n in names)
                    except (zipfile.BadZipFile, OSError, ValueError):
                        book = False
            heads.append(head)
            tails.append(tail)
            books.append(book)
            more.append(several)
        yield batch.assign(header=heads, footer=tails, is_workbook=books, several=pd.array(more, dtype="boolean"))


def extension(path: str = "path") -> str:
    """Lower-case extension of the file name, without the dot."""
    return f"lower(regexp_extract({path}, '\\\\.([A-Za-z0-9]+)$', 1))"


def detect_formats(files: DataFrame) -> DataFrame:
    """(path, length, extension, format, reason); format is NULL for unsupported files."""
    peeked = files.select("path", "length").mapInPandas(_peek, "path string, length bigint, header binary, footer binary, is_workbook boolean, several boolean")
    by_extension = "CASE ext " + " ".join(f"WHEN {quoted(e)} THEN {quoted(f)}" for e, f in vocab.EXTENSION_FORMATS.items()) + " END"
    # --- fixed values: signatures and reasons ---
    shaped = peeked.selectExpr(
        "path", "length", "is_workbook", "several", f"{extension()} AS ext", "hex(header) AS head", "hex(footer) AS foot",
        "trim(BOTH '﻿ \t\r\n' FROM make_valid_utf8(CAST(header AS STRING))) AS body",
    ).selectExpr(
        "*", "filter(split(body, '\\r\\n|\\r|\\n'), l -> trim(l) <> '') AS lines", f"{by_extension} AS named",
    ).selectExpr(
        "*", "coalesce(several, size(lines) >= 2 AND forall(slice(lines, 1, 5), l -> try_parse_json(l) IS NOT NULL)) AS json_lines",
        "substring(body, 1, 1) IN ('{', '[') AS json_start", "get(lines, 0) AS first_line",
    )
    decided = """CASE
        WHEN startswith(head, '53514C69746520666F726D6174203300') THEN 'sqlite|magic bytes match SQLite header'
        WHEN startswith(head, '50415231') OR foot = '50415231' THEN 'parquet|PAR1 magic footer detected'
        WHEN startswith(head, 'D0CF11E0A1B11AE1') THEN 'xls|OLE compound-file signature (XLS)'
        WHEN startswith(head, '504B0304') AND is_workbook THEN 'xlsx|ZIP container with XLSX signature'
        WHEN startswith(head, '504B0304') AND ext = 'xlsx' THEN 'xlsx|ZIP + .xlsx extension'
        WHEN startswith(head, '504B0304') THEN 'zip|ZIP container'
        WHEN json_start AND ext IN ('jsonl', 'ndjson') THEN concat('jsonl|extension .', ext)
        WHEN json_start AND json_lines THEN 'jsonl|multiple line-delimited JSON objects detected'
        WHEN json_start THEN 'json|text starts with JSON structure'
        WHEN contains(first_line, '\t') AND ext <> 'csv' THEN 'tsv|tab-delimited first line'
        WHEN ext IN ('csv', 'tsv', 'txt') AND body RLIKE '[,;\t]' THEN concat(CASE WHEN contains(body, '\t') AND NOT contains(body, ',') THEN 'tsv' ELSE 'csv' END, '|delimited text, extension .', ext)
        WHEN named IS NOT NULL THEN concat(named, '|extension mapping (.', ext, ')')
        END"""
    return shaped.selectExpr("path", "length", "ext AS extension", f"{decided} AS decided").selectExpr(
        "path", "length", "extension", "split(decided, '[|]')[0] AS format", "split(decided, '[|]')[1] AS reason")


def _above(value: str, limit: int | None) -> str:
    return "FALSE" if limit is None else f"{value} > {limit}"


def check_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(path, length, error, warning) of each listed file; a size limit only where one is given (``vocab.FILE_MAX_BYTES`` for uploads)."""
    known = ", ".join(quoted(e) for e in vocab.EXTENSION_FORMATS)
    return files.selectExpr(
        "path", "length",
        f"CASE WHEN length = 0 THEN 'File is empty' WHEN {_above('length', max_bytes)} THEN 'File exceeds the maximum size' END AS error",
        f"CASE WHEN {extension()} NOT IN ({known}) THEN concat('Unrecognised extension .', {extension()}) END AS warning")


# --- archives -------------------------------------------------------------------
def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "ord", "member", "size", "compressed", "is_symlink", "broken"]
    for batch in batches:
        for path in batch["path"]:
            out = []
            try:
                with open_file(path) as f:
                    for i, info in enumerate(zipfile.ZipFile(f).infolist()):
                        if not info.is_dir():
                            link = ((info.external_attr >> 16) & 0o170000) == 0o120000
                            out.append((path, i, info.filename, info.file_size, info.compress_size, link, False))
            except (zipfile.BadZipFile, OSError, ValueError):
                out = [(path, 0, None, 0, 0, False, True)]
            yield pd.DataFrame(out, columns=columns)


def archive_members(files: DataFrame) -> DataFrame:
    """One row per archive member with its verdict.

    Unsafe paths, executables and unknown kinds are marked, not dropped; an
    unreadable archive gives one row marked ``broken``.
    """
    rows = files.select("path").mapInPandas(
        _members, "path string, ord int, member string, size bigint, compressed bigint, is_symlink boolean, broken boolean")
    supported = ", ".join(quoted(e) for e in vocab.ARCHIVE_MEMBER_EXTENSIONS)
    executable = ", ".join(quoted(e) for e in vocab.EXECUTABLE_EXTENSIONS)
    unsafe = r"member RLIKE '^[/\\\\]|(^|[/\\\\])[.][.]([/\\\\]|$)|^.:'"
    return rows.selectExpr("*", f"CASE WHEN broken THEN 'broken' WHEN {unsafe} THEN 'unsafe_path' WHEN {extension('member')} IN ({executable}) THEN 'executable' "
                                f"WHEN {extension('member')} IN ({supported}) THEN 'supported' ELSE 'unsupported' END AS verdict")


def archive_verdicts(members: DataFrame, max_files: int | None = None, max_bytes: int | None = None, max_ratio: int | None = None) -> DataFrame:
    """Totals of each archive, the reason to reject it (null: accepted), and its chosen member (the largest).

    Limits hold only where they are given; ``vocab.ARCHIVE_LIMITS`` has those for uploads of strangers.
    """
    totals = members.groupBy("path").agg(
        F.expr("count(member) AS files"), F.expr("sum(size) AS bytes"), F.expr("sum(compressed) AS compressed"), F.expr("bool_or(broken) AS broken"),
        F.expr("count_if(verdict = 'supported') AS supported"),
        F.expr("max_by(member, CASE WHEN verdict = 'supported' THEN struct(size, -ord) END) AS chosen"))
    return totals.selectExpr(
        "path", "files", "bytes", "compressed", "supported", "chosen",
        f"CASE WHEN broken THEN 'not a valid ZIP archive' WHEN {_above('files', max_files)} THEN 'too many files' WHEN {_above('bytes', max_bytes)} THEN 'too large when uncompressed' "
        f"WHEN {_above('bytes / CASE WHEN compressed = 0 THEN 1 ELSE compressed END', max_ratio)} THEN 'suspicious compression ratio' WHEN supported = 0 THEN 'no supported datasets' END AS rejected")


def choose_members(verdicts: DataFrame, members: DataFrame, requested: str | None = None, every: bool = False) -> DataFrame:
    """(path, member, is_symlink) to load from each accepted archive: the requested member, every supported one, or the largest."""
    if every:
        return members.where("verdict = 'supported'").join(verdicts.where("rejected IS NULL").select("path"), "path", "left_semi").select("path", "member", "is_symlink")
    accepted = verdicts.where("rejected IS NULL").select("path", F.lit(requested).alias("wanted") if requested else F.col("chosen").alias("wanted"))
    usable = members.where("verdict = 'supported'").select("path", "member", "is_symlink")
    return accepted.join(usable, "path").where("member = wanted").drop("wanted")


def extract_members(chosen: DataFrame, target: str) -> DataFrame:
    """Copy the chosen members below ``target`` (a shared folder) in parallel; symbolic links are refused.

    A repeated task writes the same file again, so retries are harmless.
    """
    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import shutil

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            out = []
            for path, member in zip(batch["path"], batch["member"]):
                place = f"{root}/{hashlib.sha256(f"{path}\n{member}".encode()).hexdigest()[:16]}/{member.rsplit('/', 1)[-1]}"
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with open_file(path) as f, zipfile.ZipFile(f).open(member) as src, system.open_output_stream(place) as dst:
                    shutil.copyfileobj(src, dst)
                out.append((path, member, place))
            yield pd.DataFrame(out, columns=["path", "member", "extracted"])

    return chosen.where("NOT is_symlink").select("path", "member").mapInPandas(copy, "path string, member string, extracted string")
