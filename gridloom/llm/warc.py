"""Web archives packaged as ZIP: WARC records in stored members, an index beside them, read by range.

A package holds archive/data.warc.gz (one gzip member a record) and indexes/index.cdxj, both stored
without further compression. So a reader needs only the package's central directory, the index and the
byte ranges of the records that it wants; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


# --- ZIP: directories and stored members ------------------------------------------------------------


class Member(NamedTuple):
    name: str
    start: int  # of the data, in the package
    size: int
    stored: bool


def _wide(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset, read from the ZIP64 extra field where the short fields are full."""
    at, values = 0, []
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
        at += 4 + n
    return tuple(values.pop(0) if x == 0xFFFFFFFF and values else x for x in (size, packed, offset))


def directory(f: BinaryIO, total: int) -> list[Member]:
    """The members of a ZIP package of `total` bytes, by its central directory."""
    tail_at = max(0, total - 65_557 - 20)
    f.seek(tail_at)
    tail = f.read(total - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, locator + 8)
        f.seek(at)
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator leads nowhere")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    f.seek(start)
    raw, at, found = f.read(length), 0, []
    for _ in range(n):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        (method,) = struct.unpack_from("<H", raw, at + 10)
        packed, size = struct.unpack_from("<II", raw, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", raw, at + 28)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8")
        size, packed, offset = _wide(raw[at + 46 + n_name : at + 46 + n_name + n_extra], size, packed, offset)
        f.seek(offset)
        own_name, own_extra = struct.unpack_from("<HH", f.read(30), 26)
        found.append(Member(name, offset + 30 + own_name + own_extra, packed, method == 0))
        at += 46 + n_name + n_extra + n_comment
    return found


def ranges(f: BinaryIO, wanted: Iterable[tuple[int, int]], gap: int = 65_536, most: int = 8 << 20) -> Iterator[bytes]:
    """The bytes of each (start, length), in order; near ranges are fetched together."""
    group: list[tuple[int, int]] = []

    def fetched() -> Iterator[bytes]:
        first = group[0][0]
        f.seek(first)
        data = f.read(group[-1][0] + group[-1][1] - first)
        for a, n in group:
            yield data[a - first : a - first + n]

    for a, n in wanted:
        if group and not (0 <= a - (group[-1][0] + group[-1][1]) <= gap and a + n - group[0][0] <= most):
            yield from fetched()
            group = []
        group.append((a, n))
    if group:
        yield from fetched()


# --- WARC records ------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def record(page_id, url: str | None, payload: bytes, refers_to) -> tuple[bytes, str]:
    """A gzipped response record, or a revisit without payload; and the payload's digest."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        headers.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    block = http + (payload if refers_to is None else b"")
    headers += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(headers).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush(), digest


def parsed(data: bytes) -> dict:
    """The fields of a gzipped record; a response's digest is checked against its payload."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
    if response and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": _page_id(fields.get("WARC-Refers-To")), "payload": payload if response else None,
    }


def package(records: list[tuple[bytes, str, dict]]) -> bytes:
    """A ZIP package of (gzipped record, index key, index fields)."""
    body, lines, at = io.BytesIO(), [], 0
    for data, key, fields in records:
        lines.append(f"{key} {json.dumps(fields | {'offset': at, 'length': len(data)})}")
        body.write(data)
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in ((DATA, body.getvalue()), (INDEX, "\n".join(sorted(lines)).encode("utf-8", "surrogatepass")), ("datapackage.json", b'{"profile": "data-package"}')):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(content)
    return out.getvalue()


# --- Spark: writing and reading ----------------------------------------------------------------------


def responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages and refers_to: of pages with equal payloads of at least least_bytes bytes all but the one with
    the smallest page_id refer to it. Null html counts as empty. Rows that repeat the first page are
    responses too, and so are all of a group without any page_id."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    same = p.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # few payloads repeat; a hot one makes a skewed join, which Spark splits
    joined = p.join(same.where("n > 1").select("sha1", "first"), "sha1", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes packages of about archive_bytes into a folder that all executors reach; returns (path, records).

    Every task attempt writes files of its own, and only those of attempts that ended well are listed."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        pending, size, number = [], 0, 0

        def flushed() -> pd.DataFrame:
            name = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.wacz"
            with store.open_output_stream(name) as f:
                f.write(package(pending))
            return pd.DataFrame({"path": [name], "records": [len(pending)]})

        for pdf in batches:
            for page_id, url, html, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                own, other = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                data, digest = record(own, url, html.encode("utf-8", "surrogatepass"), other)
                pending.append((data, f"{_record_id(own)} {DATE}", {"url": url, "digest": f"sha1:{digest}"}))
                size += len(data)
                if size >= archive_bytes:
                    yield flushed()
                    pending, size, number = [], 0, number + 1
        if pending:
            yield flushed()

    kinds = dict(pages.dtypes)
    ids = [F.col(c).cast("string").alias(c) if kinds[c] != "string" else F.col(c) for c in ("page_id", "refers_to")]
    return pages.select(ids[0], "url", "html", ids[1]).mapInPandas(rows, "path string, records long")


def index(archives: DataFrame, folder: str) -> DataFrame:
    """(path, start, length) of every record that the packages' indexes list, start counted in the package."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path in pdf["path"]:
                with store.open_input_file(path) as f:
                    members = {m.name: m for m in directory(f, f.size())}
                    data, listed = members[DATA], members[INDEX]
                    if not (data.stored and listed.stored):
                        raise ValueError(f"{path}: compressed members can't be read by range")
                    f.seek(listed.start)
                    lines = f.read(listed.size).decode("utf-8", "surrogatepass").split("\n")
                    entries = [json.loads(x[x.index("{") :]) for x in lines if x]
                spans = sorted((data.start + e["offset"], e["length"]) for e in entries)
                yield pd.DataFrame({"path": path, "start": [s for s, _ in spans], "length": [n for _, n in spans]})

    return archives.select("path").mapInPandas(rows, "path string, start long, length long")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(spans: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records at (path, start, length), each fetched by range."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path, part in pdf.groupby("path", sort=False):
                found = []
                with store.open_input_file(path) as f:
                    for data in ranges(f, zip(part["start"], part["length"], strict=True)):
                        r = parsed(data)
                        if not payloads:
                            r.pop("payload")
                        found.append(r)
                ids = {c: pd.array([r.pop(c) for r in found], dtype="Int64") for c in ("page_id", "refers_to")}
                yield pd.DataFrame(found).assign(**ids)

    return spans.mapInPandas(rows, RECORDS + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes an archive record for every page and reads all of them back."""
    spark = pages.sparkSession
    folder = common.shared_dir(spark) + "/archives"
    listed = common.written(write(responses(pages, least_bytes), folder), "archive_list")
    # a package each task, or a few
    return read(index(listed.repartition(common.partitions(spark)), folder), folder)
