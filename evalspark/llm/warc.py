"""WARC archives with a two-level capture index: writing, indexing, looking up, reading back."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import arrays as A
from .store import given_id, landed, row_id

DATE = "2020-01-01T00:00:00Z"  # the pages carry no time of capture
FILE_BYTES = 1 << 26  # compressed bytes after which a task begins another archive
BLOCK_LINES = 512  # captures in a compressed block of the index
SHARD_LINES = 1 << 14  # captures in a shard of the index, at least
MOST_SHARDS = 20_000  # the first keys of all shards go to every executor: KEY_BYTES each at most
KEY_BYTES = 256
RANGE_BYTES = 1 << 22  # stretch of an archive that one task reads from

CAPTURE = "key string, id long, file string, at long, size long"
BLOCK = "shard int, block int, first string, lines binary"
FOUND = "id long, file string, at long, size long"
RECORD = (
    "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


class Archive(NamedTuple):
    captures: DataFrame  # one row per record: where it is
    index: DataFrame  # compressed blocks of sorted captures
    bounds: list[str]  # the first key of each shard, cut to KEY_BYTES


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://b.a.org:80/x?y#z gives org,a,b)/x?y. Default ports, user
    and fragment go; what is no URL is kept after `)`; null gives `)`."""
    if url is None:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + _plain(url)
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        port = f":{port}"
    else:
        port = ""
    name = ",".join(reversed(host.split("."))) + port
    return _plain(f"{name}){parts.path or '/'}{'?' + parts.query if parts.query else ''}")


def _plain(text: str) -> str:
    """No white space or control characters: they would break lines of an index or a header."""
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def _line_key(url: str | None, page: int) -> str:
    return f"{url_key(url)} {page + (1 << 63):020d}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int, url: str | None, payload: bytes, size: int, digest: str, first: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    if first is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{first}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """One record: id, url, record_type, payload_bytes, payload_digest, refers_to, payload (None if revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda name: int(fields[name][len("<urn:page:") : -1])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_bytes": size if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest32(payload),
        "refers_to": page("WARC-Refers-To") if revisit else None, "payload": None if revisit else payload,
    }


def _writer(folder: str):
    """Write records, each a gzip member of its own. A task's files have names of their own, and only the rows
    that Spark keeps name files: what a lost or repeated task has written is never referred to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, at = "", None, 0
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "html", "size", "digest", "first")]
            for page, url, html, size, digest, first in zip(*columns):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                text = base64.b32encode(bytes.fromhex(digest)).decode()
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(_record(page, url, html or b"", size, text, first)) + packer.flush()
                out.write(data)
                rows.append((_line_key(url, page), page, name, at, len(data)))
                at += len(data)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = [c.split()[0] for c in CAPTURE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if out is not None:
            out.close()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted captures to compressed blocks of lines."""
    from pyspark import TaskContext

    shard, number, lines, first = TaskContext.get().partitionId(), 0, [], ""

    def block():
        data = zlib.compress("\n".join(lines).encode(), 6)
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
        names = [c.split()[0] for c in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((shard, number, first, data), kinds)], names=names)

    for batch in batches:
        for key, page, file, at, size in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "file", "at", "size"))):
            if not lines:
                first = key
            lines.append(f"{key} {page} {file} {at} {size}")
            if len(lines) == BLOCK_LINES:
                yield block()
                number, lines = number + 1, []
    if lines:
        yield block()


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_revisit: int = 0,
) -> Archive:
    """Write one record per row below `folder` and index the records.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least `least_revisit` bytes the
    record of the least id is a response, the others are revisits that refer to it; smaller payloads are all
    responses. Rows that share id and payload are all of one type. The index is sorted by reversed-host URL
    key and id, cut into compressed blocks of BLOCK_LINES lines; a shard keeps the first key of each of its
    blocks, and the first keys of the shards (at most MOST_SHARDS) are known to all. `folder` must be one
    that pyarrow.fs can write to from every executor.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(row_id(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("size", F.length("html").cast("long")).withColumn("digest", F.sha1("html"))
    rows = rows.withColumn("same", F.sha2("html", 256))
    known = rows.select("id", "same", "size").distinct()
    large = known.filter(F.col("size") >= least_revisit)
    least = large.groupBy("same", "size").agg(F.min("id").alias("first"))
    # the first of its payload for every other row; joined by id, so that no payload is a hot key of the texts
    first = large.join(least, ["same", "size"]).filter("first < id").select("id", "same", "first")
    captures = rows.join(first, ["id", "same"], "left").mapInArrow(_writer(folder), CAPTURE)
    captures = landed(captures, "captures")
    count = captures.count()
    shards = min(MOST_SHARDS, max(1, -(-count // SHARD_LINES)))
    ordered = captures.repartitionByRange(shards, "key").sortWithinPartitions("key", "at")
    index = landed(ordered.mapInArrow(_blocks, BLOCK), "capture-index")
    heads = index.filter("block = 0").orderBy("shard").select(F.col("shard"), F.col("first"))
    bounds = [(r["shard"], r["first"].encode()[:KEY_BYTES]) for r in heads.collect()]
    return Archive(captures, index, bounds)


def _route(bounds: list[tuple[int, bytes]]):
    """The shards that can hold a key: binary search in the shards' first keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [b for _, b in bounds]
        for batch in batches:
            rows = []
            for page, url in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist()):
                key = _line_key(url, page)
                cut = key.encode()[:KEY_BYTES]
                low = max(0, bisect.bisect_left(heads, cut) - 1)
                rows += [(bounds[s][0], key) for s in range(low, bisect.bisect_right(heads, cut))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.string()))], names=["shard", "key"])

    return run


def _find(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
    """Binary search in the shard's directory of first keys, then in the lines of the block."""
    order = blocks.sort_by("block")
    heads = [x.encode() for x in order.column("first").to_pylist()]
    packed, opened, rows = order.column("lines"), {}, []
    for key in wanted.column("key").to_pylist():
        raw = key.encode()
        low = max(0, bisect.bisect_left(heads, raw) - 1)
        for b in range(low, bisect.bisect_right(heads, raw)):
            if b not in opened:
                opened[b] = zlib.decompress(packed[b].as_py()).split(b"\n")
            lines = opened[b]
            at = bisect.bisect_left(lines, raw + b" ")
            while at < len(lines) and lines[at].startswith(raw + b" "):
                page, file, offset, size = lines[at][len(raw) + 1 :].split(b" ")
                rows.append((int(page), file.decode(), int(offset), int(size)))
                at += 1
    columns = zip(*rows) if rows else ([],) * 4
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "file", "at", "size"])


def lookup(archive: Archive, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Where the records of the wanted (id, url) pairs are, by the index: id, file, at, size. Pairs count once."""
    pairs = wanted.select(row_id(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).distinct()
    routed = pairs.mapInArrow(_route(archive.bounds), "shard int, key string")
    return routed.groupBy("shard").cogroup(archive.index.groupBy("shard")).applyInArrow(_find, FOUND)


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(folder)
        name, source = None, None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            rows = []
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                source.seek(at)
                record = parse_record(zlib.decompress(source.read(size), 31))
                if not with_payload:
                    record["payload"] = None
                rows.append([record[c] for c in names])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if source is not None:
            source.close()

    return run


def read_records(found: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records at the places found, by range reads in the order they lie in."""
    near = found.withColumn("stretch", F.floor(F.col("at") / RANGE_BYTES))
    near = near.repartition("file", "stretch").sortWithinPartitions("file", "at")
    records = near.mapInArrow(_reader(folder, with_payload), RECORD)
    return records.withColumn("id", given_id("id")).withColumn("refers_to", given_id("refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages, look each up in the index and read its record back: page_id, payload_bytes,
    payload_digest (base32 SHA-1), record_type, refers_to (null where the response has no id), url."""
    folder = shared_dir(pages.sparkSession, "warc")
    archive = write_archive(pages, folder, id_col, url_col, html_col)
    records = read_records(lookup(archive, pages, id_col, url_col), folder, with_payload=False)
    return records.select(
        F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
