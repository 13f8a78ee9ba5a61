"""WARC archives and their two-level capture index.

``write_archive`` writes gzip members, one a record, into files of the shared folder and returns an
index row for each record. ``build_index`` sorts the rows by reversed-host URL key into gzip blocks of
``BLOCK`` lines and keeps a sparse directory with the first key of each block. ``CaptureIndex`` finds
a URL's captures: binary search in the directory, range read of the blocks, range read of the records.

A task writes to a file of a new name, and only files named by index rows that Spark has kept count;
a task that runs twice leaves a file that nothing names. Files go through pyarrow's file systems,
so the folder may be any that they open by URI.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, new_path

#: Lines of an index block.
BLOCK = 3000
#: A task starts another file after this many bytes.
FILE_BYTES = 1 << 30
#: Compression level: time matters more than the last per cent of space.
LEVEL = 3
_INDEX = "key string, page_id long, record_type string, file string, offset long, length long"


def surt(url: str | None) -> str:
    """Reversed-host key: host parts from the right, then path and query; scheme, www, port and fragment go."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return quote(url or "", safe="/?&=,)")
    path = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return quote(",".join(reversed(host.split("."))) + ")" + path, safe="/?&=,)%;:+@~")


def _fs(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its HTTP block, or a revisit that names the response's digest."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises ValueError if its length or ending is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if not lines[0].startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``refers_to``: the largest id of those with an equal payload, else null.

    Null html counts as empty. A null id is never referred to, but its row may be a revisit; repeated
    rows of the largest id are all responses. Null and malformed URLs stay as they are. Payloads under
    ``min_bytes`` are all responses. Other columns are not read; an empty table has an empty archive.

    Counts move as digests alone. Only digests that occur more than once come back to the pages.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sha = F.sha1(F.encode("html", "UTF-8"))
    twice = rows.where(F.octet_length("html") >= min_bytes).groupBy(F.unhex(sha).alias("sha")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    twice = materialise(twice, "warc-copies")
    rows = rows.withColumn("sha", F.unhex(sha)).join(twice, "sha", "left")
    return rows.select("page_id", "url", "html", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``mark_revisits`` and return the index rows, kept as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            made = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip.compress(record(page_id, url, html.encode(), refers_to, date), LEVEL, mtime=0)
                out.write(data)
                made.append((surt(url), page_id, "response" if refers_to is None else "revisit", name, at, len(data)))
                at += len(data)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialise(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, _INDEX), "warc-rows")


def build_index(rows: DataFrame, folder: str) -> DataFrame:
    """Write the blocks; return the directory ``first``, ``block_file``, ``offset``, ``length``, ``lines``, kept as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        out, name, at, block, made = None, f"{uuid.uuid4().hex}.cdx.gz", 0, [], []

        def end() -> None:
            nonlocal out, at, block
            if block:
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip.compress("\n".join(block).encode(), LEVEL, mtime=0)
                out.write(data)
                made.append((block[0].split(" ", 1)[0], name, at, len(data), len(block)))
                at, block = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append(" ".join("-" if v is None else str(v) for v in row))
                if len(block) == BLOCK:
                    end()
        end()
        if out is not None:
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["first", "block_file", "offset", "length", "lines"])

    # The whole row is the order, so a host or URL that many pages share parts over tasks.
    ordered = rows.select("key", "page_id", "record_type", "file", "offset", "length").orderBy("key", "page_id", "file", "offset")
    return materialise(ordered.mapInArrow(run, "first string, block_file string, offset long, length long, lines long"), "warc-directory")


def _entries(data: bytes) -> list[tuple[str, int | None, str, str, int, int]]:
    rows = (line.split(" ") for line in gzip.decompress(data).decode().split("\n"))
    return [(k, None if p == "-" else int(p), t, f, int(o), int(n)) for k, p, t, f, o, n in rows]


def read_index(directory: DataFrame, folder: str) -> DataFrame:
    """All index rows, read from the blocks that the directory names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("block_file", "offset", "length")), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    found = _entries(f.read_at(length, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "record_type", "file", "offset", "length"])

    return directory.repartition("block_file", "offset").mapInArrow(run, _INDEX)


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """``page_id``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to`` of each record.

    Records are read by range in file order. A response's length and digest come from its payload,
    which must agree with its header; a revisit's come from the response that it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        f, now = None, None
        for batch in batches:
            made = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if name != now:
                    f, now = fs.open_input_file(f"{base}/{name}"), name
                head, payload = parse(zlib.decompress(f.read_at(length, offset), 31))
                own = head["WARC-Record-ID"][len("<urn:page:") : -1]
                refers = head.get("WARC-Refers-To")
                refers = int(refers[len("<urn:page:") : -1]) if refers else None
                if refers is None and "sha1:" + digest(payload) != head["WARC-Payload-Digest"]:
                    raise ValueError(f"the payload of page {own} doesn't have its digest")
                made.append((int(own) if own else None, head["WARC-Type"], None if refers is not None else len(payload), head["WARC-Payload-Digest"].removeprefix("sha1:"), refers))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    near = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    got = materialise(near.mapInArrow(run, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"), "warc-read")
    full = got.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("n"))
    # A response may be referred to by very many; Spark splits that key's rows or broadcasts the other side.
    again = got.where("record_type = 'revisit'").join(full, ["refers_to"], "left").where("d is null or d = payload_digest")
    first = got.where("record_type = 'response'")
    return first.unionByName(again.select("page_id", "record_type", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "refers_to"))


class CaptureIndex:
    """Captures by URL. Holds the directory in memory: a row for each BLOCK captures."""

    def __init__(self, directory: DataFrame, folder: str) -> None:
        rows = sorted(directory.collect(), key=lambda r: (r["first"], r["block_file"], r["offset"]))
        self.rows, self.keys, self.folder = rows, [r["first"] for r in rows], folder

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Headers and payloads of a URL's records, in the order of the index."""
        key = surt(url)
        fs, base = _fs(self.folder)
        out = []
        for r in self.rows[max(0, bisect_left(self.keys, key) - 1) : bisect_right(self.keys, key)]:
            with fs.open_input_file(f"{base}/{r['block_file']}") as f:
                found = _entries(f.read_at(r["length"], r["offset"]))
            names = [e[0] for e in found]
            for _, _, _, name, offset, length in found[bisect_left(names, key) : bisect_right(names, key)]:
                with fs.open_input_file(f"{base}/{name}") as f:
                    out.append(parse(zlib.decompress(f.read_at(length, offset), 31)))
        return out


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages to archives with their index, and read them back through it."""
    folder = new_path(spark, "warc")
    rows = write_archive(mark_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    directory = build_index(rows, folder)
    return read_archive(read_index(directory, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
b AS (SELECT *, sha1(h) AS x FROM p),
c AS (SELECT *, array_to_string([lpad(bin(CAST('0x' || substr(x, i, 1) AS INTEGER)), 4, '0') for i in range(1, 41)], '') AS bits FROM b)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([CAST(substr(bits, 5 * i + j, 1) AS INTEGER) * (1 << (5 - j)) for j in range(1, 6)])::INTEGER, 1) for i in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM c
"""
