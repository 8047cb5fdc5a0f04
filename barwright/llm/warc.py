"""WARC archives, written index first and read back by coalesced byte ranges.

Each task writes one archive of gzip members, one per record, and returns an index row per record:
file, offset, length, URL, digest. Readers work from the index: the ranges wanted are sorted per file,
neighbours are joined into one read, and the records are cut from it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barwright.llm import shared

#: One read spans at most this many bytes (or one record), bridging gaps up to READ_GAP.
READ_BYTES = 4 << 20
READ_GAP = 64 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, plain."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[3:3] = [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PAGE = re.compile(r"<urn:page:(-?\d*)>")


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page_id, payload_bytes, digest, type, refers_to, payload) of one record; a wrong digest raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    own, other = (_PAGE.fullmatch(fields.get(k, "<urn:page:>"))[1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"record {own}: its payload doesn't have the digest or length that it states")
    return int(own) if own else None, size, digest, kind, int(other) if other else None, payload if kind == "response" else None


def plan_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): which records are responses, which revisits.

    Of equal payloads of at least min_bytes bytes that of the largest page_id is the response.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        shared.text_bytes(body_col).alias("payload"),
    ).withColumn("sha", F.sha2("payload", 256))
    # decided on ids and hashes alone; payloads then meet their decision by id and hash, so copies of one
    # page, which differ in their ids, don't meet in one task
    narrow = rows.select("page_id", "sha", F.octet_length("payload").alias("size")).distinct()
    first = narrow.groupBy("sha").agg(F.max("page_id").alias("first"))
    again = (F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    plan = narrow.join(first, "sha").where(again).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "first")
    mine = (F.col("sha") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("_id"))
    return rows.join(plan, mine, "left").select(
        "page_id", "url", "payload", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit")
    )


def write(records: DataFrame, base: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the records below ``base`` (a URI that all executors share); returns the stored index.

    A task's file has its attempt in its name, and only the attempt that Spark accepts has index rows;
    what a lost attempt leaves is never read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(base)
        path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        sink, offset = None, 0
        for b in batches:
            out = []
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    store.create_dir(root)
                    sink = store.open_output_stream(path, compression=None)
                data = gzip.compress(record(page_id, url, payload, refers_to, revisit, date), 6, mtime=0)
                sink.write(data)
                kind = "revisit" if revisit else "response"
                out.append((path, offset, len(data), page_id, url, sha1_base32(payload), kind))
                offset += len(data)
            if out:
                yield _batch(out, INDEX)
        if sink is not None:
            sink.close()

    return shared.stored(records.mapInArrow(run, INDEX))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


def read(index: DataFrame, base: str, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name, each parsed and its digest checked.

    ``index`` should be a stored table, or a selection from one, since its lengths are added up first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(base)
        wanted: list[tuple[str, int, int]] = []

        def fetch() -> Iterator[pa.RecordBatch]:
            path, start = wanted[0][0], wanted[0][1]
            with store.open_input_file(path) as f:
                data = f.read_at(max(o + n for _, o, n in wanted) - start, start)
            rows = []
            for _, offset, length in wanted:
                got = parse(gzip.decompress(data[offset - start : offset - start + length]))
                rows.append(got if with_payload else (*got[:5], None))
            wanted.clear()
            yield _batch(rows, RECORD)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if wanted:
                    end = wanted[-1][1] + wanted[-1][2]
                    apart = row[0] != wanted[0][0] or row[1] - end > READ_GAP
                    if apart or row[1] + row[2] - wanted[0][1] > READ_BYTES:
                        yield from fetch()
                wanted.append(row)
        if wanted:
            yield from fetch()

    # as many tasks as the archives' bytes ask for; the index alone is too small to tell
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    chunk = F.floor(F.col("offset") / READ_BYTES)
    ranges = index.select("file", "offset", "length").repartition(tasks, "file", chunk).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(run, RECORD)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, as the archives have them.

    Null html is an empty payload, and empty payloads count as equal. Rows that repeat the largest
    page_id of a payload are all responses; where a payload has null ids only, so are they; a null id
    beside others revisits. An empty table writes nothing. URLs are percent-encoded where they hold
    spaces, controls or letters beyond ASCII, and may be null. Other columns are ignored.
    """
    shared.small_batches(pages.sparkSession)
    base = shared.scratch_dir(pages.sparkSession)
    base = base if "://" in base else f"file://{base}"
    return read(write(plan_records(pages, min_bytes), base), base, with_payload=False).drop("payload")
