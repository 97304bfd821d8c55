"""WARC archives of pages, and a two-level index of their captures.

Every task writes archives of its own, one compressed member for each record, under names that no other
attempt uses; the written table of captures names those that count, so lost or repeated attempts
leave nothing but unused files. The index holds the captures sorted by address, host labels reversed,
in compressed blocks; every shard ends with a sparse directory that has each block's first key. A
look-up finds shard and block by binary search, reads and unpacks that block alone, and then reads
the record's byte range.

Files are reached through pyarrow's file systems, in the shared folder that the cluster names.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_engine.llm.common import Scratch, map_arrow, materialize, scratch_path, texts

#: Payloads below this many bytes are never revisited.
LEAST_REVISITED = 100
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 28
#: Captures in a block of the index.
BLOCK = 1000

CAPTURES = "key string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def file_system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def address_key(url: str | None) -> str:
    """Host labels reversed, then path and query: neighbours in the index are neighbours on the web."""
    _, found, rest = (url or "").partition("://")
    rest = rest if found else ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = ",".join(reversed(rest[:end].lower().split(".")))
    return f"{host}){rest[end:].partition('#')[0]}"


def _number(value: int | None) -> str:
    return "none" if value is None else str(value)


def record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """A response with its payload, or a revisit of the page ``first``."""
    # An address takes one line of the header, whatever is in it.
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_number(page_id)}>",
        f"WARC-Target-URI: {json.dumps(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The values of ``RECORDS``; raises if a response's payload is not what its digest says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    digest, size, first = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"]), None
    if fields["WARC-Type"] == "response":
        payload = rest[: int(fields["Content-Length"])]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"damaged record of page {page}")
    else:
        first = int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    return (None if page == "none" else int(page), size, digest, fields["WARC-Type"], first, json.loads(fields["WARC-Target-URI"]))


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)], names=[n for n, _ in names])


def _writing(folder: str):
    """Task: records into archives; yields where each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, revisit, first in zip(*(
                    batch.column(i).to_pylist() if i != 2 else texts(batch.column(2)) for i in range(6)
                )):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url, payload, digest, first if revisit else None), 4, mtime=0)
                    out.write(member)
                    rows.append((address_key(url), page_id, name, at, len(member)))
                    at += len(member)
                yield _columns(rows, CAPTURES)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record of every page; ``CAPTURES``, written.

    Of pages with equal payloads of ``LEAST_REVISITED`` bytes or more, those with the smallest id are
    responses, the others revisit it.
    """
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    scratch = Scratch(pages.sparkSession)
    facts = scratch.write(
        rows.where(F.octet_length("payload") >= LEAST_REVISITED).select("page_id", "digest"), "warc-digests"
    )
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = (
        facts.join(firsts.where("first is not null"), "digest")
        .where("not page_id <=> first")
        .select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "first")
        .distinct()
    )
    condition = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    typed = rows.join(revisits, condition, "left").select(
        "page_id", "url", "payload", "digest", F.col("first").isNotNull().alias("revisit"), "first"
    )
    captures = materialize(map_arrow(typed, _writing(folder), CAPTURES), "warc-captures")
    scratch.clear()
    return captures


SHARDS = "key string, page_id long, file string, n long"


def _order(key: str, page_id: int | None) -> tuple:
    """Sorts like Spark: by the key's bytes, a missing id first."""
    return key.encode(), page_id is not None, page_id or 0


def _indexing(folder: str, block: int):
    """Task: one shard of the sorted captures: compressed blocks, their directory, and where that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        out, at, total, first, directory, waiting = None, 0, 0, None, [], []

        def flush() -> None:
            nonlocal at, waiting
            data = zlib.compress("\n".join(json.dumps(r) for r in waiting).encode(), 6)
            out.write(data)
            directory.append((*waiting[0][:2], at, len(data)))
            at += len(data)
            waiting = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, first = system.open_output_stream(f"{base}/{name}", compression=None), row
                waiting.append(row)
                total += 1
                if len(waiting) == block:
                    flush()
        if out is not None:
            if waiting:
                flush()
            data = zlib.compress("\n".join(json.dumps(r) for r in directory).encode(), 6)
            out.write(data + at.to_bytes(8, "little") + len(data).to_bytes(8, "little"))
            out.close()
            yield _columns([(first[0], first[1], name, total)], SHARDS)

    return run


class _Shard:
    """Task-side reader of one shard; holds its directory and the block read last."""

    def __init__(self, system: arrow_fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        self.file.seek(self.file.size() - 16)
        tail = self.file.read(16)
        self.directory = self._lines(int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little"))
        self.starts = [_order(*entry[:2]) for entry in self.directory]
        self.number, self.rows, self.orders = -1, [], []

    def _lines(self, at: int, size: int) -> list:
        self.file.seek(at)
        return [json.loads(line) for line in zlib.decompress(self.file.read(size)).decode().split("\n")]

    def _load(self, number: int) -> None:
        if number != self.number:
            self.rows = self._lines(*self.directory[number][2:])
            self.orders, self.number = [_order(*r[:2]) for r in self.rows], number

    def find(self, wanted: tuple) -> Iterator[list]:
        """Captures with this key and id; equal ones may go on in the next block."""
        number = max(bisect.bisect_left(self.starts, wanted) - 1, 0)
        while number < len(self.starts) and self.starts[number] <= wanted:
            self._load(number)
            for i in range(bisect.bisect_left(self.orders, wanted), bisect.bisect_right(self.orders, wanted)):
                yield self.rows[i]
            number += 1


def _locating(folder: str, shards: list[tuple]):
    """Task: sorted queries to the places of their captures."""
    starts = [_order(key, page_id) for key, page_id, _ in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        number, shard = -1, None
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wanted = _order(key, page_id)
                at = bisect.bisect_right(starts, wanted) - 1
                if at < 0:
                    continue
                if at != number:
                    number, shard = at, _Shard(system, f"{base}/{shards[at][2]}")
                rows += [tuple(r) for r in shard.find(wanted)]
            yield _columns(rows, CAPTURES)

    return run


def _reading(folder: str):
    """Task: places, in the order of the archives, to records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for wanted, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if wanted != name:
                    name, file = wanted, system.open_input_file(f"{base}/{wanted}")
                file.seek(at)
                rows.append(parse(gzip.decompress(file.read(size))))
            yield _columns(rows, RECORDS)

    return run


@dataclass
class CaptureIndex:
    """Archives with their index: ``shards`` has a row for each sorted part of the captures."""

    spark: SparkSession
    folder: str
    shards: list[tuple]

    def look_up(self, queries: DataFrame) -> DataFrame:
        """``CAPTURES`` of the distinct ``key, page_id`` asked for; those that are not there give no row."""
        order = ["key", "page_id"]
        asked = queries.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
        return map_arrow(asked, _locating(self.folder, self.shards), CAPTURES)

    def read(self, places: DataFrame) -> DataFrame:
        """``RECORDS`` at the places that ``look_up`` found."""
        order = ["file", "offset"]
        rows = places.select("file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
        return map_arrow(rows, _reading(self.folder), RECORDS)


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> CaptureIndex:
    """Sort captures by key and id into shards; what the driver gets is one row for each shard."""
    order = ["key", "page_id"]
    rows = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(map_arrow(rows, _indexing(folder, block), SHARDS), "warc-shards")
    shards = sorted(((r["key"], r["page_id"], r["file"]) for r in written.collect()), key=lambda s: _order(*s[:2]))
    return CaptureIndex(captures.sparkSession, folder, shards)


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive all pages, index the captures, look all of them up, and read their records: ``RECORDS``, written.

    Missing HTML is an empty payload; a missing or malformed url has an empty host in its key; rows that
    repeat get a record each, and pages of one id and payload are of one type; a missing id is the
    last to be a response, and never referred to; other columns are ignored; an empty table gives an
    empty table.
    """
    folder = folder or scratch_path(pages.sparkSession, "archives")
    captures = write_archives(pages, folder)
    index = build_index(captures, folder)
    places = materialize(index.look_up(captures), "warc-places")
    return materialize(index.read(places), "warc-records")
