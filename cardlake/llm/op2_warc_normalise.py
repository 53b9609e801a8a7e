"""WARC archives: writing, and a normaliser for archives compressed as one gzip stream.

A monolithic archive (one gzip member over all records) can only be read from its start. The normaliser inflates such a stream
once, record by record, writes every record as a gzip member of its own, and beside the archive an index with a line for each
record: identifier, type, offset and length. A reader then fetches any record by itself.

Of records with equal payloads that of the least page_id is a response and the others revisit it. The first ones are found on
(page_id, digest) pairs alone; payloads are dealt by page_id, so copies of one payload spread over all tasks.

Null html is an empty payload. Pages that repeat a page_id are all written; those with the least page_id of their payload are
responses. A null page_id counts as larger than all others. Null urls are written as empty. Other columns are ignored; an empty table
writes nothing. A task that runs again writes the same names, and a file appears under its name only when it is whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import opened, partitions, shared_folder

#: Payload bytes of an archive, beyond which another one is begun.
ARCHIVE = 64 << 20
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or if first is given a revisit of that page without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    target = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """A block's header lines and where its body begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, end + 4


class _Whole:
    """A file that gets its name when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        context = TaskContext.get()
        self.part = f"{self.path}.{context.taskAttemptId() if context else 0}.part"
        self.out, self.size = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def stream_records(uri: str) -> Iterator[bytes]:
    """The records of an archive of one or more gzip members, inflated once from its start; holds a record and a chunk."""
    where, path = opened(uri)
    inflate, held, need = zlib.decompressobj(31), bytearray(), 0
    with where.open_input_stream(path, compression=None) as f:
        while data := f.read(CHUNK):
            while data:
                held += inflate.decompress(data, CHUNK)  # a chunk may inflate to a thousand times its size
                data = inflate.unconsumed_tail
                if inflate.eof:
                    data = inflate.unused_data
                    if data:
                        inflate = zlib.decompressobj(31)
                while len(held) >= max(need, 1):
                    if not need:
                        if (end := held.find(b"\r\n\r\n")) < 0:
                            break
                        need = end + 4 + int(headers(bytes(held[: end + 4]))[0]["content-length"]) + 4
                    if len(held) >= need:
                        yield bytes(held[:need])
                        del held[:need]
                        need = 0
    if held:
        raise ValueError(f"{uri} ends within a record")


def normalise(uri: str, to: str, *, keep: bool = False) -> None:
    """Writes to (an archive with a member for each record) and to + '.idx'; these replace the archive unless it is kept.

    If a task that had finished runs again, the archive is gone and there is nothing left to do."""
    where, path = opened(uri)
    target = opened(to)[1]
    if all(x.type == fs.FileType.NotFound if x.path == path else x.is_file for x in where.get_file_info([path, target, f"{target}.idx"])):
        return
    out, index = _Whole(to), _Whole(f"{to}.idx")
    for r in stream_records(uri):
        head, _ = headers(r)
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(r) + pack.flush()
        index.write(
            json.dumps(
                {"id": head["warc-record-id"], "type": head["warc-type"], "offset": out.size, "length": len(member)}
            ).encode() + b"\n"
        )
        out.write(member)
    out.close()
    index.close()
    if not keep:
        where.delete_file(path)


def write_archives(pages: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Monolithic archives of all pages; a row (uri) for each."""
    payload = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    copies = payload.groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("sha1", "first")
    later = payload.select("page_id", "sha1").distinct().join(copies, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(
        F.col("page_id").alias("id"), F.col("sha1").alias("of"), "first"
    )
    rows = payload.join(later, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("of")), "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, held, uris = None, 0, []
        for b in batches:
            for page, url, text, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    uris.append(f"{folder}/whole/part-{part:05d}-{len(uris):05d}.warc.gz")
                    out, held, pack = _Whole(uris[-1]), 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                data = text.encode()
                out.write(pack.compress(record(page, url, data, first)))
                held += len(data)
                if held >= archive:
                    out.write(pack.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
        if uris:
            yield pa.record_batch([pa.array(uris)], names=["uri"])

    # the join has dealt the payloads already: by page_id, or not at all if the other side was small
    dealt = rows.select("page_id", "url", "payload", "first", "sha1").sortWithinPartitions("page_id", "sha1")
    return dealt.select("page_id", "url", "payload", "first").mapInArrow(scan, "uri string")


def normalised(archives: DataFrame) -> DataFrame:
    """Normalises each archive to a folder beside its own; a row (uri) for each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [u.replace("/whole/", "/members/") for u in b.column(0).to_pylist()]
            for u, t in zip(b.column(0).to_pylist(), to, strict=True):
                normalise(u, t)
            yield pa.record_batch([pa.array(to, pa.string())], names=["uri"])

    return archives.repartition(partitions(archives), "uri").mapInArrow(scan, "uri string")


def read_members(archives: DataFrame) -> DataFrame:
    """A row for each record, fetched by the index; responses are held against their digest."""

    def page(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def read(uri: str) -> Iterator[tuple]:
        where, path = opened(uri)
        with where.open_input_stream(f"{path}.idx") as f:
            index = [json.loads(x) for x in f.read().splitlines()]
        with where.open_input_file(path) as f:
            for x in index:
                f.seek(x["offset"])
                data = zlib.decompress(f.read(x["length"]), 31)
                head, body = headers(data)
                http, start = headers(data[body:])
                told = head["warc-payload-digest"].removeprefix("sha1:")
                size = int(http["content-length"])
                if head["warc-type"] == "response":
                    payload = data[body + start : -4]
                    if len(payload) != size or digest(payload) != told:
                        raise ValueError(f"{uri} at {x['offset']}: the payload isn't what was written")
                yield page(head["warc-record-id"]), size, told, head["warc-type"], page(head.get("warc-refers-to")), uri, x["offset"], x["length"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            for uri in b.column(0).to_pylist():
                if rows := list(read(uri)):
                    yield pa.record_batch(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=[c.split()[0] for c in ROWS.split(", ")],
                    )

    return archives.mapInArrow(scan, ROWS)


def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = read_members(normalised(write_archives(pages, shared_folder(spark, "warc"))))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
