"""WARC archives: writing, gzip normalising with an offset index, and reading back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import shared_dir, stash

DATE = "2024-01-01T00:00:00Z"
#: Bytes that a reader or writer handles at a time.
STEP = 1 << 20
#: Bytes of a file that one task reads.
SPAN = 16 << 20
END = b"\r\n\r\n"
INDEX = "path string, offset long, size long, record_id string, record_type string, uri string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has no payload: it names the record that has it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": DATE, "WARC-Target-URI": "".join((url or "about:blank").split()) or "about:blank", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + END


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """The header fields of the record that begins ``data``, names in lower case, and where its block starts."""
    end = data.index(END)
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of inflated bytes; at most one record is held."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while True:
            while held[:2] == b"\r\n":
                del held[:2]
            if held.find(END) < 0:
                break
            head, start = headers(bytes(held[: held.find(END) + 4]))
            size = start + int(head["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many."""
    machine, rest = zlib.decompressobj(31), b""
    while data := rest or stream.read(STEP):
        out = machine.decompress(data, STEP)
        rest = machine.unconsumed_tail
        if out:
            yield out
        if machine.eof:
            rest, machine = machine.unused_data.lstrip(b"\0"), zlib.decompressobj(31)


def deflate(data: bytes, level: int) -> bytes:
    machine = zlib.compressobj(level, wbits=31)
    return machine.compress(data) + machine.flush()


def _write(batches: Iterable[pa.RecordBatch], folder: str, level: int, per_file: int) -> Iterator[pa.RecordBatch]:
    """Archives of whole records as one gzip stream each; a file counts once its row is committed."""
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root)
    path, out, machine, size, made = None, None, None, 0, []

    def close() -> None:
        nonlocal path, out
        if out is not None:
            out.write(machine.flush())
            out.close()
            made.append(path)
            path = out = None

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "page_id", "url", "html", "refers_to")), strict=True):
            if out is None:
                path, machine, size = f"{root}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, wbits=31), 0
                out = where.open_output_stream(path, compression=None)
            payload = (row[3] or "").encode()
            data = record(row[0], row[1], row[2], payload, digest32(payload), row[4])
            out.write(machine.compress(data))
            size += len(data)
            if size >= per_file:
                close()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])


def _normalise(batches: Iterable[pa.RecordBatch], folder: str, level: int) -> Iterator[pa.RecordBatch]:
    where, root = fs.FileSystem.from_uri(folder)
    names = [x.split()[0] for x in INDEX.split(", ")]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            new, offset, rows = f"{root}/{uuid.uuid4().hex}.members.warc.gz", 0, []
            with where.open_input_stream(path, compression=None) as source, where.open_output_stream(new, compression=None) as out:
                for data in records(inflate(source)):
                    head, _ = headers(data[: data.index(END) + 4])
                    member = deflate(data, level)
                    out.write(member)
                    rows.append((new, offset, len(member), head["warc-record-id"], head["warc-type"], head.get("warc-target-uri")))
                    offset += len(member)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            index = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)
            pq.write_table(pa.Table.from_batches([index]), new.removesuffix(".warc.gz") + ".cdx.parquet", filesystem=where)
            yield index


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _read(batches: Iterable[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Records by the index, each from its own member: their payloads are digested anew and held against the header."""
    where, _ = fs.FileSystem.from_uri(folder)
    opened, now = None, None
    for batch in batches:
        out = []
        for path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size")), strict=True):
            if path != now:
                if opened is not None:
                    opened.close()
                opened, now = where.open_input_file(path), path
            data = zlib.decompress(opened.read_at(size, offset), 31)
            head, start = headers(data[: data.index(END) + 4])
            block = data[start : start + int(head["content-length"])]
            payload = block[block.index(END) + 4 :]
            told = head["warc-payload-digest"].removeprefix("sha1:")
            number = lambda x: int(x.removeprefix("<urn:page:").rstrip(">"))
            if head["warc-type"] == "response":
                if digest32(payload) != told:
                    raise ValueError(f"{path} at {offset}: the payload differs from its digest")
                out.append((number(head["warc-record-id"]), len(payload), told, "response", None, head["warc-target-uri"], payload if with_payload else None))
            else:
                out.append((number(head["warc-record-id"]), None, told, "revisit", number(head["warc-refers-to"]), head["warc-target-uri"], None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in READ.split(", ")])


def write(pages: DataFrame, folder: str, level: int = 1, least: int = 0, per_file: int = 64 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as monolithic archives, one gzip stream a file, into ``folder`` (any URI
    that pyarrow opens); (path) of the files. Of pages with equal payloads of at least ``least`` bytes, the one of the
    largest page_id has it, the others are revisits of that. Null html: an empty payload. Null page_id: left out.
    Repeated rows of a page_id with one payload: written once each, all responses or all revisits. No pages: no file."""
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    owner = rows.groupBy("sha").agg(F.max("page_id").alias("owner"))
    both = rows.join(owner, "sha")
    again = (F.col("owner") != F.col("page_id")) & (F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    ready = both.select(F.when(again, "revisit").otherwise("response").alias("kind"), "page_id", "url", "html", F.when(again, F.col("owner")).alias("refers_to"))
    return stash(ready.mapInArrow(lambda it: _write(it, folder, level, per_file), "path string"), "archives")


def normalise(archives: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Inflate each whole-file stream of ``archives`` (path) once, rewrite every record as a gzip member of its own, and
    return the index (path, offset, size, record_id, record_type, uri). Beside each ``X.members.warc.gz`` in ``folder``
    its own rows of it are written as ``X.members.cdx.parquet``. A file
    with members already is rewritten alike. A file that ends within a record is an error; an empty one has no rows."""
    n = max(1, archives.count())
    return stash(archives.repartition(n).mapInArrow(lambda it: _normalise(it, folder, level), INDEX), "cdx")


def read(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of an index, each from its own member, dealt out by ``SPAN`` bytes of each file. A revisit's payload
    is that of the record it refers to and isn't read again: its size is null here."""
    span = F.floor(F.col("offset") / SPAN)
    n = max(1, index.select("path", span).distinct().count())
    return index.repartition(n, "path", span).sortWithinPartitions("path", "offset").mapInArrow(lambda it: _read(it, folder, with_payload), READ)


def archive_folder(spark) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``pages`` as read back from the archives.

    Null html: an empty payload. Null page_id: not returned. Null or empty url: ``about:blank``. Repeated rows of a
    page_id: one row each, with its own payload's size and digest, equal or not. Very long html: one record. Empty table: no rows. Other columns: ignored."""
    folder = archive_folder(pages.sparkSession)
    rows = stash(read(normalise(write(pages, folder), folder), folder, with_payload=False).drop("payload", "url"), "read")
    # by digest too: a page_id given with several payloads has as many sizes
    whole = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("n"))
    out = rows.join(whole, (F.coalesce("refers_to", "page_id") == F.col("of")) & (F.col("payload_digest") == F.col("digest")), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
