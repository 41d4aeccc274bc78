"""WARC archives: write, normalise to one gzip member for each record with an offset index, read back.

Pages are first written as monolithic archives, each one gzip stream over a whole file, as crawlers often leave them. The
normaliser inflates such a stream once, from front to back, rewrites every record as a gzip member of its own and writes a
sidecar index of the members' offsets; on the way it turns records whose payload another record holds into revisits. The
reader then fetches members by their offsets. Files go through Arrow's file systems to the shared folder, under names that
no other attempt of the task uses, and count once the table that names them is written: a lost executor leaves at most a
file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm._shared import fresh_path, materialize, partitions, slices

#: Payload bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
_DATE = "2024-01-01T00:00:00Z"
_GZIP = 31


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def strong(payload: bytes) -> bytes:
    """What equal payloads are told by: there are different ones with one SHA-1."""
    return hashlib.blake2b(payload, digest_size=16).digest()


def _headers(fields: dict[str, object]) -> bytes:
    lines = [f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()


def response(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """One response record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": _DATE, "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Page-ID": page_id, "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(http) + len(payload),
    }
    return _headers(head) + http + payload + b"\r\n\r\n"


def revisit(head: dict[str, str], block: bytes, page_id: int) -> bytes:
    """The revisit record of a response whose payload the record of ``page_id`` holds."""
    http = block[: block.index(b"\r\n\r\n") + 4]
    more = {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(page_id), "X-Refers-To-Page-ID": page_id, "Content-Length": len(http)}
    return _headers(head | more) + http + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    return head, raw[end + 4 : end + 4 + int(head["Content-Length"])]


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an inflated stream; holds one record at a time."""
    buffer = bytearray()
    need = None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                head, _ = parse(bytes(buffer[: end + 4]))
                need = end + 4 + int(head["Content-Length"]) + 4
            if len(buffer) < need:
                break
            yield parse(bytes(buffer[:need]))
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("archive ends within a record")


def inflate(stream, most: int = 1 << 20) -> Iterator[bytes]:
    """Inflate a gzip stream of one or more members, read once, in pieces of at most ``most`` bytes however small the stream.

    A stream that ends within a member is an error, also where a record ends there.
    """
    inflater, begun = zlib.decompressobj(_GZIP), False
    while chunk := stream.read(1 << 20):
        while chunk:
            begun = True
            yield inflater.decompress(chunk, most)
            chunk = inflater.unconsumed_tail
            if inflater.eof:
                chunk = inflater.unused_data
                inflater, begun = zlib.decompressobj(_GZIP), False
    while begun and not inflater.eof:
        if not (piece := inflater.decompress(inflater.unconsumed_tail, most)):
            raise ValueError("archive ends within a gzip member")
        yield piece


def _store(folder: str):
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return files, path


def write(pages: DataFrame, folder: str, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as monolithic archives: (archive, ordinal, page_id, own, bytes) per record.

    A null html is an empty payload; a null url is left out of the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, size, name, deflater = None, [], 0, "", None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal out, rows, size
            if out is not None:
                out.write(deflater.flush())
                out.close()
                out = None
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["archive", "ordinal", "page_id", "own", "bytes"])
                rows, size = [], 0

        files = path = None
        for b in slices(batches):
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (html or "").encode()
                if out is None:
                    if files is None:
                        files, path = _store(folder)
                    name, deflater = uuid.uuid4().hex, zlib.compressobj(1, zlib.DEFLATED, _GZIP)
                    out = files.open_output_stream(f"{path}/{name}.mono.gz", compression=None)
                out.write(deflater.compress(response(page_id, url, payload)))
                rows.append((name, len(rows), page_id, strong(payload), len(payload)))
                size += len(payload)
                if size >= most_bytes:
                    yield from done()
        yield from done()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "archive string, ordinal long, page_id long, own binary, bytes long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite monolithic ``archives`` (archive, revisits: array of (ordinal, first) or null): (archive, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for old, revisits in zip(b.column("archive").to_pylist(), b.column("revisits").to_pylist()):
                files, path = _store(folder)
                first = {r["ordinal"]: r["first"] for r in revisits or ()}
                name, at, index = uuid.uuid4().hex, 0, []
                with files.open_input_stream(f"{path}/{old}.mono.gz", compression=None) as source, files.open_output_stream(f"{path}/{name}.warc.gz", compression=None) as out:
                    for n, (head, block) in enumerate(records(inflate(source))):
                        raw = revisit(head, block, first[n]) if n in first else _headers(head) + block + b"\r\n\r\n"
                        deflater = zlib.compressobj(4, zlib.DEFLATED, _GZIP)
                        member = deflater.compress(raw) + deflater.flush()
                        out.write(member)
                        index.append({"offset": at, "length": len(member), "id": head["WARC-Record-ID"]})
                        at += len(member)
                with files.open_output_stream(f"{path}/{name}.index.jsonl", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                done.append((name, len(index), at))
            if done:
                kinds = [pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["archive", "records", "bytes"])

    return archives.select("archive", "revisits").mapInArrow(run, "archive string, records long, bytes long")


def read(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each record of normalised
    ``archives``: each member is fetched by its offset, and a response's payload is held against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for b in batches:
            for name in b.column("archive").to_pylist():
                files, path = _store(folder)
                with files.open_input_stream(f"{path}/{name}.index.jsonl", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows, held = [], 0
                with files.open_input_file(f"{path}/{name}.warc.gz") as f:
                    for x in index:
                        head, block = parse(zlib.decompress(f.read_at(x["length"], x["offset"]), _GZIP))
                        kind, sha = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                        if payload is not None and digest(payload) != sha:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
                        as_int = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        rows.append((as_int("X-Page-ID"), head.get("WARC-Target-URI"), as_int("X-Payload-Length"), sha, kind, as_int("X-Refers-To-Page-ID"), payload)[: len(names)])
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.select("archive").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Archive ``pages``: the table of normalised archives and their folder.

    Of records with equal payloads of at least ``least_bytes`` bytes that with the smallest page_id is a response, the
    others revisit it. Rows that repeat the smallest page_id are responses too; a row without page_id is a response only if
    no row of its payload has one. Other columns are ignored; an empty table gives no archives.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    written = materialize(write(pages, folder), "records")
    firsts = written.where(F.col("bytes") >= least_bytes).groupBy("own", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1 and first is not null").select("own", "bytes", "first"), "firsts")
    again = written.where(F.col("bytes") >= least_bytes).join(firsts, ["own", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = again.groupBy("archive").agg(F.collect_list(F.struct("ordinal", "first")).alias("revisits"))  # bounded by an archive
    names = written.select("archive").distinct()
    todo = names.join(revisits, "archive", "left").repartition(max(partitions(spark), 8), F.xxhash64("archive"))
    done = materialize(normalise(todo, folder), "archives")
    return done, folder


def roundtrip(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Archive ``pages`` and read the archives back: the rows of ``read``."""
    done, folder = archive(pages, None, least_bytes)
    return read(done.repartition(max(partitions(done.sparkSession), 8), F.xxhash64("archive")), folder, payloads)
