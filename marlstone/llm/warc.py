"""WARC archives with per-record Zstandard compression and an embedded dictionary.

Every partition writes one .warc.zst file. Its dictionary is built from the first records
of the partition (SAMPLE_BYTES at most) and stands in a leading skippable frame, so that
any record can be decompressed on its own; all records are then compressed one
by one. Where the records are too few or too different to train on, the dictionary is their raw content. A file is written under a name of its task attempt and renamed when whole, so a lost
executor or a second attempt leaves no half file under the final name. The folder may lie in
any file system that pyarrow can open by URI.

Equal payloads of at least REVISIT_BYTES are stored once, at the largest page_id; the
others become revisit records. Defined cases: null html is an empty payload; null url is
the empty target; rows with a null page_id keep it; rows repeated with one page_id
are all written, as responses where that page_id is the response; an empty table
writes no file; other columns are ignored, whatever their names. Payloads are written whole, however long.
Reading raises ValueError for an archive that is cut anywhere, holds another number of records than its
manifest says, or a payload that differs from its digest.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import broadcast_if_small, materialize

#: Fixed values of the formats.
DICT_FRAME_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

REVISIT_BYTES = 1000
SAMPLE_BYTES, DICT_BYTES, LEAST_SAMPLES = 2_000_000, 32_768, 16
#: Parts of each digest's rows where the table of repeated digests is too large to broadcast.
SALTS = 32
READ_COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open_folder(uri: str):
    """(file system, path) of a folder URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id, url: str, kind: str, digest: str, payload: bytes | None, size: int, refers_to=None) -> bytes:
    """One WARC record; a revisit carries no payload, only its digest, its size and what it refers to."""
    name = "" if page_id is None else str(page_id)
    block = HTTP_HEAD + payload if kind == "response" else HTTP_HEAD
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields (lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    fields["block"] = rest[: int(fields["content-length"])]
    return fields


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from archived records: trained, or the first bytes of their raw content."""
    import zstandard

    raw = b"".join(r[: DICT_BYTES // len(records) + 64] for r in records)[:DICT_BYTES]
    if len(records) < LEAST_SAMPLES:
        return raw
    size = min(DICT_BYTES, sum(map(len, records)) // 10)
    try:
        return zstandard.train_dictionary(max(size, 1024), [r[:65536] for r in records]).as_bytes()
    except zstandard.ZstdError:  # nothing in common
        return raw


def _with_response(rows: DataFrame, large: Column) -> DataFrame:
    """rows plus response: the largest page_id of a large payload's digest, where several rows have it."""
    # only digests that occur twice reach the join
    repeated = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated.select("digest", "response"), "warc-copies")
    small = broadcast_if_small(repeated)
    if small is not repeated:
        return rows.join(small, "digest", "left")
    # one payload may hold a large share of the pages: its rows are dealt to SALTS tasks
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages (page_id, url, html) below folder; a manifest of file, records, bytes, dict_bytes."""
    ship_package(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("html"), F.sha1(payload).alias("digest"))
    large = F.octet_length("html") >= REVISIT_BYTES
    joined = _with_response(rows, large)
    refers = F.when(large & (F.col("response") != F.col("page_id")), F.col("response"))
    todo = joined.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("size"), F.when(refers.isNull(), F.col("html")).alias("html"), refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _open_folder(folder)
        final = f"{base}/part-{task.partitionId():06d}.warc.zst"
        own = f"{base}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        state = {"n": 0, "bytes": 0}

        def records() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "digest", "size", "html", "refers_to")]
                for k in range(batch.num_rows):
                    page, url, digest, size, html, refers_to = (c[k].as_py() for c in columns)
                    yield record(page, url, "response" if refers_to is None else "revisit", digest, None if html is None else html.encode(), size, refers_to)

        source, sample, size = records(), [], 0
        for r in source:
            sample.append(r)
            size += len(r)
            if size >= SAMPLE_BYTES:
                break
        if not sample:
            return
        words = build_dictionary(sample)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(own, compression=None) as out:

            def put(data: bytes) -> None:
                out.write(data)
                state["bytes"] += len(data)

            put(struct.pack("<II", DICT_FRAME_MAGIC, len(words)) + words)
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
            for part in (sample, source):
                for r in part:
                    put(packer.compress(r))
                    state["n"] += 1
        fs.move(own, final)
        yield pa.RecordBatch.from_pydict({"file": [final.rsplit("/", 1)[1]], "records": [state["n"]], "bytes": [state["bytes"]], "dict_bytes": [len(words)]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("dict_bytes", pa.int64())]))

    return todo.mapInArrow(run, "file string, records long, bytes long, dict_bytes long")


def iterate_archive(stream) -> Iterator[dict]:
    """Records of one open .warc.zst file, read frame by frame with its embedded dictionary."""
    import zstandard

    data, known = stream, None
    head = data.read(8)
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICT_FRAME_MAGIC:
        size = struct.unpack("<II", head)[1]
        words, head = data.read(size), b""
        if len(words) < size:
            raise ValueError("the archive ends inside its dictionary")
        known = zstandard.ZstdCompressionDict(words)
    unpacker, buffer, ended = zstandard.ZstdDecompressor(dict_data=known), head, False
    while not ended or buffer:
        frame, out, fed = unpacker.decompressobj(), io.BytesIO(), False
        while not frame.eof:
            if not buffer:
                buffer = data.read(1 << 20)
                if not buffer:
                    ended = True
                    break
            out.write(frame.decompress(buffer))
            fed = True
            buffer = frame.unused_data if frame.eof else b""
        if not frame.eof:
            if fed:
                raise ValueError("the archive ends inside a record")
            return
        yield parse_record(out.getvalue())


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of all files in a manifest, one file at a time in a task; payloads are checked against their digests."""
    ship_package(spark)

    def page(urn: str | None) -> int | None:
        name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(name) if name else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_folder(folder)
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows: list[tuple] = []
                size = seen = 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for r in iterate_archive(stream):
                        seen += 1
                        kind, digest = r["warc-type"], r["warc-payload-digest"].removeprefix("sha1:")
                        payload = r["block"].partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(r["warc-payload-length"])):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((page(r["warc-record-id"]), r["warc-target-uri"], int(r["warc-payload-length"]), digest, kind, page(r.get("warc-refers-to")), payload if with_payload else None))
                        size += len(r["block"]) if with_payload else 0
                        if size > 4_000_000 or len(rows) >= 10_000:
                            yield _batch(rows)
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{name}: {seen} records, the manifest has {expected}")
                if rows:
                    yield _batch(rows)

    return manifest.select("file", "records").mapInArrow(run, READ_COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))
