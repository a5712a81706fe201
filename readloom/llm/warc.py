"""Dictionary-compressed WARC archives.

Each archive (a bounded number of bytes of records) trains a Zstandard dictionary on its own records and leads with it in
a skippable frame; every record is a frame of its own, so any record can be read alone. A task writes its archives under
fresh names in a folder that all machines share and returns the names as rows; only names of tasks that Spark committed
are ever read, so lost or repeated tasks leave no trace in the result.

Of records with equal payloads of at least `least` bytes, that with the largest id is a response and the others are
revisits that refer to it; smaller payloads are all responses.

Defined results: null payloads are empty; null URLs are written as urn:unknown; null ids are written without an id and
come back null; repeated rows are each a record (all rows with the largest id are responses); an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, lean

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 24 << 20, 64 << 10, 6 << 20
LEAST = 1000


def record(page_id: object, url: str | None, payload: bytes, digest: str, size: int, refers_to: object, date: str) -> bytes:
    """A response with its HTTP block, or a revisit without payload when refers_to is given. Control characters in URLs are percent-encoded."""
    name = lambda key: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:unknown"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    lines += [f"X-Payload-Length: {size}"] + ([f"X-Page-ID: {page_id}"] if page_id is not None else [])
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(records: list[bytes], level: int = 6) -> bytes:
    """One archive: the dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    samples, size = [], 0
    for r in records[:: max(1, sum(map(len, records)) // SAMPLE_BYTES)]:
        samples.append(r)
        size += len(r)
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), samples)
    except zstandard.ZstdError:  # too few or too uniform samples: the first records serve as they are
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = trained.as_bytes()
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(content)) + content + b"".join(packer.compress(r) for r in records)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("archive without a leading dictionary frame")
    content = archive[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind)).stream_reader(archive[8 + size :], read_across_frames=True)
    data = reader.read()
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        n = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 8 + n


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives when the returned rows (archive, n_records, n_bytes) are computed; keep those as the manifest."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    large = rows.where(F.col("size") >= least)
    heads = large.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    large = large.join(heads.hint("merge"), "digest", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("head")), F.col("head")))
    # Payloads that cannot be revisits are not shuffled.
    told = large.drop("head").unionByName(rows.where(F.col("size") < least).withColumn("refers_to", F.lit(None).cast(rows.schema["page_id"].dataType)))
    told = told.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data, name = compress(held), f"{at}/{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(name) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], ["archive", "n_records", "n_bytes"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "size", "refers_to")), strict=True):
                held.append(record(row[0], row[1], row[2] or b"", *row[3:], date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return told.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(lean(run), "archive string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives named in the manifest: page_id, url, record_type, payload (of responses), payload_bytes, payload_digest, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{at}/{name}") as f:
                    found = list(parse(f.read()))
                for begin in range(0, len(found), 1000):
                    rows = []
                    for h, block in found[begin : begin + 1000]:
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if h["WARC-Type"] == "response" else None
                        if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
                            raise ValueError(f"damaged record {h['WARC-Record-ID']}")
                        rows.append((h.get("X-Page-ID"), None if h["WARC-Target-URI"] == "urn:unknown" else h["WARC-Target-URI"], h["WARC-Type"], payload, int(h["X-Payload-Length"]), digest, h.get("X-Refers-To-Page-ID")))
                    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
                    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # Archives are dealt over tasks again, as one task of the writer may have named many.
    told = manifest.select("archive").repartition("archive").mapInArrow(run, "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")
    return told.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def archive_folder(pages: DataFrame) -> str:
    return fresh_path(pages.sparkSession, "warc")
