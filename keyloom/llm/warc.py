"""WARC archives compressed record by record with a dictionary of their own.

A task buffers the first records of an archive, builds a Zstandard dictionary from them, writes it
in a leading skippable frame and then one frame per record, so any record can be read alone given
the dictionary. A new archive is begun when the current one has taken ``archive_bytes`` of records.

Of captures with equal payloads of at least ``revisit_bytes`` bytes the one with the smallest page
id is a response; the others become revisits that name it and carry the digest and length of the
payload instead of the payload. Equal payloads are found from (id, digest, size) rows: minima are
combined before the exchange and only the revisits, not the pages, are joined by digest.

A null html is an empty payload, a null url leaves out the target URI. Rows without an id are
responses. Repeated rows of the first id stay responses. An empty table writes no archive.

Files are written through pyarrow's file systems into a folder that executors share; a task writes
under a temporary name and renames at the end, so a repeated task leaves the same result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import scratch_path, store

#: Fixed values of the formats: the magic of the dictionary's skippable frame, and the profile of
#: a revisit by equal payload.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 64 << 20, 2 << 20, 32 << 10, 6
MANIFEST = "archive string, records bigint, bytes bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {''.join(url.split())}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where there are too few to train on, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    def __init__(self, out, dictionary: zstandard.ZstdCompressionDict, level: int = LEVEL):
        raw = dictionary.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.out, self.bytes, self.records = out, 8 + len(raw), 0
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)

    def add(self, rec: bytes) -> None:
        frame = self.packer.compress(rec)
        self.out.write(frame)
        self.bytes, self.records = self.bytes + len(frame), self.records + 1


def read_archive(src) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, streamed."""
    magic, size = struct.unpack("<II", src.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(src.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(src, read_across_frames=True), 1 << 20)
    while first := plain.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {}
        while (line := plain.readline()) != b"\r\n":
            k, _, v = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            head[k] = v
        n = int(head["Content-Length"])
        block = plain.read(n)
        if len(block) != n or plain.read(4) != b"\r\n\r\n":
            raise ValueError("truncated record")
        yield head, block


def with_revisits(pages: DataFrame, revisit_bytes: int = 100) -> DataFrame:
    """pages (page_id, url, html) with payload_digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("payload_digest", F.sha2(F.encode(html, "UTF-8"), 256))
    small = rows.where(F.octet_length(html) >= revisit_bytes).select("page_id", "payload_digest")
    first = small.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = small.join(first, "payload_digest").where("page_id <> refers_to").distinct()
    return rows.join(later, ["page_id", "payload_digest"], "left")


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of with_revisits; a manifest row per archive. Lazy: write the result once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        held: list[bytes] = []
        size, number, made = 0, 0, []
        writer = sink = None

        def begin():
            nonlocal writer, sink
            temp = f"{base}/.{task:05d}-{number:04d}-{uuid.uuid4().hex}"
            sink = fs.open_output_stream(temp, compression=None)
            writer = ArchiveWriter(sink, build_dictionary([x[:65536] for x in held]))
            writer.temp = temp
            for x in held:
                writer.add(x)
            held.clear()

        def end():
            nonlocal writer, size, number
            sink.close()
            final = f"{base}/part-{task:05d}-{number:04d}.warc.zst"
            fs.move(writer.temp, final)
            made.append((f"{folder}/part-{task:05d}-{number:04d}.warc.zst", writer.records, writer.bytes))
            writer, size, number = None, 0, number + 1

        for batch in batches:
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                x = record(r["page_id"], r["url"], payload, r["payload_digest"], len(payload), r["refers_to"], date)
                size += len(x)
                if writer:
                    writer.add(x)
                else:
                    held.append(x)
                    if size >= SAMPLE_BYTES:
                        begin()
                if writer and size >= archive_bytes:
                    end()
        if held:
            begin()
        if writer:
            end()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([m[0] for m in made], pa.string()), "records": pa.array([m[1] for m in made], pa.int64()), "bytes": pa.array([m[2] for m in made], pa.int64())})

    return rows.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(work, MANIFEST)


def read_archives(manifest: DataFrame, spread: int = 64) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html
    (null for revisits). The payload of a response is digested again and must agree."""
    number = lambda uri: int(n) if (n := uri.strip("<>").rpartition(":")[2]) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, path = pafs.FileSystem.from_uri(name)
                out, size = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as src:
                    for head, block in read_archive(src):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                        digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} does not match its digest")
                        out.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(fields["Content-Length"]), digest, head["WARC-Type"], number(head["WARC-Refers-To"]) if revisit else None, None if revisit else payload.decode("utf-8", "surrogatepass")))
                        size += len(block)
                        if size > 8 << 20:
                            yield _rows(out)
                            out, size = [], 0
                yield _rows(out)

    return manifest.select("archive").repartition(spread, "archive").mapInArrow(work, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string")


_TYPES = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "html": pa.string()}


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(_TYPES.items())})


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages into archives in the shared folder and return their manifest."""
    folder = folder or scratch_path(spark, "warc")
    if "://" not in folder:
        folder = ("file:///" + folder.removeprefix("file:").lstrip("/")) if folder.startswith(("/", "file:")) else folder
    return store(write_archives(with_revisits(pages), folder), "manifest")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
