r"""WARC archives of one Zstandard frame a record, with the dictionary in a leading skippable frame.

``write_archives`` makes archives in a shared folder: each task writes files of at most ``ARCHIVE_BYTES`` (one larger record
makes a larger file) under names of its own, so that a task that runs again never touches another's files, and only files
named in the manifest that Spark commits are read. A file is a skippable frame (magic 0x184D2A5D) with the dictionary, then a
frame for each record. ``read_archives`` streams files frame by frame: it loads the dictionary, decodes one frame at a time,
and checks version line, required headers, Content-Length, the record's end, and a payload's length and SHA-1 digest.

Equal payloads of at least ``least`` bytes are stored once: the record of the largest key is the response and the others are
revisits (identical-payload-digest) that name it and, in their HTTP headers, the payload's length. Smaller payloads are all
responses. Digests are worked out and grouped before payloads move, with partial sums, and the join to them is one that Spark
splits where a digest is frequent.

Defined results: a null payload is empty; rows that repeat a key and payload are each a record of the same kind; a null key
never is what others refer to unless all are null, and is read back as null; an empty table gives no rows; other columns are
not archived; very long payloads are records like any other, held one at a time. A faulty record is read as a row with ``error`` and nulls, and a damaged frame ends its file with such a row
(``strict`` raises instead).
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads of fewer bytes are never made revisits.
LEAST = 1000
#: Compressed bytes after which a task begins another file.
ARCHIVE_BYTES = 64 << 20
#: Rows, and characters of each at most, from which the dictionary is trained; bytes of the dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 300, 200_000, 64 << 10
#: Fixed values of the formats.
SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2020-01-01T00:00:00Z"
RECORD = "record_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary, error string, archive string"


class ArchiveError(ValueError):
    """What is wrong with a record or a frame."""


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from samples; empty if they are too few to train one."""
    size = min(size, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 and size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def record_bytes(key: int | None, uri: str | None, payload: bytes, digest: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A record: headers, HTTP headers, and the payload of a response."""
    urn = lambda k: f"<urn:record:{'' if k is None else k}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {DATE}"]
    if uri:
        # Line breaks would end the header.
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"header line without colon: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _urn(value: str | None) -> int | None:
    if not value or not value.startswith("<urn:record:") or value[-1] != ">":
        raise ArchiveError(f"record id not understood: {value!r}")
    return int(value[12:-1]) if value[12:-1] else None


def parse_record(raw: bytes) -> dict:
    """The fields of RECORD (but for archive) from a decoded frame; raises ArchiveError."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("no WARC version line and headers")
    headers = _headers(lines)
    if missing := [h for h in REQUIRED if h.lower() not in headers]:
        raise ArchiveError(f"missing headers: {', '.join(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4:
        raise ArchiveError(f"Content-Length {headers['content-length']}, but {len(rest) - 4} bytes")
    if rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the record does not end in two line breaks")
    kind, (http, gap, payload) = headers["warc-type"], rest[:-4].partition(b"\r\n\r\n")
    if kind not in ("response", "revisit") or not gap:
        raise ArchiveError(f"record type {kind!r} without HTTP headers")
    length = _headers(http.partition(b"\r\n")[2]).get("content-length", "")
    stated = headers.get("warc-payload-digest", "")
    if not length.isdigit() or not stated.startswith("sha1:"):
        raise ArchiveError("no payload length or digest")
    try:
        digest = base64.b32decode(stated[5:]).hex()
    except ValueError as e:
        raise ArchiveError(f"digest not understood: {stated!r}") from e
    if kind == "response" and (len(payload) != int(length) or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError("the payload's length or digest differs from what is stated")
    if kind == "revisit" and payload:
        raise ArchiveError("a revisit has a payload")
    refers = _urn(headers.get("warc-refers-to")) if kind == "revisit" else None
    return {
        "record_id": _urn(headers["warc-record-id"]), "record_type": kind, "refers_to": refers, "target_uri": headers.get("warc-target-uri"),
        "payload_bytes": int(length), "payload_digest": digest, "payload": payload if kind == "response" else None, "error": None,
    }


def _frames(stream: io.RawIOBase, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The decoded frames after the dictionary; holds one frame at a time."""
    held = b""

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            got = stream.read(max(chunk, n - len(held)))
            if not got:
                return False
            held += got
        return True

    def take(n: int) -> bytes:
        nonlocal held
        if not more(n):
            raise ArchiveError("the file ends within a frame")
        out, held = held[:n], held[n:]
        return out

    if not more(1):
        raise ArchiveError("the file is empty")
    magic, size = struct.unpack("<II", take(8))
    if magic != SKIPPABLE_MAGIC:
        raise ArchiveError("no dictionary frame at the beginning")
    raw = take(size)
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    while more(1):
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not held and not more(1):
                raise ArchiveError("the file ends within a frame")
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"damaged frame: {e}") from e
            held = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def read_archive(stream: io.RawIOBase, strict: bool = False) -> Iterator[dict]:
    """The records of one archive."""
    empty = dict.fromkeys(f.split()[0] for f in RECORD.split(", "))
    frames = _frames(stream)
    while True:
        try:
            raw = next(frames)
        except StopIteration:
            return
        except ArchiveError as e:
            if strict:
                raise
            yield empty | {"error": str(e)}
            return
        try:
            yield parse_record(raw)
        except (ArchiveError, ValueError) as e:
            if strict:
                raise
            yield empty | {"error": str(e)}


class ArchiveWriter:
    """One archive file."""

    def __init__(self, stream, dictionary: bytes):
        self.stream, self.size, self.records = stream, 0, 0
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=made)
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.size += len(raw)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


def marked(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """key, uri, payload, digest, refers_to and revisit of each row."""
    base = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).alias("uri"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    large = pages.select(F.col(key).cast("long").alias("key"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")).where(F.length("payload") >= least)
    shared = large.select("key", F.sha1("payload").alias("digest")).groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = base.join(shared, "digest", "left")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to")), F.lit(False))
    return joined.select("key", "uri", "payload", "digest", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows as marked() gives them; returns the manifest (archive, records, bytes), stored below folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        done, writer, name = [], None, ""

        def close() -> None:
            writer.stream.close()
            done.append((name, writer.records, writer.size))

        for batch in batches:
            for row in batch.to_pylist():
                if writer is not None and writer.size >= archive_bytes:
                    close()
                    writer = None
                if writer is None:
                    name = f"part-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(system.open_output_stream(f"{base}/{name}", compression=None), dictionary)
                writer.add(record_bytes(row["key"], row["uri"], row["payload"], bytes.fromhex(row["digest"]), row["refers_to"], row["revisit"]))
        if writer is not None:
            close()
        names = [folder + "/" + x[0] for x in done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["archive", "records", "bytes"])

    return common.stored(rows.mapInArrow(run, "archive string, records long, bytes long"), folder + "-manifest")


def read_archives(archives: DataFrame, payloads: bool = True, strict: bool = False) -> DataFrame:
    """The records of the files named by archives(archive), each streamed by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for path in batch["archive"]:
                system, base = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(base, compression=None) as stream:
                    for record in read_archive(stream, strict):
                        held += len(record["payload"] or b"") if payloads else 256
                        rows.append(record | {"archive": path} | ({} if payloads else {"payload": None}))
                        if held >= 8 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in ("record_id", "refers_to", "payload_bytes")})

    # A task an archive: those are of about the same size, whatever the number of cores.
    return archives.select("archive").repartition(max(1, archives.count())).mapInPandas(run, RECORD)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest (archive, records, bytes) of what write_archives() wrote to folder: files of tasks that ran twice aren't in it."""
    return spark.read.parquet(folder + "-manifest")


def find_archives(spark: SparkSession, folder: str) -> DataFrame:
    """archive: all .warc.zst files below a folder that others wrote, found by Spark's own listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("archive"))


def sample_dictionary(rows: DataFrame, payload: str = "html") -> bytes:
    """A dictionary from at most SAMPLE_ROWS payloads."""
    few = rows.select(F.col(payload).alias("p")).where(F.length("p").between(1, SAMPLE_CHARS)).limit(SAMPLE_ROWS).collect()
    return train_dictionary([r["p"].encode() for r in few])


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to archives and returns the manifest."""
    folder = folder or common.work_folder(pages.sparkSession, "warc")
    return write_archives(marked(pages), folder, sample_dictionary(pages))


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read back from archives."""
    records = read_archives(archive_pages(pages), payloads=False, strict=True)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS keeper FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN m.keeper IS NULL OR m.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.keeper <> p.page_id THEN m.keeper END AS refers_to
FROM p LEFT JOIN m ON m.h = p.h
"""


def query(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "pages"))
