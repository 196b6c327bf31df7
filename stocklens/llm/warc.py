"""WARC archives under Zstandard: one frame per record, the dictionary in a leading skippable frame.

:func:`write_archives` writes each task's records into archives of bounded size below a shared folder and
returns which were written; an attempt that fails leaves a file that no list names.  A payload of
``LEAST`` bytes or more that several pages share is written once, for the largest page id; the others
become revisits of that record.

:func:`read_archives` loads the dictionary, decodes frame by frame, checks header, lengths, record end
and digests, and gives one row per record.  A broken record raises an error that names its place.

A missing payload is an empty one; very long ones are one record each; repeated rows of a page are records of their
own, whatever their payloads; a missing page id
is written as an empty field and read as missing; an empty table gives no archive; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm.tasks import arrow_schema
from stocklens.session import landed, run_folder, ship_package

LEAST = 1_000
#: Bytes after which a task begins another archive, bytes of the dictionary, and pages it is made from.
ARCHIVE, DICTIONARY, SAMPLE, SAMPLE_CHARS = 32 << 20, 64 << 10, 400, 50_000
LEAST_DICTIONARY = 1 << 10
_SKIPPABLE, _DICTIONARY_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec"
_FRAME = b"\x28\xb5\x2f\xfd"
_DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID(int=0)


class BrokenRecord(ValueError):
    """A record that contradicts its own header."""


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = _DATE) -> bytes:
    """One response record, or a revisit without payload if ``refers_to`` is given."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields.insert(2, ("WARC-Refers-To", record_id(refers_to)))
        fields.insert(3, ("WARC-Refers-To-Page", str(refers_to)))
        fields.insert(4, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The record's fields and payload, after all its checks."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise BrokenRecord("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BrokenRecord(f"no field: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BrokenRecord(f"{name} is missing")
    if not fields["content-length"].isdigit():
        raise BrokenRecord("content-length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BrokenRecord(f"block of {size} bytes expected, {len(rest) - 4} found")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise BrokenRecord("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not length:
        raise BrokenRecord("no HTTP header")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != int(length[1]):
            raise BrokenRecord("payload is shorter or longer than its header says")
        if digest and hashlib.sha1(payload).hexdigest() != digest:
            raise BrokenRecord("payload digest differs")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise BrokenRecord(f"unexpected record of type {fields['warc-type']!r}")
    return {"fields": fields, "payload": payload, "payload_bytes": int(length[1]), "payload_digest": digest}


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame that carries the dictionary, itself compressed."""
    content = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", _SKIPPABLE, len(content)) + content


class ArchiveWriter:
    """Appends records, one frame each, to an open file."""

    def __init__(self, file: BinaryIO, dictionary: bytes) -> None:
        self.file, self.size = file, 0
        self._put(leading_frame(dictionary))
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(dict_data=kept, write_checksum=True).compress

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self.compress(raw))


def records(file: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The raw records of an archive, holding one record and one chunk of the file at a time."""
    head = file.read(8)
    if len(head) < 8:
        raise BrokenRecord("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != _SKIPPABLE:
        raise BrokenRecord("the leading frame holds no dictionary")
    content = file.read(size)
    if len(content) != size:
        raise BrokenRecord("the leading frame ends early")
    if content.startswith(_FRAME):
        content = zstandard.ZstdDecompressor().decompress(content)
    if content and not content.startswith(_DICTIONARY_MAGIC):
        raise BrokenRecord("the leading frame holds no dictionary")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    waiting = file.read(chunk)
    while waiting:
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not waiting:
                raise BrokenRecord("the last frame ends early")
            parts.append(frame.decompress(waiting))
            waiting = frame.unused_data if frame.eof else file.read(chunk)
        yield b"".join(parts)
        waiting = waiting or file.read(chunk)


def trained_dictionary(pages: DataFrame, payload_column: str = "html") -> bytes:
    """A dictionary made from a bounded number of bounded pages; empty where they are too few or alike."""
    text = F.col(f"`{payload_column}`")
    rows = pages.select(text.alias("payload"), F.xxhash64(text).alias("place"))
    rows = rows.filter(F.length("payload").between(1, SAMPLE_CHARS))
    # different payloads, the smallest by hash: copies count once, and few enough to broadcast
    places = rows.groupBy("place").agg(F.count("*").alias("copies")).orderBy("place").limit(SAMPLE).select("place")
    chosen = rows.join(F.broadcast(places), "place").groupBy("place").agg(F.min("payload").alias("payload"))
    samples = [r["payload"].encode() for r in chosen.orderBy("place").select("payload").collect()]
    size = DICTIONARY
    while len(samples) >= 16 and size >= LEAST_DICTIONARY:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            size //= 4  # too large for what the samples have in common
    return b""


def _opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def planned(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (bytes) and ``refers_to``, the page a revisit points to."""
    rows = pages.select(
        F.col(f"`{id_column}`").alias("page_id"),
        F.col(f"`{url_column}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_column}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("content", F.when(F.length("payload") >= LEAST, F.sha2("payload", 256)))
    shared = (
        rows.filter(F.col("content").isNotNull())
        .groupBy("content")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("content", "largest")
    )
    # payloads stay where they are: only digests travel to find the revisits
    revisits = landed(
        rows.filter(F.col("content").isNotNull())
        .select("page_id", "content")
        .join(shared, "content")
        .filter("page_id <> largest")
        .distinct(),
        "revisits",
    )
    # a page id may stand in several rows with payloads of their own
    joined = rows.join(revisits, ["page_id", "content"], "left")
    return joined.select("page_id", "url", "payload", F.col("largest").alias("refers_to"))


def write_archives(records_: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write the rows of :func:`planned` below ``folder``; ``path``, ``records`` and ``bytes`` per archive.

    The result is landed, so that the archives it names are those of the attempts that counted.
    """
    spark = records_.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        writer = stream = path = None
        count = 0

        def closed() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [writer.size]})

        for batch in batches:
            for begin in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(begin, 1).to_pydict().items()}
                if writer is None:
                    path, count = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
                    stream = system.open_output_stream(path)
                    writer = ArchiveWriter(stream, shared.value)
                writer.add(record(row["page_id"], row["url"], row["payload"], row["refers_to"]))
                count += 1
                if writer.size >= ARCHIVE:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    written = records_.mapInArrow(run, "path string, records bigint, bytes bigint")
    return landed(written, "archives")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives listed by ``path``, in the file system of ``folder``."""
    ship_package(spark)
    integer = id_type in ("tinyint", "smallint", "int", "bigint")

    def key(text: str | None):
        return None if not text else int(text) if integer else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[dict] = []
                size = 0
                with system.open_input_stream(path) as stream:
                    for number, raw in enumerate(records(stream)):
                        try:
                            found = parsed(raw)
                        except (BrokenRecord, UnicodeDecodeError) as error:
                            raise BrokenRecord(f"{path}, record {number}: {error}") from error
                        held.append(found)
                        size += len(raw)
                        if size >= 4 << 20:
                            yield _batch(held, key, kinds)
                            held, size = [], 0
                if held:
                    yield _batch(held, key, kinds)

    schema = (
        f"page_id {id_type}, url string, record_type string, payload_bytes bigint, payload_digest string, "
        f"refers_to {id_type}, payload binary"
    )
    kinds = arrow_schema(schema)
    return archives.select("path").mapInArrow(run, schema)


def _batch(held: list[dict], key, kinds: pa.Schema) -> pa.RecordBatch:
    columns = {
        "page_id": [key(h["fields"].get("warc-page-id")) for h in held],
        "url": [h["fields"].get("warc-target-uri") for h in held],
        "record_type": [h["fields"]["warc-type"] for h in held],
        "payload_bytes": [h["payload_bytes"] for h in held],
        "payload_digest": [h["payload_digest"] for h in held],
        "refers_to": [key(h["fields"].get("warc-refers-to-page")) for h in held],
        "payload": [h["payload"] for h in held],
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)


def archived(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Write the pages as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")
    listed = write_archives(planned(pages, id_column), folder, trained_dictionary(pages))
    # a listed archive is some megabytes of work: deal them out one by one
    spread = listed.repartition("path")
    return read_archives(spark, spread, folder, pages.schema[id_column].dataType.simpleString())


def read_bytes(data: bytes) -> list[dict]:
    """The parsed records of an archive held in memory."""
    return [parsed(raw) for raw in records(io.BytesIO(data))]
