"""WARC archives with dictionary compression, written and read by tasks.

An archive is a ``.warc.zst`` file: a skippable Zstandard frame that holds the
dictionary, then one frame for each record, compressed with it, so that any
record can be read alone. The dictionary is trained once, from a bounded sample
of the records as they are archived, headers included, in pieces from all over
each, and embedded in every archive.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with
the largest id is a response and the others are revisits that refer to it and
carry no payload. A response holds an HTTP head before its payload; a revisit
names the record, the URI and the date that it refers to. Which these are is found on digests, in a narrow table; the
payload is shuffled once, to bring record kinds and payloads together.

Archives go to a folder that all machines share (by default the session's
checkpoint folder), under names of their own for each attempt of a task. The
names that count are those in the manifest, the rows of the write that
succeeded; what lost or repeated attempts left is never read.

A null payload is empty. Null ids sort below all others. Rows that share id and
payload are all responses if their id is the largest. Repeated rows have a
record each. An empty table gives no archive and no rows. Columns other than
id, URL and payload are not read. A payload of any length is one record, held
in memory while it is written and read.
"""

from __future__ import annotations

import hashlib
import random
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.staging import scratch_path, stage

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class ArchiveFormat:
    min_revisit: int = 1000
    level: int = 3
    archive_bytes: int = 64 << 20  # of payload; a longer record has its own
    dictionary_bytes: int = 64 << 10
    # the sample the dictionary is trained from: so many records, so many
    # bytes of each, in so many pieces
    sample_records: int = 1000
    sample_bytes: int = 8 << 10
    sample_pieces: int = 8
    date: str = "2024-01-01T00:00:00Z"


DEFAULTS = ArchiveFormat()
PAGE = "id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlsplit(path).scheme else (pafs.LocalFileSystem(), path)


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {_one_line(v)}" for k, v in headers.items())]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


HTTP_END = b"\r\n\r\n"


def record_id(name: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}|{digest}')}>"


def page_record(name: str, url: str | None, payload: bytes | None, digest: str, size: int, refers: str | None, refers_url: str | None, form: ArchiveFormat) -> bytes:
    """The record of a page: a response, or a revisit where it refers to one."""
    headers = {
        "WARC-Record-ID": record_id(name, digest),
        "WARC-Date": form.date,
        "WARC-Target-URI": url or "",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "X-Page-ID": name,
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + HTTP_END
    if refers is None:
        return record("response", headers, http + (payload or b""))
    told = {
        "WARC-Profile": REVISIT_PROFILE,
        "WARC-Refers-To": record_id(refers, digest),
        "WARC-Refers-To-Target-URI": refers_url or "",
        "WARC-Refers-To-Date": form.date,
        "X-Refers-To-Page-ID": refers,
        "X-Payload-Length": str(size),
    }
    return record("revisit", headers | told, http)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    block = rest[:size]
    if headers.get("Content-Type", "").startswith("application/http"):
        block = block.partition(HTTP_END)[2]
    return headers, block


def train_dictionary(samples: list[bytes], form: ArchiveFormat = DEFAULTS) -> bytes:
    """A dictionary as bytes; empty without samples. Where the samples are too
    few to train from, they are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(form.dictionary_bytes, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[: form.dictionary_bytes]


def pieces(data: bytes, digest: str, form: ArchiveFormat = DEFAULTS) -> bytes:
    """At most ``sample_bytes`` of a record: its beginning, its end, and places
    between them that its digest chooses."""
    if len(data) <= form.sample_bytes:
        return data
    size = form.sample_bytes // form.sample_pieces
    inner = random.Random(digest).sample(range(1, len(data) // size - 1), min(form.sample_pieces - 2, len(data) // size - 2))
    return b"".join(data[k * size : (k + 1) * size] for k in (0, *sorted(inner))) + data[-size:]


def _sampled(form: ArchiveFormat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, samples = batch.column("digest").to_pylist(), []
            for row in zip(*(batch.column(c) for c in ("name", "url", "payload", "digest", "size")), strict=True):
                name, url, payload, digest, size = (x.as_py() for x in row)
                samples.append(pieces(page_record(name, url, payload, digest, size, None, None, form), digest, form))
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.string()), "sample": pa.array(samples, pa.binary())})

    return run


def _train(form: ArchiveFormat):
    def run(table: pa.Table) -> pa.Table:
        samples = sorted(x for x in table.column("sample").to_pylist() if x)
        return pa.table({"dictionary": pa.array([train_dictionary(samples, form)], pa.binary())})

    return run


def dictionary_of(rows: DataFrame, form: ArchiveFormat = DEFAULTS) -> bytes:
    """Trained in one task from at most ``sample_records`` records, cut to
    ``sample_bytes`` each by the tasks that read them."""
    # digests are ordered, not payloads; copies of a payload count once
    chosen = rows.select("digest").distinct().orderBy(F.xxhash64("digest"), "digest").limit(form.sample_records)
    name = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name")
    read = rows.select(name, "url", "payload", "digest", "size").join(F.broadcast(chosen), "digest")
    sample = read.mapInArrow(_sampled(form), "digest string, sample binary")
    # of copies, the least sample
    sample = sample.groupBy("digest").agg(F.min("sample").alias("sample"))
    done = sample.select("sample").groupBy().applyInArrow(_train(form), "dictionary binary")
    row = done.first()
    return bytes(row[0]) if row else b""


class Archive:
    """Writes one archive; records are compressed one by one."""

    def __init__(self, folder: str, dictionary: bytes, form: ArchiveFormat):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = _open(self.path)
        fs.create_dir(folder if not urlsplit(folder).scheme else _open(folder)[1], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        kind = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=form.level, dict_data=kind, write_content_size=True)
        self.size = self.records = 0

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.out.close()
        return self.path, self.records


def read_archive(path: str, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one in memory at a time."""
    fs, local = _open(path)
    with fs.open_input_stream(local, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        dictionary = source.read(size)
        kind = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        reader = zstandard.ZstdDecompressor(dict_data=kind)
        frame, parts, data = reader.decompressobj(), [], b""
        while data or (data := source.read(chunk)):
            parts.append(frame.decompress(data))
            data = b""
            if frame.eof:
                yield parsed(b"".join(parts))
                data = frame.unused_data
                frame, parts = reader.decompressobj(), []


def _write(sent: Broadcast, folder: str, form: ArchiveFormat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("name", "url", "payload", "digest", "size", "refers", "refers_url")), strict=True):
                page = [x.as_py() for x in row]
                if archive is None:
                    archive = Archive(folder, sent.value, form)
                archive.add(page_record(*page, form))
                if archive.size >= form.archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        paths, counts = zip(*done, strict=True) if done else ((), ())
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "records": pa.array(counts, pa.int64())})

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ["name", "size", "digest", "kind", "refers"]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        values = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=columns)

    for given in batches:
        for path in given.column("path").to_pylist():
            for headers, block in read_archive(path):
                kind, told = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(block).hexdigest() != told:
                    raise ValueError(f"{path}: a payload does not match its digest")
                size = len(block) if kind == "response" else int(headers["X-Payload-Length"])
                rows.append((headers["X-Page-ID"], size, told, kind, headers.get("X-Refers-To-Page-ID")))
                if len(rows) >= 5000:
                    yield batch()
                    rows.clear()
    yield batch()


def payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload).alias("digest"),
        F.sha2(payload, 256).alias("same"),
    )


def revisits(rows: DataFrame, form: ArchiveFormat = DEFAULTS) -> DataFrame:
    """(id, same, refers, refers_url): the rows that are revisits, once each."""
    large = rows.where(F.col("size") >= form.min_revisit).select("id", "same", "url")
    ids = stage(large.groupBy("same", "id").agg(F.min("url").alias("url")), "payload-ids")
    largest = ids.groupBy("same").agg(
        F.max("id").alias("refers"), F.max_by("url", "id").alias("refers_url"), F.count(F.lit(1)).alias("n")
    )
    largest, ids = largest.where("n > 1"), ids.select("same", "id")
    # straight from an exchange on both sides: a payload of very many ids is split
    found = ids.join(stage(largest.drop("n"), "responses"), "same")
    return found.where(~F.col("id").eqNullSafe(F.col("refers")))


def write_archives(
    pages: DataFrame,
    folder: str,
    form: ArchiveFormat = DEFAULTS,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Writes the archives; (path, records) of each, a written table."""
    rows = payloads(pages, id_col, url_col, html_col)
    sent = pages.sparkSession.sparkContext.broadcast(dictionary_of(rows, form))
    told = stage(revisits(rows, form), "revisits").select(
        F.col("same").alias("of_same"), F.col("id").alias("of_id"), "refers", "refers_url"
    )
    both = rows.join(told, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("same") == F.col("of_same")), "left")
    payload = F.when(F.col("of_same").isNull(), F.col("payload"))
    named = both.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"),
        "url",
        payload.alias("payload"),
        "digest",
        "size",
        F.col("refers").cast("string").alias("refers"),
        "refers_url",
    )
    return stage(named.mapInArrow(_write(sent, folder, form), "path string, records long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, kind: str = "long") -> DataFrame:
    """A row per record of the archives in ``manifest``; an archive is a task."""
    n = max(1, manifest.count())
    found = manifest.select("path").repartition(n, "path").mapInArrow(
        _read, "name string, size long, digest string, kind string, refers string"
    )
    name = F.when(F.col("name") != "", F.col("name"))
    return found.select(
        name.cast(kind).alias("id"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
    )


def archived(
    pages: DataFrame,
    form: ArchiveFormat = DEFAULTS,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Writes all pages to archives and reads them back: a row per page."""
    spark = pages.sparkSession
    manifest = write_archives(pages, scratch_path(spark, "warc"), form, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    return read_archives(spark, manifest, kind).withColumnRenamed("id", id_col)
