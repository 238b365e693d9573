"""Media columns over archives (operator 7).

A Spark data source reads and writes ZIP archives of media members. Planning takes the archives named by the
directory file that the write's commit left, and cuts each into byte ranges; a task opens its archive's own
central directory, takes the members whose offset lies in its range, and streams them through Arrow. A member
that fails to read is read again by its offset, alone. Write tasks put their archive under a name of their
own, and only committed ones enter the directory, so lost or repeated tasks leave nothing to read.

Payloads are stored as greyscale PNG images, 192 samples of 8 bits a row.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .store import documents, new_path, small_batches, text_of

FORMAT = "tidemark_archive"
WIDTH = 192
RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 16 << 20, 4 << 20, 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def to_payload(data: bytes) -> bytes:
    """Spaces fill the data to a positive multiple of the row width."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """The payload's rows as 8-bit grey samples, unfiltered; the unpadded length as a text chunk."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    body = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 4)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"tEXt", b"bytes\0%d" % n_bytes) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of what ``encode_png`` made; checks every chunk's checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts = 8, {}
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    width = struct.unpack_from(">I", parts[b"IHDR"])[0]
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes(), int(parts[b"tEXt"].removeprefix(b"bytes\0"))


def feature(payload: bytes) -> str:
    """Sum of samples, and a 64-bit average hash over 64 equal stretches."""
    samples = np.frombuffer(payload, np.uint8)
    edges = np.arange(64) * len(samples) // 64
    means = np.add.reduceat(samples, edges, dtype=np.int64) / np.diff(np.append(edges, len(samples)))
    bits = np.packbits(means > samples.mean()).tobytes().hex()
    return f"{int(samples.sum(dtype=np.int64))}-{bits}"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Archives(WriterCommitMessage):
    found: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    stop: int


class ArchiveSource(DataSource):
    """Options: path; range_bytes and attempts for reading."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "member string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        files, root = _open(self.path)
        name, size = f"part-{uuid.uuid4().hex}.zip", 0
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for b in iterator:
                for member, media in zip(b.column("member").to_pylist(), b.column("media").to_pylist(), strict=True):
                    archive.writestr(zipfile.ZipInfo(member), media)
                    size += 1
        return Archives([(name, files.get_file_info(f"{root}/{name}").size)] if size else [])

    def commit(self, messages: list[Archives | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/directory-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([x for m in messages if m for x in m.found]).encode())

    def abort(self, messages: list[Archives | None]) -> None:
        files, root = _open(self.path)
        for m in messages:
            for name, _ in m.found if m else []:
                files.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[Range]:
        """Byte ranges; needs one entry an archive, never one a member."""
        from pyarrow import fs

        files, root = _open(self.path)
        found = []
        for info in files.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("directory-"):
                with files.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        ranges = [Range(name, a, min(a + self.range_bytes, size)) for name, size in found for a in range(0, size, self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, root = _open(self.path)
        place = f"{root}/{partition.archive}"
        with files.open_input_file(place) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.stop]
        held, size = [], 0
        source = files.open_input_file(place)
        try:
            for m in members:
                for attempt in range(self.attempts):
                    try:
                        media = read_member(source, m)
                        break
                    except (OSError, ValueError, zipfile.BadZipFile):
                        if attempt + 1 == self.attempts:
                            raise
                        source.close()
                        source = files.open_input_file(place)
                held.append((m.filename, m.header_offset, media))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        finally:
            source.close()
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["member", "offset", "media"])


def read_member(source, m: zipfile.ZipInfo) -> bytes:
    """One stored member by its offset; its checksum must hold."""
    source.seek(m.header_offset)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at {m.header_offset}")
    names, extra = struct.unpack_from("<HH", head, 26)
    source.seek(m.header_offset + 30 + names + extra)
    data = source.read(m.file_size)
    if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
        raise zipfile.BadZipFile(f"damaged member at {m.header_offset}")
    return data


def write_media(docs: DataFrame, path: str) -> None:
    """Every text as a PNG member of an archive under ``path``.

    Null text: empty. Members are named by doc_id ("null" without one) and a number, so repeated rows each stand.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in it:
            names, media = [], []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = text.encode()
                names.append(f"{'null' if d is None else d}/{n}.png")
                media.append(encode_png(to_payload(data), len(data)))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["member", "media"])

    docs.sparkSession.dataSource.register(ArchiveSource)
    rows.mapInArrow(run, "member string, media binary").write.format(FORMAT).mode("append").save(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_bytes, payload, media, feature) of every member under ``path``.

    Null doc_ids come back as null, repeated rows each stand; equal payloads have equal media and features. Empty texts
    are one row of spaces; a member of any length must fit in a task. No members: no rows.
    """
    spark.dataSource.register(ArchiveSource)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [decode_png(m) for m in b.column("media").to_pylist()]
            ids = [None if x.startswith("null/") else int(x.split("/")[0]) for x in b.column("member").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array([p for p, _ in found], pa.binary()), b.column("media"), pa.array([feature(p) for p, _ in found], pa.string())], names=["doc_id", "n_bytes", "payload", "media", "feature"])

    return spark.read.format(FORMAT).load(path).select("member", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, media binary, feature string")


def op7_archive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = new_path(spark, "media")
    write_media(documents(spark, sf_dir), path)
    return read_media(spark, path).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
