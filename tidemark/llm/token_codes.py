"""Token-id files of directly addressable codes (operator 1).

Every id is split into 8-bit chunks. Level 0 holds the lowest chunk of each id, level k the k-th chunk of
the ids that have one; a bitmap per level tells which entries go on, and a rank directory (set bits before
each block of 512) finds an entry's place in the next level. So any token is read with one byte and one
rank per level, without decoding its neighbours. Segments of whole documents are rows of a Parquet table:
Spark commits a task's files only when it ends, so a lost executor leaves no half-written segment.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import WORD_BPE, batches, encoder, tokenizer_path
from .store import P, documents, new_path, partitions_for, small_batches, text_of

BLOCK = 512
SEGMENT_SCHEMA = "part int, segment int, before long, n_tokens long, doc_ids array<long>, starts array<long>, lengths array<long>, codes binary"


class Codes:
    """One sequence of ids below 2^32 as directly addressable codes."""

    def __init__(self, levels: list[np.ndarray], bits: list[np.ndarray], ranks: list[np.ndarray], n: int):
        self.levels, self.bits, self.ranks, self.n = levels, bits, ranks, n

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        rest, levels, bits, ranks = ids.astype(np.uint32), [], [], []
        while True:
            levels.append((rest & 0xFF).astype(np.uint8))
            more = rest > 0xFF
            packed = np.packbits(more, bitorder="little")
            bits.append(packed)
            ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(ones) else ones)
            if not more.any():
                return cls(levels, bits, ranks, len(ids))
            rest = rest[more] >> 8

    def to_bytes(self) -> bytes:
        out = [struct.pack("<QB", self.n, len(self.levels))]
        for level, bits, ranks in zip(self.levels, self.bits, self.ranks, strict=True):
            out += [struct.pack("<Q", len(level)), level.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        n, depth = struct.unpack_from("<QB", data)
        at, levels, bits, ranks = 9, [], [], []
        for _ in range(depth):
            (m,) = struct.unpack_from("<Q", data, at)
            at += 8
            for kept, count, kind in ((levels, m, "u1"), (bits, -(-m // 8), "u1"), (ranks, -(-m // BLOCK), "<u4")):
                kept.append(np.frombuffer(data, kind, count, at))
                at += kept[-1].nbytes
        return cls(levels, bits, ranks, n)

    def access(self, i: int) -> int:
        """The i-th id, read directly."""
        value = shift = 0
        for level, bits, ranks in zip(self.levels, self.bits, self.ranks, strict=True):
            value |= int(level[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block, shift = i // BLOCK, shift + 8
            tail = bits[block * (BLOCK // 8) : (i >> 3) + 1].copy()
            tail[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(tail).sum())
        return value

    def decode(self) -> np.ndarray:
        """All ids, from the deepest level up."""
        above = np.zeros(0, np.uint32)
        for level, bits in zip(self.levels[::-1], self.bits[::-1], strict=True):
            value = level.astype(np.uint32)
            value[np.unpackbits(bits, count=len(level), bitorder="little").astype(bool)] |= above << 8
            above = value
        return above


def write_codes(docs: DataFrame, path: str, *, tokenizer: str = WORD_BPE, end_id: int | None = 2, segment_tokens: int = 1 << 20, partitions: int | None = None) -> None:
    """Encodes every text and writes segments in ascending doc_id order.

    Null text: no ids but the end id. Null doc_id: first. Repeated doc_ids: ordered by their text's hash,
    repeated rows each stand. Texts are dealt by range of (doc_id, hash), so one much repeated doc_id
    spreads over partitions; only the row's own document must fit in a task.
    """
    spark, path_of_tokenizer = docs.sparkSession, tokenizer_path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    n = partitions or partitions_for(spark, rows.agg(F.sum(F.octet_length("text") + 24)).first()[0])
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    end = struct.pack("<I", end_id) if end_id is not None else b""

    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ends: list[int] = []
        held = bytearray()

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, held
            ids, stop = np.frombuffer(held, "<u4"), np.array(ends, np.int64)
            start = np.concatenate([[0], stop[:-1]])
            row = {"part": part, "segment": segment, "before": before, "n_tokens": len(ids), "doc_ids": doc_ids.copy(), "starts": start, "lengths": stop - start, "codes": Codes.of(ids).to_bytes()}
            segment, before, held = segment + 1, before + len(ids), bytearray()
            doc_ids.clear(), ends.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        enc = encoder(path_of_tokenizer)
        for whole in it:
            for b in batches(whole):
                for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode_many(b.column("text").to_pylist()), strict=True):
                    doc_ids.append(d)
                    held += ids
                    held += end
                    ends.append(len(held) // 4)
                    if ends[-1] >= segment_tokens:
                        yield flush()
        if doc_ids:
            yield flush()

    dealt.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def _part_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each part: one number per write task, however many documents there are."""
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    return dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files, ids as little-endian unsigned 32-bit integers.

    Rows as written: nulls, empty texts (the end id alone) and repeated rows each stand. No segments: no rows.
    """
    segments = _segments(spark, path)
    first = _part_starts(segments)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s in b.to_pylist():
                ids, starts, lengths = Codes.from_bytes(s["codes"]).decode().astype("<u4", copy=False), np.array(s["starts"], np.int64), np.array(s["lengths"], np.int64)
                cut = [ids[a : a + n].tobytes() for a, n in zip(s["starts"], s["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s["doc_ids"], pa.int64()), pa.array(starts + s["before"] + first[s["part"]]), pa.array(lengths), pa.array(cut, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.select("part", "before", "doc_ids", "starts", "lengths", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, position, token) for wanted (doc_id, position): each token by direct access, no segment is decoded.

    Positions outside a document, and unknown doc_ids, give no row.
    """
    segments = _segments(spark, path)
    light = segments.select("part", "segment", F.explode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("x"))
    index = light.select("part", "segment", F.col("x.doc_ids").alias("doc_id"), F.col("x.lengths").alias("n"), F.col("x.starts").alias("first"))
    hits = wanted.select("doc_id", "position").join(index, "doc_id").where("position >= 0 AND position < n")
    asked = hits.groupBy("part", "segment", F.pmod(F.xxhash64("doc_id", "position"), F.lit(16)).alias(f"{P}salt")).agg(F.collect_list(F.struct("doc_id", "position", (F.col("first") + F.col("position")).alias("at"))).alias("asked"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for s in b.to_pylist():
                codes = Codes.from_bytes(s["codes"])
                out += [{"doc_id": q["doc_id"], "position": q["position"], "token": codes.access(q["at"])} for q in s["asked"]]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("token", pa.int64())]))

    return segments.select("part", "segment", "codes").join(asked, ["part", "segment"]).select("codes", "asked").mapInArrow(run, "doc_id long, position long, token long")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = new_path(spark, "codes")
    write_codes(documents(spark, sf_dir), path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
