"""Packing along a space-filling curve (operator 10).

A document's token ids are counted in hashed buckets, the counts are projected to three dimensions with
fixed random signs, and the point's place on a Hilbert curve is its key. Rows are range-sorted by (key,
doc_id, text hash, part), so neighbours are alike and equal documents, however many, spread over partitions;
long documents go in parts, so rows are of like size and no task must hold one whole. Each partition lays its
rows end to end and cuts every ``length`` tokens: only its last sequence is padded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import BYTE_BPE, batches, encoder, tokenizer_path
from .store import documents, materialize, partitions_for, small_batches, text_of

BUCKETS, DIMS, BITS = 1024, 3, 10
#: Tokens of a row that is dealt.
PART = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid points (n, dims) on the Hilbert curve: axes to transposed form, then interleaved bits."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            high = x[i] >> b & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v ^ flip) >> b & 1
    return key


def document_keys(ids: list[bytes], signs: np.ndarray) -> np.ndarray:
    """Keys of documents' ids; -1 without ids, so empty documents come first."""
    return np.concatenate([_keys(ids[i : i + 256], signs) for i in range(0, len(ids), 256)])


def _keys(ids: list[bytes], signs: np.ndarray) -> np.ndarray:
    sizes = np.array([len(x) // 4 for x in ids])
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.uint64)
    hashed = (flat * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(ids)) * BUCKETS, sizes) + hashed, minlength=len(ids) * BUCKETS).reshape(-1, BUCKETS)
    root = np.sqrt(counts)
    z = root @ signs / np.maximum(np.sqrt(sizes), 1)[:, None]
    grid = np.clip((z + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return np.where(sizes == 0, -1, hilbert_keys(grid, BITS))


def narrow(ids: bytes) -> bytes:
    """Ids of 32 bits as 16 bits, if all fit: half of what is written and dealt."""
    numbers = np.frombuffer(ids, "<u4")
    return numbers.astype("<u2").tobytes() if len(numbers) and numbers.max() < 1 << 16 else ids


def widen(ids: bytes, n: int) -> bytes:
    """``n`` ids of 32 bits, from what ``narrow`` made of them."""
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def pack(docs: DataFrame, *, tokenizer: str = BYTE_BPE, end_id: int = 1, length: int = 2048, partitions: int | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    Null text: empty, one piece with the end id. Null doc_id: first among equal keys. Repeated rows each stand.
    sequence_id: partition * 2^32 + number in it. A document longer than a sequence fills several.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    path = tokenizer_path(tokenizer)
    signs = np.random.default_rng(20).choice([-1.0, 1.0], (BUCKETS, DIMS))
    end = struct.pack("<I", end_id)

    def key(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in (part for whole in it for part in batches(whole, 500_000)):
            ids = enc.encode_many(b.column("text").to_pylist())
            keys = document_keys(ids, signs)
            whole = [x + end for x in ids]
            row, start = zip(*((i, s) for i, x in enumerate(whole) for s in range(0, len(x) // 4, PART)), strict=True)
            parts = [narrow(whole[i][4 * s : 4 * (s + PART)]) for i, s in zip(row, start, strict=True)]
            at = np.array(row)
            total = np.array([len(x) // 4 for x in whole])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), b.column("h").take(pa.array(at)), pa.array(keys[at]), pa.array(start, pa.int64()), pa.array(total[at]), pa.array(parts, pa.binary())], names=["doc_id", "h", "key", "start", "total", "ids"])

    coded = materialize(rows.mapInArrow(key, "doc_id long, h long, key long, start long, total long, ids binary"), "packing")
    sized = coded.agg(F.sum(F.least(F.col("total") - F.col("start"), F.lit(PART)) * 2 + 40)).first()[0]
    n = partitions or partitions_for(spark, sized)
    order = ["key", "doc_id", "h", "start"]
    dealt = coded.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "start", "total", "ids")

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, at = TaskContext.get().partitionId() << 32, 0
        for b in it:
            out = []
            for d, first, total, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "total", "ids")), strict=True):
                ids = widen(ids, min(PART, total - first))
                done, n_ids = 0, len(ids) // 4
                while done < n_ids:
                    size = min(length - at, n_ids - done)
                    piece = ids[4 * done : 4 * (done + size)]
                    out.append((d, first + done, size, zlib.crc32(piece), total, sequence, at, piece))
                    done, at = done + size, at + size
                    if at == length:
                        sequence, at = sequence + 1, 0
            if out:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return dealt.mapInArrow(fill, PIECES)


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(documents(spark, sf_dir)).drop("ids")
