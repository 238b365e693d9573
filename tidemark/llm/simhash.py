"""SimHash near-duplicates by anchor-point covering (operator 9).

Fingerprints link at four or fewer differing bits. The covering code is a product: an anchor is a word of a linear
code over the lower 32 bits beside one over the upper 32, about one anchor for 64 distinct fingerprints. So distances
to both codes' few words give the nearest anchor and all anchors in any radius, at a cost of twice the root of their
number. A fingerprint's home is its nearest anchor, at its covering distance r; it is also replicated to every anchor
within r + threshold. If x and y link and x is the one nearer to its home, y is at most r_x + threshold <= r_y +
threshold from it, so the two meet at x's home: no link is lost, whatever the code. Each anchor compares its home
fingerprints with all that came, and passes on a spanning forest of the links, not the pairs. An anchor with many homes
is split into tiles. Components come from alternating large and small stars on these forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import P, columns, documents, materialize, small_batches, text_of

SHINGLE, THRESHOLD, SEED = 4, 4, 42
#: Of each half's code: words are 2 to the power of these.
MIN_CODE_BITS, MAX_CODE_BITS = 2, 11
#: Home fingerprints of one tile.
TILE = 16_384


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < SHINGLE:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:z], SEED) for a, z in spans], "<u8")
    counts = sum(np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for part in np.array_split(hashes, len(hashes) // 65_536 + 1))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): fp signed, h a hash of the text. Null text: empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fps)], names=["doc_id", "h", "fp"])

    return rows.mapInArrow(run, "doc_id long, h long, fp long")


@cache
def code(bits: int) -> np.ndarray:
    """The 2^bits words of a fixed random linear code of length 32: of eight, the one that covers best."""
    points = np.random.default_rng(32).integers(0, 1 << 32, 512, np.uint32)
    found = []
    for seed in range(8):
        words = np.zeros(1, np.uint32)
        for row in np.random.default_rng(seed).integers(0, 1 << 32, bits, np.uint32):
            words = np.concatenate([words, words ^ row])
        found.append((int(np.bitwise_count(points[:, None] ^ words).min(axis=1).sum()), seed, words))
    return min(found, key=lambda x: x[:2])[2]


def _halves(fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distances of the lower and of the upper halves to their code's words) for blocks of rows."""
    words, parts = code(bits), fps.view(np.uint32).reshape(-1, 2)
    step = max(1, (1 << 19) >> bits)
    for i in range(0, len(fps), step):
        yield i, np.bitwise_count(parts[i : i + step, :1] ^ words), np.bitwise_count(parts[i : i + step, 1:] ^ words)


def _homes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.argmin(axis=1) * low.shape[1] + high.argmin(axis=1)


def _ball(low: np.ndarray, high: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within each row's covering distance plus ``threshold``."""
    over = [d - d.min(axis=1, keepdims=True) for d in (low, high)]
    row, word = np.nonzero(over[0] <= threshold)
    left = threshold - over[0][row, word].astype(np.int64)
    # of the other half, each row's words in order of their distance: those within what is left come first
    row2, word2 = np.nonzero(over[1] <= threshold)
    over2 = over[1][row2, word2].astype(np.int64)
    word2 = word2[np.lexsort((word2, over2, row2))]
    upto = np.cumsum(np.bincount(row2 * (threshold + 1) + over2, minlength=len(low) * (threshold + 1)).reshape(len(low), -1), axis=1)
    first = np.cumsum(upto[:, -1]) - upto[:, -1]
    n = upto[row, left]
    return np.repeat(row, n), np.repeat(word, n) * low.shape[1] + word2[np.repeat(first[row], n) + _within(n)]


def _within(n: np.ndarray) -> np.ndarray:
    """0 to n[i] - 1 for each i."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; every root is the least of its set."""
    while True:
        while not np.array_equal(parent, up := parent[parent]):
            parent[:] = up
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def _forest(t: pa.Table, threshold: int) -> pa.Table:
    """Edges (node, root) of the links that this tile owns: those of a home fingerprint that is the nearer of the two to its home, or the lesser node."""
    node, fp, r, home = (t.column(c).to_numpy() for c in ("node", "fp", "r", "home"))
    order = np.lexsort((fp, node))
    node, fp, r, home = node[order], fp[order].view(np.uint64), r[order].astype(np.int64), home[order]
    rank = np.empty(len(node), np.int64)
    rank[np.lexsort((fp, node, r))] = np.arange(len(node))
    parent, homes = np.arange(len(node)), np.flatnonzero(home)
    step = max(1, (1 << 22) // max(1, len(node)))
    for i in range(0, len(homes), step):
        own = homes[i : i + step]
        a, b = np.nonzero(np.bitwise_count(fp[own, None] ^ fp[None, :]) <= threshold)
        a = own[a]
        kept = rank[a] < rank[b]
        join_roots(parent, a[kept], b[kept])
    linked = np.flatnonzero((parent != np.arange(len(node))) & (node[parent] != node))
    return pa.table({"u": pa.array(node[linked], pa.int64()), "v": pa.array(node[parent[linked]], pa.int64())})


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v), u > v: forests whose components are those of the links between ``nodes`` (node, fp)."""
    bits = min(MAX_CODE_BITS, max(MIN_CODE_BITS, -(-(nodes.count() // 64).bit_length() // 2)))

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, low, high in _halves(b.column("fp").to_numpy(), bits):
                yield pa.RecordBatch.from_arrays([pa.array(_homes(low, high).astype(np.int32))], names=["anchor"])

    counts = nodes.select("fp").mapInArrow(settle, "anchor int").groupBy("anchor").count().where(f"count > {TILE}")
    crowded = sorted((r["anchor"], -(-r["count"] // TILE)) for r in counts.collect())  # at most one row an anchor
    hot, parts = np.array([a for a, _ in crowded] + [1 << 62]), np.array([n for _, n in crowded] + [1])

    def replicate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            node, fp = batch.column("node").to_numpy(), batch.column("fp").to_numpy()
            for i, low, high in _halves(fp, bits):
                row, anchor = _ball(low, high, threshold)
                r, home, at = low.min(axis=1) + high.min(axis=1), _homes(low, high)[row] == anchor, np.searchsorted(hot, anchor)
                n = np.where(hot[at] == anchor, parts[at], 1)
                mine = (fp[i + row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                # tile (x, y) compares homes of part x with arrivals of part y: arrivals go to all x, homes as such to all y;
                # in an undivided cell a home stands for both
                copies = np.where(home, np.where(n > 1, 2 * n, 1), n)
                src, k = np.repeat(np.arange(len(row)), copies), _within(copies)
                n, mine = n[src], mine[src]
                is_home = home[src] & (k >= np.where(n > 1, n, 0))
                tile = np.where(is_home, mine * n + k % n, k * n + mine)
                a = row[src]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[src].astype(np.int32)), pa.array(tile), pa.array(node[i + a]), pa.array(fp[i + a]), pa.array(r[a].astype(np.int8)), pa.array(is_home)], names=["anchor", "tile", "node", "fp", "r", "home"])

    cells = nodes.select("node", "fp").mapInArrow(replicate, "anchor int, tile long, node long, fp long, r byte, home boolean")
    forest = cells.groupBy("anchor", "tile").applyInArrow(lambda t: _forest(t.select(["node", "fp", "r", "home"]), threshold), "u long, v long")
    return forest.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root): the least node of each component, for all nodes but the roots. Alternating stars, each joined with its aggregated centre."""
    state, edges = None, materialize(edges, "links")
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select("u", F.col("v").alias("root"))
        state = new
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "stars")


def _grouped(prints: DataFrame, threshold: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in ``prints`` (doc_id, fp): the least fingerprint and the least doc_id of its component."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("last")).where("v < last").select("doc_id", "v")
    shared = prints.join(several, "doc_id").where("fp > v").select(F.col("fp").alias("u"), "v").distinct()
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), threshold).unionByName(shared))
    placed = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    return placed.select("fp", "root").join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, h, fp, component_id): a row for each row of ``docs``.

    Null text: empty, fingerprint zero, linked like any other. Rows that share a doc_id count as one document.
    Rows without a doc_id link too; component_id is null where a component has none. Texts are read whole, repeated
    rows each stand. Empty table: empty result.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    return prints.join(_grouped(prints, threshold), "fp").select("doc_id", "h", "fp", "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all columns: the smallest doc_id's.

    Null doc_ids come last; ties: the least text hash; repeated rows: any one. Null and empty texts are alike. Rows
    that share a doc_id are one group. Empty table: empty result.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    place = [F.isnull("doc_id").alias(f"{P}none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(f"{P}doc")]
    first = F.min(F.struct(*place, F.col("h").alias(f"{P}h")))
    kept = prints.join(_grouped(prints, threshold), "fp").groupBy("root").agg(first.alias("b")).select("b.*")
    names = [f"{P}none", f"{P}doc", f"{P}h"]
    # repeated rows are combined before they are dealt, and then lie where the join wants them
    once = docs.select(*columns(docs), *place, F.xxhash64(text_of()).alias(f"{P}h")).dropDuplicates(names)
    return once.join(kept, names, "left_semi").select(*columns(docs))


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
