"""Minimax contiguous sharding of atomic groups (operator 5).

Equal texts are one atomic group. Groups lie in the order of their text's hash; the smallest capacity that
lets a greedy walk fill the given number of shards is found by binary search, and the walk's cuts are the
shards. Groups larger than an even share come first and get a shard each, so the rest stays near equal.

The walk is exact but never sees all groups: it starts on sums over hash prefixes, bounds where each cut can
fall, and refines only the prefixes that may hold a cut until these are single groups. Every round is one
aggregation, whose result is bounded by the number of shards and the fan-out, not by the data.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import documents, materialize, text_of

FIRST_BITS, MORE_BITS = 12, 8
#: Rows of one numbering task.
CELL = 1 << 16


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """First item of each shard but the first, if ``capacity`` suffices; ``ends``: running sums of item sizes."""
    cuts, at, done = [], 0, 0
    for _ in range(shards):
        nxt = bisect.bisect_right(ends, done + capacity, at)
        if nxt == len(ends):
            return cuts
        if nxt == at:
            return None
        cuts.append(nxt)
        at, done = nxt, ends[nxt - 1]
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(ends, mid, shards) is not None else (mid + 1, high)
    return low


def _may_hold_a_cut(sizes: list[int], largest: int, shards: int) -> list[int]:
    """Items in which a cut can fall for any capacity between the lower bound and what whole items need."""
    ends = list(accumulate(sizes))
    low, high = max(largest, -(-ends[-1] // shards)), smallest_capacity(sizes, shards)
    found: set[int] = set()
    near = far = 0
    for _ in range(shards - 1):
        i = bisect.bisect_right(ends, near + low)
        near, far = ends[i - 1] if i else 0, far + high
        found.update(range(bisect.bisect_right(ends, near), min(bisect.bisect_left(ends, far) + 1, len(ends))))
    return sorted(found)


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """Keys at which shards 1, 2, ... begin; ``groups``: (key, size), one row a key."""
    bits = FIRST_BITS

    def sums(df: DataFrame, b: int) -> list[tuple]:
        prefix = F.shiftright("key", 64 - b)
        found = df.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n"), F.min("key").alias("k")).collect()
        return sorted((r["k"], r["s"], r["m"], r["n"], r["p"], b) for r in found)

    items = sums(groups, bits)
    if not items:
        return []
    while True:
        open_items = [items[i] for i in _may_hold_a_cut([x[1] for x in items], max(x[2] for x in items), shards) if items[i][3] > 1]
        if not open_items:
            break
        for b in {x[5] for x in open_items}:
            at = [x[4] for x in open_items if x[5] == b]
            items = [x for x in items if x not in open_items or x[5] != b] + sums(groups.where(F.shiftright("key", 64 - b).isin(at)), min(64, b + MORE_BITS))
        items.sort()
    sizes = [x[1] for x in items]
    return [items[i][0] for i in greedy(list(accumulate(sizes)), smallest_capacity(sizes, shards), shards)]


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): a row for each row of ``docs``.

    Size: UTF-8 bytes and 8. Null text: no bytes, in one group with the empty text. Slots are gapless from 0
    in each shard, in an order of hashed cells. Null and repeated doc_ids, and repeated rows, each get a slot; texts of any length.
    Fewer groups than shards leave shards empty; an empty table gives an empty result.
    """
    text = text_of()
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    rest, left, own = groups.agg(F.sum("size")).first()[0] or 0, shards, []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():  # at most ``shards`` groups exceed an even share
        if left == 1 or r["size"] * left <= rest:
            break
        own.append(r["key"])
        rest, left = rest - r["size"], left - 1
    cuts = cut_keys(groups.where(~F.col("key").isin(own)) if own else groups, left)
    shard: Column = F.lit(len(own))
    if cuts:
        shard = shard + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key")))
    for i, key in enumerate(own):
        shard = F.when(F.col("key") == key, i).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    # rows, equal ones too, are numbered within cells of bounded size; a cell starts after the cells before it in its shard
    cells = placed.groupBy("shard").count().collect()
    parts = [1] * shards
    for r in cells:
        parts[r["shard"]] = -(-r["count"] // CELL)
    celled = placed.withColumn("cell", F.pmod(F.xxhash64("row", F.lit(5)), F.get(F.array(*map(F.lit, parts)), F.col("shard"))))
    counts = celled.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row")) - 1
    return celled.withColumn("number", number).join(starts, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number")).alias("slot"))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
