"""Running sums and as-of joins that do not put a whole key into one task.

Rows of a key are cut into blocks of time. A block's total (or first row) is one small row; these are
accumulated over blocks and joined back, so a key with most of the rows still spreads over its blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400.0


#: Of each kind: over rows, over blocks, and of what came before the block with what the block adds.
_KINDS: dict[str, tuple] = {
    "sums": (F.sum, F.sum, lambda before, inside: F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))),
    "mins": (F.min, F.min, F.least),
    "maxes": (F.max, F.max, F.greatest),
    "lasts": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda before, inside: F.coalesce(inside, before)),
}


def running(df: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, *, mins: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, keys: tuple[str, ...] = ("ticker",), block: float = DAY, order: tuple[str, ...] = ("ts", "seq"), with_row: bool = True) -> DataFrame:
    """Adds, in ``order`` (a number first): sums, last values that are not NULL, least and greatest values up to each row.

    ``with_row=False``: of the rows before it alone.
    """
    asked = {n: (kind, c) for kind, named in (("sums", sums), ("lasts", lasts), ("mins", mins), ("maxes", maxes)) for n, c in (named or {}).items()}
    rows = df.withColumns({"__block": F.floor(F.col(order[0]) / block), **{f"__v_{n}": c for n, (_, c) in asked.items()}})
    at = F.struct(*order)
    total = {n: F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)) if kind == "lasts" else _KINDS[kind][0](f"__v_{n}") for n, (kind, _) in asked.items()}
    ends = rows.groupBy(*keys, "__block").agg(*(t.alias(f"__t_{n}") for n, t in total.items()))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "__block", *(_KINDS[kind][1](f"__t_{n}").over(earlier).alias(f"__b_{n}") for n, (kind, _) in asked.items()))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if with_row else -1)
    within = rows.withColumns({f"__i_{n}": _KINDS[kind][0](f"__v_{n}").over(inside) for n, (kind, _) in asked.items()})
    joined = within.join(starts, [*keys, "__block"])
    named = [_KINDS[kind][2](F.col(f"__b_{n}"), F.col(f"__i_{n}")).alias(n) for n, (kind, _) in asked.items()]
    return joined.select(*(c for c in df.columns if c not in asked), *named)


def running_sum(df: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("ticker",), block: float = DAY) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row, in the order of (ts, seq)."""
    return running(df, {name: value}, keys=keys, block=block)


def asof(left: DataFrame, right: DataFrame, at: Column, *, forward: bool = True, strict: bool = False, keys: tuple[str, ...] = ("ticker",), value: str = "price", block: float = DAY) -> DataFrame:
    """``left`` with (matched_ts, matched): the nearest row of ``right`` (keys, ts, value) at or after ``at``.

    ``forward=False``: at or before. ``strict``: not at. NULL where there is none; ties of ts take the first in
    the search direction by value.
    """
    cols = left.columns
    sides = left.select(*keys, at.alias("__k"), F.lit(_left_rank(forward, strict)).alias("__o"), F.struct(*cols).alias("__l"), F.lit(None).cast(right.select(F.struct("ts", value)).schema[0].dataType).alias("__r"))
    other = right.select(*keys, F.col("ts").alias("__k"), F.lit(1 - _left_rank(forward, strict)).alias("__o"), F.lit(None).cast(sides.schema["__l"].dataType).alias("__l"), F.struct("ts", value).alias("__r"))
    # at equal times a left row must see the right one unless strict
    both = sides.unionByName(other).withColumn("__b", F.floor(F.col("__k") / block))
    # a search forward runs backwards: a frame up to the last row is made anew for each row, in the square of a block's rows
    turn = F.desc if forward else F.asc
    span = Window.partitionBy(*keys, "__b").orderBy(turn("__k"), turn("__o"), turn(F.col(f"__r.{value}")))
    near = both.withColumn("__m", F.last("__r", ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, 0)))
    edge = both.where("__r IS NOT NULL").groupBy(*keys, "__b").agg((F.min if forward else F.max)("__r").alias("__e"))
    # blocks of left rows alone need the next block that has right rows
    blocks = both.select(*keys, "__b").distinct().join(edge, [*keys, "__b"], "left")
    over = Window.partitionBy(*keys).orderBy(turn("__b"))
    beyond = F.last("__e", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    next_edge = blocks.select(*keys, "__b", beyond.alias("__n"))
    found = near.where("__l IS NOT NULL").join(next_edge, [*keys, "__b"]).withColumn("__f", F.coalesce("__m", "__n"))
    return found.select("__l.*", F.col("__f.ts").alias("matched_ts"), F.col(f"__f.{value}").alias("matched"))


def in_key_order(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with a key's rows one after the other in a partition, for walks that carry a small state over batches.

    They are dealt by a hash of the keys: a shuffle by the keys themselves is left out after a join by them, and that join's
    own shuffle may be read by mapper once the join turns out to be a broadcast.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "ts", "seq")


def key_values(pdf: pd.DataFrame, keys: tuple[str, ...]) -> list[tuple]:
    """The key of every row; missing values are None, which equals itself."""
    return list(zip(*(pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys), strict=True))


def _left_rank(forward: bool, strict: bool) -> int:
    """Place of a left row among right rows of its time: before them if it searches forward and may match them."""
    return 0 if forward != strict else 1
