"""Sampler state that can be stopped, kept as JSON, and gone on with.

A bar that is still open is kept as typed partial values, one struct for each topic, which merge with what comes later:
of a sum its sum, of a mean sum and count, of a variance count, mean and squares about it, of first and last the
value with its place, of a median how often each value came. A snapshot of a ticker is the ring of its last bars in
that form and its clock's running total. Bars of a tape are the same whether it is read at once or cut and resumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .running import running_sum
from .sampling import Topic, order

_AT = "at struct<ts: double, seq: bigint>"


@dataclass(frozen=True)
class Partial:
    """A mode's partial value: its type, how it comes from rows, how partial values merge, and what it says in the end."""

    kind: str
    of: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    value: Callable[[Column], Column]


def _placed(x: Column) -> Column:
    return F.when(x.isNotNull(), F.struct(order().alias("at"), x.cast("double").alias("x")))


def _listed(parts: Column, field: str) -> Column:
    return F.flatten(F.transform(parts, lambda p: p[field]))


def _spread(x: Column) -> Column:
    n, mean = F.count(x).cast("double"), F.coalesce(F.avg(x), F.lit(0.0))
    return F.struct(n.alias("n"), mean.alias("mean"), (n * F.coalesce(F.var_pop(x), F.lit(0.0))).alias("m2"))


def _spread_of_both(parts: Column) -> Column:
    def join(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(parts, none, join)


def _middle(p: Column) -> Column:
    """Median of values with their counts."""
    counts = F.sort_array(p["xs"])
    n = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(a: Column, c: Column) -> Column:
        upto = a["seen"] + c["n"]
        reach = lambda old, place: F.when(old.isNull() & (upto > place), c["x"]).otherwise(old)
        return F.struct(upto.alias("seen"), reach(a["low"], F.floor((n - 1) / 2)).alias("low"), reach(a["high"], F.floor(n / 2)).alias("high"))

    both = F.aggregate(counts, start, step)
    return (both["low"] + both["high"]) / 2


def _counted(values: Column) -> Column:
    """(x, n) of an array of (x, n), each x once."""
    xs = F.array_distinct(F.transform(values, lambda c: c["x"]))
    total = lambda x: F.aggregate(F.filter(values, lambda c: c["x"] == x), F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    return F.transform(xs, lambda x: F.struct(x.alias("x"), total(x).alias("n")))


def _runs(values: Column) -> Column:
    """(x, n) of a sorted array of numbers: one struct for each run."""
    ends = F.filter(F.sequence(F.lit(1), F.size(values)), lambda i: (i == F.size(values)) | (F.get(values, i) != F.get(values, i - 1)))
    runs = F.transform(ends, lambda e, k: F.struct(F.get(values, e - 1).alias("x"), (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).cast("bigint").alias("n")))
    return F.when(F.size(values) == 0, F.array().cast("array<struct<x: double, n: bigint>>")).otherwise(runs)


_ONE = "struct<x: double>"
PARTIALS: dict[str, Partial] = {
    "update": Partial(f"struct<{_AT}, x: double>", lambda x: F.max(_placed(x)), F.array_max, lambda p: p["x"]),
    "first": Partial(f"struct<{_AT}, x: double>", lambda x: F.min(_placed(x)), F.array_min, lambda p: p["x"]),
    "accumulate": Partial(_ONE, lambda x: F.struct(F.coalesce(F.sum(x.cast("double")), F.lit(0.0)).alias("x")), lambda ps: F.struct(F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["x"]).alias("x")), lambda p: p["x"]),
    "max": Partial(_ONE, lambda x: F.struct(F.max(x.cast("double")).alias("x")), lambda ps: F.struct(F.array_max(F.transform(ps, lambda p: p["x"])).alias("x")), lambda p: p["x"]),
    "min": Partial(_ONE, lambda x: F.struct(F.min(x.cast("double")).alias("x")), lambda ps: F.struct(F.array_min(F.transform(ps, lambda p: p["x"])).alias("x")), lambda p: p["x"]),
    "median": Partial("struct<xs: array<struct<x: double, n: bigint>>>", lambda x: F.struct(_runs(F.sort_array(F.collect_list(x.cast("double")))).alias("xs")), lambda ps: F.struct(_counted(_listed(ps, "xs")).alias("xs")), _middle),
    "mean": Partial("struct<x: double, n: double>", lambda x: F.struct(F.coalesce(F.sum(x.cast("double")), F.lit(0.0)).alias("x"), F.count(x).cast("double").alias("n")), lambda ps: F.aggregate(ps, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("n")), lambda a, p: F.struct((a["x"] + p["x"]).alias("x"), (a["n"] + p["n"]).alias("n"))), lambda p: F.try_divide(p["x"], p["n"])),
    "variance": Partial("struct<n: double, mean: double, m2: double>", _spread, _spread_of_both, lambda p: F.try_divide(p["m2"], p["n"])),
    "store": Partial(f"struct<xs: array<struct<{_AT}, x: double>>>", lambda x: F.struct(F.sort_array(F.collect_list(_placed(x))).alias("xs")), lambda ps: F.struct(F.sort_array(_listed(ps, "xs")).alias("xs")), lambda p: F.transform(p["xs"], lambda s: s["x"])),
}


def partial_bars(tape: DataFrame, topics: tuple[Topic, ...], index: Column, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, idx, and of each topic its partial value)."""
    return tape.groupBy(*keys, index.cast("long").alias("idx")).agg(*(PARTIALS[t.mode].of(F.expr(t.expr)).alias(t.name) for t in topics))


def merged_bars(parts: DataFrame, topics: tuple[Topic, ...], keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Partial bars, one for each key and idx, of as many as there are of it."""
    lists = parts.groupBy(*keys, "idx").agg(*(F.collect_list(t.name).alias(t.name) for t in topics))
    return lists.select(*keys, "idx", *(F.when(F.size(t.name) > 0, PARTIALS[t.mode].merge(F.col(t.name))).cast(PARTIALS[t.mode].kind).alias(t.name) for t in topics))


def finished(parts: DataFrame, topics: tuple[Topic, ...], keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Bars of partial bars, as ``sampling.bars`` gives them."""
    return parts.select(*keys, "idx", *(PARTIALS[t.mode].value(F.col(t.name)).alias(t.name) for t in topics))


def _state_kind(topics: tuple[Topic, ...]) -> str:
    bar = ", ".join(f"`{t.name}`: {PARTIALS[t.mode].kind}" for t in topics)
    return f"struct<total: double, ring: array<struct<idx: bigint, {bar}>>>"


def snapshot(parts: DataFrame, topics: tuple[Topic, ...], size: int, totals: DataFrame | None = None, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, state): the last ``size`` bars of each key, the open one among them, and its clock's total, as JSON.

    ``totals`` (keys, total) are running totals of clocks that count volume; without, zero.
    """
    ring = F.sort_array(F.collect_list(F.struct("idx", *(t.name for t in topics))))
    held = parts.groupBy(*keys).agg(F.slice(ring, F.greatest(F.size(ring) - size + 1, F.lit(1)), size).alias("ring"))
    held = held.join(totals.select(*keys, F.col("total").cast("double").alias("total")), list(keys), "left") if totals is not None else held.withColumn("total", F.lit(0.0))
    return held.select(*keys, F.to_json(F.struct(F.coalesce("total", F.lit(0.0)).alias("total"), "ring")).alias("state"))


def restored(states: DataFrame, topics: tuple[Topic, ...], keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, total, ring) of snapshots."""
    return states.select(*keys, F.from_json("state", _state_kind(topics)).alias("s")).select(*keys, "s.total", "s.ring")


def resume(tape: DataFrame, states: DataFrame, topics: tuple[Topic, ...], index: Column, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Partial bars of the ring and of ``tape``, the rows after the snapshot; the open bar is one."""
    held = restored(states, topics, keys).select(*keys, F.inline("ring"))
    return merged_bars(held.unionByName(partial_bars(tape, topics, index, keys)), topics, keys)


def clock_totals(tape: DataFrame, value: str, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, total): where a volume clock stands."""
    return tape.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("total"))


def resumed_volume(tape: DataFrame, states: DataFrame, topics: tuple[Topic, ...], value: str = "volume", keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """``tape`` with ``vol_acc``: volume up to and with each row, counted on from the snapshot."""
    before = restored(states, topics, keys).select(*keys, "total")
    rows = running_sum(tape, F.coalesce(value, F.lit(0.0)), "vol_acc", keys=keys).join(before, list(keys), "left")
    return rows.withColumn("vol_acc", F.col("vol_acc") + F.coalesce("total", F.lit(0.0))).drop("total")


def save(states: DataFrame, path: str) -> None:
    states.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, keys: str = "ticker string") -> DataFrame:
    return spark.read.schema(f"{keys}, state string").json(path)
