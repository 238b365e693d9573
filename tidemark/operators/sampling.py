"""Samplers: tape to bars, nine aggregation modes, bounded history.

A sampler is a declared set of topics, each an expression and a mode. All topics of a row share its bucket.
Bars of one clock are computed once; every factor derives from them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order() -> Column:
    return F.struct("ts", "seq")


def _store(x: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(F.col("ts"), F.col("seq"), x.alias("x")))))
    return F.transform(rows, lambda s: s["x"])


MODES: dict[str, Callable[[Column], Column]] = {
    "update": lambda x: F.max_by(x, F.when(x.isNotNull(), order())),
    "first": lambda x: F.min_by(x, F.when(x.isNotNull(), order())),
    "accumulate": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    "max": F.max,
    "min": F.min,
    "median": F.median,
    "mean": F.avg,
    "variance": F.var_pop,
    "store": _store,
}
#: Modes whose empty bucket repeats the last value.
CARRIED = ["update", "first", "max", "min"]


@dataclass(frozen=True)
class Topic:
    name: str
    expr: str
    mode: str

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown sampler mode {self.mode!r}; known: {', '.join(MODES)}")

    def column(self) -> Column:
        return MODES[self.mode](F.expr(self.expr)).alias(self.name)


OHLC = (Topic("open", "price", "first"), Topic("high", "price", "max"), Topic("low", "price", "min"), Topic("close", "price", "update"))


def time_index(interval: float) -> Column:
    """Index of the epoch-aligned bucket."""
    return F.floor(F.col("ts") / interval).cast("long")


def bars(tape: DataFrame, topics: tuple[Topic, ...], index: Column, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """One row for each bucket with events: one shuffle, partial aggregates first."""
    return tape.groupBy(*keys, index.alias("idx")).agg(*(t.column() for t in topics))


def fixed_bars(tape: DataFrame, interval: float, topics: tuple[Topic, ...]) -> DataFrame:
    return bars(tape, topics, time_index(interval))


def fill_gaps(sampled: DataFrame, topics: tuple[Topic, ...]) -> DataFrame:
    """Empty buckets between a ticker's first and last: sums 0, stores empty, values carried, the rest NULL."""
    w = Window.partitionBy("ticker").orderBy("idx")
    steps = sampled.withColumn("next", F.lead("idx").over(w))
    full = steps.select(*sampled.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("next") - F.col("idx") - 1, F.lit(0)))).alias("step"))
    empty = {"accumulate": lambda c: F.lit(0.0), "store": lambda c: F.array().cast("array<double>")}
    out = [F.when(F.col("step") == 0, F.col(t.name)).otherwise(F.col(t.name) if t.mode in CARRIED else empty.get(t.mode, lambda c: F.lit(None))(t.name)).alias(t.name) for t in topics]
    return full.select("ticker", (F.col("idx") + F.col("step")).alias("idx"), *out)


def history(n: int, keys: tuple[str, ...] = ("ticker",)):
    """Window of a bar and the n - 1 before it."""
    return Window.partitionBy(*keys).orderBy("idx").rowsBetween(-(n - 1), 0)


def last_bars(sampled: DataFrame, n: int) -> DataFrame:
    """The last n bars of each ticker."""
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("idx")))
    return sampled.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def history_array(sampled: DataFrame, value: str, n: int) -> DataFrame:
    """(ticker, values): the last ``n`` bars' values in order, the open bar's at the end."""
    rows = F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("v"))))
    return last_bars(sampled, n).groupBy("ticker").agg(rows.alias("r")).select("ticker", F.transform("r", lambda s: s["v"]).alias("values"))


def active_and_latest(sampled: DataFrame, value: str) -> DataFrame:
    """(ticker, active, last_closed, n_closed): the open bucket, and the closed one before it."""
    rows = F.sort_array(F.collect_list(F.struct("idx", value)), asc=False)
    top = last_bars(sampled, 2).groupBy("ticker").agg(rows.alias("r"))
    n = sampled.groupBy("ticker").agg((F.count("*") - 1).alias("n_closed"))
    return top.join(n, "ticker").select("ticker", F.get("r", F.lit(0))[value].alias("active"), F.get("r", F.lit(1))[value].alias("last_closed"), "n_closed")
