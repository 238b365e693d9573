"""Volume clocks: bars whose buckets are counted in traded volume.

``final`` forms use one interval for all rows and are built-in window expressions; ``online`` forms revise
their interval as they go, so past bars never change, and step through each ticker's day in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import in_key_order, key_values, running, running_sum
from .sampling import Topic, bars


def event_clock(tape: DataFrame, use_notional: bool = False, session: Column | None = None, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds ``vol_acc``: trades and bars add their volume (or notional), a snapshot puts its session total in its place.

    Other events, and rows out of session, leave it. Give a day among the keys for totals that start anew each day.
    """
    own, total = ("notional", "total_traded_notional") if use_notional else ("volume", "total_traded_volume")
    inside = F.lit(True) if session is None else session
    adds = F.when(inside & F.col("dtype").isin("TradeData", "TransactionData", "BarData"), F.col(own))
    rows = running(tape, {"__sum": F.coalesce(adds, F.lit(0.0))}, keys=keys)
    # what the last snapshot said, and what had been added by then
    rows = running(rows, lasts={"__tick": F.when(inside & (F.col("dtype") == "TickData") & F.col(total).isNotNull(), F.struct(F.col(total).alias("total"), F.col("__sum").alias("sum")))}, keys=keys)
    vol = F.coalesce(F.col("__tick.total") + F.col("__sum") - F.col("__tick.sum"), F.col("__sum"))
    return rows.withColumn("vol_acc", vol).drop("__sum", "__tick")


def with_volume(tape: DataFrame, value: str = "volume", session: Column | None = None) -> DataFrame:
    """Adds ``vol_acc``: the ticker's volume up to and with each row; rows out of session add nothing."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return running_sum(tape, F.when(session, v).otherwise(0.0) if session is not None else v, "vol_acc")


def volume_bars(tape: DataFrame, interval: float, topics: tuple[Topic, ...], value: str = "volume") -> DataFrame:
    """A bar for each ``interval`` of volume; a row's own volume counts before its bucket is chosen."""
    return bars(with_volume(tape, value), topics, F.floor(F.col("vol_acc") / interval).cast("long"))


def volume_baseline(tape: DataFrame, interval: float, window: int, value: str = "volume") -> DataFrame:
    """(ticker, baseline, n): mean volume of the first ``window`` time buckets; NULL with under half of them."""
    v = tape.groupBy("ticker", F.floor(F.col("ts") / interval).alias("idx")).agg(F.sum(value).alias("v"))
    first = v.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy("idx"))).where(F.col("r") <= window)
    out = first.groupBy("ticker").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return out.select("ticker", F.when((F.col("n") >= window // 2) & (F.col("m") > 0), F.col("m")).alias("baseline"), "n")


def adaptive_bars_final(tape: DataFrame, interval: float, window: int, topics: tuple[Topic, ...], value: str = "volume") -> DataFrame:
    """Bars on the final baseline of each ticker, on time where it has none. Looks ahead by its nature."""
    rows = with_volume(tape, value).join(volume_baseline(tape, interval, window, value).select("ticker", "baseline"), "ticker")
    idx = F.when(F.col("baseline").isNull(), F.floor(F.col("ts") / interval)).otherwise(F.floor(F.col("vol_acc") / F.col("baseline")))
    return bars(rows, topics, idx.cast("long"))


def aligned_clock(tape: DataFrame, weights: DataFrame, intervals: DataFrame, step: float, value: str = "volume") -> DataFrame:
    """(step_idx, clock): one index for all tickers, from weighted volume over weighted intervals.

    The global order is cut into steps of ``step`` seconds, summed first, so only one row a step is ordered. A clock is
    known to a millionth: sums in another order would else put a total that lies on a bucket's edge to either side.
    """
    scale = weights.join(intervals.select("ticker", "baseline"), "ticker").agg(F.nullif(F.sum(F.col("weight") * F.col("baseline")), F.lit(0.0)).alias("scale"))
    rows = tape.join(weights.select("ticker", "weight"), "ticker").groupBy(F.floor(F.col("ts") / step).alias("step_idx")).agg(F.sum(F.col("weight") * F.col(value)).alias("v"))
    acc = running_sum(rows.select(F.lit("all").alias("ticker"), (F.col("step_idx") * step).alias("ts"), F.col("step_idx").alias("seq"), "step_idx", "v"), F.col("v"), "acc")
    # ``scale`` is an aggregate without groups: one row
    return acc.join(F.broadcast(scale)).select("step_idx", F.floor(F.round(F.col("acc") / F.col("scale"), 6)).cast("long").alias("clock"))


def aligned_bars(tape: DataFrame, clock: DataFrame, step: float, topics: tuple[Topic, ...]) -> DataFrame:
    """Bars of all tickers on one ``clock`` (step_idx, clock); rows without one have no bar."""
    rows = tape.withColumn("step_idx", F.floor(F.col("ts") / step)).join(clock.where("clock IS NOT NULL"), "step_idx")
    return bars(rows, topics, F.col("clock"))


@dataclass
class AdaptiveClock:
    """State of one ticker's adaptive clock."""

    interval: float
    sample_size: int
    window: int
    start_volume: float | None = None
    idx: float | None = None
    bucket_start: float = 0.0
    bucket_volume: float = 0.0
    done: list[float] = field(default_factory=list)
    frozen: float | None = None
    bar: int = -1
    at: tuple[float, float] | None = None

    def baseline(self, ts: float, acc: float, own: float) -> float | None:
        """Mean bucket volume so far; an open bucket counts, scaled, once over half of it has passed."""
        if self.frozen is not None:
            return self.frozen
        if self.start_volume is None:
            self.start_volume = acc
            self.idx, self.bucket_start, self.bucket_volume = ts // self.interval, ts // self.interval * self.interval, acc
        idx = ts // self.interval
        before = acc - own
        if idx > self.idx:
            self.done.append(before - self.bucket_volume)
            self.idx, self.bucket_start, self.bucket_volume = idx, idx * self.interval, before
            if len(self.done) >= self.window:
                mean = sum(self.done[: self.window]) / self.window
                if mean > 0:
                    self.frozen = mean
                    return mean
                self.done.clear()
        if len(self.done) + 1 < min(self.sample_size, self.window // 2):
            return None
        values, passed = list(self.done), ts - self.bucket_start
        if passed > 0.5 * self.interval:
            values.append((acc - self.bucket_volume) / max(1.0, passed) * self.interval)
        mean = sum(values) / len(values) if values else 0.0
        return mean if mean > 0 else None

    def step(self, ts: float, acc: float, own: float) -> int:
        """Number of the row's bar; it grows when either index does. The unused index is zero."""
        base = self.baseline(ts, acc, own)
        now = (ts // self.interval, 0.0) if base is None else (0.0, acc // base)
        if self.at is None or now[0] > self.at[0] or now[1] > self.at[1]:
            self.at = now
            self.bar += 1
        return self.bar


def adaptive_bars_online(tape: DataFrame, interval: float, window: int, topics: tuple[Topic, ...], *, sample_size: int = 20, value: str = "volume", keys: tuple[str, ...] = ("ticker", "day")) -> DataFrame:
    """Bars of the clock as it stood at each row. The state starts anew for every ticker and day; no day is held whole."""
    rows = tape.withColumn("day", F.floor(F.col("ts") / 86400.0)) if "day" not in tape.columns else tape
    light = rows.select(*keys, "ts", "seq", F.coalesce(F.col(value), F.lit(0.0)).alias("v"))

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, clock, acc = None, None, 0.0
        for pdf in parts:
            out = []
            for key, ts, v in zip(key_values(pdf, keys), pdf["ts"], pdf["v"], strict=True):
                if clock is None or key != held:
                    held, clock, acc = key, AdaptiveClock(interval, sample_size, window), 0.0
                acc += v
                out.append(clock.step(ts, acc, v))
            yield pdf[[*keys, "ts", "seq"]].assign(bar=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema.fields if f.name != "v") + ", bar long"
    numbered = in_key_order(light, keys).mapInPandas(number, schema)
    return bars(rows.join(numbered, [*keys, "ts", "seq"]), topics, F.col("bar"), keys)


def readiness(bounds: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ready): whether every ticker has a value."""
    return bounds.groupBy(*by).agg(F.bool_and(F.col(column).isNotNull()).alias("ready"))
