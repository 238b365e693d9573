"""Trading sessions: predicates, elapsed time and bucket grids as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seconds(hms: str) -> float:
    h, m, s = (*hms.split(":"), "0")[:3]
    return int(h) * 3600 + int(m) * 60 + float(s)


@dataclass(frozen=True)
class SessionCalendar:
    """Times of day in seconds. ``inclusive``: the session's and breaks' own boundaries are in session."""

    start: float = seconds("09:30")
    end: float = seconds("15:00")
    breaks: tuple[tuple[float, float], ...] = ((seconds("11:30"), seconds("13:00")),)
    opening: float = seconds("10:00")
    closing: float = seconds("14:30")
    inclusive: bool = True
    utc_offset: float = 0.0
    days: tuple[str, ...] = field(default=())

    @property
    def length(self) -> float:
        return self.end - self.start - sum(b - a for a, b in self.breaks)

    def n_intervals(self, interval: float) -> int:
        return int(-(-self.length // interval))

    def time_of_day(self, ts: Column) -> Column:
        return (ts + F.lit(self.utc_offset)) % 86400.0

    def in_session(self, ts: Column) -> Column:
        tod = self.time_of_day(ts)
        inside = (tod >= self.start) & (tod <= self.end) if self.inclusive else (tod > self.start) & (tod < self.end)
        for a, b in self.breaks:
            inside = inside & ~((tod > a) & (tod < b) if self.inclusive else (tod >= a) & (tod <= b))
        return inside

    def dummies(self, ts: Column) -> tuple[Column, Column]:
        """1 before the opening phase ends, 1 after the closing phase begins; both strict."""
        tod = self.time_of_day(ts)
        return (tod < self.opening).cast("int"), (tod > self.closing).cast("int")

    def elapsed(self, ts: Column) -> Column:
        """Seconds of session before ``ts``; within a break, as at its start."""
        tod = self.time_of_day(ts)
        out = tod - self.start
        for a, b in self.breaks:
            out = out - F.when(tod > a, F.least(tod, F.lit(b)) - a).otherwise(0.0)
        return out

    def interval_index(self, ts: Column, interval: float, dtype: Column | None = None) -> Column:
        """Index of the session interval; a snapshot or bar exactly on a boundary belongs to the one before."""
        t = self.elapsed(ts)
        idx = F.floor(t / interval)
        if dtype is not None:
            idx = idx - F.when(dtype.isin("TickData", "BarData") & (t % interval == 0) & (t > 0), 1).otherwise(0)
        return idx.cast("long")

    def grid(self, spark: SparkSession, days: DataFrame, interval: float) -> DataFrame:
        """(day, idx, ts_start): every bucket of each day in ``days`` (column ``day``, days since the epoch)."""
        idx = F.explode(F.sequence(F.lit(0), F.lit(self.n_intervals(interval) - 1))).alias("idx")
        out = days.select("day", idx)
        tod = F.lit(self.start) + F.col("idx") * interval
        for a, b in self.breaks:
            tod = F.when(tod >= a, tod + (b - a)).otherwise(tod)
        return out.select("day", F.col("idx").cast("long").alias("idx"), (F.col("day") * 86400.0 + tod - self.utc_offset).alias("ts_start"))


ALL_DAY = SessionCalendar(0.0, 86400.0, ())
#: Continuous trading of the mainland China market; holidays are a table of the user's.
CN = SessionCalendar()
