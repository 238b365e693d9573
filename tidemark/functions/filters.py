"""Event filters as column predicates, combined by bit flags."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tape import DTYPES, TRADES
from .calendar import SessionCalendar


class FilterMode(IntFlag):
    """What to drop."""

    NO_CANCEL = 1
    NO_AUCTION = 2
    NO_ORDER = 4
    NO_TRADE = 8
    NO_TICK = 16


DEFAULT = FilterMode.NO_CANCEL | FilterMode.NO_AUCTION | FilterMode.NO_ORDER


def mask(mode: FilterMode, calendar: SessionCalendar, dtype: str = "dtype") -> Column:
    """True for rows that stay."""
    kind, keep = F.col(dtype), F.lit(True)
    for flag, condition in (
        (FilterMode.NO_CANCEL, ~(kind.isin(*TRADES) & (F.col("side") == 0))),
        (FilterMode.NO_AUCTION, calendar.in_session(F.col("ts"))),
        (FilterMode.NO_ORDER, kind != "OrderData"),
        (FilterMode.NO_TRADE, ~kind.isin(*TRADES)),
        (FilterMode.NO_TICK, kind != "TickData"),
    ):
        if flag in mode:
            keep = keep & condition
    return keep


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def dispatch(tape: DataFrame) -> dict[str, DataFrame]:
    """A branch for each class of events."""
    return {"trade": tape.where(F.col("dtype").isin(*TRADES)), **{d: tape.where(F.col("dtype") == d) for d in DTYPES if d not in TRADES}}


def checked(tape: DataFrame) -> DataFrame:
    """Fails on an event class that is not known."""
    return tape.where(F.when(F.col("dtype").isin(*DTYPES), True).otherwise(F.raise_error(F.concat(F.lit("unknown dtype: "), F.col("dtype"))).cast("boolean")))


def side_split(value: Column) -> tuple[Column, Column]:
    """Buys and sells; an unknown side counts as neither."""
    return F.when(F.col("side") > 0, value).otherwise(0.0), F.when(F.col("side") < 0, value).otherwise(0.0)


def constituents(tape: DataFrame, weights: DataFrame) -> DataFrame:
    """Events of the index's members. The planner broadcasts the weights where they are small."""
    return tape.join(weights.select("ticker").distinct(), "ticker", "left_semi")


def unique_trades(tape: DataFrame) -> DataFrame:
    """The first of each trade that repeats within a ticker."""
    first = F.min_by(F.struct(*tape.columns), F.struct("ts", "seq")).alias("e")
    return tape.groupBy("ticker", "buy_id", "sell_id").agg(first).select("e.*")
