"""Candlesticks, overlays and the position ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import SessionCalendar
from ..functions.filters import finite
from ..sources.shared import written
from .running import DAY, running

FEE_RATE = 0.00016


def candles(tape: DataFrame, interval: float, price: str = "price") -> DataFrame:
    """(ticker, bucket, ts_start, prices, volume, ver, body bounds, colour); ver counts the updates."""
    at, p = F.struct("ts", "seq"), F.col(price)
    out = tape.groupBy("ticker", F.floor(F.col("ts") / interval).alias("bucket")).agg(F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("ver"))
    return out.withColumns({"ts_start": F.col("bucket") * interval, "body_low": F.least("open", "close"), "body_high": F.greatest("open", "close"), "colour": F.when(F.col("close") > F.col("open"), "up").otherwise("down")})


def session_candles(tape: DataFrame, calendar: SessionCalendar, interval: float) -> DataFrame:
    """Candles on the session's own buckets: the last bucket start at or before a row, by elapsed time."""
    rows = tape.where(calendar.in_session(F.col("ts")))
    day = F.floor((F.col("ts") + calendar.utc_offset) / 86400.0)
    idx = F.least(F.floor(calendar.elapsed(F.col("ts")) / interval), F.lit(calendar.n_intervals(interval) - 1))
    at = F.struct("ts", "seq")
    return rows.groupBy("ticker", day.alias("day"), idx.cast("long").alias("idx")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))


def overlay(predictions: DataFrame, interval: float, names: tuple[str, ...] = ("value", "upper", "lower"), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bucket, names): the last finite prediction of each bucket."""
    ok = predictions.where(finite(F.col(names[0])))
    return ok.groupBy(*keys, F.floor(F.col("ts") / interval).alias("bucket")).agg(*(F.max_by(n, F.col("ts")).alias(n) for n in names))


def forward_fill(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``value`` or the last one before it, by key; without keys, one series."""
    if keys:
        return running(df, lasts={value: F.col(value)}, keys=keys)
    return running(df.withColumn("__one", F.lit(0)), lasts={value: F.col(value)}, keys=("__one",)).drop("__one")


def throttle(rows: DataFrame, interval: float, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The last row of every aligned interval: what a display, or a poll of factors, shows once an interval at most."""
    names = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys, F.floor(F.col("ts") / interval).alias("__step")).agg(F.max_by(F.struct(*names), F.struct("ts", "seq")).alias("r"))
    return last.select(*keys, "r.*")


def export_candles(candles: DataFrame, path: str) -> None:
    """Candles as CSV with a header, by day, times ascending."""
    columns = ["ticker", "bucket", "ts_start", "open", "high", "low", "close", "volume"]
    day = F.date_format(F.timestamp_seconds("ts_start"), "yyyyMMdd").alias("market_date")
    candles.select(*columns, day).repartition("market_date").sortWithinPartitions("ts_start", "ticker").write.mode("overwrite").partitionBy("market_date").option("header", True).csv(path)


def ledger(rows: DataFrame, *, keys: tuple[str, ...] = ("ticker",), fee_rate: float = FEE_RATE) -> DataFrame:
    """Adds position, n_action, fee, trade_id, cash, pnl and nav to rows with price and action.

    An action trades at its row's price. When the position returns to flat, the trade's cash is realised into
    pnl and starts again at zero. An action of 0 only marks the position to the price.
    """
    flow = -F.col("action") * F.col("price")
    acts = F.col("action") != 0
    out = running(rows, {"position": F.col("action"), "n_action": F.when(acts, 1).otherwise(0), "fee": F.abs(flow) * fee_rate, "paid": flow}, keys=keys)
    # flat between trades: all that was paid up to a close is realised by it
    opens, closes = acts & (F.col("position") - F.col("action") == 0), acts & (F.col("position") == 0)
    out = running(out, {"trade_id": F.when(opens, 1).otherwise(0)}, {"pnl": F.when(closes, F.col("paid"))}, keys=keys)
    pnl = F.coalesce("pnl", F.lit(0.0))
    cash = F.when(F.col("position") == 0, 0.0).otherwise(F.col("paid") - pnl)
    return out.withColumns({"cash": cash, "pnl": pnl}).withColumn("nav", F.col("position") * F.col("price") + F.col("cash")).drop("paid")


def drawdown(book: DataFrame, *, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds, for rows with a position, the trade's worst nav so far and the time since it was opened."""
    held = running(book.where("position <> 0"), mins={"max_drawdown": F.col("nav"), "__since": F.col("ts")}, keys=(*keys, "trade_id"))
    return held.withColumn("holding_time", F.col("ts") - F.col("__since")).drop("__since")


#: Rows of a run, whose steps are composed in one expression.
RUN = 256
_SIDES = ("short", "flat", "long")


def _apply(step: Column, position: Column) -> Column:
    """The position after a step, which names the next one for each."""
    return F.when(position < 0, step["short"]).when(position > 0, step["long"]).otherwise(step["flat"])


def _after(first: Column, step: Column) -> Column:
    """Two steps as one."""
    return F.struct(*(_apply(step, first[s]).alias(s) for s in _SIDES))


def signal_actions(rows: DataFrame, *, keys: tuple[str, ...] = ("ticker",), block: float = DAY) -> DataFrame:
    """Adds action: flat enters long where ``lower`` > 0 and short where ``upper`` < 0; a position is closed when
    ``value`` changes sign. Missing values decide nothing; all columns must have an order.

    A row is a step from each of three positions to the next, and steps compose: runs of rows of a block of time are
    folded into one step each, those into the block's, and a key's blocks in turn give the position that each run
    starts from. So a key's rows spread over its runs, and only a short step for each run or block meets in one row.
    """
    sign = lambda c: F.when(F.isnan(c), 0).otherwise(F.coalesce(F.signum(c), F.lit(0.0))).cast("int")
    value, upper, lower = (sign(F.col(c).cast("double")) for c in ("value", "upper", "lower"))
    step = F.struct(F.when(value > 0, 0).otherwise(-1).alias("short"), F.when(lower > 0, 1).when(upper < 0, -1).otherwise(0).alias("flat"), F.when(value < 0, 0).otherwise(1).alias("long"))
    key = F.struct(*keys).alias("__key")  # rows without a ticker are a key like any other
    names = [c for c in rows.columns if c not in keys]
    in_block = Window.partitionBy("__key", "__block").orderBy("ts", "seq")
    cut = rows.select(key, F.floor(F.col("ts") / block).alias("__block"), F.col("ts"), F.col("seq"), step.alias("step"), F.struct(*names).alias("row"))
    placed = cut.withColumn("__run", F.floor((F.row_number().over(in_block) - 1) / RUN))
    runs = written(placed.groupBy("__key", "__block", "__run").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "step", "row"))).alias("rows")), "signal_runs")
    nothing = F.struct(*(F.lit(p).alias(s) for p, s in enumerate(_SIDES, -1)))
    whole = runs.select("__key", "__block", F.struct("__run", F.aggregate("rows", nothing, lambda a, r: _after(a, r["step"])).alias("step")).alias("r"))
    listed = "array<struct<__run: bigint, step: struct<short: int, flat: int, long: int>>>"
    steps = F.aggregate(F.sort_array("rs"), F.struct(nothing.alias("step"), F.array().cast(listed).alias("starts")), lambda a, r: F.struct(_after(a["step"], r["step"]).alias("step"), F.concat(a["starts"], F.array(F.struct(r["__run"].alias("__run"), a["step"].alias("step")))).alias("starts")))
    blocks = whole.groupBy("__key", "__block").agg(F.collect_list("r").alias("rs")).select("__key", "__block", steps.alias("s"))
    in_turn = F.aggregate(F.sort_array("bs"), F.struct(F.lit(0).alias("position"), F.array().cast("array<struct<__block: bigint, position: int>>").alias("starts")), lambda a, b: F.struct(_apply(b["step"], a["position"]).alias("position"), F.concat(a["starts"], F.array(F.struct(b["__block"].alias("__block"), a["position"].alias("position")))).alias("starts")))
    held = blocks.groupBy("__key").agg(F.collect_list(F.struct("__block", F.col("s.step").alias("step"))).alias("bs")).select("__key", F.inline(in_turn["starts"]))
    starts = blocks.join(held, ["__key", "__block"]).select("__key", "__block", "position", F.inline("s.starts")).select("__key", "__block", "__run", _apply(F.col("step"), F.col("position")).alias("position"))

    def acted(a: Column, r: Column) -> Column:
        new = _apply(r["step"], a["position"])
        return F.struct(new.alias("position"), F.concat(a["actions"], F.array((new - a["position"]).cast("long"))).alias("actions"))

    actions = F.aggregate("rows", F.struct(F.col("position"), F.array().cast("array<bigint>").alias("actions")), acted)["actions"]
    each = runs.join(starts, ["__key", "__block", "__run"]).select("__key", F.inline(F.arrays_zip("rows", actions.alias("action"))))
    return each.select(*(F.col(f"__key.{c}" if c in keys else f"rows.row.{c}").alias(c) for c in rows.columns), "action")


def order_size(position: Column, side: Column) -> Column:
    """Volume of a market order: the opposite position if there is one, else one."""
    return F.when((F.signum(position) * side) < 0, F.abs(position)).otherwise(1.0)
