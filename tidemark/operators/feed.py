"""Feed telemetry: duplicates, gaps, reconciliation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running

#: Sequence numbers of one block.
SEQ_BLOCK = 1 << 16


def trade_statistics(trades: DataFrame) -> DataFrame:
    """(ticker, n_trades, acc_volume) of unique trades."""
    once = trades.groupBy("ticker", "buy_id", "sell_id").agg(F.min_by("volume", F.struct("ts", "seq")).alias("v"))
    return once.groupBy("ticker").agg(F.count("*").alias("n_trades"), F.sum("v").alias("acc_volume"))


def snapshot_statistics(ticks: DataFrame) -> DataFrame:
    """(ticker, n_ticks, last_total): repeated and backward snapshots are dropped, the last total counts."""
    seen = running(ticks, maxes={"__m": F.col("ts")}, order=("seq",), block=SEQ_BLOCK, with_row=False)
    fresh = seen.where(F.col("__m").isNull() | (F.col("ts") > F.col("__m")))
    return fresh.groupBy("ticker").agg(F.count("*").alias("n_ticks"), F.max_by("total_traded_volume", F.struct("ts", "seq")).alias("last_total"))


def gaps(tape: DataFrame, limit: float = 6.0) -> DataFrame:
    """(ticker, ts, gap) of rows that come more than ``limit`` seconds after the row before."""
    rows = running(tape.select("ticker", "ts", "seq"), maxes={"__before": F.col("ts")}, with_row=False)
    return rows.withColumn("gap", F.col("ts") - F.col("__before")).where(F.col("gap") > limit).select("ticker", "ts", "gap")


def reconcile(trades: DataFrame, totals: DataFrame, tolerance: float = 1.005) -> DataFrame:
    """(ticker, traded, reported, suspect): trades against reported totals."""
    t = trades.groupBy("ticker").agg(F.sum("volume").alias("traded"))
    return t.join(totals, "ticker", "full_outer").select("ticker", "traded", "reported", (F.col("traded") > tolerance * F.col("reported")).alias("suspect"))


def call_profile(calls: DataFrame, k: int = 10) -> DataFrame:
    """Top-k report of (name, seconds): calls, cumulative and mean time, calls a second."""
    out = calls.groupBy("name").agg(F.count("*").alias("calls"), F.sum("seconds").alias("cumulative"))
    return out.withColumns({"mean": F.try_divide("cumulative", "calls"), "per_second": F.try_divide("calls", "cumulative")}).orderBy(F.desc("cumulative"), "name").limit(k)
