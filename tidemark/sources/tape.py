"""The event tape: one wide row per market event, and adapters from other tables.

Tape rows are immutable. ``seq`` breaks ties of ``ts``; missing values are NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADES = ["TradeData", "TransactionData"]
DTYPES = [*TRADES, "TickData", "BarData", "OrderBook", "OrderData"]

TAPE = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("ts", T.DoubleType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("dtype", T.StringType(), False),
        *(T.StructField(c, T.DoubleType()) for c in ("market_price", "price", "volume", "notional")),
        T.StructField("side", T.IntegerType()),
        T.StructField("flow", T.DoubleType()),
        *(T.StructField(c, T.StringType()) for c in ("buy_id", "sell_id", "transaction_id")),
        *(T.StructField(c, T.DoubleType()) for c in ("total_traded_volume", "total_traded_notional", "open_price", "high_price", "low_price", "close_price")),
    ]
)


def clean(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def read_tape(spark: SparkSession, path: str, start: date | None = None, end: date | None = None, tickers: Iterable[str] | None = None, dtypes: Iterable[str] | None = None) -> DataFrame:
    """Scan of a tape partitioned by market_date; every condition reaches the scan."""
    df = spark.read.parquet(path)
    for condition in (start and F.col("market_date") >= F.lit(start), end and F.col("market_date") <= F.lit(end), tickers and F.col("ticker").isin(*tickers), dtypes and F.col("dtype").isin(*dtypes)):
        if condition is not None and condition is not False:
            df = df.where(condition)
    return df


def write_tape(tape: DataFrame, path: str) -> None:
    dated = tape.withColumn("market_date", F.to_date(F.timestamp_seconds("ts")))
    dated.repartition("market_date", "ticker").sortWithinPartitions("ticker", "ts", "seq").write.mode("overwrite").partitionBy("market_date").parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ``us``: its timestamp in microseconds."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def trades(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """Events as trades: ``key`` is the ticker, value the price and props.k the volume.

    Purchases and signups buy, errors and clicks sell, views are cancels.
    """
    df = events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("double")
    side = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type").isin("error", "click"), -1).otherwise(0)
    dtype = F.when(F.col("event_type") == "signup", "TransactionData").when(F.col("event_type") == "error", "OrderData").when(F.col("event_type") == "click", "TickData").otherwise("TradeData")
    return df.select(
        F.col(key).cast("string").alias("ticker"),
        (F.col("us") / 1e6).alias("ts"),
        F.col("event_id").alias("seq"),
        "us",
        F.lit("TradeData").alias("dtype"),
        dtype.alias("kind"),
        F.col("value").alias("price"),
        k.alias("volume"),
        (F.col("value") * k).alias("notional"),
        side.alias("side"),
        "user_id",
        "event_type",
    )


def daily_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by supplier from lineitem: notional, volume and their ratio as price."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date")
    bars = df.groupBy(F.col("l_suppkey").alias("ticker"), F.unix_date(day).cast("long").alias("day")).agg(F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("notional"))
    return bars.withColumn("price", F.try_divide("notional", "volume"))


def type_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index_name, ticker, weight): event types weighted by their number of events."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("ticker")).agg(F.count("*").cast("double").alias("weight")).select(F.lit("types").alias("index_name"), "ticker", "weight")


def synthetic_bars(spark: SparkSession, days: list[date], interval: float = 5.0, start: float = 34200.0, stop: float = 54000.0, seed: int = 1) -> DataFrame:
    """Seeded random bars of one trading session a day, for demonstrations."""
    n = int((stop - start) // interval)
    rows = spark.range(len(days) * n).withColumn("day", F.get(F.array(*(F.lit(d) for d in days)), (F.col("id") / n).cast("int")))
    ts = F.unix_seconds(F.col("day").cast("timestamp")) + start + (F.col("id") % n) * interval
    level, wide = F.lit(100.0) + F.sin(F.col("id") / 400.0) * 3, F.rand(seed) * 0.2
    return rows.select(ts.cast("double").alias("ts"), level.alias("open_price"), (level + wide / 2).alias("close_price"), (level + wide).alias("high_price"), (level - wide).alias("low_price"), F.floor(F.rand(seed + 1) * 100).cast("double").alias("volume"))
