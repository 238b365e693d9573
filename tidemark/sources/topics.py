"""Message topics: ``action``, ``action.ticker`` or ``action.ticker.dtype``; a ticker may hold dots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Actions by how many parts follow them.
PLAIN = ["on_order", "on_report", "launch_signal", "eod", "eod_done", "bod", "bod_done"]
WITH_TICKER = ["launch_order", "cancel_order", "open", "close"]
WITH_DTYPE = ["query", "subscribe", "realtime", "history"]
#: Parts of a log, each of many topics.
LOG_PARTS = 16


def push_topic(ticker: Column, dtype: Column) -> Column:
    return F.concat_ws(".", F.lit("realtime"), ticker, dtype)


def parse(topic: Column) -> Column:
    """Struct (action, ticker, dtype); what an action does not carry is NULL. Unknown actions parse as plain."""
    parts = F.split(topic, "\\.")
    action, n = F.get(parts, F.lit(0)), F.size(parts)
    ticker = F.when(action.isin(WITH_DTYPE) & (n > 2), F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), ".")).when(action.isin(WITH_TICKER) & (n > 1), F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), "."))
    dtype = F.when(action.isin(WITH_DTYPE) & (n > 2), F.element_at(parts, -1))
    return F.struct(action.alias("action"), ticker.alias("ticker"), dtype.alias("dtype"))


def log_part(topic: Column) -> Column:
    """Where a log keeps a topic."""
    return F.pmod(F.xxhash64(topic), F.lit(LOG_PARTS)).alias("part")


def send(stream: DataFrame, path: str, state: str, drain: Callable[[StreamingQuery], None] | None = None) -> None:
    """Appends a stream of (topic, payload) to a log of JSON files by parts of topics, until its input ends; ``state``: its checkpoint.

    A folder for each topic would be a file for each topic in each task: nearly one for each message, with many topics.

    ``drain`` waits for the end of an input that goes on by itself, such as a replay.
    """
    writer = stream.select("topic", "payload", log_part(F.col("topic"))).writeStream.format("json").partitionBy("part").option("path", path).option("checkpointLocation", state)
    if drain:
        drain(writer.start())
    else:
        writer.trigger(availableNow=True).start().awaitTermination()


def listen(spark: SparkSession, path: str) -> DataFrame:
    """Stream of (topic, payload) from a log: its history first, then what is appended."""
    return spark.readStream.schema("topic string, payload string, part long").json(path).select("topic", "payload")


def messages(rows: DataFrame, topic: Column) -> DataFrame:
    """(topic, payload): rows as JSON, for any message sink; strings pass as they are."""
    if rows.columns == ["payload"] and rows.schema["payload"].dataType.simpleString() == "string":
        return rows.select(topic.alias("topic"), "payload")
    return rows.select(topic.alias("topic"), F.to_json(F.struct(*rows.columns)).alias("payload"))
