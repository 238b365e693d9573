"""Streams over the events table, run until their input ends; each equals its batch query.

The table's files may be in any order. A stream replays a copy that is partitioned by day, some days a micro-batch; inside
these the rows come in no order. Aggregates by event time don't mind; keyed processors let rows wait until the watermark
has passed them.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import SETTINGS
from ..sources import replay, topics
from ..sources.shared import scratch
from . import processors

#: Keyed processors have several kinds of state, which Spark's default store refuses.
STORE = "spark.sql.streaming.stateStore.providerClass"
PARTS = "spark.sql.shuffle.partitions"

#: Rows of a micro-batch, about; a replay has ``BATCHES`` of them or more.
ROWS, BATCHES = 1_000_000, 3
#: Rows of a partition of a replay's state, each of which starts a Python worker in each micro-batch, and of a file of a replayed day, about.
STATE_ROWS, FILE_ROWS = 1_000_000, 50_000
#: Rows of a group of tickers whose state is kept together, about.
GROUP_ROWS = 10_000
#: Seconds of a slot in which keyed processors let rows wait.
SLOT = 3600.0
#: Days over which a tape in the order of its ids is spread.
ID_DAYS = 30

#: Held while a stream's settings stand in the session: of streams that start at once, one would else take the other's away.
STARTS = threading.RLock()


class Feed(NamedTuple):
    """A replay's rows, their span in seconds, partitions and groups of tickers that their state takes, first and last times."""

    rows: DataFrame
    span: float
    parts: int
    groups: int
    first: float
    last: float

    @property
    def shift(self) -> float:
        """Seconds, in whole slots, that put the first time after 1970, where a watermark starts: it would drop rows before."""
        return max(-((self.first - 86400) // SLOT) * SLOT, 0.0)


def state_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for the state of ``rows``: a stream keeps its number, and opens each one in each micro-batch."""
    with STARTS:
        most = int(spark.conf.get(PARTS))
    return min(max(-(-rows // STATE_ROWS), spark.sparkContext.defaultParallelism), most)


def state_groups(spark: SparkSession, rows: int) -> int:
    """Groups that tickers are dealt to: they grow with ``rows``, so that a group's state does not."""
    return max(-(-rows // GROUP_ROWS), state_parts(spark, rows))


def source(spark: SparkSession, sf_dir: str, rows: int | None = None, names: tuple[str, ...] | None = None, order: Callable[[DataFrame], DataFrame] | None = None) -> Feed:
    """Events as trades by user in event time ``at``, some ``rows`` a micro-batch by days.

    Rows of one day are in no order. The closing row has no ticker. ``names``: the columns to replay beside
    ticker, ts, seq and at, all by default. ``order`` may give the tape's rows other times.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    at = F.col("ts").cast("timestamp")
    tape = raw.select(F.col("user_id").cast("string").alias("ticker"), (F.unix_micros(at) / 1e6).alias("ts"), F.col("event_id").alias("seq"), at.alias("at"), F.col("value").alias("price"), k.alias("volume"), "event_type", "user_id")
    tape = tape if names is None else tape.select("ticker", "ts", "seq", "at", *names)
    tape = order(tape) if order else tape
    by_day = tape.groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    n, first, last, days, most = by_day.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("first"), F.max("last"), F.count("day"), F.coalesce(F.max("n"), F.lit(0))).first()
    path = scratch(spark, "stream_feed")
    replay.write_days(tape, path, files=max(-(-most // FILE_ROWS), 1))
    step = max(days // max(-(-n // (rows or ROWS)), BATCHES), 1)
    feed = replay.replay(spark, path, tape.schema, days=step, closing=3 * SLOT, progress=f"{path}-progress/day")
    return Feed(feed, (last or 0.0) - (first or 0.0), state_parts(spark, n), state_groups(spark, n), first or 0.0, last or 0.0)


def by_id(tape: DataFrame) -> DataFrame:
    """The prices of ``tape`` in the order of ``seq``, which takes the place of time: ids are spread over ``ID_DAYS`` days.

    Close ids may get one time; processors fold such rows by ``seq``. No price without a ticker goes on from another, so of
    these only the first is kept.
    """
    tape = tape.where("price IS NOT NULL")
    first, last, alone = tape.agg(F.min("seq").cast("double"), F.max("seq").cast("double"), F.min(F.when(F.col("ticker").isNull(), F.col("seq")))).first()
    width = ID_DAYS * 86400 / max((last or 0.0) - (first or 0.0), 1.0)
    ts = 86400 + (F.col("seq").cast("double") - F.lit(first or 0.0)) * F.lit(width)
    kept = tape.where(F.col("ticker").isNotNull() | F.col("seq").eqNullSafe(F.lit(alone)))
    return kept.withColumn("ts", ts).withColumn("at", F.timestamp_micros((ts * 1e6).cast("long")))


def ordered(spark: SparkSession, sf_dir: str, *names: str, order: Callable[[DataFrame], DataFrame] | None = None) -> Feed:
    """The source's rows for processors that fold in the order of time: the watermark follows the newest row by a slot.

    Rows without a time come first, and wait until the end.
    """
    feed = source(spark, sf_dir, names=names, order=order)
    at = F.timestamp_micros(F.coalesce(F.unix_micros("at"), F.lit(round(feed.first * 1e6))) + F.lit(round(feed.shift * 1e6)))
    return feed._replace(rows=feed.rows.select("ticker", "ts", "seq", *names, at.alias("at")).withWatermark("at", f"{int(SLOT)} seconds"))


def of_tickers(rows: DataFrame) -> DataFrame:
    """``rows`` that have a ticker, and the closing row, which has neither a ticker nor a ``seq``."""
    return rows.where("ticker IS NOT NULL OR seq IS NULL")


@contextmanager
def settings(spark: SparkSession, asked: dict[str, str]) -> Iterator[None]:
    """Queries that start inside have the settings ``asked``, whatever the session's; a query takes its settings at its start."""
    with STARTS:
        before = {k: spark.conf.get(k, None) for k in asked}
        try:
            for k, v in asked.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)


def drain(query: StreamingQuery) -> None:
    """Waits until a replay's closing row, and what it sets off, is done; then stops."""
    try:
        while query.isActive:
            done = query.lastProgress
            if done and replay.END in str(done["sources"][0]["endOffset"]):
                query.processAllAvailable()
                break
            time.sleep(0.1)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()


def to_table(stream: DataFrame, name: str, mode: str, path: str | None = None, *, replayed: bool = False, parts: int | None = None) -> DataFrame:
    """Runs ``stream`` over what there is; its rows with the number of the batch that wrote them.

    ``replayed``: a replay, which ends with its closing row. ``parts``: partitions of its state. A batch writes its own folder anew, so a batch that is repeated after a failure replaces itself. Given the ``path``
    of an earlier run, it goes on from that run's state.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state")
    with settings(spark, {STORE: SETTINGS[STORE]} | ({PARTS: str(parts)} if parts else {})):
        query = writer.start() if replayed else writer.trigger(availableNow=True).start()
    if replayed:
        drain(query)
    else:
        query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key: what an updating sink holds in the end."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def fixed_bars(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    """Bars by event time, updated in place until the watermark passes; days come in order, so no row is late."""
    at, feed = F.struct("ts", "seq"), source(spark, sf_dir)
    tape = feed.rows.where("ticker IS NOT NULL").withColumn("ticker", F.col("event_type")).withWatermark("at", "1 day")
    bars = tape.groupBy("ticker", F.window("at", f"{seconds} seconds").alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    out = bars.select("ticker", (F.unix_seconds("w.start") / seconds).cast("long").alias("idx"), "open", "high", "low", "close", "volume")
    return latest(to_table(out, "stream_bars", "update", replayed=True, parts=feed.parts), ["ticker", "idx"])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent as JSON messages by topic, and read again from the log's start."""
    path = scratch(spark, "messages")
    rows = source(spark, sf_dir).rows.where("ticker IS NOT NULL")
    sent = topics.messages(rows.select(F.col("seq").alias("event_id"), F.col("price").alias("value"), "ticker"), topics.push_topic(F.col("ticker"), F.lit("TradeData")))
    topics.send(sent, f"{path}/log", f"{path}/state", drain)
    back = topics.listen(spark, f"{path}/log").select("topic", F.from_json("payload", "event_id long, value double").alias("r")).select("topic", "r.*")
    return to_table(back, "stream_messages", "append").drop("batch")


def volume_bars(spark: SparkSession, sf_dir: str, interval: float) -> DataFrame:
    feed = ordered(spark, sf_dir, "price", "volume")
    out = to_table(processors.volume_bars(feed.rows, interval, late=SLOT, shift=feed.shift), "stream_volume_bars", "update", replayed=True, parts=feed.parts)
    rest = [c for c in out.columns if c not in ("ticker", "idx", "batch")]
    # a bar's later versions have more rows
    return out.groupBy("ticker", "idx").agg(F.max_by(F.struct(*rest), "n").alias("r")).select("ticker", "idx", "r.*")


def ema(spark: SparkSession, sf_dir: str, alpha: float) -> DataFrame:
    """EMA of each ticker's prices in the order of their ids, whatever their times."""
    feed = ordered(spark, sf_dir, "price", order=by_id)
    return to_table(processors.ema(feed.rows, "price", alpha, late=SLOT, groups=feed.groups), "stream_ema", "append", replayed=True, parts=feed.parts).drop("batch")


def sessions(spark: SparkSession, sf_dir: str, alpha: float, idle: float) -> tuple[DataFrame, DataFrame]:
    """EMA that starts anew after ``idle`` seconds without a row, and (ticker, seen, memory) of the states that are left at the end."""
    path, feed = scratch(spark, "stream_sessions"), ordered(spark, sf_dir, "price")
    given = of_tickers(feed.rows).withColumn("given", F.col("price").isNotNull())
    rows = to_table(processors.ema(given, "price", alpha, idle=idle, late=SLOT, untimed=feed.last, shift=feed.shift, groups=feed.groups), "stream_sessions", "append", path, replayed=True, parts=feed.parts)
    left = spark.read.format("statestore").option("stateVarName", "memory").load(f"{path}/state")
    each = left.select(F.inline(F.arrays_zip("value.ticker", "value.seen", "value.memory")))
    return rows.drop("batch"), each.where("memory IS NOT NULL")


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = ordered(spark, sf_dir, "price")
    out = to_table(processors.waves(of_tickers(feed.rows), late=SLOT, untimed=feed.last, shift=feed.shift, groups=feed.groups, confirmation=0.05, timeout=43200.0, up=0.5, down=0.5), "stream_waves", "append", replayed=True, parts=feed.parts)
    return out.select("ticker", F.round("start_ts", 3).alias("start_ts"), F.round("end_ts", 3).alias("end_ts"), "start_price", "end_price", "high", "low", "flag")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events of each user, repeats dropped; the watermark covers the table's span, so no state expires."""
    feed = source(spark, sf_dir)
    rows = feed.rows.where("ticker IS NOT NULL").withWatermark("at", f"{int(feed.span) + 1} seconds").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return to_table(rows.select("user_id", "event_type"), "stream_dedup", "append", replayed=True, parts=feed.parts).drop("batch")
