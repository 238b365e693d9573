"""Queries over the ledger, the factor store, feed quality, topics and streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as display
from ..operators import feed
from ..sources import pool, topics
from ..sources.tape import events, trades
from ..streaming import runs
from . import queries_sampling, sql
from .catalog import _ORACLES, long, register, rounded
from .queries_factors import H1, H6, closes
from .registry import FactorSpec, param_grid

LEDGER = f"""{sql.trades()}, a AS (SELECT ticker, ts, seq, price, CASE WHEN k % 4 IN (0, 3) THEN 1 ELSE -1 END AS action FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) - 1 AS k FROM tape)),
p AS (SELECT *, sum(action) OVER w AS position, count(*) OVER w AS n_action, sum(abs(action * price) * 0.00016) OVER w AS fee FROM a WINDOW w AS (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, sum(CASE WHEN position - action = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS trade_id FROM p),
c AS (SELECT *, sum(-action * price) OVER (PARTITION BY ticker, trade_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS spent FROM t),
l AS (SELECT *, CASE WHEN position = 0 THEN 0 ELSE spent END AS cash, sum(CASE WHEN position = 0 THEN spent ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS pnl FROM c)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buy, sell, sell, buy, by turns."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy("ts", "seq")) - 1
    return trades(spark, sf_dir).select("ticker", "ts", "seq", "price").withColumn("action", F.when((k % 4).isin(0, 3), 1).otherwise(-1))


@register(f"WITH {LEDGER} SELECT ticker, seq, CAST(position AS BIGINT) AS position, n_action, round(fee, 6) AS fee, CAST(trade_id AS BIGINT) AS trade_id, round(cash, 4) + 0.0 AS cash, round(pnl, 4) + 0.0 AS pnl, round(position * price + cash, 4) + 0.0 AS nav FROM l")
def q_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, cash, realised profit and value."""
    out = display.ledger(_actions(spark, sf_dir))
    money = ((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("cash", "pnl", "nav"))
    return out.select("ticker", "seq", long("position").alias("position"), "n_action", F.round("fee", 6).alias("fee"), "trade_id", *money)


@register(f"""WITH {LEDGER} SELECT ticker, seq, round(min(position * price + cash) OVER w, 4) + 0.0 AS max_drawdown, round(ts - first_value(ts) OVER w, 3) AS holding_time FROM l WHERE position <> 0
WINDOW w AS (PARTITION BY ticker, trade_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)""")
def q_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open trade's worst value and its age."""
    out = display.drawdown(display.ledger(_actions(spark, sf_dir)))
    return out.select("ticker", "seq", (F.round("max_drawdown", 4) + F.lit(0.0)).alias("max_drawdown"), F.round("holding_time", 3).alias("holding_time"))


@register(f"""WITH RECURSIVE {sql.trades()}, r AS (SELECT ticker, seq, price - 100 AS v, price - 50 AS u, price - 150 AS lo, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS n FROM tape),
s AS (SELECT ticker, n, seq, CASE WHEN lo > 0 THEN 1 WHEN u < 0 THEN -1 ELSE 0 END AS action, CASE WHEN lo > 0 THEN 1 WHEN u < 0 THEN -1 ELSE 0 END AS position FROM r WHERE n = 1
UNION ALL SELECT ticker, n, seq, a, position + a FROM (SELECT r.ticker, r.n, r.seq, s.position, CASE WHEN s.position = 0 THEN CASE WHEN r.lo > 0 THEN 1 WHEN r.u < 0 THEN -1 ELSE 0 END
  WHEN s.position < 0 AND r.v > 0 THEN 1 WHEN s.position > 0 AND r.v < 0 THEN -1 ELSE 0 END AS a FROM s JOIN r ON r.ticker = s.ticker AND r.n = s.n + 1))
SELECT ticker, seq, CAST(action AS BIGINT) AS action FROM s""")
def q_signal_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions from predictions and the position they lead to."""
    p = F.col("price")
    rows = trades(spark, sf_dir).select("ticker", "ts", "seq", (p - 100).alias("value"), (p - 50).alias("upper"), (p - 150).alias("lower"))
    return display.signal_actions(rows).select("ticker", "seq", "action")


@register(f"WITH {LEDGER} SELECT ticker, seq, CAST(CASE WHEN sign(position) * (CASE WHEN ticker < '5' THEN 1 ELSE -1 END) < 0 THEN abs(position) ELSE 1 END AS DOUBLE) AS size FROM l")
def q_order_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume of a market order against each row's position."""
    book = display.ledger(_actions(spark, sf_dir))
    side = F.when(F.col("ticker") < "5", 1).otherwise(-1)
    return book.select("ticker", "seq", display.order_size(F.col("position"), side).cast("double").alias("size"))


@register(f"WITH {sql.trades('event_type')} SELECT ticker, arg_max(seq, (ts, seq)) AS seq, arg_max(price, (ts, seq)) AS price FROM tape GROUP BY ticker, floor(ts / 10000)")
def q_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of every aligned interval."""
    return display.throttle(trades(spark, sf_dir, "event_type").select("ticker", "ts", "seq", "price"), 10_000.0).select("ticker", "seq", "price")


@register("SELECT DISTINCT ticker FROM (SELECT event_type AS ticker FROM events WHERE value > 100 UNION ALL SELECT CAST(user_id AS VARCHAR) FROM events WHERE value < 50)")
def q_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers that either of two subscriptions wants."""
    a = trades(spark, sf_dir, "event_type").where("price > 100").select("ticker")
    return a.union(trades(spark, sf_dir).where("price < 50").select("ticker")).distinct()


FACTORS = f"{sql.trades('event_type')}, {sql.bars(H6)}, f AS (SELECT CAST(idx * {H6} AS DOUBLE) AS ts, ticker || '.close' AS factor, close AS value FROM bars)"
NAMES = [f"{t}.close" for t in ("click", "error", "purchase", "signup", "view")]


def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closes(spark, sf_dir).select((F.col("idx") * float(H6)).alias("ts"), F.concat("ticker", F.lit(".close")).alias("factor"), F.col("close").alias("value"))


@register(f"WITH {FACTORS} SELECT ts, " + ", ".join(f"max(value) FILTER (WHERE factor = '{n}') AS {n.replace('.', '_')}" for n in NAMES) + " FROM f GROUP BY 1")
def q_pool_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, DM5, DM11: the wide form of the store."""
    out = pool.wide(factor_rows(spark, sf_dir), NAMES)
    return out.select("ts", *(F.col(f"`{n}`").alias(n.replace(".", "_")) for n in NAMES))


@register(f"WITH {FACTORS}, n AS (SELECT floor((ts + 100) / 43200) * 43200 AS ts, factor, arg_max(value + 1, ts) AS value FROM f WHERE factor <> 'view.close' GROUP BY ALL) SELECT coalesce(n.ts, f.ts) AS ts, coalesce(n.factor, f.factor) AS factor, coalesce(n.value, f.value) AS value FROM f FULL JOIN n ON n.ts = f.ts AND n.factor = f.factor")
def q_pool_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cells over stored ones, times floored, one factor left out."""
    stored = factor_rows(spark, sf_dir)
    new = stored.select((F.col("ts") + 100).alias("ts"), "factor", (F.col("value") + 1).alias("value"))
    return pool.upsert(stored, new, interval=43200.0, exclude=["view.close"])


@register(f"WITH {FACTORS} SELECT DISTINCT factor FROM f")
def q_pool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the store."""
    return pool.names(factor_rows(spark, sf_dir))


@register(f"WITH {FACTORS} SELECT DISTINCT CAST(floor(ts / 86400) AS BIGINT) AS day FROM f WHERE floor(ts / 86400) < 19740 ORDER BY 1 DESC LIMIT 5")
def q_last_n_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five dates before one."""
    return pool.last_dates(pool.dated(factor_rows(spark, sf_dir)), F.lit(date(2024, 1, 18)), 5, exclude_current=True).select(F.unix_date("market_date").cast("long").alias("day"))


@register(f"WITH {FACTORS} SELECT ts, count(*) AS n, round(sum(value), 4) AS total FROM f GROUP BY 1")
def q_pool_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store written by date, exported as CSV and read back."""
    from ..sources.shared import scratch

    path = scratch(spark, "pool")
    pool.write(factor_rows(spark, sf_dir), f"{path}/store")
    pool.export_csv(pool.read(spark, f"{path}/store").drop("market_date"), f"{path}/csv", NAMES)
    back = pool.import_csv(spark, f"{path}/csv", NAMES)
    return rounded(back.groupBy("ts").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@register(f"""WITH {FACTORS}, c AS (SELECT DISTINCT floor(ts / 3600) * 3600 AS ts FROM tape), k AS (SELECT DISTINCT ts FROM f), m AS (SELECT c.ts, min(k.ts) AS matched_ts FROM c LEFT JOIN k ON k.ts > c.ts GROUP BY 1)
SELECT m.ts, matched_ts, {", ".join(f"max(value) FILTER (WHERE factor = '{n}') AS {n.replace('.', '_')}" for n in NAMES)} FROM m LEFT JOIN f ON f.ts = m.matched_ts GROUP BY 1, 2""")
def q_cache_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's factors seen from an hourly clock, the row strictly after each time."""
    clock = trades(spark, sf_dir).select((F.floor(F.col("ts") / 3600) * 3600.0).alias("ts")).distinct()
    seen = pool.playback(clock, factor_rows(spark, sf_dir), NAMES, forward=True, strict=True)
    return seen.select("ts", "matched_ts", *(F.try_element_at("factors", F.lit(n)).alias(n.replace(".", "_")) for n in NAMES))


@register(f"WITH {FACTORS}, c AS (SELECT DISTINCT floor(ts / 3600) * 3600 + 1 AS ts FROM tape), k AS (SELECT DISTINCT ts FROM f) SELECT c.ts, coalesce(min(k.ts), floor(c.ts / {H6}) * {H6}) AS found FROM c LEFT JOIN k ON k.ts >= c.ts GROUP BY c.ts")
def q_locate_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored time at or after each time, else the floored one."""
    clock = trades(spark, sf_dir).select((F.floor(F.col("ts") / 3600) * 3600.0 + 1).alias("ts")).distinct()
    return pool.lookup(clock, factor_rows(spark, sf_dir).select("ts").distinct(), float(H6))


@register(f"WITH {FACTORS}, p AS (SELECT ts, value * 2 AS pred FROM f WHERE factor = 'view.close' AND CAST(ts AS BIGINT) % 43200 = 0), c AS (SELECT ts, value FROM f WHERE factor = 'click.close') SELECT coalesce(c.ts, p.ts) AS ts, value, pred FROM c FULL JOIN p ON p.ts = c.ts WHERE value IS NOT NULL")
def q_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker's prices and predictions by time, rows without a price dropped."""
    f = factor_rows(spark, sf_dir)
    pred = f.where((F.col("factor") == "view.close") & (F.col("ts") % 43200 == 0)).select("ts", (F.col("value") * 2).alias("pred"))
    return f.where("factor = 'click.close'").select("ts", "value").join(pred, "ts", "full_outer").dropna(subset=["value"])


@register(f"""WITH {FACTORS}, p AS (SELECT ts, factor, CASE WHEN CAST(ts AS BIGINT) % 43200 = 0 THEN value END AS pred FROM f)
SELECT ts, factor, last_value(pred IGNORE NULLS) OVER (PARTITION BY factor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pred FROM p""")
def q_ffill_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last prediction of each factor carried on."""
    f = factor_rows(spark, sf_dir)
    rows = f.select("ts", F.lit(0).alias("seq"), "factor", F.when(F.col("ts") % 43200 == 0, F.col("value")).alias("pred"))
    return display.forward_fill(rows, "pred", ("factor",)).select("ts", "factor", "pred")


@register(f"WITH {sql.trades('event_type')} SELECT ticker, CAST(floor(ts / {H1}) AS BIGINT) AS bucket, arg_max(price, ts) AS value, arg_max(price + 1, ts) AS upper, arg_max(price - 1, ts) AS lower FROM tape GROUP BY ALL")
def q_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the last prediction of each bucket, by ticker."""
    p = F.col("price")
    rows = trades(spark, sf_dir, "event_type").select("ticker", "ts", p.alias("value"), (p + 1).alias("upper"), (p - 1).alias("lower"))
    return display.overlay(rows, H1, keys=("ticker",))


@register("SELECT event_type AS name, count(*) AS calls, round(sum(value), 3) AS cumulative, round(avg(value), 6) AS mean, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY 1 ORDER BY sum(value) DESC LIMIT 3")
def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three costliest calls."""
    calls = events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("value").alias("seconds"))
    return rounded(feed.call_profile(calls, 3).withColumn("cumulative", F.round("cumulative", 3)))


@register(f"WITH {sql.trades()}, u AS (SELECT ticker, event_type, CAST(volume AS BIGINT) % 7 AS s, arg_min(volume, (ts, seq)) AS v FROM tape GROUP BY ALL) SELECT ticker, count(*) AS n_trades, sum(v) AS acc_volume FROM u GROUP BY 1")
def q_dedup_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of unique trades."""
    rows = trades(spark, sf_dir).withColumns({"buy_id": F.col("event_type"), "sell_id": (long("volume") % 7).cast("string")})
    return feed.trade_statistics(rows)


@register(f"WITH {sql.trades()}, g AS (SELECT ticker, ts, ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts, seq) AS gap FROM tape) SELECT ticker, round(ts, 3) AS ts, round(gap, 3) AS gap FROM g WHERE gap > 86400")
def q_feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of over a day."""
    return rounded(feed.gaps(trades(spark, sf_dir), 86400.0), 3)


@register(f"WITH {sql.trades()}, t AS (SELECT ticker, sum(volume) AS traded, sum(volume) - max(volume) AS reported FROM tape GROUP BY 1) SELECT *, traded > 1.005 * reported AS suspect FROM t")
def q_volume_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded against reported volume."""
    tape = trades(spark, sf_dir)
    return feed.reconcile(tape, tape.groupBy("ticker").agg((F.sum("volume") - F.max("volume")).alias("reported")))


@register(f"WITH {sql.trades()}, a AS (SELECT ticker, ts, seq, sum(volume) OVER (PARTITION BY ticker ORDER BY seq) AS total, max(ts) OVER (PARTITION BY ticker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tape) SELECT ticker, count(*) AS n_ticks, arg_max(total, (ts, seq)) AS last_total FROM a WHERE m IS NULL OR ts > m GROUP BY 1")
def q_snapshot_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots without repeats, and their last total."""
    total = F.sum("volume").over(Window.partitionBy("ticker").orderBy("seq"))
    return feed.snapshot_statistics(trades(spark, sf_dir).withColumn("total_traded_volume", total))


@register("SELECT event_id, 'realtime' AS action, '6000' || user_id || '.SH' AS ticker, 'TickData' AS dtype FROM events UNION ALL SELECT -event_id - 1, 'launch_order', event_type || '.X', NULL FROM events")
def q_topic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16, DM17: topics made and parsed again."""
    e = events(spark, sf_dir)
    made = e.select("event_id", topics.push_topic(F.concat(F.lit("6000"), F.col("user_id"), F.lit(".SH")), F.lit("TickData")).alias("t")).unionByName(e.select((-F.col("event_id") - 1).alias("event_id"), F.concat(F.lit("launch_order."), F.col("event_type"), F.lit(".X")).alias("t")))
    return made.select("event_id", topics.parse(F.col("t")).alias("p")).select("event_id", "p.*")


@register("SELECT event_id, json_extract_string(props, '$.k') AS k, value FROM events")
def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON messages and back."""
    sent = topics.messages(events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"), "value"), F.lit("events.history"))
    return sent.select(F.from_json("payload", "event_id long, k string, value double").alias("r")).select("r.*")


@register("SELECT 'realtime.' || user_id || '.TradeData' AS topic, event_id, value FROM events")
def q_message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream written as JSON messages; a later reader gets the history first."""
    return runs.messages(spark, sf_dir)


@register("SELECT * FROM (VALUES (0, 1, 3, 'Monitor.Grid.Trend.0'), (1, 2, 3, 'Monitor.Grid.Trend.1'), (2, 1, 4, 'Monitor.Grid.Trend.2'), (3, 2, 4, 'Monitor.Grid.Trend.3')) t(i, a, b, name)")
def q_param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of parameters in order."""
    rows = [(i, p["a"], p["b"], p["name"]) for i, p in enumerate(param_grid({"a": [1, 2], "b": [3, 4]}, name="Trend"))]
    return spark.createDataFrame(rows, "i int, a int, b int, name string")


SPEC = FactorSpec("Monitor.Trend", "trend", {"alpha": 0.1, "interval": H6})


@register("""SELECT 'Monitor.Trend' AS name, sha256('{"comments": "", "family": "", "name": "Monitor.Trend", "params": {"alpha": 0.1, "interval": 21600}, "plan": "trend", "version": "1"}') AS digest""")
def q_spec_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec's digest."""
    return spark.createDataFrame([(SPEC.name, SPEC.digest)], "name string, digest string")


@register(f"WITH {sql.trades('event_type')}, {sql.bars(H1)} SELECT ticker, idx, open, high, low, close, volume FROM bars")
def q_stream_fixed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from a stream."""
    return runs.fixed_bars(spark, sf_dir, H1)


@register(queries_sampling.VOLUME_BARS.replace("round(sum(notional), 4) AS notional", "count(*) AS n"))
def q_stream_volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume bars from keyed state."""
    return runs.volume_bars(spark, sf_dir, 500.0)


@register(f"WITH RECURSIVE {sql.trades()}, {sql.ema('(SELECT ticker, seq, price FROM tape)', 'price', 0.2, 'ticker', 'seq')} SELECT ticker, seq, round(ema, 6) AS ema FROM ema")
def q_stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA from keyed state."""
    return rounded(runs.ema(spark, sf_dir, 0.2))


@register(_ORACLES["q_online_decoder"])
def q_stream_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves from keyed state."""
    return runs.waves(spark, sf_dir)


@register("SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated events dropped from a stream."""
    return runs.first_events(spark, sf_dir)


IDLE = 5 * 86400
SESSIONS = f"""{sql.trades()}, g AS (SELECT ticker, ts, seq, price, CASE WHEN ts - lag(ts) OVER w > {IDLE} THEN 1 ELSE 0 END AS gap FROM tape WINDOW w AS (PARTITION BY ticker ORDER BY ts, seq)),
n AS (SELECT ticker, sum(gap) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run, ts, seq, price FROM g),
o AS (SELECT ticker, run, price, seq, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS place FROM n), {sql.ema('o', 'price', 0.2, 'ticker, run', 'place')}"""


@register(f"WITH RECURSIVE {SESSIONS} SELECT o.ticker, o.seq, round(ema, 6) AS ema FROM ema JOIN o ON o.ticker = ema.ticker AND o.place = ema.place")
def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA of rows that arrive in no order within the watermark; a key silent for five days starts anew."""
    return rounded(runs.sessions(spark, sf_dir, 0.2, float(IDLE))[0])


@register(f"""WITH RECURSIVE {SESSIONS}, l AS (SELECT ticker, max(ts) AS seen FROM tape GROUP BY 1), e AS (SELECT o.ticker, arg_max(ema, o.place) AS memory FROM ema JOIN o ON o.ticker = ema.ticker AND o.place = ema.place GROUP BY 1)
SELECT l.ticker, round(seen, 3) AS seen, round(memory, 6) AS memory FROM l JOIN e ON e.ticker = l.ticker WHERE seen + {IDLE} >= (SELECT max(ts) FROM tape) + 7200""")
def q_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that a stopped query's checkpoint holds: those of keys that were not idle at its last watermark."""
    return runs.sessions(spark, sf_dir, 0.2, float(IDLE))[1].select("ticker", F.round("seen", 3).alias("seen"), F.round("memory", 6).alias("memory"))
