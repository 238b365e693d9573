"""Queries over filters, samplers, clocks, candles and profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import CN
from ..functions.filters import FilterMode, checked, constituents, dispatch, finite, mask, side_split
from ..operators import bars as display
from ..operators import sampling, snapshots, volume_clock, volume_profile
from ..operators.composite import normalize
from ..operators.running import running_sum
from ..operators.sampling import Topic
from ..sources.shared import scratch
from ..sources.tape import TAPE, daily_supplier, read_tape, synthetic_bars, trades, type_weights, write_tape
from . import sql
from .catalog import _ORACLES, long, register, rounded

H6, H1 = 21600, 3600
MODES = tuple(Topic(m, "price", m) for m in ("update", "first", "accumulate", "max", "min", "median", "mean", "variance"))
BAR = (*sampling.OHLC, Topic("volume", "volume", "accumulate"), Topic("notional", "notional", "accumulate"))
FLAGS = [1, 2, 3, 4, 7, 8, 16, 31]


def _flag_sql(m: int) -> str:
    parts = [p for b, p in ((1, "NOT (kind IN ('TradeData', 'TransactionData') AND side = 0)"), (2, sql.SESSION), (4, "kind <> 'OrderData'"), (8, "kind NOT IN ('TradeData', 'TransactionData')"), (16, "kind <> 'TickData'")) if m & b]
    return f"SELECT {m} AS mode, count(*) AS n, coalesce(sum(volume), 0) AS volume FROM tape WHERE {' AND '.join(parts)}"


@register(f"WITH {sql.trades()} {' UNION ALL '.join(map(_flag_sql, FLAGS))}")
def q_mask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and volume that each combination of filters keeps, in one pass."""
    tape = trades(spark, sf_dir)
    kept = {m: mask(FilterMode(m), CN, "kind") for m in FLAGS}
    one = tape.agg(*(F.struct(F.lit(m).alias("mode"), F.count_if(k).alias("n"), F.coalesce(F.sum(F.when(k, F.col("volume"))), F.lit(0.0)).alias("volume")).alias(f"m{m}") for m, k in kept.items()))
    return one.select(F.explode(F.array(*(f"m{m}" for m in FLAGS))).alias("r")).select("r.*")


@register(f"WITH {sql.trades()} SELECT CASE WHEN kind IN ('TradeData', 'TransactionData') THEN 'trade' ELSE kind END AS branch, count(*) AS n, sum(volume) AS volume FROM tape GROUP BY 1")
def q_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows and volume of each class's branch; unknown classes fail."""
    tape = checked(trades(spark, sf_dir).withColumn("dtype", F.col("kind")))
    parts = [b.agg(F.lit(k).alias("branch"), F.count("*").alias("n"), F.sum("volume").alias("volume")) for k, b in dispatch(tape).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


@register(f"WITH {sql.trades()} SELECT CAST(floor(ts / 3600) AS BIGINT) % 24 AS hour, count(*) FILTER (WHERE {sql.SESSION}) AS inside, count(*) AS n FROM tape GROUP BY 1")
def q_session_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F8: events in session by hour."""
    hour = long(F.floor(F.col("ts") / 3600)) % 24
    return trades(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.count_if(CN.in_session(F.col("ts"))).alias("inside"), F.count("*").alias("n"))


@register(f"WITH {sql.trades()} SELECT seq, CAST({sql.TOD} < 36000 AS INT) AS opening, CAST({sql.TOD} > 52200 AS INT) AS closing FROM tape")
def q_session_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """opening and closing phases."""
    opening, closing = CN.dummies(F.col("ts"))
    return trades(spark, sf_dir).select("seq", opening.alias("opening"), closing.alias("closing"))


@register(f"WITH {sql.trades('event_type')} SELECT ticker, CAST(floor(ts / {H1}) AS BIGINT) AS idx, round(sum(CASE WHEN side > 0 THEN notional ELSE 0 END), 4) AS buy, round(sum(CASE WHEN side < 0 THEN notional ELSE 0 END), 4) AS sell FROM tape WHERE side <> 0 GROUP BY ALL")
def q_side_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """buys and sells by hour."""
    buy, sell = side_split(F.col("notional"))
    tape = trades(spark, sf_dir, "event_type").where("side <> 0").withColumns({"b": buy, "s": sell})
    return rounded(sampling.fixed_bars(tape, H1, (Topic("buy", "b", "accumulate"), Topic("sell", "s", "accumulate"))), 4)


@register(f"WITH {sql.trades('event_type')} SELECT ticker, count(*) AS n FROM tape WHERE ticker IN ('click', 'purchase') AND isfinite(price) GROUP BY 1")
def q_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index's members, found by a semi join, with finite prices."""
    members = type_weights(spark, sf_dir).where(F.col("ticker").isin("click", "purchase"))
    return constituents(trades(spark, sf_dir, "event_type").where(finite(F.col("price"))), members).groupBy("ticker").agg(F.count("*").alias("n"))


@register(f"""WITH {sql.trades()} SELECT ticker, CAST(floor(ts / {H6}) AS BIGINT) AS idx, round(arg_max(price, (ts, seq)), 6) AS "update", round(arg_min(price, (ts, seq)), 6) AS "first",
  round(sum(price), 6) AS accumulate, round(max(price), 6) AS max, round(min(price), 6) AS min, round(median(price), 6) AS median, round(avg(price), 6) AS mean, round(var_pop(price), 4) AS variance FROM tape GROUP BY ALL""")
def q_sampler_modes_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight modes over six-hour bars."""
    out = rounded(sampling.fixed_bars(trades(spark, sf_dir), H6, MODES))
    return out.withColumn("variance", F.round("variance", 4))


#: In the middle of the events' month, inside a bar.
CUT = 1_705_300_000.0


def _saved(spark: SparkSession, states: DataFrame) -> DataFrame:
    """Snapshots as a later run finds them."""
    path = scratch(spark, "sampler_states")
    snapshots.save(states, path)
    return snapshots.load(spark, path)


@register(_ORACLES["q_sampler_modes_fixed"])
def q_sampler_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight modes of bars, cut inside a bar: the ring is kept as JSON, and later rows go on from it."""
    tape, index = trades(spark, sf_dir), sampling.time_index(H6)
    before = snapshots.partial_bars(tape.where(F.col("ts") < CUT), MODES, index)
    states = _saved(spark, snapshots.snapshot(before, MODES, 3))
    after = snapshots.resume(tape.where(F.col("ts") >= CUT), states, MODES, index)
    kept = snapshots.restored(states, MODES).select("ticker", F.inline("ring")).select("ticker", "idx")
    out = snapshots.finished(before.join(kept, ["ticker", "idx"], "left_anti").unionByName(after), MODES)
    return rounded(out).withColumn("variance", F.round("variance", 4))


@register(f"WITH {sql.trades()} SELECT ticker, CAST(floor(ts / 86400) AS BIGINT) AS idx, string_agg(CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY ts, seq) AS prices FROM tape GROUP BY ALL")
def q_sampler_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw values of daily bars."""
    out = sampling.fixed_bars(trades(spark, sf_dir), 86400, (Topic("p", "price", "store"),))
    return out.select("ticker", "idx", F.array_join(F.transform("p", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("prices"))


@register(f"WITH {sql.trades()}, {sql.bars(H6)} SELECT ticker, idx, round(avg(close) OVER w, 6) AS mean_5, max(high) OVER w AS high_5, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY idx ROWS 4 PRECEDING)")
def q_history_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the last five bars."""
    w = sampling.history(5)
    b = sampling.fixed_bars(trades(spark, sf_dir), H6, sampling.OHLC)
    return rounded(b.select("ticker", "idx", F.avg("close").over(w).alias("mean_5"), F.max("high").over(w).alias("high_5"), F.count("*").over(w).alias("n")))


@register(f"""WITH {sql.trades()}, {sql.bars(H6)}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY idx DESC) AS k FROM bars)
SELECT ticker, max(close) FILTER (WHERE k = 1) AS active, max(close) FILTER (WHERE k = 2) AS last_closed, count(*) - 1 AS n_closed FROM r GROUP BY 1""")
def q_latest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and last closed bar."""
    return sampling.active_and_latest(sampling.fixed_bars(trades(spark, sf_dir), H6, sampling.OHLC), "close")


@register(f"""WITH {sql.trades()}, {sql.bars(H6)}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY idx DESC) AS k FROM bars)
SELECT ticker, string_agg(CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY idx) AS closes FROM r WHERE k <= 8 GROUP BY 1""")
def q_history_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven closed bars and the open one as an array."""
    out = sampling.history_array(sampling.fixed_bars(trades(spark, sf_dir), H6, sampling.OHLC), "close", 8)
    return out.select("ticker", F.array_join(F.transform("values", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("closes"))


@register(f"""WITH {sql.trades('event_type')}, {sql.bars(H1)}, s AS (SELECT ticker, unnest(range(min(idx), max(idx) + 1)) AS idx FROM bars GROUP BY ticker)
SELECT s.ticker, s.idx, round(last_value(close IGNORE NULLS) OVER (PARTITION BY s.ticker ORDER BY s.idx ROWS UNBOUNDED PRECEDING), 6) AS close, coalesce(volume, 0) AS volume FROM s LEFT JOIN bars b ON b.ticker = s.ticker AND b.idx = s.idx""")
def q_fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3 on empty buckets: carried values and zero sums."""
    topics = (Topic("close", "price", "update"), Topic("volume", "volume", "accumulate"))
    return rounded(sampling.fill_gaps(sampling.fixed_bars(trades(spark, sf_dir, "event_type"), H1, topics), topics))


@register(f"""WITH {sql.trades('event_type')}, {sql.bars(H1)} SELECT ticker, idx AS bucket, open, high, low, close, volume, n_trades AS ver, CAST(idx * {H1} AS BIGINT) AS ts_start, least(open, close) AS body_low,
greatest(open, close) AS body_high, CASE WHEN close > open THEN 'up' ELSE 'down' END AS colour FROM bars""")
def q_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles."""
    return display.candles(trades(spark, sf_dir, "event_type"), H1)


@register(f"WITH {sql.trades('event_type')}, {sql.bars(H1)} SELECT ticker, idx AS bucket, CAST(idx * {H1} AS BIGINT) AS ts_start, open, high, low, close, volume FROM bars")
def q_candle_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles exported as CSV and read back."""
    path = scratch(spark, "candles")
    made = display.candles(trades(spark, sf_dir, "event_type"), H1)
    display.export_candles(made, path)
    schema = ", ".join(f"{c} {made.schema[c].dataType.simpleString()}" for c in ("ticker", "bucket", "ts_start", "open", "high", "low", "close", "volume"))
    return spark.read.schema(schema + ", market_date string").csv(path, header=True).drop("market_date")


@register(f"WITH {sql.trades()} SELECT ticker, CAST(floor(ts / 86400) AS BIGINT) AS day, count(*) AS n, sum(volume) AS volume FROM tape WHERE kind IN ('TradeData', 'TickData') AND floor(ts / 86400) BETWEEN 19730 AND 19740 GROUP BY ALL")
def q_tape_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tape written by date and ticker, and scanned by dates and classes that reach the scan."""
    path, rows = scratch(spark, "tape"), trades(spark, sf_dir).withColumn("dtype", F.col("kind"))
    write_tape(rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TAPE.fields)), path)
    day = lambda n: date.fromordinal(date(1970, 1, 1).toordinal() + n)
    tape = read_tape(spark, path, day(19730), day(19740), dtypes=["TradeData", "TickData"])
    return tape.groupBy("ticker", long(F.floor(F.col("ts") / 86400)).alias("day")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@register("SELECT CAST(d * 86400 + 34200 + i * 5 AS DOUBLE) AS ts, round(100 + sin(((d - 19723) * 3960 + i) / 400.0) * 3, 6) AS open_price, true AS ordered FROM (SELECT unnest(range(19723, 19726)) AS d), (SELECT unnest(range(0, 3960)) AS i)")
def q_synthetic_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of random bars; their times, levels and order of prices are fixed."""
    b = synthetic_bars(spark, [date(2024, 1, d) for d in (1, 2, 3)])
    within = (F.col("low_price") <= F.col("open_price")) & (F.col("open_price") <= F.col("close_price")) & (F.col("close_price") <= F.col("high_price"))
    return b.select("ts", F.round("open_price", 6).alias("open_price"), within.alias("ordered"))


@register(f"""WITH {sql.trades('event_type')} SELECT ticker, CAST(floor(ts / 86400) AS BIGINT) AS day, CAST(least(floor({sql.ELAPSED} / 1800), 7) AS BIGINT) AS idx, arg_min(price, (ts, seq)) AS open,
max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume FROM tape WHERE {sql.SESSION} GROUP BY ALL""")
def q_session_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles on session buckets of half an hour."""
    return display.session_candles(trades(spark, sf_dir, "event_type"), CN, 1800)


@register("""WITH d AS (SELECT DISTINCT CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day FROM events), g AS (SELECT day, unnest(range(0, 8)) AS idx FROM d)
SELECT day, idx, CAST(day * 86400 + 34200 + idx * 1800 + CASE WHEN 34200 + idx * 1800 >= 41400 THEN 5400 ELSE 0 END AS DOUBLE) AS ts_start FROM g""")
def q_session_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's buckets of every day seen."""
    days = trades(spark, sf_dir).select(long(F.floor(F.col("ts") / 86400)).alias("day")).distinct()
    return CN.grid(spark, days, 1800)


@register(f"WITH {sql.trades()} SELECT ticker, seq, sum(volume) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS vol_acc FROM tape")
def q_volume_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume clock of every row."""
    return volume_clock.with_volume(trades(spark, sf_dir)).select("ticker", "seq", "vol_acc")


def _clock_sql(value: str) -> str:
    return f"""WITH {sql.trades()}, s AS (SELECT *, sum({value}) OVER w AS total, sum(CASE WHEN {sql.SESSION} AND kind IN ('TradeData', 'TransactionData') THEN {value} ELSE 0 END) OVER w AS added FROM tape WINDOW w AS (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, last_value(CASE WHEN kind = 'TickData' AND {sql.SESSION} THEN total - added END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS lead FROM s)
SELECT ticker, seq, round(added + coalesce(lead, 0), 4) AS vol_acc FROM k"""


def _clock(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    """Clicks are snapshots that tell the total of all events so far."""
    tape = running_sum(trades(spark, sf_dir).withColumn("dtype", F.col("kind")), F.col(value), f"total_traded_{value}")
    return rounded(volume_clock.event_clock(tape, value == "notional", CN.in_session(F.col("ts"))).select("ticker", "seq", "vol_acc"), 4)


@register(_clock_sql("volume"))
def q_event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock of trades and snapshots, in session."""
    return _clock(spark, sf_dir, "volume")


@register(_clock_sql("notional"))
def q_event_clock_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in notional."""
    return _clock(spark, sf_dir, "notional")


VOLUME_BARS = f"""WITH {sql.trades()}, v AS (SELECT *, sum(volume) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS acc FROM tape)
SELECT ticker, CAST(floor(acc / 500) AS BIGINT) AS idx, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, round(sum(notional), 4) AS notional FROM v GROUP BY ALL"""


@register(VOLUME_BARS)
def q_volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 500 units of volume."""
    return rounded(volume_clock.volume_bars(trades(spark, sf_dir), 500.0, BAR), 4)


@register(VOLUME_BARS)
def q_volume_clock_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume bars, cut inside a bar: the clock's total and the open bar are kept as JSON and gone on with."""
    tape, index = trades(spark, sf_dir), F.floor(F.col("vol_acc") / 500.0)
    early = tape.where(F.col("ts") < CUT)
    before = snapshots.partial_bars(volume_clock.with_volume(early), BAR, index)
    states = _saved(spark, snapshots.snapshot(before, BAR, 1, snapshots.clock_totals(early, "volume")))
    after = snapshots.resume(snapshots.resumed_volume(tape.where(F.col("ts") >= CUT), states, BAR), states, BAR, index)
    kept = snapshots.restored(states, BAR).select("ticker", F.inline("ring")).select("ticker", "idx")
    return rounded(snapshots.finished(before.join(kept, ["ticker", "idx"], "left_anti").unionByName(after), BAR), 4)


BASELINE = f"""v AS (SELECT ticker, floor(ts / {H6}) AS idx, sum(volume) AS v FROM tape GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY idx) AS k FROM v),
base AS (SELECT ticker, CASE WHEN count(*) >= 10 AND avg(v) > 0 THEN avg(v) END AS baseline, count(*) AS n FROM r WHERE k <= 20 GROUP BY 1)"""


@register(f"WITH {sql.trades('event_type')}, {BASELINE} SELECT ticker, round(baseline, 6) AS baseline, n FROM base")
def q_adaptive_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean bucket volume of the first twenty buckets."""
    return rounded(volume_clock.volume_baseline(trades(spark, sf_dir, "event_type"), H6, 20))


@register(f"""WITH {sql.trades('event_type')}, {BASELINE}, a AS (SELECT t.*, sum(volume) OVER (PARTITION BY t.ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS acc FROM tape t)
SELECT a.ticker, CAST(CASE WHEN baseline IS NULL THEN floor(ts / {H6}) ELSE floor(acc / baseline) END AS BIGINT) AS idx, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume FROM a JOIN base b ON b.ticker = a.ticker GROUP BY ALL""")
def q_adaptive_bars_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars on each ticker's final baseline."""
    return volume_clock.adaptive_bars_final(trades(spark, sf_dir, "event_type"), H6, 20, (Topic("close", "price", "update"), Topic("volume", "volume", "accumulate")))


ALIGNED = f"""WITH {sql.trades('event_type')}, {BASELINE}, {sql.WEIGHTS}, s AS (SELECT sum(weight * baseline) AS scale FROM weights JOIN base ON base.ticker = weights.ticker),
x AS (SELECT CAST(floor(ts / {H1}) AS BIGINT) AS step_idx, sum(weight * volume) AS v FROM tape JOIN weights ON weights.ticker = tape.ticker GROUP BY 1)"""


@register(ALIGNED + """ SELECT step_idx, CAST(floor(round(sum(v) OVER (ORDER BY step_idx) / scale, 6)) AS BIGINT) AS clock FROM x, s""")
def q_aligned_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clock for all members, by weighted volume."""
    tape = trades(spark, sf_dir, "event_type")
    return volume_clock.aligned_clock(tape, normalize(type_weights(spark, sf_dir)), volume_clock.volume_baseline(tape, H6, 20), H1)


@register(ALIGNED + """, c AS (SELECT step_idx, CAST(floor(round(sum(v) OVER (ORDER BY step_idx) / scale, 6)) AS BIGINT) AS idx FROM x, s)
SELECT ticker, idx, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, round(sum(notional), 4) AS notional FROM tape JOIN c ON c.step_idx = CAST(floor(ts / 3600) AS BIGINT) GROUP BY ALL""")
def q_aligned_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all members on the one clock."""
    tape = trades(spark, sf_dir, "event_type")
    clock = volume_clock.aligned_clock(tape, normalize(type_weights(spark, sf_dir)), volume_clock.volume_baseline(tape, H6, 20), H1)
    return rounded(volume_clock.aligned_bars(tape, clock, H1, BAR), 4)


@register(f"WITH {sql.trades()}, {BASELINE}, g AS (SELECT base.*, CAST(ticker AS BIGINT) % 5 AS grp FROM base) SELECT grp, bool_and(baseline IS NOT NULL) AS ready FROM g GROUP BY 1")
def q_baseline_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all tickers of a group have a baseline."""
    base = volume_clock.volume_baseline(trades(spark, sf_dir), H6, 20)
    return volume_clock.readiness(base.withColumn("grp", F.col("ticker").cast("long") % 5), "baseline", ("grp",))


#: What the adaptive clock knows at each row (buckets done, volume at the bucket's start, first volume), its baseline, and its steps.
ADAPTIVE_ONLINE = f"""WITH RECURSIVE {sql.trades('event_type')}, a AS (SELECT ticker, CAST(floor(ts / 86400) AS BIGINT) AS day, ts, seq, price, volume, floor(ts / {H1}) AS h FROM tape),
b AS (SELECT *, sum(volume) OVER w AS acc, first_value(volume) OVER w AS v0, dense_rank() OVER (PARTITION BY ticker, day ORDER BY h) - 1 AS done, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY ticker, day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN done = 0 THEN v0 ELSE first_value(acc - volume) OVER (PARTITION BY ticker, day, h ORDER BY ts, seq) END AS start, ts - h * {H1} AS passed FROM b),
d AS (SELECT *, max(CASE WHEN done = 8 THEN start END) OVER (PARTITION BY ticker, day) AS frozen, done + CASE WHEN passed > {H1 / 2} THEN 1 ELSE 0 END AS cnt,
  start - v0 + CASE WHEN passed > {H1 / 2} THEN (acc - start) / greatest(1, passed) * {H1} ELSE 0 END AS total FROM c),
e AS (SELECT *, CASE WHEN done >= 8 THEN (frozen - v0) / 8 WHEN done >= 3 AND cnt > 0 AND total > 0 THEN total / cnt END AS base FROM d),
f AS MATERIALIZED (SELECT ticker, day, k, ts, seq, price, volume, CASE WHEN base IS NULL THEN h ELSE 0 END AS x, CASE WHEN base IS NULL THEN 0 ELSE floor(acc / base) END AS y FROM e),
s AS (SELECT ticker, day, k, x, y, 0::BIGINT AS bar FROM f WHERE k = 1
UNION ALL SELECT f.ticker, f.day, f.k, CASE WHEN f.x > s.x OR f.y > s.y THEN f.x ELSE s.x END, CASE WHEN f.x > s.x OR f.y > s.y THEN f.y ELSE s.y END, s.bar + CASE WHEN f.x > s.x OR f.y > s.y THEN 1 ELSE 0 END
  FROM s JOIN f ON f.ticker = s.ticker AND f.day = s.day AND f.k = s.k + 1)
SELECT f.ticker, f.day, s.bar AS idx, round(arg_max(price, (ts, seq)), 6) AS close, sum(volume) AS volume FROM f JOIN s ON s.ticker = f.ticker AND s.day = f.day AND s.k = f.k GROUP BY ALL"""


@register(ADAPTIVE_ONLINE)
def q_adaptive_bars_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13, W14 as they stood at each row."""
    return rounded(volume_clock.adaptive_bars_online(trades(spark, sf_dir, "event_type"), H1, 8, (Topic("close", "price", "update"), Topic("volume", "volume", "accumulate")), sample_size=4))


@register(f"""WITH {sql.trades('event_type')}, p AS (SELECT ticker, CAST(floor(ts / 86400) AS BIGINT) AS day, sum(volume) AS day_volume FROM tape WHERE {sql.SESSION} GROUP BY ALL),
f AS (SELECT ticker, day, lag(day_volume) OVER (PARTITION BY ticker ORDER BY day) / 8 AS step FROM p),
a AS (SELECT t.*, CAST(floor(ts / 86400) AS BIGINT) AS day, sum(volume) OVER (PARTITION BY ticker, floor(ts / 86400) ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS acc FROM tape t WHERE {sql.SESSION})
SELECT a.ticker, a.day, CAST(CASE WHEN step IS NULL OR step = 0 THEN floor({sql.ELAPSED} / 1800) ELSE floor(acc / step) END AS BIGINT) AS idx, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume FROM a JOIN f ON f.ticker = a.ticker AND f.day = a.day GROUP BY ALL""")
def q_profile_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17 with one forecast a day, here the day before's volume: windows alone."""
    tape = trades(spark, sf_dir, "event_type").where(CN.in_session(F.col("ts")))
    return volume_profile.profile_bars(tape, CN, 1800, volume_profile.naive_forecast(tape), (Topic("close", "price", "update"), Topic("volume", "volume", "accumulate")))


@register(f"""WITH {sql.trades('event_type')}, p AS (SELECT ticker, CAST(floor(ts / 86400) AS BIGINT) AS day, sum(volume) AS v FROM tape WHERE {sql.SESSION} GROUP BY ALL),
f AS (SELECT ticker, day, nullif(lag(v) OVER (PARTITION BY ticker ORDER BY day), 0) / 8 AS step FROM p),
a AS (SELECT t.*, CAST(floor(ts / 86400) AS BIGINT) AS day, sum(volume) OVER (PARTITION BY ticker, floor(ts / 86400) ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS acc FROM tape t WHERE {sql.SESSION}),
b AS (SELECT a.*, step IS NOT NULL AS known, CASE WHEN step IS NULL THEN floor({sql.ELAPSED} / 1800) ELSE floor(acc / step) END AS i FROM a JOIN f ON f.ticker = a.ticker AND f.day = a.day),
c AS (SELECT *, dense_rank() OVER (PARTITION BY ticker, day ORDER BY i) - CASE WHEN min(i) OVER (PARTITION BY ticker, day) = 0 THEN 1 ELSE 0 END AS idx FROM b)
SELECT ticker, day, CAST(idx AS BIGINT) AS idx, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, arg_max(known, (ts, seq)) AS ready FROM c GROUP BY ALL""")
def q_profile_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online profile clock on a model's forecast, here the day before's volume; session time without one."""
    tape = trades(spark, sf_dir, "event_type").where(CN.in_session(F.col("ts")))
    topics = (Topic("close", "price", "update"), Topic("volume", "volume", "accumulate"))
    return volume_profile.profile_bars_online(tape, CN, 1800, topics, window=1 << 30, forecast=volume_profile.naive_forecast(tape))


#: At each row the leading intervals without a gap (rk counts intervals, n them), what they forecast, the forecast that stays from the fifth interval on, and the clock's steps.
PROFILE_ONLINE = f"""WITH RECURSIVE {sql.trades('event_type')}, a AS (SELECT ticker, CAST(floor(ts / 86400) AS BIGINT) AS day, ts, seq, price, volume, {sql.ELAPSED} AS e, floor({sql.ELAPSED} / 1800) AS i FROM tape WHERE {sql.SESSION}),
b AS (SELECT *, dense_rank() OVER (PARTITION BY ticker, day ORDER BY i) - 1 AS rk FROM a),
c AS (SELECT *, sum(volume) OVER w AS acc, coalesce(max(CASE WHEN i = rk THEN i + 1 END) OVER w, 0) AS n, sum(CASE WHEN i = rk THEN volume ELSE 0 END) OVER w AS v, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY ticker, day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CASE WHEN n >= 2 AND e > 0 THEN v / e * 14400 END AS fc FROM c),
g AS (SELECT *, CASE WHEN i >= 4 THEN lag(fc) OVER (PARTITION BY ticker, day ORDER BY ts, seq) END AS old FROM d),
f AS MATERIALIZED (SELECT ticker, day, k, ts, seq, price, volume, i, acc, coalesce(first_value(old IGNORE NULLS) OVER (PARTITION BY ticker, day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), fc) AS fc FROM g),
s AS (SELECT ticker, day, 0::BIGINT AS k, NULL::DOUBLE AS bucket, 0::DOUBLE AS last, 0::BIGINT AS bar FROM f WHERE k = 1
UNION ALL SELECT ticker, day, k, CASE WHEN idx > last THEN NULL ELSE bucket END, idx, bar + CASE WHEN idx > last THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN bucket IS NULL THEN i ELSE floor(acc / bucket) END AS idx FROM (SELECT f.ticker, f.day, f.k, f.i, f.acc, s.last, s.bar, coalesce(s.bucket, nullif(f.fc, 0) / 8) AS bucket FROM s JOIN f ON f.ticker = s.ticker AND f.day = s.day AND f.k = s.k + 1)))
SELECT f.ticker, f.day, s.bar AS idx, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, arg_max(fc IS NOT NULL, (ts, seq)) AS ready FROM f JOIN s ON s.ticker = f.ticker AND s.day = f.day AND s.k = f.k GROUP BY ALL"""


@register(PROFILE_ONLINE)
def q_profile_bars_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose bucket is forecast anew after each roll, by the day itself."""
    topics = (Topic("close", "price", "update"), Topic("volume", "volume", "accumulate"))
    return volume_profile.profile_bars_online(trades(spark, sf_dir, "event_type"), CN, 1800, topics, window=4)


OBS = f"""o AS (SELECT ticker, CAST(floor(ts / 86400) AS BIGINT) AS day, CAST(floor({sql.ELAPSED} / 1800) AS BIGINT) AS i, sum(volume) AS acc_vol, sum(notional) AS acc_amt, max(price) - min(price) AS px_range,
  arg_max(price, (ts, seq)) - arg_min(price, (ts, seq)) AS px_diff FROM tape WHERE {sql.SESSION} AND {sql.ELAPSED} < 14400 GROUP BY ALL),
days AS (SELECT DISTINCT ticker, day FROM o), gr AS (SELECT ticker, day, unnest(range(0, 8)) AS i FROM days),
g AS (SELECT gr.ticker, gr.day, gr.i, coalesce(acc_vol, 0) AS acc_vol, coalesce(acc_amt, 0) AS acc_amt, coalesce(px_range, 0) AS px_range, coalesce(px_diff, 0) AS px_diff, o.ticker IS NOT NULL AS is_init
  FROM gr LEFT JOIN o ON o.ticker = gr.ticker AND o.day = gr.day AND o.i = gr.i)"""
SMA = "s AS (SELECT ticker, day, i, " + ", ".join(f"avg({m}) OVER w AS {m}" for m in volume_profile.MEASURES) + " FROM g WINDOW w AS (PARTITION BY ticker, i ORDER BY day ROWS 4 PRECEDING))"
LAG = "b AS (SELECT ticker, day, i, " + ", ".join(f"lag({m}) OVER w AS {m}" for m in volume_profile.MEASURES) + " FROM s WINDOW w AS (PARTITION BY ticker, i ORDER BY day))"
ROUNDED = ", ".join(f"round({m}, 4) + 0.0 AS {m}" for m in volume_profile.MEASURES)


def profile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume_profile.full_grid(volume_profile.observations(trades(spark, sf_dir, "event_type"), CN, 1800), CN, 1800)


@register(f"WITH {sql.trades('event_type')}, {OBS} SELECT ticker, day, i, {ROUNDED}, is_init FROM g")
def q_profile_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session intervals with their sums."""
    return rounded(profile_grid(spark, sf_dir).select("ticker", "day", "i", *volume_profile.MEASURES, "is_init"), 4)


@register(f"WITH {sql.trades('event_type')}, {OBS}, {SMA} SELECT ticker, day, i, {ROUNDED} FROM s")
def q_profile_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: trailing means over days."""
    return rounded(volume_profile.sma_baseline(profile_grid(spark, sf_dir)), 4)


@register(f"WITH RECURSIVE {sql.trades('event_type')}, {OBS}, {sql.ema('g', 'acc_vol', 1 / 3, 'ticker, i', 'day')} SELECT ticker, i, day, round(ema, 4) AS acc_vol FROM ema")
def q_profile_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: exponential means over days."""
    return rounded(volume_profile.ema_baseline(profile_grid(spark, sf_dir)).select("ticker", "i", "day", "acc_vol"), 4)


@register(f"WITH {sql.trades('event_type')}, {OBS}, {SMA}, {LAG} SELECT g.ticker, g.i, g.day, " + ", ".join(f"round(g.{m} - b.{m}, 4) + 0.0 AS {m}" for m in volume_profile.MEASURES) + " FROM g JOIN b ON b.ticker = g.ticker AND b.i = g.i AND b.day = g.day WHERE b.acc_vol IS NOT NULL")
def q_profile_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals less the baseline of the days before."""
    g = profile_grid(spark, sf_dir)
    return rounded(volume_profile.residuals(g, volume_profile.out_of_sample(volume_profile.sma_baseline(g))).select("ticker", "i", "day", *volume_profile.MEASURES), 4)


def _interp(m: str) -> str:
    now = f"g.{m} + (1 - 1200 / 1800.0) * s.{m}" if m in ("acc_vol", "acc_amt") else f"g.{m} * sqrt(1800 / 1200.0)"
    return f"round(CASE WHEN g.i < 3 THEN g.{m} WHEN g.i = 3 THEN {now} ELSE s.{m} END, 4) + 0.0 AS {m}"


@register(f"WITH {sql.trades('event_type')}, {OBS}, {SMA} SELECT g.ticker, g.i, g.day, {', '.join(map(_interp, volume_profile.MEASURES))} FROM g JOIN s ON s.ticker = g.ticker AND s.i = g.i AND s.day = g.day")
def q_profile_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: days as they look after three intervals and two thirds of the fourth."""
    g = profile_grid(spark, sf_dir)
    return rounded(volume_profile.interpolate(g, volume_profile.sma_baseline(g), F.lit(3 * 1800.0 + 1200.0), 1800.0), 4)


@register(f"""WITH {sql.trades('event_type')}, {OBS}, l AS (SELECT *, coalesce(min(i) FILTER (WHERE NOT is_init) OVER (PARTITION BY ticker, day), 8) AS gap FROM g),
m AS (SELECT ticker, day, max(least(gap, 6)) AS n, sum(acc_vol) FILTER (WHERE i < least(gap, 6)) AS v FROM l GROUP BY ALL)
SELECT ticker, day, round(CASE WHEN n >= 3 THEN v / (n * 1800) * 14400 END, 4) AS forecast FROM m""")
def q_simple_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day volume from its leading intervals."""
    return rounded(volume_profile.profile_forecast("simple_online", profile_grid(spark, sf_dir), CN, 1800, 6), 4)


@register()
def q_accumulated_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's volume by stored least squares on the days before; tested against numpy."""
    return rounded(volume_profile.profile_forecast("accumulative_volume", profile_grid(spark, sf_dir), CN, 1800, 0), 3)


@register()
def q_interval_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by interval, after four intervals of the day; tested against numpy."""
    return rounded(volume_profile.profile_forecast("interval_volume", profile_grid(spark, sf_dir), CN, 1800, 4), 3)


@register("""SELECT CAST(l_suppkey AS BIGINT) AS ticker, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS notional,
round(sum(l_extendedprice) / sum(l_quantity), 9) AS price FROM lineitem GROUP BY ALL""")
def q_daily_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of suppliers."""
    return daily_supplier(spark, sf_dir).select(long("ticker").alias("ticker"), "day", "volume", F.round("notional", 2).alias("notional"), F.round("price", 9).alias("price"))
