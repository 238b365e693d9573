"""Queries over recurrences, composites, entropy, as-of joins, decoders and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite, decoder, entropy, recurrence, running, sampling, targets
from ..operators.sampling import OHLC, Topic
from ..sources.tape import trades, type_weights
from . import factors, sql  # noqa: F401
from .catalog import _ORACLES, register, rounded
from .registry import FactorSet, FactorSpec

H6, H1, DAY = 21600, 3600, 86400
CLOSE = (Topic("close", "price", "update"),)


def closes(spark: SparkSession, sf_dir: str, interval: int = H6, key: str = "event_type") -> DataFrame:
    return sampling.fixed_bars(trades(spark, sf_dir, key), interval, CLOSE)


@register(f"WITH RECURSIVE {sql.trades()}, {sql.bars(H6)}, {sql.ema('bars', 'close', 0.2)} SELECT ticker, idx, round(ema, 6) AS ema FROM ema")
def q_ema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA of closes."""
    return rounded(recurrence.ema_series(closes(spark, sf_dir, H6, "user_id"), "close", 0.2))


@register(f"WITH {sql.trades('event_type')}, {sql.bars(H6)} SELECT ticker, round(list_reduce(list(close ORDER BY idx), lambda a, x: 0.2 * x + 0.8 * a), 6) AS ema FROM bars GROUP BY 1")
def q_ema_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory after the last bar."""
    return rounded(recurrence.ema_last(closes(spark, sf_dir), "close", 0.2))


@register(f"WITH RECURSIVE {sql.trades('event_type')}, {sql.bars(H6)}, {sql.ema('bars', 'volume', 0.0265)} SELECT ticker, idx, round(ema, 4) AS ema FROM ema")
def q_accumulate_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA of sums, committed at each bucket's end."""
    bars = sampling.fixed_bars(trades(spark, sf_dir, "event_type"), H6, (Topic("volume", "volume", "accumulate"),))
    return rounded(recurrence.ema_series(bars, "volume", round(recurrence.ALPHA["0.2"], 4)), 4)


@register(f"""WITH RECURSIVE {sql.trades('event_type')}, {sql.bars(H6)}, r AS (SELECT ticker, idx, close AS x, row_number() OVER (PARTITION BY ticker ORDER BY idx) AS n FROM bars),
m AS (SELECT ticker, idx, n, x, x AS f, x AS g, CAST(0 AS DOUBLE) AS h FROM r WHERE n = 1 UNION ALL SELECT ticker, idx, n, x, f, g, 0.2 * (f - g) + 0.8 * h FROM (
  SELECT r.ticker, r.idx, r.n, r.x, 2 / 13.0 * r.x + 11 / 13.0 * m.f AS f, 2 / 27.0 * r.x + 25 / 27.0 * m.g AS g, m.h FROM m JOIN r ON r.ticker = m.ticker AND r.n = m.n + 1))
SELECT ticker, idx, round(f - g, 6) + 0.0 AS line, round(h, 6) + 0.0 AS signal, round(f - g - h, 6) + 0.0 AS diff, round(CASE WHEN x <> 0 THEN (f - g - h) / x END, 4) + 0.0 AS diff_adjusted FROM m""")
def q_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD of closes."""
    return rounded(recurrence.macd(closes(spark, sf_dir)).withColumn("diff_adjusted", F.round("diff_adjusted", 4)))


TREND = """ch AS (SELECT ticker, idx, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY idx), 0) - 1 AS change FROM (SELECT *, max(idx) OVER (PARTITION BY ticker) AS last FROM bars) WHERE idx < last)"""


@register(f"WITH RECURSIVE {sql.trades('event_type')}, {sql.bars(H6)}, {TREND}, {sql.ema('ch', 'change', 0.1)} SELECT ticker, idx, round(ema, 4) + 0.0 AS trend FROM ema")
def q_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA of relative changes between closed bars."""
    return rounded(recurrence.trend(closes(spark, sf_dir), 0.1), 4)


@register(f"""WITH RECURSIVE {sql.trades('event_type')}, {sql.bars(H6)}, {TREND}, {sql.ema('ch', 'change', 0.1)}, {sql.WEIGHTS}
SELECT idx, round(sum(weight * ema), 4) + 0.0 AS trend FROM ema JOIN weights ON weights.ticker = ema.ticker GROUP BY 1""")
def q_trend_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of the members' trends."""
    w = composite.normalize(type_weights(spark, sf_dir))
    return rounded(composite.composite(w, recurrence.trend(closes(spark, sf_dir), 0.1), "trend", by=("idx",), name="trend").select("idx", "trend"), 4)


@register(f"""WITH {sql.trades('event_type')}, {sql.WEIGHTS}, l AS (SELECT ticker, arg_max(price, (ts, seq)) AS p FROM tape GROUP BY 1)
SELECT 'types' AS index_name, round(sum(weight * p), 6) AS composite FROM weights JOIN l ON l.ticker = weights.ticker""")
def q_weights_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM7, G1, G2, G4, J1: weighted last prices."""
    last = trades(spark, sf_dir, "event_type").groupBy("ticker").agg(F.max_by("price", F.struct("ts", "seq")).alias("p"))
    return rounded(composite.composite(composite.normalize(type_weights(spark, sf_dir)), last, "p"))


@register(f"""WITH RECURSIVE {sql.trades()}, {sql.bars(H6)}, {sql.ema('bars', 'close', 0.2)}, h AS (SELECT CAST(avg(idx) AS BIGINT) AS mid FROM bars)
SELECT ticker, idx, round(ema, 6) AS ema FROM ema, h WHERE idx > mid""")
def q_ema_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA up to a bar, kept as JSON, and gone on with from there."""
    bars = closes(spark, sf_dir, H6, "user_id")
    mid = bars.agg(F.round(F.avg("idx")).cast("long").alias("mid"))
    halves = bars.join(F.broadcast(mid))  # one row
    states = recurrence.snapshot(halves.where("idx <= mid").select("ticker", "idx", "close"), "close", 0.2)
    return rounded(recurrence.resume(halves.where("idx > mid").select("ticker", "idx", "close"), "close", states, 0.2))


def _index_sql(missing: str) -> str:
    return f"""WITH {sql.trades('event_type')}, w AS (SELECT event_type AS ticker, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1 UNION ALL SELECT 'unseen', 200.0),
r AS (SELECT ticker, arg_max(price, (ts, seq)) / nullif(arg_min(price, (ts, seq)), 0) AS ratio FROM tape GROUP BY 1)
SELECT 'types' AS index_name, round({missing}, 6) AS level FROM w LEFT JOIN r ON r.ticker = w.ticker"""


def _with_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of all types, and of a member that never trades."""
    more = spark.createDataFrame([("types", "unseen", 200.0)], "index_name string, ticker string, weight double")
    return composite.normalize(type_weights(spark, sf_dir).unionByName(more))


@register(_index_sql("1000 * sum(weight * coalesce(ratio, 1)) / sum(weight)"))
def q_synthetic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index level; a member never seen counts as unchanged."""
    return rounded(composite.synthetic_index(trades(spark, sf_dir, "event_type"), _with_unseen(spark, sf_dir), base=1000.0))


@register(_index_sql("1000 * sum(weight * ratio) / sum(weight) FILTER (WHERE ratio IS NOT NULL)"))
def q_synthetic_index_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index level; a member never seen has no weight."""
    return rounded(composite.synthetic_index(trades(spark, sf_dir, "event_type"), _with_unseen(spark, sf_dir), base=1000.0, missing="renormalize"))


@register(f"""WITH {sql.trades('event_type')}, {sql.bars(H6)}, {sql.WEIGHTS}, b AS (SELECT ticker, arg_min(price, (ts, seq)) AS base FROM tape GROUP BY 1),
s AS (SELECT sum(weight * base) AS b FROM weights JOIN b ON b.ticker = weights.ticker)
SELECT idx, {', '.join(f'round(CASE WHEN count(*) = 5 THEN sum(weight * {c}) / max(b) END, 6) AS {c}' for c in ('open', 'high', 'low', 'close'))}, sum(volume) AS volume, round(sum(notional), 3) AS notional, CAST(sum(n_trades) AS BIGINT) AS n_trades
FROM bars JOIN weights ON weights.ticker = bars.ticker, s GROUP BY 1""")
def q_index_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the index."""
    tape = trades(spark, sf_dir, "event_type")
    bars = tape.groupBy("ticker", sampling.time_index(H6).alias("idx")).agg(*(t.column() for t in OHLC), F.sum("volume").alias("volume"), F.sum("notional").alias("notional"), F.count("*").alias("n_trades"))
    base = tape.groupBy("ticker").agg(F.min_by("price", F.struct("ts", "seq")).alias("base"))
    out = rounded(composite.index_bars(bars, composite.normalize(type_weights(spark, sf_dir)), base).drop("index_name"))
    return out.withColumn("notional", F.round("notional", 3))


@register(f"WITH {sql.trades('event_type')}, {sql.bars(H6)} SELECT a.ticker AS a, b.ticker AS b, round(covar_pop(a.close, b.close), 4) + 0.0 AS cov, count(*) AS n FROM bars a JOIN bars b ON a.idx = b.idx WHERE a.ticker <= b.ticker GROUP BY 1, 2")
def q_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of every two members."""
    return rounded(entropy.covariance(closes(spark, sf_dir), "close"), 4)


MEMBERS = ["click", "error", "purchase", "signup", "view"]
_PAIRS = [(a, b) for i, a in enumerate(MEMBERS) for b in MEMBERS[i:]]
_SEEN = " AND ".join(f"{m} IS NOT NULL" for m in MEMBERS)


@register(f"""WITH {sql.trades('event_type')}, {sql.bars(H6)}, p AS (SELECT idx, {", ".join(f"max({{0}}) FILTER (WHERE ticker = '{m}') AS {m}".format("close") for m in MEMBERS)} FROM bars GROUP BY 1),
f AS (SELECT idx, {", ".join(f"last_value({m} IGNORE NULLS) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS {m}" for m in MEMBERS)} FROM p),
k AS (SELECT idx, {", ".join(f"CASE WHEN {_SEEN} THEN {m} END AS {m}" for m in MEMBERS)} FROM f),
c AS (SELECT idx, count(click) OVER w AS n, {", ".join(f"covar_pop({a}, {b}) OVER w AS {a}_{b}" for a, b in _PAIRS)} FROM k WINDOW w AS (ORDER BY idx ROWS 19 PRECEDING))
""" + " UNION ALL ".join(f"SELECT idx, n, '{a}' AS a, '{b}' AS b, round({a}_{b} + 0.00000003, 4) + 0.0 AS cov FROM c" for a, b in _PAIRS))
def q_rolling_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of all members' closes over the last twenty buckets, a row for each bucket and pair.

    Prices are decimals, so covariances may lie on a rounding's edge; both sides are moved off it.
    """
    moments = entropy.rolling_moments(closes(spark, sf_dir), MEMBERS, ["close"], 20)
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.get("cov_close", F.lit(i)) + 0.00000003).alias("cov")) for i, (a, b) in enumerate(_PAIRS)))
    out = moments.select("idx", F.col("n_close").alias("n"), F.inline(pairs))
    return rounded(out, 4)


@register(f"""WITH {sql.trades('event_type')}, {sql.bars(H6)}, g AS (SELECT DISTINCT idx FROM bars WHERE ticker IN ('click', 'purchase')),
m0 AS (SELECT g.idx, last_value(a.close IGNORE NULLS) OVER v AS x, last_value(b.close IGNORE NULLS) OVER v AS y FROM g LEFT JOIN bars a ON a.idx = g.idx AND a.ticker = 'click' LEFT JOIN bars b ON b.idx = g.idx AND b.ticker = 'purchase' WINDOW v AS (ORDER BY g.idx ROWS UNBOUNDED PRECEDING)),
m AS (SELECT idx, x AS x0, y AS y0, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y FROM m0),
c AS (SELECT idx, var_pop(x) OVER w AS a, covar_pop(x, y) OVER w AS b, var_pop(y) OVER w AS d, count(x) OVER w AS n, count(x0) OVER w = 10 AND count(y0) OVER w = 10 AS ready FROM m WINDOW w AS (ORDER BY idx ROWS 9 PRECEDING)),
e AS (SELECT idx, n, ready, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l2 FROM c WHERE n >= 3)
SELECT idx, round(CASE WHEN l1 > 1e-9 THEN -l1 * log2(l1) ELSE 0 END + CASE WHEN l2 > 1e-9 THEN -l2 * log2(l2) ELSE 0 END, 3) + 0.0 AS pair_entropy, round(CASE WHEN l2 > 1e-9 THEN -l2 * log2(l2) ELSE 0 END, 3) + 0.0 AS pair_secondary_entropy, ready FROM e""")
def q_entropy_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropies of two members' last ten closes."""
    pair = closes(spark, sf_dir).where(F.col("ticker").isin("click", "purchase"))
    return rounded(entropy.rolling_entropy(pair, ["click", "purchase"], "close", 10, "pair"), 3).where("pair_entropy IS NOT NULL")


@register()
def q_trend_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends on the adaptive and the profile clock, and their index; tested against a plain model of each step."""
    tape, w = trades(spark, sf_dir, "event_type"), {t: 1.0 for t in ("click", "error", "purchase", "signup", "view")}
    params = {"adaptive": {"clock": "adaptive", "interval": H6, "baseline_window": 20}, "profile": {"clock": "profile", "interval": 1800, "profile_window": 4}}
    chosen = FactorSet()
    for name, p in params.items():
        chosen.add(FactorSpec(f"Monitor.Trend.{name}", "trend", {**p, "alpha": 0.1}))
        chosen.add(FactorSpec(f"Monitor.TrendIndex.{name}", "trend", {**p, "alpha": 0.1, "weights": w}))
    return rounded(chosen.collect(tape), 5)


@register()
def q_entropy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy factor on the profile clock, at its five parameterisations; tested against numpy."""
    chosen = FactorSet()
    for spec in factors.entropy_profile_specs(["click", "purchase", "view"]):
        chosen.add(spec)
    return rounded(chosen.collect(trades(spark, sf_dir, "event_type")), 5)


@register()
def q_entropy_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy factor of five members, through the registry; tested against numpy."""
    spec = FactorSpec("Monitor.Entropy", "entropy", {"clock": "time", "interval": H6, "sample_size": 20, "members": MEMBERS})
    return rounded(FactorSet({spec.name: spec}).collect(trades(spark, sf_dir, "event_type")), 5)


ASOF = f"""WITH {sql.trades()}, l AS (SELECT *, ts + 3600 AS at FROM tape)"""


@register(f"{ASOF} SELECT l.ticker, l.seq, round(CASE WHEN l.price <> 0 THEN r.price / l.price - 1 END, 4) + 0.0 AS pct_change_3600 FROM l ASOF LEFT JOIN tape r ON r.ticker = l.ticker AND r.ts >= l.at")
def q_forward_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative change to the first price an hour later or after."""
    tape = trades(spark, sf_dir)
    return rounded(targets.fixed_horizon(tape.select("ticker", "ts", "seq", "price"), 3600.0).select("ticker", "seq", "pct_change_3600"), 4)


@register(f"{ASOF} SELECT l.ticker, l.seq, r.price AS matched FROM l ASOF LEFT JOIN tape r ON r.ticker = l.ticker AND r.ts < l.ts")
def q_backward_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price before each row."""
    tape = trades(spark, sf_dir)
    return running.asof(tape.select("ticker", "ts", "seq"), tape.select("ticker", "ts", "price"), F.col("ts"), forward=False, strict=True).select("ticker", "seq", "matched")


ONLINE = {"confirmation": 0.05, "timeout": 3600.0 * 12, "up": 0.5, "down": 0.5}


@register(f"""WITH RECURSIVE {sql.trades()}, r AS (SELECT ticker, price AS p, ts AS t, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS n FROM tape),
s AS (SELECT ticker, n, p AS sp, t AS st, p AS ep, t AS et, p AS hi, p AS lo, 'unknown' AS lf, CAST(NULL AS VARCHAR) AS cf, CAST(NULL AS DOUBLE) AS cst, CAST(NULL AS DOUBLE) AS cet, CAST(NULL AS DOUBLE) AS csp, CAST(NULL AS DOUBLE) AS cep, CAST(NULL AS DOUBLE) AS chi, CAST(NULL AS DOUBLE) AS clo FROM r WHERE n = 1
UNION ALL SELECT ticker, n, CASE WHEN f IS NULL THEN sp ELSE p END, CASE WHEN f IS NULL THEN st ELSE t END, p, t, CASE WHEN f IS NULL THEN greatest(hi, p) ELSE p END, CASE WHEN f IS NULL THEN least(lo, p) ELSE p END, coalesce(f, lf), f, st, et, sp, ep, hi, lo
FROM (SELECT r.ticker, r.n, r.p, r.t, s.sp, s.st, s.ep, s.et, s.hi, s.lo, s.lf,
  CASE WHEN r.p > s.sp * 1.5 AND s.lf IN ('up', 'up_overshoot', 'unknown') THEN 'up_overshoot' WHEN r.p < s.sp * 0.5 AND s.lf IN ('down', 'down_overshoot', 'unknown') THEN 'down_overshoot'
  WHEN r.t > s.st + 43200 THEN 'flat' WHEN r.p < s.hi * 0.95 AND s.lf NOT IN ('up', 'up_overshoot') THEN 'down' WHEN r.p > s.lo * 1.05 AND s.lf NOT IN ('down', 'down_overshoot') THEN 'up' END AS f
  FROM s JOIN r ON r.ticker = s.ticker AND r.n = s.n + 1))
SELECT ticker, round(cst, 3) AS start_ts, round(cet, 3) AS end_ts, csp AS start_price, cep AS end_price, chi AS high, clo AS low, cf AS flag FROM s WHERE cf IS NOT NULL""")
def q_online_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of every ticker."""
    waves = decoder.decode_waves(trades(spark, sf_dir), **ONLINE)
    return waves.select("ticker", F.round("start_ts", 3).alias("start_ts"), F.round("end_ts", 3).alias("end_ts"), "start_price", "end_price", "high", "low", "flag")


@register(f"""WITH {sql.trades()}, a AS (SELECT *, sign(lead(price) OVER w - price) AS d FROM tape WINDOW w AS (PARTITION BY ticker ORDER BY ts, seq)),
b AS (SELECT *, last_value(nullif(d, 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM a)
SELECT ticker, round(ts, 3) AS ts, price, CAST(-d AS INT) AS flag FROM b WHERE d <> 0 AND (c IS NULL OR c <> d)""")
def q_turning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 level 0, D8: turning points as windows."""
    return decoder.first_level(trades(spark, sf_dir)).drop("seq").withColumn("ts", F.round("ts", 3))


@register(_ORACLES["q_online_decoder"].replace("SELECT ticker, round(cst, 3) AS start_ts, round(cet, 3) AS end_ts, csp AS start_price, cep AS end_price, chi AS high, clo AS low, cf AS flag FROM s", "SELECT ticker, round(cst, 3) AS start_ts, round(CASE WHEN csp <> 0 THEN (cep - csp) / csp END, 4) + 0.0 AS pct_change FROM s"))
def q_wave_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: relative change of each wave."""
    waves = decoder.decode_waves(trades(spark, sf_dir), **ONLINE)
    return rounded(waves.select("ticker", F.round("start_ts", 3).alias("start_ts"), decoder.pct_change().alias("pct_change")), 4)


_WAVES = _ORACLES["q_online_decoder"].rpartition("SELECT ticker, round(cst, 3)")[0]


@register(f"""{_WAVES}, o AS (SELECT ticker, cst, cf, lag(cf) OVER (PARTITION BY ticker ORDER BY cst) AS b FROM s WHERE cf IS NOT NULL)
SELECT ticker, round(cst, 3) AS start_ts, cf AS flag, NOT coalesce(cf = 'up_overshoot' AND b NOT IN ('up', 'up_overshoot', 'unknown') OR cf = 'down_overshoot' AND b NOT IN ('down', 'down_overshoot', 'unknown'), false) AS valid FROM o""")
def q_wave_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of waves, and whether each may follow the one before."""
    waves = decoder.valid_transitions(decoder.decode_waves(trades(spark, sf_dir), **ONLINE))
    return waves.select("ticker", F.round("start_ts", 3).alias("start_ts"), "flag", "valid")


def _levels(top: int) -> str:
    """CTEs l0 to l<top> (ticker, k, ts, price, flag): extremes of each level, in the order in which they are found."""
    first = f"""{sql.trades('event_type')}, a AS (SELECT *, sign(lead(price) OVER w - price) AS d FROM tape WINDOW w AS (PARTITION BY ticker ORDER BY ts, seq)),
b AS (SELECT *, last_value(nullif(d, 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM a),
start AS (SELECT ticker, arg_min(ts, (ts, seq)) AS ts, arg_min(price, (ts, seq)) AS price FROM tape GROUP BY 1),
l0 AS MATERIALIZED (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS k, ts, price, CAST(-d AS INT) AS flag FROM b WHERE d <> 0 AND (c IS NULL OR c <> d))"""
    # a level holds the last point (m), the last point of either kind (t, b) and its last extreme (e); u is the point that a new one is tested for
    return first + "".join(
        f""",
s{n} AS (SELECT ticker, 0::BIGINT AS k, price AS m, ts AS mt, NULL::DOUBLE AS t, NULL::DOUBLE AS tt, NULL::DOUBLE AS b, NULL::DOUBLE AS bt, NULL::DOUBLE AS e, NULL::DOUBLE AS u, NULL::DOUBLE AS ut, 0 AS f FROM start
UNION ALL SELECT ticker, k, p, pt, CASE WHEN flag = 1 THEN p ELSE t END, CASE WHEN flag = 1 THEN pt ELSE tt END, CASE WHEN flag = -1 THEN p ELSE b END, CASE WHEN flag = -1 THEN pt ELSE bt END,
  CASE WHEN turns THEN c ELSE e END, CASE WHEN turns THEN c END, CASE WHEN turns THEN ct END, CASE WHEN turns THEN flag ELSE 0 END
FROM (SELECT *, old IS NULL OR e IS NULL OR flag = 1 AND e < c AND c > p OR flag = -1 AND e > c AND c < p AS turns
  FROM (SELECT s.ticker, r.k, r.price AS p, r.ts AS pt, r.flag, s.m, s.t, s.tt, s.b, s.bt, s.e, CASE WHEN r.flag = 1 THEN s.t ELSE s.b END AS old,
    coalesce(CASE WHEN r.flag = 1 THEN s.t ELSE s.b END, s.m) AS c, coalesce(CASE WHEN r.flag = 1 THEN s.tt ELSE s.bt END, s.mt) AS ct FROM s{n} s JOIN l{n - 1} r ON r.ticker = s.ticker AND r.k = s.k + 1))),
l{n} AS MATERIALIZED (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY k) AS k, ut AS ts, u AS price, f AS flag FROM s{n} WHERE f <> 0)"""
        for n in range(1, top + 1)
    )


@register(f"WITH RECURSIVE {_levels(3)} " + " UNION ALL ".join(f"SELECT ticker, {n} AS level, round(ts, 3) AS ts, price, flag FROM l{n}" for n in range(4)))
def q_recursive_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of four levels."""
    return decoder.turning_points(trades(spark, sf_dir, "event_type"), 3).withColumn("ts", F.round("ts", 3))


#: Segments between extremes of level 3: rows with their segment's extremes, and the highest and lowest price up to its end.
WAVES = f"""{_levels(3)}, e AS (SELECT ticker, ts, arg_max(price, flag) AS price, max(flag) AS flag FROM l3 GROUP BY 1, 2),
marks AS MATERIALIZED (SELECT ticker, ts AS from_ts, flag, row_number() OVER w AS seg, lead(ts) OVER w AS next_ts, lead(flag) OVER w AS next_flag, lead(price, 2) OVER w AS after_price FROM e WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
r AS MATERIALIZED (SELECT tape.ticker, tape.ts, tape.seq, tape.price, m.seg, m.from_ts, m.flag, m.next_ts, m.next_flag, m.after_price FROM tape ASOF LEFT JOIN marks m ON m.ticker = tape.ticker AND tape.ts >= m.from_ts),
both_ AS (SELECT *, seg AS s FROM r WHERE seg IS NOT NULL UNION ALL SELECT *, seg - 1 FROM r WHERE ts = from_ts),
x AS (SELECT *, max(price) OVER w AS hi, min(price) OVER w AS lo FROM both_ WINDOW w AS (PARTITION BY ticker, s ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT ticker, ts, seq, price, seg, from_ts, next_ts, next_flag, after_price, -flag AS state, hi, lo FROM x WHERE s = seg UNION ALL SELECT ticker, ts, seq, price, NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL FROM r WHERE seg IS NULL),
z AS (SELECT *, CASE WHEN price <> 0 THEN hi / price END - 1 AS up, CASE WHEN price <> 0 THEN lo / price END - 1 AS down FROM y),
w AS MATERIALIZED (SELECT *, CASE state WHEN 1 THEN up WHEN -1 THEN down ELSE up + down END AS target FROM z)"""


@register(f"""WITH RECURSIVE {WAVES} SELECT ticker, seq, price, state, hi AS local_max, lo AS local_min, round(up, 4) + 0.0 AS up_actual, round(down, 4) + 0.0 AS down_actual, round(target, 4) + 0.0 AS target_actual FROM w""")
def q_wave_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets between extremes."""
    tape = trades(spark, sf_dir, "event_type").select("ticker", "ts", "seq", "price")
    return rounded(targets.wave_target(tape, level=3, smooth=False).drop("ts"), 4)


#: Parts of segments near their ends, as (ticker, s), with the share of holding on (h) and the next segment's gain (g).
_BLEND = """p0 AS (SELECT w.*, w.seg - d AS s FROM w, (VALUES (0), (1)) v(d) WHERE w.seg IS NOT NULL AND (d = 0 OR w.ts = w.from_ts)),
ends AS (SELECT DISTINCT ticker, seg AS s, from_ts AS a, next_ts AS z, next_flag AS zf, after_price AS za FROM w WHERE seg IS NOT NULL),
p1 AS (SELECT p0.*, a, z, zf, za, CASE WHEN zf = -1 THEN down ELSE -up END AS worst FROM p0 JOIN ends ON ends.ticker = p0.ticker AND ends.s = p0.s WHERE za IS NOT NULL AND ts >= greatest(a, z - 7200) AND ts <= z),
p2 AS (SELECT *, min(worst) OVER (PARTITION BY ticker, s ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS loss, greatest(min(worst) OVER (PARTITION BY ticker, s), -0.008) AS thr FROM p1),
p3 AS MATERIALIZED (SELECT ticker, ts, seq, seg - s AS d, zf, CASE WHEN loss > thr THEN 1 - loss / nullif(thr, 0) ELSE 0 END AS h, CASE WHEN zf = -1 THEN greatest(za / nullif(price, 0) - 1, 0) ELSE least(za / nullif(price, 0) - 1, 0) END AS g FROM p2),
q0 AS (SELECT w.*, up AS u0, down AS d0, target AS t0 FROM w)"""


def _blended(source: str, d: int, n: int) -> str:
    """CTE q<n>: the smoothed forms after the end of the segment that lies ``d`` before a row's own."""
    return f"""q{n} AS (SELECT q.* EXCLUDE (u0, d0, t0), CASE WHEN zf = -1 THEN h * g + (1 - h) * up ELSE u0 END AS u0, CASE WHEN zf = 1 THEN h * g + (1 - h) * down ELSE d0 END AS d0,
CASE WHEN zf = -1 THEN h * g + (1 - h) * d0 WHEN zf = 1 THEN h * g + (1 - h) * u0 ELSE t0 END AS t0 FROM {source} q LEFT JOIN p3 ON p3.ticker = q.ticker AND p3.ts = q.ts AND p3.seq = q.seq AND p3.d = {d})"""


@register(f"""WITH RECURSIVE {WAVES}, {_BLEND}, {_blended("q0", 1, 1)}, {_blended("q1", 0, 2)}
SELECT q.ticker, q.seq, q.price, q.state AS state_3, {", ".join(f"round({c}, 4) + 0.0 AS {n}_3" for c, n in (("q.up", "up_actual"), ("q.down", "down_actual"), ("q.target", "target_actual"), ("u0", "up_smoothed"), ("d0", "down_smoothed"), ("t0", "target_smoothed")))},
round(CASE WHEN q.price <> 0 THEN r.price / q.price - 1 END, 4) + 0.0 AS pct_change_900 FROM (SELECT *, ts + 900 AS at FROM q2) q ASOF LEFT JOIN tape r ON r.ticker = q.ticker AND r.ts >= q.at""")
def q_wave_target_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3, L4: the smoothed targets and the fixed horizon, by the names that predictions carry."""
    tape = trades(spark, sf_dir, "event_type").select("ticker", "ts", "seq", "price")
    return rounded(targets.named_targets(tape, level=3, look_back=7200.0).drop("ts"), 4)
