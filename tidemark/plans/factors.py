"""Built-in factors: plans from a tape of trades to (ts, key, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import CN
from ..functions.filters import side_split
from ..operators import composite, entropy, recurrence, sampling, volume_clock, volume_profile
from ..sources.shared import written
from .registry import FactorSpec, factor_plan

CLOSE = (sampling.Topic("close", "price", "update"),)
BAR_TS = sampling.Topic("bar_ts", "ts", "max")
# Fixed values: (sampling interval in seconds, bars of history) of the entropy factors on the profile clock.
ENTROPY_GRID = [(5, 60), (15, 60), (30, 30), (60, 15), (150, 10)]


def _clock(tape: DataFrame, spec: FactorSpec, topics: tuple[sampling.Topic, ...]) -> DataFrame:
    """(ticker, idx, topics, bar_ts) on the spec's clock, written: what a factor makes of its bars does not read the tape again."""
    return written(_bars(tape, spec, topics), "factor_bars")


def _bars(tape: DataFrame, spec: FactorSpec, topics: tuple[sampling.Topic, ...]) -> DataFrame:
    """On time, volume, adaptive volume, or the day's volume profile."""
    p, topics = spec.params, (*topics, BAR_TS)
    kind = p.get("clock", "time")
    if kind == "time":
        return sampling.fixed_bars(tape, p["interval"], topics)
    if kind == "volume":
        return volume_clock.volume_bars(tape, p["interval"], topics)
    if kind == "adaptive":
        return volume_clock.adaptive_bars_final(tape, p["interval"], p.get("baseline_window", 100), topics)
    if kind == "profile":
        inside = tape.where(CN.in_session(F.col("ts")))
        bars = volume_profile.profile_bars_online(inside, CN, p["interval"], topics, window=p.get("profile_window", 15))
        return bars.withColumn("idx", F.col("day").cast("long") * 1_000_000 + F.col("idx")).drop("day", "ready")
    raise ValueError(f"unknown clock {kind!r}")


def _stamped(rows: DataFrame, bars: DataFrame, keys: tuple[str, ...] = ("ticker", "idx")) -> DataFrame:
    """Adds ts: when the row's bar, or the last of its members' bars, ended."""
    return rows.join(bars.groupBy(*keys).agg(F.max("bar_ts").alias("ts")), list(keys))


@factor_plan("trend")
def trend(tape: DataFrame, spec: FactorSpec) -> DataFrame:
    """EMA of relative changes, by ticker; with weights, their composite under ``index``."""
    p = spec.params
    bars = _clock(tape, spec, CLOSE)
    rows = recurrence.trend(bars, p["alpha"])
    if "weights" not in p:
        return _stamped(rows, bars).select("ts", F.col("ticker").alias("key"), F.col("trend").alias("value"))
    w = rows.sparkSession.createDataFrame([("index", t, float(x)) for t, x in p["weights"].items()], "index_name string, ticker string, weight double")
    rows = composite.composite(composite.normalize(w), rows, "trend", by=("idx",), name="trend")
    return _stamped(rows, bars, ("idx",)).select("ts", F.lit("index").alias("key"), F.col("trend").alias("value"))


@factor_plan("macd")
def macd(tape: DataFrame, spec: FactorSpec) -> DataFrame:
    bars = _clock(tape, spec, CLOSE)
    rows = _stamped(recurrence.macd(bars), bars)
    return rows.select("ts", F.concat_ws(".", "ticker", F.lit("macd_diff_adjusted")).alias("key"), F.col("diff_adjusted").alias("value"))


@factor_plan("entropy")
def entropy_factor(tape: DataFrame, spec: FactorSpec) -> DataFrame:
    """Entropy and secondary entropy of members' prices, and entropies of their relative changes, notional and shares of buys and sells.

    ``weights``, if given, scale a member's prices and notional.
    """
    p = spec.params
    buy, sell = side_split(F.col("notional"))
    topics = (*CLOSE, sampling.Topic("notional", "notional", "accumulate"), sampling.Topic("notional_buy", "b", "accumulate"), sampling.Topic("notional_sell", "s", "accumulate"))
    bars = _clock(tape.withColumns({"b": buy, "s": sell}), spec, topics)
    if p.get("weights"):
        weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in p["weights"].items() for x in kv)), F.col("ticker")).cast("double"), F.lit(1.0))
        bars = bars.withColumns({c: F.col(c) * weight for c in ("close", "notional", "notional_buy", "notional_sell")})
    bars = entropy.relative_change(bars, "close").withColumn("buy_share", entropy.buy_share()).withColumn("sell_share", 1 - F.col("buy_share"))
    n, members = p["sample_size"], p["members"]
    names = {"close": "price", "close_change": "price_pct", "notional": "notional", "buy_share": "notional_buy_pct", "sell_share": "notional_sell_pct"}
    found = entropy.rolling_entropies(bars, members, names, n)
    both = _stamped(found, bars, ("idx",))
    if p.get("clock") == "profile":
        # a day's bars are as many as its volume makes; once the session has lasted for as long as they should, they count as enough for its rest
        late = F.col("ready") | (CN.elapsed(F.col("ts")) > n * p["interval"])
        day = Window.partitionBy(F.floor(F.col("ts") / 86400.0)).orderBy("ts", "idx").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("ready", F.coalesce(F.bool_or(late).over(day), F.lit(False)))
    values = [f"{x}_entropy" for x in ("price", "price_pct", "notional", "notional_buy_pct", "notional_sell_pct")] + ["price_secondary_entropy"]
    return both.select("ts", "ready", F.explode(F.array(*(F.struct(F.lit(v).alias("key"), F.col(v).alias("value")) for v in values))).alias("z")).select("ts", "z.*", "ready")


def entropy_profile_specs(members: list[str], weights: dict[str, float] | None = None) -> list[FactorSpec]:
    """The entropy factor on the profile clock, at each of its parameterisations."""
    fixed = {"clock": "profile", "members": members, **({"weights": weights} if weights else {})}
    return [FactorSpec(f"Monitor.Entropy.VolumeProfile.{interval}.{n}", "entropy", {**fixed, "interval": interval, "sample_size": n}) for interval, n in ENTROPY_GRID]


@factor_plan("mean_price")
def mean_price(tape: DataFrame, spec: FactorSpec) -> DataFrame:
    """Mean close of the last bars; NULL until there are ``sample_size``."""
    n = spec.params["sample_size"]
    w = sampling.history(n)
    bars = _clock(tape, spec, CLOSE)
    mean = F.when(F.count("close").over(w) == n, F.avg("close").over(w))
    return bars.select(F.col("bar_ts").alias("ts"), F.col("ticker").alias("key"), mean.alias("value"), mean.isNotNull().alias("ready"))


@factor_plan("flow")
def flow(tape: DataFrame, spec: FactorSpec) -> DataFrame:
    """Share of buys in each bar's notional."""
    buy, sell = side_split(F.col("notional"))
    rows = tape.withColumns({"b": buy, "s": sell})
    bars = _clock(rows, spec, (sampling.Topic("notional_buy", "b", "accumulate"), sampling.Topic("notional_sell", "s", "accumulate")))
    return bars.select(F.col("bar_ts").alias("ts"), F.col("ticker").alias("key"), entropy.buy_share().alias("value"))
