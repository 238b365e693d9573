"""Intraday volume profiles: interval observations, baselines, residuals, and day-volume forecasts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import SessionCalendar
from ..sources.shared import scratch, written
from .recurrence import alpha_of, ema_series
from .running import in_key_order, key_values, running_sum
from .sampling import Topic, bars

MEASURES = ["acc_vol", "acc_amt", "px_range", "px_diff"]
FEATURES = ["acc_amt", "px_range", "px_diff"]
KEY = ["ticker", "i"]


def observations(tape: DataFrame, calendar: SessionCalendar, interval: float) -> DataFrame:
    """(ticker, day, i, measures, prices): one row for each session interval with events; out of session dropped.

    Snapshots carry session totals and count by their increase; events without volume give prices only.
    """
    ts = F.col("ts")
    rows = tape.where(calendar.in_session(ts)).withColumns({"day": F.floor((ts + calendar.utc_offset) / 86400.0), "i": calendar.interval_index(ts, interval, F.col("dtype"))}).where(F.col("i").between(0, calendar.n_intervals(interval) - 1))
    traded = F.col("dtype").isin("TradeData", "TransactionData", "BarData")
    at = F.struct("ts", "seq")
    out = rows.groupBy("ticker", "day", "i").agg(
        F.coalesce(F.sum(F.when(traded, F.col("volume"))), F.lit(0.0)).alias("acc_vol"),
        F.coalesce(F.sum(F.when(traded, F.col("notional"))), F.lit(0.0)).alias("acc_amt"),
        F.min_by("price", at).alias("px_open"),
        F.max_by("price", at).alias("px_close"),
        F.max("price").alias("px_high"),
        F.min("price").alias("px_low"),
        *([F.max(F.when(F.col("dtype") == "TickData", F.col("total_traded_volume"))).alias("__tv"), F.max(F.when(F.col("dtype") == "TickData", F.col("total_traded_notional"))).alias("__ta")] if "total_traded_volume" in tape.columns else []),
    )
    if "__tv" in out.columns:
        upto = Window.partitionBy("ticker", "day").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        gain = lambda c: F.coalesce(F.col(c) - F.coalesce(F.max(c).over(upto), F.lit(0.0)), F.lit(0.0))
        out = out.withColumns({"acc_vol": F.col("acc_vol") + gain("__tv"), "acc_amt": F.col("acc_amt") + gain("__ta")}).drop("__tv", "__ta")
    return out.withColumns({"px_range": F.col("px_high") - F.col("px_low"), "px_diff": F.col("px_close") - F.col("px_open")})


def full_grid(obs: DataFrame, calendar: SessionCalendar, interval: float) -> DataFrame:
    """Every interval of each observed (ticker, day); empty ones are zero and not ``is_init``."""
    days = obs.select("ticker", "day").distinct()
    grid = days.select("ticker", "day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(calendar.n_intervals(interval) - 1).cast("long"))).alias("i"))
    return grid.join(obs.withColumn("is_init", F.lit(True)), ["ticker", "day", "i"], "left").fillna(0.0, MEASURES).fillna(False, ["is_init"])


def sma_baseline(grid: DataFrame, window: int = 5) -> DataFrame:
    """Trailing mean over days of each interval's measures, the day itself included."""
    w = Window.partitionBy(*KEY).orderBy("day").rowsBetween(-(window - 1), 0)
    return grid.select(*KEY, "day", *(F.avg(m).over(w).alias(m) for m in MEASURES))


def ema_baseline(grid: DataFrame, window: int = 5) -> DataFrame:
    """EMA over days of each interval's measures, from the first day on."""
    long = grid.select(*KEY, "day", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES))).alias("z")).select(*KEY, "day", "z.*")
    series = ema_series(long, "v", alpha_of(window), keys=(*KEY, "measure"), order="day")
    return series.groupBy(*KEY, "day").agg(*(F.max(F.when(F.col("measure") == m, F.col("ema"))).alias(m) for m in MEASURES))


def out_of_sample(baseline: DataFrame) -> DataFrame:
    """Each day's baseline from the days before it; NULL on the first."""
    w = Window.partitionBy(*KEY).orderBy("day")
    return baseline.select(*KEY, "day", *(F.lag(m).over(w).alias(m) for m in MEASURES))


def residuals(grid: DataFrame, baseline: DataFrame) -> DataFrame:
    """Measures less their baseline, for the days that have one."""
    b = baseline.select(*KEY, "day", *(F.col(m).alias(f"b_{m}") for m in MEASURES)).where(F.col("b_acc_vol").isNotNull())
    return grid.join(b, [*KEY, "day"]).select(*KEY, "day", *((F.col(m) - F.col(f"b_{m}")).alias(m) for m in MEASURES), *(f"b_{m}" for m in MEASURES))


def interpolate(grid: DataFrame, baseline: DataFrame, elapsed: Column, interval: float, threshold: float = 0.25) -> DataFrame:
    """An unfinished day: past intervals as seen, the current one completed, the rest as the baseline.

    The current interval counts once more than ``threshold`` of it has passed: its sums gain the baseline's
    share of what is left, its range and difference grow with the root of time.
    """
    b = baseline.select(*KEY, "day", *(F.col(m).alias(f"b_{m}") for m in MEASURES))
    rows = grid.join(b, [*KEY, "day"])
    k, rest = F.floor(elapsed / interval), elapsed % interval
    now = (F.col("i") == k) & (rest > threshold * interval)
    left = F.lit(1.0) - rest / interval

    def value(m: str) -> Column:
        grown = F.col(m) + left * F.col(f"b_{m}") if m in ("acc_vol", "acc_amt") else F.col(m) * F.sqrt(F.try_divide(F.lit(interval), rest))
        return F.when(F.col("i") < k, F.col(m)).when(now, grown).otherwise(F.col(f"b_{m}")).alias(m)

    return rows.select(*KEY, "day", *map(value, MEASURES))


def simple_forecast(grid: DataFrame, calendar: SessionCalendar, interval: float, n_window: int) -> DataFrame:
    """(ticker, day, forecast): volume of the leading unbroken intervals, at most ``n_window``, scaled to the session."""
    gap = F.min(F.when(~F.col("is_init"), F.col("i"))).over(Window.partitionBy("ticker", "day"))
    lead = grid.withColumn("upto", F.least(F.coalesce(gap, F.lit(calendar.n_intervals(interval))), F.lit(n_window))).groupBy("ticker", "day").agg(F.max("upto").alias("n"), F.sum(F.when(F.col("i") < F.col("upto"), F.col("acc_vol"))).alias("v"))
    return lead.select("ticker", "day", F.when(F.col("n") >= n_window / 2, F.try_divide("v", F.col("n") * interval) * calendar.length).alias("forecast"))


def _matrix(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """(days, columns x intervals), each column's intervals together."""
    return np.hstack([pdf.pivot(index="day", columns="i", values=c).to_numpy() for c in columns])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with intercept; the smallest coefficients where there are more features than days."""
    return np.linalg.lstsq(np.hstack([x, np.ones((len(x), 1))]), y, rcond=None)[0]


def fit_accumulated(resid: DataFrame) -> DataFrame:
    """(ticker, beta): residual day volume on the day's residual features."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.groupby("day")["acc_vol"].sum().sort_index().to_numpy()
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "beta": [_fit(_matrix(pdf, FEATURES), y).tolist()]})

    return resid.groupBy("ticker").applyInPandas(fit, "ticker string, beta array<double>")


def predict_accumulated(resid: DataFrame, models: DataFrame) -> DataFrame:
    """(ticker, day, forecast): features times beta plus the baseline's volume."""
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(c).alias("x")))), lambda s: s["x"])
    days = resid.groupBy("ticker", "day").agg(F.concat(*map(by, FEATURES), F.array(F.lit(1.0))).alias("x"), F.sum("b_acc_vol").alias("base"))
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return days.join(models, _shared(models)).select("ticker", "day", (dot + F.col("base")).alias("forecast"))


def _shared(models: DataFrame) -> list[str]:
    """A model is its ticker's, or its ticker's on one day."""
    return [c for c in ("ticker", "day") if c in models.columns]


def fit_intervals(resid: DataFrame) -> DataFrame:
    """(ticker, k, beta): residual volume of interval k on the features of the intervals before it."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        vol = pdf.pivot(index="day", columns="i", values="acc_vol")
        parts = {c: pdf.pivot(index="day", columns="i", values=c).to_numpy() for c in FEATURES}
        rows = [(k, _fit(np.hstack([parts[c][:, :k] for c in FEATURES]), vol.to_numpy()[:, k]).tolist()) for k in range(1, vol.shape[1])]
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "k": [k for k, _ in rows], "beta": [b for _, b in rows]})

    return resid.groupBy("ticker").applyInPandas(fit, "ticker string, k long, beta array<double>")


def predict_intervals(resid: DataFrame, models: DataFrame, at: int) -> DataFrame:
    """(ticker, day, forecast) at the start of interval ``at``: volume seen before, model and baseline after.

    Features of intervals from ``at`` on are the baseline's, so their residuals are zero. Interval 0 without
    anything seen is the baseline.
    """
    seen = F.col("i") < at
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(seen, F.col(c)).otherwise(0.0).alias("x")))), lambda s: s["x"])
    days = resid.groupBy("ticker", "day").agg(*(by(c).alias(f"x_{c}") for c in FEATURES), F.sum("b_acc_vol").alias("base"), F.sum(F.when(seen, F.col("acc_vol")).otherwise(0.0)).alias("seen"))
    x = F.concat(*(F.slice(f"x_{c}", F.lit(1), F.col("k").cast("int")) for c in FEATURES), F.array(F.lit(1.0)))
    dot = F.aggregate(F.zip_with(x, "beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    later = days.join(models.where(F.col("k") >= max(at, 1)), _shared(models)).groupBy("ticker", "day").agg(F.sum(dot).alias("model"), F.max("base").alias("base"), F.max("seen").alias("seen"))
    return later.select("ticker", "day", (F.col("seen") + F.col("model") + F.col("base")).alias("forecast"))


#: Days of a block, which one triangular factor stands for.
FIT_DAYS = 32
MODELS = "ticker string, day long, k long, beta array<double>"


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangle that least squares need of ``rows``: it has their products of columns. Factors one upon another give the factor of both."""
    return np.linalg.qr(rows, mode="r")


def _day_rows(resid: DataFrame) -> DataFrame:
    """(ticker, day, block, row): a day's features, 1, and residual volumes by interval, as one array."""
    by = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", F.col(c).alias("x")))), lambda s: s["x"])
    days = resid.groupBy("ticker", "day").agg(F.concat(*map(by, FEATURES), F.array(F.lit(1.0)), by("acc_vol")).alias("row"))
    return days.select("ticker", "day", F.floor(F.col("day") / FIT_DAYS).alias("block"), "row")


def fit_daily(resid: DataFrame, at: int | None = None, min_days: int = 1) -> DataFrame:
    """(ticker, day, k, beta): for each day the models that the days before it give, from ``min_days`` of them on.

    k = 0 is the accumulated model; with ``at`` there are instead the models of intervals k >= ``at``. A block of days is
    a factor, a ticker's few factors are merged in turn, and a block starts from what came before it, so no day is
    fitted twice and a ticker's blocks are fitted beside each other.
    """
    rows = written(_day_rows(resid), "profile_rows")
    kinds = "ticker string, block long, days long, width int, factor array<double>"

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _factor(np.vstack(pdf["row"].tolist()))
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[:1], "block": pdf["block"].iloc[:1], "days": [len(pdf)], "width": [r.shape[1]], "factor": [r.ravel()]})

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, days, out = pdf.sort_values("block"), None, 0, []
        for ticker, block, n, width, factor in zip(*(pdf[c] for c in ("ticker", "block", "days", "width", "factor")), strict=True):
            out.append((ticker, block, days, width, [] if held is None else held.ravel()))
            own_ = factor.reshape(-1, width)
            held, days = own_ if held is None else _factor(np.vstack([held, own_])), days + n
        return pd.DataFrame(out, columns=pdf.columns)

    def fit(days: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(days) and len(start):
            days, width, n = days.sort_values("day"), int(start["width"].iloc[0]), int(start["days"].iloc[0])
            held, i = np.asarray(start["factor"].iloc[0]).reshape(-1, width), (width - 1) // (len(FEATURES) + 1)
            y = width - i
            for day, row in zip(days["day"], days["row"], strict=True):
                if n >= max(min_days, 1):
                    if at is None:
                        wanted = [(0, np.arange(y), held[:, y:].sum(axis=1))]
                    else:
                        wanted = [(k, np.concatenate([*(f * i + np.arange(k) for f in range(len(FEATURES))), [y - 1]]), held[:, y + k]) for k in range(max(at, 1), i)]
                    out += [(days["ticker"].iloc[0], day, k, np.linalg.lstsq(held[:, cols], target, rcond=None)[0]) for k, cols, target in wanted]
                held, n = np.vstack([held, row]), n + 1
        return pd.DataFrame(out, columns=["ticker", "day", "k", "beta"])

    blocks = rows.groupBy("ticker", "block").applyInPandas(own, kinds)
    starts = blocks.groupBy("ticker").applyInPandas(before, kinds)
    return rows.groupBy("ticker", "block").cogroup(starts.groupBy("ticker", "block")).applyInPandas(fit, MODELS)


def store_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Models as they were stored, for any later run."""
    return spark.read.schema(MODELS).parquet(path)


def forecast_by(resid: DataFrame, models: DataFrame, at: int | None = None) -> DataFrame:
    """(ticker, day, forecast) for every day; NULL where ``models`` (of ``fit_daily``, loaded or not) have none."""
    found = predict_accumulated(resid, models) if at is None else predict_intervals(resid, models, at)
    return resid.select("ticker", "day").distinct().join(found, ["ticker", "day"], "left")


def walk_forward(resid: DataFrame, at: int | None = None, min_days: int = 1) -> DataFrame:
    """(ticker, day, forecast): each day's volume by a model of the days before it alone; NULL with under ``min_days`` of them.

    Without ``at``, the accumulated model on the whole day's features; with it, the interval models at the start of
    interval ``at``. Models are stored, and the forecasts are made from the stored ones.
    """
    path = scratch(resid.sparkSession, "profile_models")
    store_models(fit_daily(resid, at, min_days), path)
    return forecast_by(resid, load_models(resid.sparkSession, path), at)


#: Forecasts of a day's volume by the profile's name.
PROFILES = {
    "simple_online": lambda grid, calendar, interval, window: simple_forecast(grid, calendar, interval, window),
    "accumulative_volume": lambda grid, calendar, interval, window: walk_forward(residuals(grid, out_of_sample(ema_baseline(grid)))),
    "interval_volume": lambda grid, calendar, interval, window: walk_forward(residuals(grid, out_of_sample(ema_baseline(grid))), window),
}


def profile_forecast(kind: str, grid: DataFrame, calendar: SessionCalendar, interval: float, window: int) -> DataFrame:
    """(ticker, day, forecast) by the profile called ``kind``; ``window``: the intervals that are seen of the day."""
    if kind not in PROFILES:
        raise ValueError(f"no profile {kind!r}; there are {', '.join(PROFILES)}")
    return PROFILES[kind](grid, calendar, interval, window)


@dataclass
class ProfileClock:
    """State of one ticker's day: a bucket's volume is the forecast day volume's share, forecast anew after each roll.

    Without ``given``, the forecast comes from the leading intervals without a gap, once there are half of
    ``window``, and stays when interval ``window`` is reached. With neither, buckets are session time.
    """

    interval: float
    length: float
    window: int
    given: float | None = None
    seen: dict[int, float] = field(default_factory=dict)
    elapsed: float = 0.0
    fixed: float | None = None
    bucket: float | None = None
    last: float = 0.0
    bar: int = 0

    def forecast(self) -> float | None:
        """Of the day's volume, as it stands."""
        if self.given is not None:
            return self.given
        if self.fixed is not None:
            return self.fixed
        n = next(i for i in range(len(self.seen) + 1) if i not in self.seen)
        if n < self.window / 2 or self.elapsed <= 0:
            return None
        return sum(self.seen[i] for i in range(n)) / self.elapsed * self.length

    @property
    def ready(self) -> bool:
        return self.forecast() is not None

    def step(self, elapsed: float, volume: float, acc: float) -> int:
        """Number of the row's bar; ``acc``: the day's volume with the row's own."""
        i = int(elapsed // self.interval)
        if self.fixed is None and i >= self.window:
            self.fixed = self.forecast()
        self.seen[i] = self.seen.get(i, 0.0) + volume
        self.elapsed = elapsed
        if self.bucket is None:
            day = self.forecast()
            self.bucket = day / (self.length / self.interval) if day else None
        idx = elapsed // self.interval if self.bucket is None else acc // self.bucket
        if idx > self.last:
            self.bar, self.bucket = self.bar + 1, None
        self.last = idx
        return self.bar


def profile_bars_online(tape: DataFrame, calendar: SessionCalendar, interval: float, topics: tuple, *, window: int = 15, forecast: DataFrame | None = None) -> DataFrame:
    """(ticker, day, idx, ready, topics): bars of the profile clock as it stood at each row; ready as at the bar's last row.

    ``forecast`` (ticker, day, forecast) is a model's, made before the day; without one the day forecasts itself. Rows
    are walked in order with a small state, so no ticker's day is held whole.
    """
    keys = ("ticker", "day")
    rows = tape.where(calendar.in_session(F.col("ts"))).withColumn("day", F.floor((F.col("ts") + calendar.utc_offset) / 86400.0))
    light = rows.select(*keys, "ts", "seq", calendar.elapsed(F.col("ts")).alias("e"), F.coalesce("volume", F.lit(0.0)).alias("v"))
    light = light.join(forecast.select(*keys, "forecast"), list(keys), "left") if forecast is not None else light.withColumn("forecast", F.lit(None).cast("double"))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, clock, acc = None, None, 0.0
        for pdf in parts:
            out = []
            for key, e, v, given in zip(key_values(pdf, keys), pdf["e"], pdf["v"], pdf["forecast"], strict=True):
                if clock is None or key != held:
                    held, clock, acc = key, ProfileClock(interval, calendar.length, window, None if pd.isna(given) else float(given)), 0.0
                acc += v
                out.append((clock.step(e, v, acc), clock.ready))
            yield pdf[[*keys, "ts", "seq"]].assign(bar=[b for b, _ in out], ready=[r for _, r in out])

    numbered = in_key_order(light, keys).mapInPandas(walk, "ticker string, day long, ts double, seq long, bar long, ready boolean")
    return bars(rows.join(numbered, [*keys, "ts", "seq"]), (*topics, Topic("ready", "ready", "update")), F.col("bar"), keys)


def naive_forecast(tape: DataFrame) -> DataFrame:
    """(ticker, day, forecast): the volume of the day before; NULL on the first."""
    days = tape.groupBy("ticker", F.floor(F.col("ts") / 86400.0).alias("day")).agg(F.sum("volume").alias("v"))
    return days.select("ticker", "day", F.lag("v").over(Window.partitionBy("ticker").orderBy("day")).alias("forecast"))


def profile_bars(tape: DataFrame, calendar: SessionCalendar, interval: float, forecast: DataFrame, topics: tuple) -> DataFrame:
    """(ticker, day, idx, topics): bars of an even share of the forecast day volume; by session time without one."""
    rows = tape.withColumn("day", F.floor(F.col("ts") / 86400.0))
    rows = running_sum(rows, F.coalesce("volume", F.lit(0.0)), "vol_acc", keys=("ticker", "day")).join(forecast, ["ticker", "day"], "left")
    step = F.col("forecast") / (calendar.length / interval)
    idx = F.when(step.isNull() | (step == 0), F.floor(calendar.elapsed(F.col("ts")) / interval)).otherwise(F.floor(F.try_divide("vol_acc", step)))
    return bars(rows, topics, idx.cast("long"), ("ticker", "day"))
