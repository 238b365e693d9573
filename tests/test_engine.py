import random

import numpy as np
import pytest
from models import adaptive_bars, ema, extremes, profile_bars, wave_target
from pyspark.sql import functions as F

from tidemark.functions.calendar import CN
from tidemark.functions.filters import DEFAULT, FilterMode, checked, dispatch, mask, unique_trades
from tidemark.operators import bars as display
from tidemark.operators import composite, decoder, entropy, recurrence, running, sampling, targets, volume_clock, volume_profile
from tidemark.operators.sampling import Topic
from tidemark.sources import pool, topics
from tidemark.sources.config import Config

TAPE = "ticker string, ts double, seq long, dtype string, price double, volume double, notional double, side int"


def tape(spark, rows):
    """(ts, price[, volume[, side]]) rows of ticker a, or with a ticker first."""
    out = []
    for i, r in enumerate(rows):
        t, r = (r[0], r[1:]) if isinstance(r[0], str) else ("a", r)
        v = float(r[2]) if len(r) > 2 else 1.0
        out.append((t, float(r[0]), i, "TradeData", float(r[1]), v, float(r[1]) * v, r[3] if len(r) > 3 else 1))
    return spark.createDataFrame(out, TAPE)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def close(a, b):
    return a is None and b is None or a == pytest.approx(b, abs=1e-9)


def test_fixed_bars_golden(spark):
    b = sampling.fixed_bars(tape(spark, [(61, 10), (90, 12), (125, 11), (250, 13)]), 60, sampling.OHLC)
    assert rows(b, "idx") == [("a", 1, 10.0, 12.0, 10.0, 12.0), ("a", 2, 11.0, 11.0, 11.0, 11.0), ("a", 4, 13.0, 13.0, 13.0, 13.0)]
    assert sampling.active_and_latest(b, "close").first().asDict() == {"ticker": "a", "active": 13.0, "last_closed": 11.0, "n_closed": 2}


def test_volume_bars_golden(spark):
    b = volume_clock.volume_bars(tape(spark, [(1, 1, 30), (2, 2, 30), (3, 3, 50)]), 100.0, (Topic("v", "volume", "accumulate"),))
    assert rows(b, "idx") == [("a", 0, 60.0), ("a", 1, 50.0)]


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError, match="unknown sampler mode"):
        Topic("x", "price", "sum")


def test_empty_buckets(spark):
    topics_ = (Topic("c", "price", "update"), Topic("v", "volume", "accumulate"), Topic("var", "price", "variance"), Topic("s", "price", "store"))
    out = sampling.fill_gaps(sampling.fixed_bars(tape(spark, [(1, 5), (31, 7)]), 10, topics_), topics_)
    assert rows(out, "idx") == [("a", 0, 5.0, 1.0, 0.0, [5.0]), ("a", 1, 5.0, 0.0, None, []), ("a", 2, 5.0, 0.0, None, []), ("a", 3, 7.0, 1.0, 0.0, [7.0])]


def test_macd_golden(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([10.0, 11.0, 12.0, 11.0])], "ticker string, idx long, close double")
    got = rows(recurrence.macd(df), "idx")
    assert [r[2] for r in got] == pytest.approx([0, 0.0797720798, 0.2211345687, 0.2495965237])
    assert [r[3] for r in got] == pytest.approx([0, 0.015954416, 0.0569904465, 0.0955116619])
    assert got[-1][5] == pytest.approx(0.0140077147)


def test_ema_with_nulls_and_seed(spark):
    xs = [1.0, None, 3.0, 2.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "ticker string, idx long, x double")
    assert [r[2] for r in rows(recurrence.ema_series(df, "x", 0.5), "idx")] == pytest.approx(ema([1, 3, 2], 0.5))
    assert rows(recurrence.ema_series(df, "x", 0.5, emit_seed=False), "idx")[0][2] is None
    assert rows(recurrence.ema_series(df, "x", 0.5, seed=0.0), "idx")[0][2] == 0.5
    assert [round(v**60, 4) for v in recurrence.RETENTION.values()] == [0.4996, 0.1996, 0.1003, 0.01, 0.001]


def test_indices_golden(spark):
    w = spark.createDataFrame([("i", "a", 0.5), ("i", "b", 0.3), ("i", "c", 0.2)], "index_name string, ticker string, weight double")
    t = tape(spark, [("a", 1, 10), ("b", 1, 10), ("a", 2, 11), ("b", 2, 9)])
    assert composite.synthetic_index(t, w).first()["level"] == pytest.approx(1.02)
    assert composite.synthetic_index(t, w, missing="renormalize").first()["level"] == pytest.approx(1.025)
    values = spark.createDataFrame([("a", 2.0), ("b", None)], "ticker string, v double")
    assert composite.composite(w, values, "v").first()["composite"] == pytest.approx(1.0)
    assert composite.composite(w, values, "v", replace_na=10.0).first()["composite"] == pytest.approx(6.0)
    assert composite.composite(w, values, "v", replace_na=None).first()["composite"] is None
    with pytest.raises(ValueError):
        composite.weights_from_json(spark, '{"index_name": "i", "weights": {"a": 0}}')


def test_entropy_golden():
    assert entropy.spectral(np.array([[1.25, 0.75], [0.75, 1.25]])) == pytest.approx((-1.5, 0.5))


def test_rolling_entropy_against_numpy(spark):
    rnd = random.Random(2)
    data = {(t, i): rnd.random() for t in "abc" for i in range(30) if rnd.random() < 0.9 or i == 0}
    df = spark.createDataFrame([(t, i, x) for (t, i), x in data.items()], "ticker string, idx long, x double")
    for got in entropy.rolling_entropy(df, ["a", "b", "c"], "x", 6, "p").collect():
        series = []
        for t in "abc":
            held, filled = None, []
            for i in range(30):
                held = data.get((t, i), held)
                if any((u, i) in data for u in "abc") and i <= got["idx"]:
                    filled.append(held)
            series.append(filled[-6:])
        k = min(map(len, series))
        want = entropy.spectral(np.cov(np.array(series), ddof=0)) if k >= 3 else (None, None)
        assert close(got["p_entropy"], want[0]) and close(got["p_secondary_entropy"], want[1]) and got["ready"] == (k == 6)


def test_running_sum_and_asof_over_blocks(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), round(rnd.uniform(0, 400), 1), rnd.randint(1, 9)) for _ in range(300)]
    t = tape(spark, data)
    got = {r["seq"]: r["acc"] for r in running.running_sum(t, F.col("price"), "acc", block=25.0).collect()}
    order = sorted(range(300), key=lambda i: (data[i][1], i))
    for i in range(300):
        assert got[i] == sum(data[k][2] for k in order[: order.index(i) + 1] if data[k][0] == data[i][0])
    right = t.where("seq < 40").select("ticker", "ts", "price")
    pts = [d for d in data[:40]]
    for forward in (True, False):
        for strict in (True, False):
            out = running.asof(t.select("ticker", "ts", "seq"), right, F.col("ts") + 7, forward=forward, strict=strict, block=25.0)
            for r in out.collect():
                at = r["ts"] + 7
                ok = [p[1] for p in pts if p[0] == r["ticker"] and (p[1] > at if forward else p[1] < at) or (not strict and p[0] == r["ticker"] and p[1] == at)]
                assert r["matched_ts"] == ((min if forward else max)(ok) if ok else None)


def test_turning_points_against_model(spark):
    rnd = random.Random(4)
    for _ in range(2):
        pts = [(float(i), float(rnd.randint(90, 110))) for i in range(400)]
        t = tape(spark, pts)
        got = sorted((r["level"], r["ts"], r["price"], r["flag"]) for r in decoder.turning_points(t, 3).collect())
        want = sorted(extremes(pts, 3))
        assert got == want
        level0 = sorted((r["ts"], r["price"], r["flag"]) for r in decoder.first_level(t).collect())
        assert len(level0) == len([w for w in want if w[0] == 0])


def test_wave_target_against_model(spark):
    rnd, p, pts = random.Random(6), 100.0, []
    for i in range(500):
        p *= 1 + rnd.uniform(-0.004, 0.004)
        pts.append((float(i * 10), p))
    marks = [(ts, price, flag) for n, ts, price, flag in extremes(pts, 2) if n == 2]
    assert len(marks) >= 4
    want = wave_target(pts, sorted(marks), 0.008, 300.0)
    got = targets.wave_target(tape(spark, pts), level=2, look_back=300.0).collect()
    assert len(got) == 500
    for r in got:
        w = want[r["ts"]]
        for a, b in (("state", "state"), ("local_max", "hi"), ("local_min", "lo"), ("up_actual", "up"), ("down_actual", "down"), ("target_actual", "target"), ("up_smoothed", "s_up"), ("down_smoothed", "s_down"), ("target_smoothed", "s_target")):
            assert close(r[a], w[b]), (r["ts"], a, r[a], w[b])


def test_no_key_is_held_whole(spark):
    rnd, rows = random.Random(8), []
    for i in range(900):
        rows.append((rnd.choice("aaab"), float(i * 700 + rnd.randint(0, 2) * 100_000), float(rnd.randint(95, 105))))
    t = tape(spark, rows).repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        options = {"confirmation": 0.02, "timeout": 20_000.0, "up": 0.05, "down": 0.05}
        signals = t.withColumns({"value": F.col("price") - 100, "upper": F.col("price") - 97, "lower": F.col("price") - 103})
        found = {"points": decoder.turning_points(t, 3), "waves": decoder.decode_waves(t, **options), "actions": display.signal_actions(signals).select("ticker", "seq", "action")}
        for df in found.values():
            assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
        got = {k: sorted(map(tuple, df.collect())) for k, df in found.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    points, waves, actions = [], [], []
    for key in "ab":
        path = sorted((ts, i, p) for i, (k, ts, p) in enumerate(rows) if k == key)
        points += [(key, *x) for x in extremes([(ts, p) for ts, _, p in path], 3)]
        d, position = decoder.OnlineDecoder(**options), 0
        for ts, i, p in path:
            if w := d.step(p, ts):
                waves.append((key, *w.row()))
            if position == 0:
                action = 1 if p > 103 else -1 if p < 97 else 0
            else:
                action = 1 if position < 0 and p > 100 else -1 if position > 0 and p < 100 else 0
            position += action
            actions.append((key, i, action))
    assert max(x[1] for x in points) == 3
    assert got == {"points": sorted(points), "waves": sorted(waves), "actions": sorted(actions)}


def test_retrospective_wave_ends_at_its_extreme():
    d = decoder.OnlineDecoder(retrospective=True, up=0.5, down=0.5)
    closed = [w for w in (d.step(p, float(i)) for i, p in enumerate([100, 99, 103, 101, 100])) if w]
    assert [(w.flag, w.end_price, w.end_ts) for w in closed] == [("down", 100, 0.0)] * 3


def test_transitions(spark):
    df = spark.createDataFrame([("a", 1.0, "up"), ("a", 2.0, "down_overshoot"), ("a", 3.0, "down")], "ticker string, start_ts double, flag string")
    assert [r["valid"] for r in decoder.valid_transitions(df).orderBy("start_ts").collect()] == [True, False, True]


def test_filters(spark):
    day = 1704067200
    data = [("TradeData", 10 * 3600, 1), ("TradeData", 10 * 3600, 0), ("TradeData", 12 * 3600, 1), ("OrderData", 10 * 3600, 1), ("TickData", 13 * 3600, 0)]
    df = spark.createDataFrame([("a", float(day + s), i, d, 1.0, 1.0, 1.0, side) for i, (d, s, side) in enumerate(data)], TAPE)
    kept = lambda m: [r["seq"] for r in df.where(mask(FilterMode(m), CN)).orderBy("seq").collect()]
    assert (kept(0), kept(1), kept(2), kept(4), kept(8), kept(16)) == ([0, 1, 2, 3, 4], [0, 2, 3, 4], [0, 1, 3, 4], [0, 1, 2, 4], [3, 4], [0, 1, 2, 3])
    assert kept(int(DEFAULT)) == [0, 4]
    assert dispatch(df)["trade"].count() == 3
    with pytest.raises(Exception, match="unknown dtype"):
        checked(df.withColumn("dtype", F.lit("Other"))).count()


def test_boundary_snapshot_belongs_to_the_interval_before(spark):
    df = spark.createDataFrame([(34200.0 + 60, "TickData"), (34200.0 + 60, "TradeData"), (46800.0 + 60, "TradeData")], "ts double, dtype string")
    assert [r[0] for r in df.select(CN.interval_index(F.col("ts"), 60, F.col("dtype"))).collect()] == [0, 1, 121]


def test_duplicate_trades(spark):
    df = tape(spark, [(1, 5), (2, 6), (3, 7)]).withColumns({"buy_id": F.lit("b"), "sell_id": (F.col("seq") % 2).cast("string")})
    assert sorted(r["price"] for r in unique_trades(df).collect()) == [5.0, 6.0]


def test_adaptive_clock_never_revises(spark):
    rnd = random.Random(8)
    data = [(i * 7.0, 100, rnd.randint(1, 9)) for i in range(400)]
    t = tape(spark, data)
    whole = volume_clock.adaptive_bars_online(t, 60.0, 10, (Topic("n", "volume", "accumulate"),), sample_size=4)
    part = volume_clock.adaptive_bars_online(t.where("seq < 200"), 60.0, 10, (Topic("n", "volume", "accumulate"),), sample_size=4)
    a, b = rows(whole, "idx"), rows(part, "idx")
    assert a[: len(b) - 1] == b[:-1] and sum(r[-1] for r in a) == sum(d[2] for d in data)


def test_adaptive_clock_against_model():
    rnd = random.Random(9)
    for _ in range(20):
        ts, events = 0.0, []
        for _ in range(250):
            ts += rnd.choice([0.5, 3.0, 20.0, 200.0])
            events.append((ts, float(rnd.randint(1, 9))))
        clock, acc, got = volume_clock.AdaptiveClock(60.0, 4, 10), 0.0, []
        for t, v in events:
            acc += v
            got.append(clock.step(t, acc, v))
        assert got == adaptive_bars(events, 60.0, 4, 10)


def test_forecasts_against_numpy(spark):
    rnd = np.random.default_rng(3)
    days, n = 9, 4
    obs = [("a", d, i, *map(float, rnd.uniform(1, 9, 4)), True) for d in range(days) for i in range(n)]
    grid = spark.createDataFrame(obs, "ticker string, day long, i long, acc_vol double, acc_amt double, px_range double, px_diff double, is_init boolean")
    r = volume_profile.residuals(grid, volume_profile.out_of_sample(volume_profile.sma_baseline(grid)))
    pdf = r.toPandas().sort_values(["day", "i"])
    x = np.hstack([pdf[c].to_numpy().reshape(-1, n) for c in volume_profile.FEATURES] + [np.ones((days - 1, 1))])
    beta = np.linalg.lstsq(x, pdf["acc_vol"].to_numpy().reshape(-1, n).sum(1), rcond=None)[0]
    want = x @ beta + pdf["b_acc_vol"].to_numpy().reshape(-1, n).sum(1)
    got = volume_profile.predict_accumulated(r, volume_profile.fit_accumulated(r)).orderBy("day").toPandas()["forecast"]
    assert np.allclose(got, want)
    models = volume_profile.fit_intervals(r)
    whole = volume_profile.predict_intervals(r, models, n - 1).orderBy("day").toPandas()["forecast"]
    k = n - 1
    feats = np.hstack([pdf[c].to_numpy().reshape(-1, n)[:, :k] for c in volume_profile.FEATURES] + [np.ones((days - 1, 1))])
    vol, base = pdf["acc_vol"].to_numpy().reshape(-1, n), pdf["b_acc_vol"].to_numpy().reshape(-1, n)
    beta = np.linalg.lstsq(feats, vol[:, k], rcond=None)[0]
    assert np.allclose(whole, (vol + base)[:, :k].sum(1) + feats @ beta + base[:, k])


def test_forecasts_see_no_later_day(spark):
    rnd = np.random.default_rng(4)
    days, n = 7, 4
    obs = [("a", d, i, *map(float, rnd.uniform(1, 9, 4)), True) for d in range(days) for i in range(n)]
    grid = spark.createDataFrame(obs, "ticker string, day long, i long, acc_vol double, acc_amt double, px_range double, px_diff double, is_init boolean")
    r = volume_profile.residuals(grid, volume_profile.out_of_sample(volume_profile.sma_baseline(grid)))
    pdf = r.toPandas().sort_values(["day", "i"])
    table = lambda c: pdf[c].to_numpy().reshape(-1, n)
    vol, base = table("acc_vol"), table("b_acc_vol").sum(1)
    fit = lambda x, y: np.linalg.lstsq(np.hstack([x, np.ones((len(x), 1))]), y, rcond=None)[0]
    whole = {x["day"]: x["forecast"] for x in volume_profile.walk_forward(r).collect()}
    part = {x["day"]: x["forecast"] for x in volume_profile.walk_forward(r, 2).collect()}
    assert whole[1] is None and part[1] is None and len(whole) == days - 1
    for d in range(1, days - 1):
        x = np.hstack([table(c) for c in volume_profile.FEATURES])
        assert whole[d + 1] == pytest.approx(np.append(x[d], 1) @ fit(x[:d], vol[:d].sum(1)) + base[d])
        want = vol[d, :2].sum() + base[d]
        for k in (2, 3):
            x = np.hstack([table(c)[:, :k] for c in volume_profile.FEATURES])
            now = np.hstack([np.concatenate([table(c)[d, :2], np.zeros(k - 2)]) for c in volume_profile.FEATURES])
            want += np.append(now, 1) @ fit(x[:d], vol[:d, k])
        assert part[d + 1] == pytest.approx(want)


def test_profile_clock_against_model(spark):
    rnd = random.Random(10)
    for _ in range(20):
        e, events = 0.0, []
        for _ in range(200):
            e += rnd.choice([0.5, 3.0, 20.0, 90.0])
            events.append((e, float(rnd.randint(1, 9))))
        clock, acc, got = volume_profile.ProfileClock(60.0, 14400.0, 6), 0.0, []
        for t, v in events:
            acc += v
            got.append(clock.step(t, v, acc))
        assert got == profile_bars(events, 60.0, 14400.0, 6)
    day = 34200.0
    data = [(k, day + t, 10.0, v) for k in "ab" for t, v in events if t < 7000]
    bars = volume_profile.profile_bars_online(tape(spark, data).repartition(3), CN, 60.0, (Topic("n", "volume", "accumulate"),), window=6)
    want = {}
    for k in "ab":
        own = [x for x in events if x[0] < 7000]
        for b, (_, v) in zip(profile_bars(own, 60.0, CN.length, 6), own):
            want[k, 0, b] = want.get((k, 0, b), 0.0) + v
    assert {(r["ticker"], r["day"], r["idx"]): r["n"] for r in bars.collect()} == want


def test_blocks_of_any_width_give_one_series(spark, monkeypatch):
    rnd = random.Random(12)
    xs = [rnd.uniform(1, 9) for _ in range(90)]
    df = spark.createDataFrame([("a", 7 * i, x) for i, x in enumerate(xs)], "ticker string, idx long, close double")
    found = []
    for width in (1, 50, 1024):
        monkeypatch.setattr(recurrence, "BLOCK", width)
        found.append([r[2:] for r in rows(recurrence.macd(df), "idx")])
        assert [r[2] for r in rows(recurrence.ema_series(df, "close", 0.3), "idx")] == pytest.approx(ema(xs, 0.3))
        assert recurrence.ema_last(df, "close", 0.3).first()["ema"] == pytest.approx(ema(xs, 0.3)[-1])
    for other in found[1:]:
        assert np.allclose(other, found[0])


def test_entropy_topics_against_numpy(spark):
    from tidemark.plans import factors  # noqa: F401
    from tidemark.plans.registry import FactorSet, FactorSpec

    rnd = random.Random(13)
    data = [(t, i * 10 + k, rnd.randint(5, 9), rnd.randint(1, 9), rnd.choice([-1, 1])) for i in range(12) for k, t in enumerate("ab")]
    spec = FactorSpec("Monitor.E", "entropy", {"interval": 10, "sample_size": 5, "members": ["a", "b"], "weights": {"a": 2.0}})
    got = {(r["ts"], r["factor"]): r["value"] for r in FactorSet({spec.name: spec}).collect(tape(spark, data)).collect()}
    own = lambda f: {t: [f(p * (2.0 if t == "a" else 1.0), v, s) for u, _, p, v, s in data if u == t] for t in "ab"}
    wanted = {"price": own(lambda p, v, s: p), "notional": own(lambda p, v, s: p * v), "notional_buy_pct": own(lambda p, v, s: float(s > 0)), "notional_sell_pct": own(lambda p, v, s: float(s < 0))}
    for name, series in wanted.items():
        for i in range(4, 12):
            last = np.array([series[t][i - 4 : i + 1] for t in "ab"])
            assert close(got[float(i * 10 + 1), f"E.{name}_entropy"], entropy.spectral(np.cov(last, ddof=0))[0]), (name, i)


def test_snapshots_go_on(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(20)] + [("b", i, 1.0 + i) for i in range(12, 20)], "ticker string, idx long, x double")
    states = recurrence.snapshot(df.where("idx < 10"), "x", 0.3)
    got = {(r["ticker"], r["idx"]): r["ema"] for r in recurrence.resume(df, "x", states, 0.3).collect()}
    want = {(t, i): v for t, first in (("a", 0), ("b", 12)) for i, v in zip(range(first, 20), ema([float(i % 5) if t == "a" else 1.0 + i for i in range(first, 20)], 0.3)) if i >= 10}
    assert set(got) == set(want) and all(close(got[k], want[k]) for k in want)


def test_ledger_and_signals(spark):
    t = tape(spark, [(1, 10), (2, 12), (3, 11), (4, 9)]).withColumn("action", F.element_at(F.array(*map(F.lit, [1, 0, -1, -1])), (F.col("seq") + 1).cast("int")))
    got = [(r["position"], r["cash"], r["pnl"], r["nav"]) for r in display.ledger(t).orderBy("seq").collect()]
    assert got == [(1, -10.0, 0.0, 0.0), (1, -10.0, 0.0, 2.0), (0, 0.0, 1.0, 0.0), (-1, 9.0, 1.0, 0.0)]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(0.0, "x", 1.0), (10.0, "y", 2.0)], pool.FACTORS)
    new = spark.createDataFrame([(12.0, "y", 3.0), (3.0, "z", 4.0), (14.0, "y", 5.0)], pool.FACTORS).coalesce(1)
    assert rows(pool.upsert(old, new, interval=10.0), "ts", "factor") == [(0.0, "x", 1.0), (0.0, "z", 4.0), (10.0, "y", 5.0)]
    pool.write(old, str(tmp_path / "p"))
    pool.write(spark.createDataFrame([(86400.0, "x", 9.0)], pool.FACTORS), str(tmp_path / "p"))
    assert pool.read(spark, str(tmp_path / "p")).count() == 3
    assert pool.import_csv(spark, str(tmp_path / "none"), ["x"]).count() == 0


def test_topics(spark):
    df = spark.createDataFrame([("realtime.600.SH.TickData",), ("launch_order.600.SH",), ("eod",)], "t string")
    assert [tuple(r[0]) for r in df.select(topics.parse(F.col("t"))).collect()] == [("realtime", "600.SH", "TickData"), ("launch_order", "600.SH", None), ("eod", None, None)]


def test_config(tmp_path):
    f = tmp_path / "c.ini"
    f.write_text("[A.B]\nx = 1\ny.z = 2024-01-02\nlist = [1, 2]\nw = text\nempty\n")
    c = Config.from_ini(f)
    assert (c.A.B.x, c.get("A.B", "y.z").year, c.A.B.list, c.A.B.w, c.get("A.B.empty"), c.get("no", default=3)) == (1, 2024, [1, 2], "text", None, 3)
    with pytest.raises(KeyError):
        c.set(1, "A")


def test_factors_on_every_clock(spark):
    from tidemark.plans import factors  # noqa: F401
    from tidemark.plans.registry import FactorSet, FactorSpec, param_grid
    from tidemark.sources.tape import trades

    t = trades(spark, "/root/testdata/sf0.001", "event_type")
    chosen = FactorSet()
    for clock, step in (("time", 21600), ("volume", 500.0), ("adaptive", 21600), ("profile", 1800)):
        for plan, params in (("trend", {"alpha": 0.1}), ("macd", {}), ("mean_price", {"sample_size": 3}), ("flow", {}), ("entropy", {"sample_size": 4, "members": ["click", "view"]})):
            chosen.add(FactorSpec(f"Monitor.{plan}.{clock}", plan, {"clock": clock, "interval": step, **params}))
    chosen.add(FactorSpec("Monitor.index", "trend", {"interval": 21600, "alpha": 0.1, "weights": {"click": 1, "view": 3}}))
    got = {r["f"]: r["n"] for r in chosen.collect(t).withColumn("f", F.regexp_extract("factor", r"^(index|\w+\.\w+)", 1)).groupBy("f").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {n.removeprefix("Monitor.") for n in chosen.specs} and min(got.values()) > 0
    assert list(param_grid({"a": [1, 2], "b": [3, 4]}, {"b": 9}, "T"))[1] == {"a": 2, "b": 9, "name": "Monitor.Grid.T.1"}
    with pytest.raises(ValueError):
        FactorSpec("X", "trend")


def test_profile_entropy_is_ready_once_the_session_is_long_enough(spark):
    """Few bars come, so only the elapsed session makes it ready: from 40 x 60 s on, the lunch break left out, and for the rest of the day."""
    from tidemark.plans import factors
    from tidemark.plans.registry import FactorSpec

    start = 19_000 * 86_400 + 34_200
    seconds = [60.0 * i for i in range(0, 44, 4)] + [12_700.0]  # the last in the afternoon
    rows = [(m, start + s + j, 10 * i + j, float((i * 7 + j) % 5 + 1), 1.0, 2.0, 1 if j else -1, "TradeData") for i, s in enumerate(seconds) for j, m in enumerate("ab")]
    rows += [(m, start + 86_400.0 + j, 1000 + j, 3.0, 1.0, 2.0, 1, "TradeData") for j, m in enumerate("ab")]
    t = spark.createDataFrame(rows, "ticker string, ts double, seq long, price double, volume double, notional double, side int, dtype string")
    spec = FactorSpec("Monitor.E", "entropy", {"clock": "profile", "interval": 60, "sample_size": 40, "members": ["a", "b"]})
    got = {r["ts"] - start: r["ready"] for r in factors.entropy_factor(t, spec).select("ts", "ready").distinct().collect()}
    assert got and all(ready == (2400 < s < 86_400) for s, ready in got.items()) and {True, False} == set(got.values())


def test_registry_round_trip(tmp_path):
    from tidemark.plans.registry import DecisionCore, FactorSet, FactorSpec

    s = FactorSet()
    s.add(FactorSpec("Monitor.A", "trend", {"alpha": 0.5}))
    s.dump(tmp_path / "f.json")
    assert FactorSet.load(tmp_path / "f.json").digest == s.digest
    DecisionCore().dump(tmp_path / "core.2024.json", {"a": 1})
    DecisionCore().dump(tmp_path / "core.2025.json", {"a": 2})
    assert DecisionCore.load(tmp_path, "core.*.json") == {"a": 2}


def test_aligned_clock_on_a_buckets_edge(spark):
    """Eight tenths of volume, added as doubles, lie just below the eighth bucket's edge."""
    rows_ = tape(spark, [(0, 10, 0.7), (4000, 10, 0.1)])
    weights = spark.createDataFrame([("a", 1.0)], "ticker string, weight double")
    intervals = spark.createDataFrame([("a", 0.1)], "ticker string, baseline double")
    assert rows(volume_clock.aligned_clock(rows_, weights, intervals, 3600), "step_idx") == [(0, 7), (1, 8)]


def test_walks_after_a_join_that_turns_out_to_be_a_broadcast(spark):
    """A join's shuffle is read by mapper then, but a day's rows stay one walk."""
    days = [("a", 86400.0 * d + 34200 + 30 * i, 10) for d in (19000, 19001) for i in range(200)]
    asked = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        spread = tape(spark, days).repartition(8)
        got = volume_profile.profile_bars_online(spread, CN, 1800, (Topic("volume", "volume", "accumulate"),), window=1 << 30, forecast=volume_profile.naive_forecast(spread))
        assert [r["volume"] for r in got.where("day = 19001").orderBy("idx").collect()] == [24.0, *[25.0] * 7, 1.0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_forward_search_takes_no_frame_to_the_last_row(spark):
    """Such a frame is made anew for each row, so a block's work grew with the square of its rows."""
    left = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 90_000.0), ("a", 300_000.0), ("b", 2.0)], "ticker string, ts double")
    right = spark.createDataFrame([("a", 5.0, 2.0), ("a", 5.0, 1.0), ("a", 200_000.0, 3.0)], "ticker string, ts double, price double")
    for strict, want in ((False, [1.0, 1.0, 3.0, None, None]), (True, [1.0, 3.0, 3.0, None, None])):
        got = running.asof(left, right, F.col("ts"), strict=strict)
        assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()
        assert [r["matched"] for r in got.orderBy("ticker", "ts").collect()] == want
