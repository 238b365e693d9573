"""Streams over several files end in the batch result."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.sources.tape import trades
from tidemark.streaming import processors, runs


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events of the smallest data in three files, in time order."""
    root = tmp_path_factory.mktemp("data")
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 600")
    for i in range(3):
        df.where(f"event_id DIV 200 = {i}").coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    return str(root)


def same(a, b):
    cols = sorted(a.columns)
    order = lambda df: sorted(map(str, (tuple(r) for r in df.select(cols).collect())))
    assert order(a) == order(b)


def test_volume_bars(spark, parts):
    batch = catalog.queries()["q_volume_bars"](spark, parts)
    same(runs.volume_bars(spark, parts, 500.0).drop("n"), batch.select("ticker", "idx", "open", "high", "low", "close", "volume"))


def test_fixed_bars(spark, parts):
    batch = catalog.queries()["q_candles"](spark, parts).select("ticker", F.col("bucket").alias("idx"), "open", "high", "low", "close", "volume")
    same(runs.fixed_bars(spark, parts, 3600), batch)


def test_waves(spark, parts):
    same(runs.waves(spark, parts), catalog.queries()["q_online_decoder"](spark, parts))


def test_ema_rows(spark, parts):
    assert runs.ema(spark, parts, 0.2).count() == 600


def test_a_stopped_stream_goes_on_from_its_state(spark, tmp_path):
    """The second run gets only the new file, and the memories of the first."""
    rows = [(t, float(i), i, float(i % 7)) for i in range(40) for t in "ab"]
    df = spark.createDataFrame(rows, "ticker string, ts double, seq long, price double")
    found = {}
    for part in ("ts < 20", "ts >= 20"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        out = runs.to_table(processors.ema(stream, "price", 0.3), "again", "append", f"{tmp_path}/run")
        found = {(r["ticker"], r["seq"]): r["ema"] for r in out.collect()}
    memory, want = {}, {}
    for t, _, seq, x in rows:
        memory[t] = x if t not in memory else 0.3 * x + 0.7 * memory[t]
        want[t, seq] = memory[t]
    assert found == pytest.approx(want)


def test_idle_keys_lose_their_state(spark, tmp_path):
    """The watermark passes key a's last row by over 100 s while b trades; then a starts anew."""
    files = [[("a", 0.0, 1.0), ("a", 10.0, 2.0)], [("b", 10_000.0, 1.0)], [("b", 10_001.0, 5.0)], [("a", 10_010.0, 9.0), ("b", 10_020.0, 9.0)]]
    for n, part in enumerate(files):
        rows = [(k, 5000.0 + ts, n * 10 + i, p) for i, (k, ts, p) in enumerate(part)]
        spark.createDataFrame(rows, "ticker string, ts double, seq long, price double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
        for f in (tmp_path / "in" / str(n)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("ticker string, ts double, seq long, price double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    marked = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", "0 seconds")
    out = runs.to_table(processors.ema(marked, "price", 0.5, idle=100.0), "idle", "append")
    assert {r["seq"]: r["ema"] for r in out.collect()} == {0: 1.0, 1: 1.5, 10: 1.0, 20: 3.0, 30: 9.0, 31: 6.0}


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events in part files by a hash, spread over 300 days; the files are written in no order of time."""
    root = str(tmp_path_factory.mktemp("shuffled"))
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 600").withColumn("user_id", F.col("user_id") % 5)
    late = df.withColumn("ts", (F.col("ts").cast("timestamp") + F.expr("make_interval(0, 0, 0, event_id DIV 2)")).cast(df.schema["ts"].dataType))
    late.repartition(4, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id", F.lit(1))).write.parquet(f"{root}/events.parquet")
    return root


@pytest.mark.parametrize("name", ["fixed_bars", "volume_bars", "ema", "decoder", "dedup"])
def test_files_in_any_order(spark, shuffled, name, monkeypatch):
    monkeypatch.setattr(runs, "ROWS", 100)
    got = catalog.queries()[f"q_stream_{name}"](spark, shuffled)
    if name == "dedup":
        return same(got, spark.read.parquet(f"{shuffled}/events.parquet").select("user_id", "event_type").distinct())
    if name == "ema":
        memory, want = {}, []
        for r in trades(spark, shuffled).orderBy("ts", "seq").collect():
            m = memory.get(r["ticker"])
            memory[r["ticker"]] = m = r["price"] if m is None else 0.2 * r["price"] + 0.8 * m
            want.append((r["ticker"], r["seq"], round(m, 6)))
        assert sorted((r["ticker"], r["seq"]) for r in got.collect()) == sorted(w[:2] for w in want)
        assert all(abs(r["ema"] - w[2]) < 2e-6 for r, w in zip(sorted(got.collect(), key=lambda r: r["seq"]), sorted(want, key=lambda w: w[1]), strict=True))
        return None
    batch = {"fixed_bars": "q_candles", "volume_bars": "q_volume_bars", "decoder": "q_online_decoder"}[name]
    want = catalog.queries()[batch](spark, shuffled)
    if name == "fixed_bars":
        want = want.withColumnRenamed("bucket", "idx")
    got = got.drop("n")
    same(got, want.select(*got.columns))
    return None


@pytest.mark.parametrize(("name", "few"), [("volume_bars", 20_000), ("ema", 20_000), ("decoder", 20_000), ("volume_bars", 7), ("sessions", 3), ("state", 3)])
def test_a_session_of_other_settings(spark, shuffled, name, few, monkeypatch):
    """Spark's default store can't keep these states, so streams bring their own; rows wait together or by slots."""
    import duckdb

    store = spark.conf.get(runs.STORE)
    monkeypatch.setattr(runs, "ROWS", 100)
    monkeypatch.setattr(processors, "FEW", few)
    spark.conf.set(runs.STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        got = catalog.queries()[f"q_stream_{name}"](spark, shuffled)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{shuffled}/events.parquet/*.parquet'")
        want, cols = con.sql(catalog.oracle_sql()[f"q_stream_{name}"]), sorted(got.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want.select(", ".join(cols)).fetchall()))
        assert "HDFS" in spark.conf.get(runs.STORE)
    finally:
        spark.conf.set(runs.STORE, store)


def test_streams_that_start_at_once(spark):
    """The first stream's settings go while the second starts; the second still has its own, and the session's come back."""
    import threading

    store, seen, left = spark.conf.get(runs.STORE), [], threading.Event()
    rocks, plain = (f"org.apache.spark.sql.execution.streaming.state.{x}StateStoreProvider" for x in ("RocksDB", "HDFSBacked"))

    def second():
        with runs.settings(spark, {runs.STORE: rocks}):
            left.wait(60)
            seen.append(spark.conf.get(runs.STORE))

    spark.conf.set(runs.STORE, plain)
    try:
        other = threading.Thread(target=second)
        with runs.settings(spark, {runs.STORE: rocks}):
            other.start()
            other.join(1)
        left.set()
        other.join(60)
        assert seen == [rocks] and spark.conf.get(runs.STORE) == plain
    finally:
        spark.conf.set(runs.STORE, store)


#: Events of 5 users with what tables may hold: ids in another order than times, no price, no time, no user.
ODD = {
    "order": {"event_id": "(event_id * 7919) % 400"},
    "price": {"value": "CASE WHEN event_id % 7 <> 3 THEN value END"},
    "time": {"ts": "CASE WHEN event_id % 50 <> 3 THEN ts END"},
    "user": {"user_id": "CASE WHEN event_id % 9 <> 3 THEN user_id END"},
}


def odd_events(spark, root, *kinds, but="false"):
    """The SQL's results over odd events by DuckDB; the events, without those of ``but``, are written to ``root``."""
    import duckdb

    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 400").withColumn("user_id", F.col("user_id") % 5)
    exprs = {c: e for k in kinds for c, e in ODD[k].items()}
    df.selectExpr(*(f"{exprs.get(c, c)} AS {c}" for c in df.columns)).where(f"NOT coalesce({but}, false)").repartition(3).write.parquet(f"{root}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{root}/events.parquet/*.parquet'")
    return lambda name: con.sql(catalog.oracle_sql()[name])


def test_ema_of_odd_events(spark, tmp_path):
    """Prices are taken in the order of their ids; rows without a price count for nothing, those without a time as others."""
    want = odd_events(spark, tmp_path, *ODD)("q_stream_ema").select("ticker, seq, ema").fetchall()
    got = catalog.queries()["q_stream_ema"](spark, str(tmp_path)).select("ticker", "seq", "ema")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_sessions_and_states_of_odd_events(spark, tmp_path):
    """A row without a price is a sign of life alone; rows without a time are a key's last, and no silence lies before them."""
    want = odd_events(spark, tmp_path, "price", "time", "user", but="user_id = 0 AND ts IS NOT NULL AND event_id > 120")
    rows, left = runs.sessions(spark, str(tmp_path), 0.2, float(5 * 86400))
    for name, got in (("q_stream_sessions", rows.withColumn("ema", F.round("ema", 6))), ("q_stream_state", left.select("ticker", F.round("seen", 3).alias("seen"), F.round("memory", 6).alias("memory")))):
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want(name).select(", ".join(got.columns)).fetchall()))


def test_waves_of_odd_events(spark, tmp_path):
    """A missing price passes no bound and is no extreme; rows without a time come last and never run out of time."""
    want = odd_events(spark, tmp_path, "price", "time", "user")("q_stream_decoder")
    got = catalog.queries()["q_stream_decoder"](spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.select(", ".join(got.columns)).fetchall()))


def test_events_before_1970(spark, tmp_path):
    """A watermark starts at 1970 and would drop them."""
    import duckdb

    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 200")
    old = df.withColumn("ts", F.expr("ts - make_interval(100)").cast(df.schema["ts"].dataType)).withColumn("user_id", F.col("user_id") % 5)
    old.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("q_stream_decoder", "q_stream_state"):
        got, want = catalog.queries()[name](spark, str(tmp_path)), con.sql(catalog.oracle_sql()[name])
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.select(", ".join(got.columns)).fetchall()))


def test_many_tickers_share_their_state(spark, tmp_path, monkeypatch):
    """Tickers of few rows are kept by groups: an access to the state for each of them in each micro-batch takes most of the time."""
    import duckdb

    monkeypatch.setattr(runs, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(runs, "GROUP_ROWS", 100)
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 600").withColumn("user_id", F.col("event_id") % 300)
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("ema", "sessions", "decoder"):
        got, want = catalog.queries()[f"q_stream_{name}"](spark, str(tmp_path / ".")), con.sql(catalog.oracle_sql()[f"q_stream_{name}"])
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.select(", ".join(got.columns)).fetchall()))
        monkeypatch.setattr(runs, "scratch", lambda spark, part, name=name: f"file://{tmp_path}/{name}/{part}")
    kept = [p for p in tmp_path.rglob("state") if (p / "commits").exists()]
    assert len(kept) == 3
    for path in kept:
        held = spark.read.format("statestore").option("stateVarName", "memory").load(f"file://{path}")
        assert 1 <= held.count() <= 6
