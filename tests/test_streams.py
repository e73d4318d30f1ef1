"""Streams over interleaved files, timers that only the watermark moves, restarts and compaction."""

import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.streaming import stateful as T
from tidemark.streaming import streams as Z


class Feed:
    """A folder of files that a stream reads one by one."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0
        os.makedirs(self.path, exist_ok=True)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/p={self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/*")


def drain(stream, path, mode="append"):
    """All rows that a stream has given out so far under one checkpoint."""
    spark = stream.sparkSession
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/_n={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/ck").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return [r for r in spark.read.parquet(f"{path}/out").drop("_n").collect()]


SIGNALS = "market string, symbol string, event_id long, ts_ms long, eligible boolean"


def test_hold_timer_rings_when_only_the_watermark_moves(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SIGNALS)
    feed.add([("spot", "A", 1, 1_000, True), ("spot", "B", 2, 1_000, True), ("spot", "B", 3, 1_400, False)])
    feed.add([("spot", "Z", 4, 10_000_000, False)])  # another key moves the watermark
    out = drain(T.stream_signal_state(feed.stream(), 500, "0 seconds", 1_000), tmp_path)
    got = {(r.symbol, r.ts_ms, r.event_id, r.state) for r in out}
    assert got == {("A", 1_000, 1, "HOLDING"), ("A", 1_500, None, "TRIGGER"), ("B", 1_000, 2, "HOLDING"), ("B", 1_400, 3, "FILTERED")}


def test_interleaved_files_give_sums_in_event_order(spark, tmp_path):
    rng = random.Random(3)
    schema = "exchange string, market string, symbol string, event_id long, ts_ms long, side string, price double, qty double"
    rows = [("x", "spot", rng.choice("ab"), i, i * 500 + rng.randrange(400), rng.choice(["buy", "sell", "unknown"]), 10.0, float(rng.randrange(1, 9))) for i in range(200)]
    feed = Feed(spark, tmp_path / "in", schema)
    for part in range(4):  # times overlap by up to 3 s between neighbouring files
        feed.add([r for i, r in enumerate(rows) if (i + (i % 7)) // 52 == part])
    feed.add([("x", "spot", "end", 999, 10**9, "buy", 1.0, 1.0)])
    out = drain(T.stream_cvd(feed.stream(), "10 seconds", 10**8, 1_000), tmp_path)
    total, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[3])):
        total[r[2]] = total.get(r[2], 0.0) + {"buy": 1, "sell": -1}.get(r[5], 0) * r[7]
        want[r[3]] = total[r[2]]
    assert {r.event_id: r.cvd_qty for r in out} == want and len(out) == len(want)


def test_book_patches_across_restarts(spark, tmp_path):
    schema = "asset_id string, event_id long, event_type string, ts_ms long, best_bid double, best_ask double, bid_depth double, ask_depth double"
    feed = Feed(spark, tmp_path / "in", schema)
    make = lambda: T.stream_prediction_state(feed.stream(), "0 seconds", 10**8, 1_000)
    feed.add([("t", 1, "book", 1_000, 0.4, 0.6, 9.0, 8.0), ("t", 2, "price_change", 1_500, 0.45, None, None, None), ("e", 0, "book", 5_000, None, None, None, None)])
    drain(make(), tmp_path)
    feed.add([("t", 3, "price_change", 6_000, None, 0.55, None, None), ("t", 4, "book", 6_500, None, 0.7, None, None), ("e", 9, "book", 10**7, None, None, None, None)])
    out = {r.event_id: tuple(r[-4:]) for r in drain(make(), tmp_path) if r.asset_id == "t"}
    assert out == {1: (0.4, 0.6, 9.0, 8.0), 2: (0.45, 0.6, 9.0, 8.0), 3: (0.45, 0.55, 9.0, 8.0), 4: (None, 0.7, None, None)}


def test_latest_rows_end_and_state_stays_bounded(spark, tmp_path):
    schema = "exchange string, market string, symbol string, event_id long, bid double, ts_ms long"
    feed = Feed(spark, tmp_path / "in", schema)
    for n in range(6):  # 20 new keys an hour
        feed.add([("x", "spot", f"{n}-{k}", n * 20 + k, 1.0, n * 3_600_000 + k) for k in range(20)])
    table = Z.Upserts(spark, f"{tmp_path}/t", ("exchange", "market", "symbol"), order=("gone", "ts_ms"), gone="gone")
    query = table.feed(T.stream_latest(feed.stream(), ("exchange", "market", "symbol"), 2_500, "0 seconds"), "append")
    query.awaitTermination()
    assert T.retention_ms(2_500) == 300_000 and T.retention_ms(1) == 300_000 and T.retention_ms(10**6) == 3_600_000
    assert {r.symbol for r in table.read().collect()} == {f"5-{k}" for k in range(20)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] <= 60  # values and timers of the last hour, not of six


SYMBOLS = "exchange string, symbol string, " + T.SymbolState.schema


def _event(ts, event_id, domain, **kw):
    names = [c.split()[0] for c in SYMBOLS.split(", ")]
    return Row(*names)(*[{"exchange": "x", "symbol": "s", "ts_ms": ts, "event_id": event_id, "rank": 0, "domain": domain, **kw}.get(n) for n in names])


def test_symbol_state_by_hand(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SYMBOLS)
    book = dict(price=9.0, qty=5.0, ask=11.0, ask_qty=4.0, bid_depth=45.0, ask_depth=44.0)
    feed.add([
        _event(100, 1, "trade", market="perp", side="buy", price=10.0, qty=2.0), _event(200, 2, "open_interest", value=100.0), _event(300, 3, "book", **book),
        _event(1_100, 4, "open_interest", value=110.0), _event(1_200, 5, "book", **{**book, "qty": 7.0}), _event(1_300, 6, "liquidation", side="sell", price=10.0, qty=3.0),
        _event(1_400, 7, "trade", market="spot", side="sell", price=12.0, qty=1.0), _event(1_500, 8, "funding", value=-0.001), _event(1_600, 9, "trade", market="odd", side="buy", price=None, qty=1.0),
        Row(**{**_event(50_000, 10, "quote", value=1.0).asDict(), "symbol": "other"}),
    ])
    out = drain(T.stream_symbol_state(feed.stream(), 2_000, 4_000, "0 seconds", 1_000), tmp_path)
    got = {r.tick_ms: r.asDict() for r in out if r.symbol == "s"}
    assert sorted(got) == [1_000, 2_000, 3_000, 4_000, 6_000]  # two with events, three as sums leave
    assert (got[1_000]["perp_cvd"], got[1_000]["latest_price"], got[1_000]["ofi"]) == (20.0, 10.0, None)
    two = got[2_000]
    assert (two["perp_cvd"], two["spot_cvd"], two["ofi"], two["sell_liquidation"], two["oi_change_pct"], two["funding_rate"], two["latest_price"]) == (20.0, -12.0, 20.0, 30.0, 10.0, -0.001, 12.0)
    assert (got[3_000]["perp_cvd"], got[3_000]["spot_cvd"]) == (None, -12.0)
    assert (got[4_000]["spot_cvd"], got[4_000]["ofi"], got[4_000]["sell_liquidation"]) == (None, None, 30.0)
    assert got[6_000]["sell_liquidation"] is None and got[6_000]["open_interest"] == 110.0


def test_upserts_survive_restarts_and_stay_few(spark, tmp_path):
    table = Z.Upserts(spark, f"{tmp_path}/t", ("k",), every=3)
    plain = Z.Upserts(spark, f"{tmp_path}/p", (), every=3)
    want, rows = {}, []
    for n in range(20):
        batch = [(n % 5, n), (100 + n, n)]
        want |= dict(batch)
        rows += batch
        df = spark.createDataFrame(batch, "k int, v int").coalesce(1)
        for t in (table, plain):
            t.write(df, n)
            if n % 4 == 0:  # the batch is run again after a failure
                Z.Upserts(spark, t.path, t.keys, every=3).write(df, n)
    os.makedirs(f"{tmp_path}/t/snapshots/g_999")  # a compaction that died
    assert {r.k: r.v for r in table.read().collect()} == want
    assert sorted(tuple(r) for r in plain.read().collect()) == sorted(rows)
    assert len(os.listdir(f"{tmp_path}/t/data")) <= 7 and len(os.listdir(f"{tmp_path}/t/snapshots")) <= 3


def test_fanout_restart(spark, tmp_path):
    schema = "type string, exchange string, market string, symbol string, ts_ms long, payload string"
    feed = Feed(spark, tmp_path / "in", schema)
    rows = [("trade", "x", "spot", "A", n, f'{{"price": {n}, "qty": "2", "side": "BID"}}') for n in range(30)]
    for n in range(3):
        feed.add([*rows[n * 10 : n * 10 + 10], ("order_book", "x", "perp", "A", n, '{"bids": [{"price": 1.5, "qty": 2}]}'), ("quote", "x", "spot", "A", n, "{bad"), ("odd", "x", None, None, n, "{}")])
        Z.stream_fanout(feed.stream(), f"{tmp_path}/f", every=2).awaitTermination()  # stopped and started thrice
    got = Z.read_fanout(spark, f"{tmp_path}/f")
    assert sorted(r.price for r in got["trade"].collect()) == [float(n) for n in range(30)]
    assert {r.side for r in got["trade"].collect()} == {"buy"}
    assert [(r.best_bid, r.best_ask, r.asks_json) for r in got["order_book"].collect()] == [(1.5, None, "[]")] * 3
    assert got["dead"].count() == 3 and got["log"].count() == 36 and got["quote"].count() == 0


@pytest.mark.parametrize("intervals", [("1m", "5m"), ("3m", "5m")])
def test_intervals_must_divide(spark, intervals):
    quotes = spark.readStream.format("rate").load().selectExpr("'x' as exchange", "'spot' as market", "'s' as symbol", "value as event_id", "1D as bid", "2D as ask", "value as ts_ms")
    if intervals[0] == "3m":
        with pytest.raises(ValueError):
            Z.stream_klines(quotes, intervals)
    else:
        plan = Z.stream_klines(quotes, intervals)
        assert plan.isStreaming and F.col("open") is not None


@pytest.mark.parametrize("name", ["stream_imbalance", "stream_latest", "stream_cvd", "stream_prediction_state"])
def test_queries_give_rows_that_the_watermark_does_not_reach(spark, name):
    import __spark_entry__ as entry
    from tidemark.sources import adapters as A

    d = "/root/testdata/sf0.001"
    got, trades = entry.queries()[name](spark, d), A.trades(spark, d)
    if name == "stream_imbalance":  # every trade lies in two windows
        assert got.agg(F.sum("n")).first()[0] == 2 * trades.count()
    elif name == "stream_latest":
        assert got.count() == trades.select("exchange", "market", "symbol").distinct().count()
    else:
        assert got.count() == (trades if name == "stream_cvd" else A.prediction_events(spark, d)).count()


def test_nulls_and_nan_stay_apart_in_packs(spark, tmp_path):
    schema = "asset_id string, event_id long, event_type string, ts_ms long, best_bid double, best_ask double, bid_depth double, ask_depth double"
    feed = Feed(spark, tmp_path / "in", schema)
    feed.add([(None, 1, "book", 1_000, float("nan"), None, 1.0, None), (None, 2, None, 1_001, None, 2.0, None, None), ("e", 9, "book", 10**7, None, None, None, None)])
    out = {r.event_id: tuple(r[-4:]) for r in drain(T.stream_prediction_state(feed.stream(), "0 seconds", 10**8, 1_000), tmp_path) if r.asset_id is None}
    assert str(out) == "{1: (nan, None, 1.0, None), 2: (nan, 2.0, 1.0, None)}"


def test_packs_hold_what_a_tick_needs():
    import numpy as np
    import pandas as pd

    state = T.SymbolState(2_000, 4_000, 1_000)
    n = 1_000
    frame = pd.DataFrame({c: np.zeros(n, np.int64) for c in (*state.longs, "_nulls")} | {c: np.ones(n) for c in state.doubles}).assign(exchange="x", symbol="s", event_id=range(n), kind=T.SymbolState.SPOT)
    packs = state.pack(frame, ("exchange", "symbol"))
    assert len(packs) == 1 and len(packs.numbers[0]) < 2_000  # a thousand trades are one row with their sum and last price
