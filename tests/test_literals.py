"""Small literal cases of the market operators."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import bars, books, contracts, coverage, flow, listings, normalize, scoring, signals, state

Q = "event_id long, exchange string, market string, symbol string, bid double, ask double, mark double, funding_rate double, ts_ms long"
T = "event_id long, exchange string, market string, symbol string, price double, qty double, side string, ts_ms long"
B = "exchange string, market string, symbol string, interval string, open_time_ms long, close_time_ms long, open double, high double, low double, close double, volume double, updated_at_ms long"


def quote(i, ex, bid, ask, ts=60_001, market="spot", rate=None):
    return (i, ex, market, "BTCUSDT", float(bid), float(ask), None, rate, ts)


def bar(i, close, vol=1.0, high=None, open_time=None):
    t = i * 60_000 if open_time is None else open_time
    return ("a", "spot", "X", "1m", t, t + 59_999, float(close), float(high or close), float(close), float(close), vol, t + 60_000)


def test_bars(spark):
    out = bars.klines(spark.createDataFrame([quote(1, "a", 99, 101), quote(2, "a", 109, 111)], Q), ("1m", "5m")).collect()
    assert {(r.interval, r.open_time_ms, r.open, r.high, r.close) for r in out} == {("1m", 60_000, 100.0, 110.0, 110.0), ("5m", 0, 100.0, 110.0, 110.0)}
    with pytest.raises(ValueError):
        bars.klines(spark.createDataFrame([], Q), ("3m", "5m"))
    assert bars.klines(spark.createDataFrame([], Q)).count() == 0


def test_order_flow_and_retention(spark):
    t = spark.createDataFrame([(1, "a", "spot", "X", 10.0, 2.0, "buy", 5), (2, "a", "spot", "X", 10.0, 1.0, "sell", 6), (3, "a", "spot", "X", 0.0, 1.0, "buy", 7)], T)
    r = flow.order_flow(t, (60_000,)).first()
    assert (r.buy_qty, r.sell_qty, r.delta_qty, r.trade_count, r.cumulative_delta_qty) == (2, 1, 1, 2, 1)
    f = spark.range(600).selectExpr("'a' as exchange", "'spot' as market", "'X' as symbol", "60000L as window_ms", "id * 60000 as bucket_start_ms")
    kept = flow.bucket_retention(f, 600 * 60_000)
    assert kept.count() == 500 and kept.agg(F.min("bucket_start_ms")).first()[0] == 100 * 60_000


def test_footprint(spark):
    t = spark.createDataFrame([(1, "a", "spot", "X", 100.1, 2.0, "buy", 60_001), (2, "a", "spot", "X", 100.2, 1.0, "sell", 60_002), (3, "a", "spot", "X", 100.9, 3.0, "buy", 60_003)], T)
    r = flow.footprint(t, 60_000, 1.0, 3.0, 1.0, 2).first()
    assert (r.bucket_start_ms, r.trade_count, len(r.levels), r.delta_qty) == (60_000, 3, 2, 4.0)
    assert [x.bin for x in r.levels] == [100, 101]
    u = flow.footprint_levels(spark.createDataFrame([(1, "a", "spot", "X", 5.0, 1.0, "unknown", 1)], T)).first()
    assert (u.total_qty, u.trades) == (0.0, 0)


def test_exec_price_and_pressure(spark):
    df = spark.createDataFrame([([(100.0, 5.0), (110.0, 5.0)], [(1.0, 0.0)])], "bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    r = df.select(books.average_price(F.col("bids"), 1000.0).alias("p"), books.average_price(F.col("bids"), 5000.0).alias("q"), books.average_price(F.col("asks"), 1.0).alias("z")).first()
    assert abs(r.p - 104.76190476190476) < 1e-9 and r.q is None and r.z is None


def test_profit_and_pairs(spark):
    p = spark.createDataFrame([("k", "BTC", "a", 80152.6, "b", 80164.4)], "market string, symbol string, buy_exchange string, ask double, sell_exchange string, bid double")
    r = signals.profit(signals.leg_fees(p, None)).first()
    assert r.gross > 0 > r.net and r.buy_fee_bps + r.sell_fee_bps > r.gross_bps
    ticks = spark.createDataFrame([quote(1, "a", 101, 102), quote(2, "b", 110, 111)], Q).withColumn("stale", F.lit(False))
    r = signals.cross_pair(ticks).first()
    assert (r.buy_exchange, r.ask, r.sell_exchange, r.bid) == ("a", 102, "b", 110)
    tie = spark.createDataFrame([quote(i, x, 100, 100) for i, x in enumerate("cab")], Q).withColumn("stale", F.lit(False))
    r = signals.cross_pair(tie).first()
    assert (r.buy_exchange, r.sell_exchange) == ("a", "b")
    one = signals.cross_pair(ticks.where("exchange = 'a'"))
    assert one.count() == 0


def test_flow_window(spark):
    rows = [(1, "a", "spot", "X", 1.0, 100.0, "buy", 1000), (2, "a", "spot", "X", 1.0, 40.0, "sell", 1100), (3, "a", "spot", "X", 1.0, 999.0, "buy", 10)]
    r = flow.trade_imbalance(spark.createDataFrame(rows, T), 1200, 500).first()
    assert (r.n, r.signed_notional, r.absolute_notional) == (2, 60, 140) and abs(r.imbalance - 60 / 140) < 1e-12


def test_lake_quality(spark):
    df = spark.createDataFrame([bar(0, 1), bar(1, 1), bar(1, 1), bar(3, 1)], B)
    r = bars.lake_quality(df).first()
    assert (r.row_count, r.duplicates, r.gaps, r.coverage) == (4, 1, 1, 0.75)


def test_days_percentiles_symbols(spark):
    df = spark.createDataFrame([(0, [10, 20, 30, 40, 50])], "t long, v array<long>")
    r = df.select(S.utc_day(F.col("t")), S.utc_day(F.col("t") + 86_400_000), S.pct_rounded(F.col("v"), 0.5), S.pct_rounded(F.col("v"), 0.95), S.pct_floored(F.col("v"), 95)).first()
    assert tuple(r) == ("1970-01-01", "1970-01-02", 30, 50, 40)
    names = spark.createDataFrame([("BTC-USDT-SWAP",), ("BTCUSDTM",), ("tBTCF0:USDTF0",), ("BTC_USDT",)], "s string")
    assert {x[0] for x in names.select(S.canonical_perp(F.col("s"))).collect()} == {"BTCUSDT"}
    x = spark.createDataFrame([("BTCFDUSD",)], "s string").select(S.split_symbol(F.col("s")).alias("x")).first().x
    assert tuple(x) == ("BTCFD", "USD")
    v = {r.venue: r.venue_symbol for r in normalize.venue_symbols(spark.createDataFrame([("BTCUSDT",)], "symbol string")).collect()}
    assert (v["kraken_perp"], v["bitfinex_perp"], v["kucoin_perp"]) == ("PF_XBTUSD", "tBTCF0:USTF0", "XBTUSDTM")


def test_health(spark):
    df = spark.createDataFrame([("perp", 3, 0, 0.0, 10), ("spot", 1, 0, 0.0, 10), ("spot", 2, 0, 0.0, 10)], "market string, exchanges_total long, exchanges_with_funding long, stale_ratio double, latency_ms_p95 long")
    got = [(r.health_status, r.alerts) for r in coverage.health(df).collect()]
    assert got == [("critical", ["no funding available across exchanges"]), ("warning", ["single-exchange coverage"]), ("healthy", [])]


def test_fee_tier(spark):
    tiers = spark.createDataFrame([("a", 0.0, 10.0, 12.0), ("a", 1e6, 8.0, 9.0), ("a", 5e6, 6.0, 7.0)], "exchange string, min_volume double, maker double, taker double")
    r = signals.fee_tier(spark.createDataFrame([("a", 5.5e6)], "exchange string, volume double"), tiers).first()
    assert (r.maker, r.taker) == (6, 7)


def test_research(spark):
    df = spark.createDataFrame([bar(i, c, v) for i, (c, v) in enumerate([(100, 1.0), (110, 2.0), (121, 3.0)])], B)
    assert bars.realized_vol(df).first().realized_vol is not None and bars.close_zscore(df).first().close_zscore > 0
    flat = spark.createDataFrame([bar(i, 5) for i in range(4)], B)
    assert bars.close_zscore(flat).first().close_zscore is None
    reg = bars.regimes(spark.createDataFrame([(30.0, None, None, 40.0, 10.0)], "basis_bps double, funding_rate double, open_interest double, spread_bps double, liquidity_score double")).first()
    assert (reg.basis_regime, reg.liquidity_regime, reg.funding_regime) == ("perp_premium", "wide_spread", "unknown")


METRICS = "exchange string, symbol string, latest_price double, funding_rate double, oi_change_pct double, cvd_divergence string, perp_cvd double, ofi double, buy_liquidation double, depth_ratio double, depth_pressure double"


def test_states(spark):
    rows = [("a", "X", 100.0, -0.0006, 16.0, "spot_up_perp_down", -1.0, 1.0, 1000.0, None, None), ("a", "Y", 100.0, 0.0006, -12.0, None, -1000.0, -100.0, None, 0.5, -0.5)]
    df = scoring.exhaustion_state(scoring.squeeze_state(spark.createDataFrame(rows, METRICS)))
    x, y = df.orderBy("symbol").collect()
    assert (x.squeeze_state, x.squeeze_score) == ("triggered_long_squeeze", 10)
    assert y.exhaustion_state == "triggered_short_exhaustion" and "book_vacuum" in y.exhaustion_progress
    stops = {r.symbol: r.suggested_hard_stop for r in scoring.risk_context(df).collect()}
    assert abs(stops["X"] - 98.5) < 1e-9 and abs(stops["Y"] - 101.5) < 1e-9


def test_state_edges(spark):
    ticks = spark.createDataFrame([("a", "spot", "X", t) for t in (100, 1000, 1100)], "exchange string, market string, symbol string, ts_ms long")
    assert state.prune_snapshots(ticks, 1100, 0, 1).collect()[0].ts_ms == 1100
    same = spark.createDataFrame([("w", "b", "abc", 1, 1, 1.0), ("w", "b", "abc", 1, 2, 1.0)], "source string, chain string, tx_hash string, ts_ms long, event_id long, tie double")
    assert state.dedupe_transfers(same).count() == 1
    bad = spark.createDataFrame([quote(1, "a", float("nan"), 1), quote(2, "a", 1, float("inf")), quote(3, "a", 1, 2)], Q)
    assert [r.event_id for r in state.finite_events(bad, ["bid", "ask", "mark"]).collect()] == [3]
    assert spark.range(1).select(state.as_of(spark.createDataFrame([], Q))).first()[0] == 0 and state.latest_ticks(spark.createDataFrame([], Q)).count() == 0
    dup = spark.createDataFrame([quote(1, "a", 1, 2), quote(2, "a", 3, 4)], Q)
    assert state.latest_ticks(dup).first().bid == 3


def test_normalizers(spark):
    df = spark.createDataFrame([(1e9, 2e8, 9, 6)], "in_amount double, out_amount double, in_decimals int, out_decimals int")
    assert abs(normalize.swap_price(df).first().price - 200) < 1e-9
    r = normalize.synthetic_quotes(spark.createDataFrame([(100.0,), (-1.0,)], "price double"), 10.0).collect()
    assert abs(r[0].bid - 99.95) < 1e-9 and abs(r[0].ask - 100.05) < 1e-9 and r[1].bid is None
    e = spark.createDataFrame([("2026-05-20T16:58:43.789Z",), ("2026-05-21 01:45:46",), ("1700000000",), ("5",)], "s string")
    assert [x[0] for x in e.select(normalize.epoch_norm(F.col("s"), 1000)).collect()] == [1779296323789, 1779327946000, 1700000000000, 1005]
    o = contracts.parse_options(spark.createDataFrame([("BTC-260626-100000-C",), ("ETH-26MAR27-5000-P",), ("BTC-XX-1-C",)], "instrument_name string")).collect()
    assert [x.expiry_time for x in o] == ["2026-06-26T08:00:00Z", "2027-03-26T08:00:00Z"]
    v = normalize.signal_values(spark.createDataFrame([(1, "x", '{"data":[{"fundingRate":"0.0001"}]}')], "event_id long, source string, payload string"), {}).first()
    assert v.value == 0.0001


def test_prediction_fallback_is_pinned(spark):
    m = spark.createDataFrame([("c1", "s1", "Will Bitcoin be above 100000?", True, '["1","2"]', '["Yes","No"]'), ("c2", "s2", "Will Bitcoin reach $120,000?", True, '["1","2"]', '["Up","Down"]')], "condition_id string, slug string, question string, active boolean, clob_token_ids string, outcomes string")
    out = contracts.parse_prediction(m).collect()
    assert [(r.condition_id, r.strike, r.rule_type, r.yes_token_id) for r in out] == [("c2", 120000.0, "touch", "1")]


def test_funding_runs(spark):
    rows = [("a", "X", i, i * 3_600_000, p) for i, p in enumerate([-0.3, -0.3, 0.1, -0.4])]
    df = spark.createDataFrame(rows, "exchange string, symbol string, event_id long, ts_ms long, pct double")
    got = sorted((r.start_ms, r.end_ms, r.points) for r in listings.funding_runs(df, -0.2).collect())
    assert got == [(0, 7_200_000, 2), (10_800_000, 14_400_000, 1)]
    assert listings.typical_interval(df).first().interval_ms == 3_600_000


def test_signal_hold(spark):
    df = spark.createDataFrame([("m", "X", t, e) for t, e in ((0, True), (400, True), (600, True), (700, False), (800, True))], "market string, symbol string, ts_ms long, eligible boolean")
    got = [r.state for r in signals.signal_state(df, ("market", "symbol"), 500).orderBy("ts_ms").collect()]
    assert got == ["HOLDING", "HOLDING", "TRIGGER", "FILTERED", "HOLDING"]


def test_lake_needs_a_filter(spark, tmp_path):
    with pytest.raises(ValueError):
        bars.lake_delete(spark, str(tmp_path))


def test_symbol_texts(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import scalars as S

    one = lambda f, *cols: tuple(spark.createDataFrame([cols], ", ".join(f"c{i} string" for i in range(len(cols)))).select(f(*[F.col(f"c{i}") for i in range(len(cols))]).alias("o")).first().o)
    split = {"BTCFDUSD": ("BTC", "FDUSD"), "ABCXYZW": ("ABC", "XYZW"), "ABCDE": ("ABCDE", "USDT"), "USDT": ("", "USDT"), "SOLXRP": ("SOL", "XRP")}
    for text, want in split.items():
        assert one(S.venue_split, text) == want, text
    product = {" tbtc-usdt ": ("BTC", "BTCUSDT", "USDT"), "btc": (None, None, "BTC"), "eth/brl": ("ETH", "ETHBRL", "BRL"), "": (None, None, None), "doge": ("DOGE", None, None)}
    product["btc"] = ("BTC", None, None)
    for text, want in product.items():
        assert one(S.product_text, text) == want, text
    assert "".join(one(S.pair_name, "xbt", "usd", "x")) == "BTCUSD"
    assert "".join(one(S.pair_name, None, "usd", "eth-usdt-SWAP")) == "ETHUSDT"


def test_lake_delete_wants_partitions(spark, tmp_path):
    from tidemark.operators import bars

    with pytest.raises(ValueError):
        bars.lake_delete(spark, str(tmp_path), open="1")


def test_swap_that_gives_nothing_has_price_zero(spark):
    rows = [(1e9, 0.0, 9, 6), (0.0, 2e8, 9, 6), (1e9, -1.0, 9, 6), (1e9, None, 9, 6)]
    df = spark.createDataFrame(rows, "in_amount double, out_amount double, in_decimals int, out_decimals int")
    assert [r.price for r in normalize.swap_price(df).collect()] == [0.0, None, None, None]


def test_quote_paths_are_each_read_once(spark):
    raw = spark.createDataFrame(
        [(1, "x", "spot", "A", '{"bid": "NaN", "b": "2", "ask": 3, "T": 7}', 5), (2, "y", "spot", "A", '{"bestBid": 1, "a": true, "bestAsk": 2}', 5), (3, "x", "spot", "A", '{"b": 1, "a": -1}', 5), (4, None, "spot", "A", "{bad", 5)],
        "event_id long, exchange string, market string, symbol string, payload string, received_at_ms long",
    )
    out = normalize.normalize_quotes(raw)
    assert sorted((r.event_id, r.bid, r.ask, r.mark, r.ts_ms) for r in out.collect()) == [(1, 2.0, 3.0, None, 7), (2, 1.0, 2.0, None, 5)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(") == 11  # as many as there are paths


def test_fanout_parses_a_payload_once(spark):
    df = spark.createDataFrame([("trade", "x", "spot", "A", 1, '{"price": 1}')], "type string, exchange string, market string, symbol string, ts_ms long, payload string")
    given = df.withColumn("v", F.try_parse_json(F.lit('{"price": 2}')))
    assert normalize.typed_rows(given).first().price == 2.0 and normalize.typed_rows(df).first().price == 1.0


def test_fanout_deals_a_symbol_out(spark, tmp_path):
    rows = [("trade", "x", "spot", "A", n * 3_600_000, f'{{"price": {n}}}') for n in range(24 * 40)]
    df = spark.createDataFrame(rows, "type string, exchange string, market string, symbol string, ts_ms long, payload string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        normalize.write_fanout(df, f"file://{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    back = spark.read.parquet(f"file://{tmp_path}/t")
    files = back.groupBy(F.input_file_name()).count().collect()
    assert back.count() == len(rows) and len(files) == 4 and max(r["count"] for r in files) < 0.7 * len(rows)
