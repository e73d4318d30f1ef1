"""Leaf search, rule tables, versioned manifest, typed tables, reasons and one-pass plans."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, normalize, scoring, state
from tidemark.plans import catalog, market, reference
from tidemark.sources import adapters as A
from tidemark.sources import exports, schemas

SF = "/root/testdata/sf0.001"


def test_numeric_leaf(spark):
    cases = {
        '{"data":[{"fundingRate":"0.0001"}]}': 0.0001, '{"a":1,"rate":"2"}': 2.0, '{"rate":{"x":5},"a":4}': 4.0, '{"rate":"n/a","total":3,"value":null}': 3.0, "[[],[{}],[[7,8]]]": 7.0, '"12"': 12.0,
        '{"a":{"b":{"c":{"d":{"e":{"f":{"g":[true,"x",-1.5]}}}}}}}': -1.5, '{"b":{"value":1},"a":{"z":2}}': 2.0, "true": None, "{bad": None, "[]": None, None: None, '"NaN"': None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "event_id long, payload string").withColumns({"v": F.lit(1), "place": F.lit("x")})
    got = {r.event_id: r.value for r in normalize.numeric_leaf(df).collect()}
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())


def test_venue_forms(spark):
    typed = ["BTCUSDT", "BTC-PERP", "BTCPERP", "eth_usdt", "PI_XBTUSD", "XBTUSD", "BTC/USDC"]
    got = {(r.symbol, r.venue): r.venue_symbol for r in normalize.venue_symbols(spark.createDataFrame([(x,) for x in typed], "symbol string")).collect()}
    assert len({v for _, v in got}) == len(normalize.VENUE_FORMS) >= 25
    want = {
        ("BTCUSDT", "okx_swap"): "BTC-USDT-SWAP", ("BTCPERP", "derive_perp"): "BTC-PERP", ("BTC-PERP", "pacifica_perp"): "BTC", ("BTC-PERP", "coinex"): "BTC", ("BTCPERP", "bitmex_perp"): "XBTUSD",
        ("XBTUSD", "bitmex_perp"): "XBTUSD", ("PI_XBTUSD", "kraken_perp"): "PI_XBTUSD", ("eth_usdt", "grvt_perp"): "eth_usdt", ("eth_usdt", "cryptocom_spot"): "ETH_USDT", ("BTC/USDC", "decibel_perp"): "BTC-USDC",
        ("BTC/USDC", "evedex_perp"): "BTCUSDC", ("BTC/USDC", "upbit"): "USDC-BTC", ("BTCUSDT", "deribit_perp"): "BTC-PERPETUAL", ("BTCUSDT", "woo_spot"): "SPOT_BTC_USDT", ("BTC-PERP", "grvt_perp"): "_BTC_Perp",
    }
    assert {k: got[k] for k in want} == want


def test_quote_paths(spark):
    rules = [("a", ["$.x", "$.y"], ["$.z"], [], [], []), *normalize.QUOTE_PATHS]
    rows = [(1, "a", '{"x":"no","y":"1","z":2,"bid":9}'), (2, "b", '{"bid":3,"ask":4,"ts":5}'), (3, "a", '{"bid":3,"ask":4}'), (4, "b", "{bad"), (5, None, '{"b":1,"a":2}')]
    raw = spark.createDataFrame(rows, "event_id long, exchange string, payload string").selectExpr("*", "'spot' as market", "'X' as symbol", "7L as received_at_ms")
    assert {(r.event_id, r.bid, r.ask, r.ts_ms) for r in normalize.normalize_quotes(raw, rules).collect()} == {(1, 1.0, 2.0, 7), (2, 3.0, 4.0, 5), (5, 1.0, 2.0, 7)}


def test_versioned_manifest(spark, tmp_path):
    root, manifest = f"file://{tmp_path}/lake", f"file://{tmp_path}/manifest"
    rows = [(e, "spot", s, "1d", d * 86_400_000, float(d)) for e in ("a", "b") for s in ("X", "Y") for d in range(3)]
    bars.lake_write(spark.createDataFrame(rows, "exchange string, market string, symbol string, interval string, open_time_ms long, close double"), root)
    assert bars.commit_manifest(spark, manifest, bars.lake_files(spark, root)) == 1
    size = sum(r.bytes for r in bars.read_manifest(spark, manifest).where("exchange = 'a' and symbol = 'X'").collect())
    os.makedirs(f"{tmp_path}/manifest/v_9")  # a commit that died
    gone = bars.lake_delete(spark, root, manifest, exchange="a", symbol="X").collect()
    assert (len(gone), sum(r.rows for r in gone), sum(r.files for r in gone)) == (3, 3, 3) and sum(r.bytes for r in gone) == size > 0
    key = lambda df: sorted((r.exchange, r.symbol, r.day, r.rows) for r in df.collect())
    now = key(bars.read_manifest(spark, manifest))
    assert now == key(bars.lake_files(spark, root)) and len(now) == 9
    assert len(key(bars.read_manifest(spark, manifest, 1))) == 12  # the version before can still be read
    assert bars.lake_delete(spark, root, manifest, exchange="none").count() == 0
    with pytest.raises(ValueError):
        bars.lake_delete(spark, root, manifest)


def test_reasons(spark):
    names = "exchange string, symbol string, funding_rate double, oi_change_pct double, cvd_divergence string, ofi double, buy_liquidation double, depth_pressure double, depth_ratio double, perp_cvd double"
    rows = [("x", "long", -0.001, 20.0, "spot_up_perp_down", 5.0, 9.0, -0.5, 0.33, -1.0), ("x", "short", 0.001, -12.0, None, -5.0, None, 0.1, 0.5, -1.0), ("x", "calm", None, None, None, None, None, None, None, None)]
    got = {r.symbol: r for r in scoring.exhaustion_state(scoring.squeeze_state(spark.createDataFrame(rows, names))).collect()}
    a, b, c = got["long"], got["short"], got["calm"]
    assert a.squeeze_state == "triggered_long_squeeze" and a.squeeze_score == 10
    assert a.squeeze_reasons == ["funding deeply negative: -0.1000%", "OI expansion is extreme: +20.00%", "spot CVD up while perp CVD down"]
    assert a.squeeze_invalidated and a.squeeze_invalidation[0].startswith("top-10 book is ask-heavy") and a.exhaustion_invalidated
    assert b.exhaustion_state == "triggered_short_exhaustion" and b.exhaustion_reasons == ["funding extremely positive: 0.1000%", "OI dropped sharply: -12.00%", "bid depth is thin versus asks: 0.50"]
    assert (c.squeeze_reasons, c.squeeze_invalidation, c.squeeze_state, c.exhaustion_state) == ([], [], "neutral", "neutral")


def test_exports_and_load(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b", 1.5, None), ("é", None, 7)], "s string, x double, n long")
    for kind in ("csv", "json"):
        exports.write(df, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, exports.read(spark, f"{tmp_path}/{kind}", kind, df.schema).collect())) == sorted(map(tuple, df.collect()))
    exports.write(df.select("s"), f"{tmp_path}/text", "text")
    assert {r.s for r in exports.read(spark, f"{tmp_path}/text", "text", df.select("s").schema).collect()} == {"a,\"b", "é"}
    with pytest.raises(ValueError):
        exports.write(df, f"{tmp_path}/t", "text")
    spark.createDataFrame([(1, "x")], "event_id long, extra string").write.json(f"{tmp_path}/q")
    out = schemas.load(spark, f"{tmp_path}/q", "quotes", "json")
    assert out.schema.simpleString() == spark.createDataFrame([], schemas.DOMAINS["quotes"]).schema.simpleString() and out.first().event_id == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_one_pass_plans(spark):
    for df, most in ((market.features(spark, SF), 3), (reference.metrics(spark, SF), 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= most and "CartesianProduct" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_unified_events_are_the_domains(spark):
    events = A.unified_events(spark, SF)
    assert events.columns == list(state.EVENT)
    counts = {r.domain: r["count"] for r in events.groupBy("domain").count().collect()}
    names = {"quote": "quotes", "trade": "trades", "funding": "funding", "open_interest": "open_interest", "liquidation": "liquidations", "order_book": "order_books"}
    assert counts == {k: getattr(A, n)(spark, SF).count() for k, n in names.items()}
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
