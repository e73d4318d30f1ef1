"""Queries over latest state, bars, flow, books and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import bars, books, flow, signals, state
from tidemark.plans.registry import D1, H1, H4, TTL, R, register, rounded
from tidemark.sources import adapters as A
from tidemark.sources.shared import shared_dir

KEY = state.KEY
K = "exchange, market, symbol"


def ticks(spark, d):
    return state.latest_ticks(A.quotes(spark, d), ttl_ms=TTL)


def last(name, keys):
    return lambda s, d: state.latest(getattr(A, name)(s, d), keys)


def now(s, d):
    return state.as_of(A.ev(s, d))


TICK = f"{K}, event_id, round(bid,4) AS bid, round(ask,4) AS ask, round(mark,4) AS mark, round(funding_rate,8) AS funding_rate, ts_ms, latency_ms, stale"


def tick_columns(df):
    return df.select(*KEY, "event_id", R("bid", 4).alias("bid"), R("ask", 4).alias("ask"), R("mark", 4).alias("mark"), R("funding_rate", 8).alias("funding_rate"), "ts_ms", "latency_ms", "stale")


register("latest_ticks", lambda s, d: tick_columns(ticks(s, d)), f"SELECT {TICK} FROM lt")
register("quotes", lambda s, d: tick_columns(state.quotes_view(ticks(s, d), ["BTCUSDT", "ETHUSDT"], ["binance", "okx"])), f"SELECT {TICK} FROM lt WHERE NOT stale AND symbol IN ('BTCUSDT','ETHUSDT') AND exchange IN ('binance','okx')")
register("snapshot", lambda s, d: tick_columns(state.filter_market(ticks(s, d), ["BTCUSDT"])), f"SELECT {TICK} FROM lt WHERE symbol = 'BTCUSDT'")
register("prune_snapshots", lambda s, d: tick_columns(state.prune_snapshots(ticks(s, d), now(s, d), TTL)), f"SELECT {TICK} FROM lt WHERE latency_ms <= 3600000")
register("filter_ticks", lambda s, d: tick_columns(state.stream_filter(ticks(s, d), ["SOLUSDT"], market="perp")), f"SELECT {TICK} FROM lt WHERE NOT stale AND symbol = 'SOLUSDT' AND market = 'perp'")
_last = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY ts_ms DESC, event_id DESC) = 1"
_LATEST = {
    "funding": (("exchange", "symbol"), "next_funding_time_ms, mark_price, index_price, ts_ms", 8),
    "open_interest": (("exchange", "symbol"), "open_interest_value, ts_ms", 4),
    "trades": (KEY, "price, qty, side, trade_id, ts_ms", 4),
    "liquidations": (("exchange", "symbol"), "side, price, qty, ts_ms", 4),
    "signals": (("source", "category", "symbol", "metric"), "value, ts_ms", 4),
}
_VALUE = {"funding": "funding_rate", "open_interest": "open_interest", "trades": "price", "liquidations": "price", "signals": "value"}
for _n, (_keys, _, _digits) in _LATEST.items():
    _short = {"open_interest": "oi"}.get(_n, _n)
    _v = _VALUE[_n]
    register(
        f"latest_{_short}", lambda s, d, n=_n, k=_keys, v=_v, g=_digits: last(n, k)(s, d).select(*k, R(v, g).alias(v), "event_id", "ts_ms"),
        f"SELECT {', '.join(_keys)}, round({_v},{_digits}) AS {_v}, event_id, ts_ms FROM {_n} " + _last.format(", ".join(_keys)),
    )
_ROWS = {"funding_rows": ("funding", ("exchange", "symbol")), "open_interest_rows": ("open_interest", ("exchange", "symbol")), "trade_rows": ("trades", KEY), "liquidation_rows": ("liquidations", ("exchange", "symbol"))}
for _q, (_n, _keys) in _ROWS.items():
    _v = _VALUE[_n]
    register(
        _q, lambda s, d, n=_n, k=_keys, v=_v: state.filter_market(last(n, k)(s, d), ["BTCUSDT", "XRPUSDT", "DOGEUSDT"], ["okx", "bybit"], "perp").select(*k, R(v, 8).alias(v), "ts_ms"),
        f"SELECT {', '.join(_keys)}, round({_v},8) AS {_v}, ts_ms FROM (SELECT * FROM {_n} {_last.format(', '.join(_keys))}) WHERE symbol IN ('BTCUSDT','XRPUSDT','DOGEUSDT') AND exchange IN ('okx','bybit')" + (" AND market = 'perp'" if "market" in _keys else ""),
    )
register(
    "latest_books", lambda s, d: last("order_books", KEY)(s, d).select(*KEY, "event_id", F.explode(F.arrays_zip("bids", "asks")).alias("z")).select(*KEY, "event_id", R("z.bids.price", 4).alias("bid"), F.col("z.bids.qty").alias("bid_qty"), R("z.asks.price", 4).alias("ask"), F.col("z.asks.qty").alias("ask_qty")),
    f"SELECT b.exchange, b.market, b.symbol, b.event_id, round(b.price,4) AS bid, b.qty AS bid_qty, round(a.price,4) AS ask, a.qty AS ask_qty FROM lb b JOIN lb a ON b.event_id = a.event_id AND b.lvl = a.lvl AND b.side = 'bid' AND a.side = 'ask'",
)
register(
    "order_books", lambda s, d: state.filter_market(last("order_books", KEY)(s, d), ["BTCUSDT"], None, "perp").select(*KEY, "event_id", R(S.book_sum(F.col("bids"), 10), 4).alias("bid_notional"), F.size("bids").alias("levels")),
    f"SELECT {K}, event_id, round(sum(price*qty) FILTER (side='bid'),4) AS bid_notional, count(*) FILTER (side='bid') AS levels FROM lb WHERE symbol='BTCUSDT' AND market='perp' GROUP BY ALL",
)
register(
    "signals", lambda s, d: state.signals_view(last("signals", ("source", "category", "symbol", "metric"))(s, d), ["coingecko", "coinglass"], None, ["BTCUSDT"], None).select("source", "category", "symbol", "metric", R("value", 4).alias("value"), "ts_ms"),
    "SELECT source, category, symbol, metric, round(value,4) AS value, ts_ms FROM (SELECT * FROM signals " + _last.format("source, category, symbol, metric") + ") WHERE source IN ('coingecko','coinglass') AND (symbol IS NULL OR symbol = 'BTCUSDT')",
)
_BASIS = "bs AS (SELECT s.exchange, s.symbol, (s.bid+s.ask)/2 AS spot_mid, (p.bid+p.ask)/2 AS perp_mid, greatest(s.ts_ms, p.ts_ms) AS ts_ms FROM lt s JOIN lt p ON s.exchange=p.exchange AND s.symbol=p.symbol AND s.market='spot' AND p.market='perp' WHERE NOT s.stale AND NOT p.stale AND s.bid>0 AND s.ask>0 AND p.bid>0 AND p.ask>0)"
register("basis", lambda s, d: rounded(state.basis(ticks(s, d))), f"WITH {_BASIS} SELECT exchange, symbol, round(spot_mid,4) AS spot_mid, round(perp_mid,4) AS perp_mid, round(perp_mid-spot_mid,4) AS basis, round((perp_mid-spot_mid)/spot_mid*10000,4) AS basis_bps, ts_ms FROM bs")
register("dedupe_trades", lambda s, d: state.dedupe_trades(A.trades(s, d).withColumn("trade_id", F.expr("concat('t', event_id % 50)"))).select(*KEY, "trade_id", "event_id"), f"SELECT {K}, 't' || (event_id % 50) AS trade_id, event_id FROM trades QUALIFY row_number() OVER (PARTITION BY {K}, event_id % 50 ORDER BY ts_ms, event_id) = 1")
_DT = "dt AS (SELECT * FROM transfers QUALIFY row_number() OVER (PARTITION BY source, chain, tx_hash ORDER BY ts_ms, event_id, tie) = 1)"
register("dedupe_transfers", lambda s, d: state.dedupe_transfers(A.transfers(s, d)).select("source", "chain", "tx_hash", "event_id", "asset", R("amount_usd", 2).alias("amount_usd"), "ts_ms"), f"WITH {_DT} SELECT source, chain, tx_hash, event_id, asset, round(amount_usd,2) AS amount_usd, ts_ms FROM dt")
register("transfers", lambda s, d: state.transfers_view(state.dedupe_transfers(A.transfers(s, d)), "Whale_Alert", None, "btc", 100_000.0, 200).select("source", "tx_hash", "event_id", R("amount_usd", 2).alias("amount_usd"), "ts_ms"), f"WITH {_DT} SELECT source, tx_hash, event_id, round(amount_usd,2) AS amount_usd, ts_ms FROM dt WHERE source='whale_alert' AND lower(asset)='btc' AND amount_usd >= 100000 ORDER BY ts_ms DESC, event_id DESC, tie DESC LIMIT 200")
_ID = "CASE WHEN symbol LIKE '%USDT' THEN substr(symbol,1,length(symbol)-4) || '-USDT-' || upper(market) END"
register("envelopes", lambda s, d: state.envelopes(ticks(s, d)).select("version", "domain", F.col("source_ref.source").alias("source"), "instrument_ref.instrument_id", "freshness.latency_ms", "freshness.stale", R("payload.bid", 4).alias("bid")), f"SELECT 'v1' AS version, 'market_quote' AS domain, exchange AS source, {_ID} AS instrument_id, latency_ms, stale, round(bid,4) AS bid FROM lt")
register("finite_events", lambda s, d: state.finite_events(A.quotes(s, d).withColumn("mark", F.expr("case when event_id % 13 = 0 then cast('NaN' as double) when event_id % 17 = 0 then cast('Infinity' as double) else mark end")), ["bid", "ask", "mark", "funding_rate"]).select("event_id", R("bid", 4).alias("bid")), "SELECT event_id, round(bid,4) AS bid FROM quotes WHERE event_id % 13 <> 0 AND event_id % 17 <> 0")
register("instruments", lambda s, d: state.instruments(ticks(s, d), A.options_raw(s, d), A.prediction_events(s, d)), f"SELECT id AS instrument_id, arg_min(kind, r) AS kind FROM (SELECT {_ID} AS id, 'market' AS kind, 0 AS r FROM lt UNION ALL SELECT instrument_name, 'option', 1 FROM options_raw UNION ALL SELECT asset_id, 'prediction', 2 FROM pe) GROUP BY 1")
register(
    "catalog_health", lambda s, d: state.catalog_health(
        ticks(s, d).select(F.col("exchange").alias("source"), F.lit("market_quote").alias("domain"), "stale", "ts_ms"),
        state.with_freshness(state.latest(A.prediction_events(s, d), ("asset_id",)), now(s, d), TTL).select(F.lit("polymarket").alias("source"), F.lit("prediction_book").alias("domain"), "stale", "ts_ms"),
        A.options_raw(s, d).select(F.col("venue").alias("source"), F.lit("option_chain").alias("domain"), F.expr("received_at_ms < 1700001200000").alias("stale"), F.col("received_at_ms").alias("ts_ms"))),
    "SELECT source, domain, count(*) AS records, count(*) FILTER (stale) AS stale_records, max(ts_ms) AS last_received_ms, CASE WHEN count(*) FILTER (stale) = 0 THEN 'healthy' WHEN count(*) FILTER (stale) = count(*) THEN 'stale' ELSE 'degraded' END AS status FROM ("
    "SELECT exchange AS source, 'market_quote' AS domain, stale, ts_ms FROM lt UNION ALL SELECT 'polymarket', 'prediction_book', t - ts_ms > 7200000, ts_ms FROM (SELECT * FROM pe QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts_ms DESC, event_id DESC)=1), now"
    " UNION ALL SELECT venue, 'option_chain', received_at_ms < 1700001200000, received_at_ms FROM options_raw) GROUP BY 1, 2",
)
_DOMAINS = ("quotes", "funding", "open_interest", "trades", "liquidations", "signals", "order_books")
register("event_counts", lambda s, d: state.event_counts(*[(n, getattr(A, n)(s, d)) for n in _DOMAINS]), " UNION ALL ".join(f"SELECT '{n}' AS type, count(*) AS events FROM {n}" for n in _DOMAINS[:-1]) + " UNION ALL SELECT 'order_books', count(DISTINCT event_id) FROM lv")
register("asof_mid", lambda s, d: rounded(state.asof_mid(A.liquidations(s, d).withColumn("market", F.lit("spot")), A.quotes(s, d))), "SELECT l.exchange, 'spot' AS market, l.symbol, l.event_id, round(q.mid,4) AS asof_mid FROM liquidations l ASOF LEFT JOIN (SELECT exchange, symbol, (bid+ask)/2 AS mid, ts_ms*1000000::HUGEINT+event_id AS o FROM quotes WHERE market='spot' AND bid>0 AND ask>=bid) q ON l.exchange=q.exchange AND l.symbol=q.symbol AND l.ts_ms*1000000::HUGEINT+l.event_id >= q.o")


def _bundle(s, d):
    q = ticks(s, d).select("symbol", "exchange", "market", R("bid", 4).alias("value"))
    f = last("funding", ("exchange", "symbol"))(s, d).select("symbol", "exchange", F.lit("perp").alias("market"), R("funding_rate", 6).alias("value"))
    o = last("open_interest", ("exchange", "symbol"))(s, d).select("symbol", "exchange", F.lit("perp").alias("market"), R("open_interest", 4).alias("value"))
    return state.context_bundle(7, quotes=q, funding=f, open_interest=o)


register("context_bundle", _bundle, " UNION ALL ".join(f"(SELECT '{n}' AS section, symbol, exchange AS source, market, value FROM ({q}) ORDER BY symbol, exchange, market LIMIT 7)" for n, q in {
    "quotes": "SELECT symbol, exchange, market, round(bid,4) AS value FROM lt", "funding": "SELECT symbol, exchange, 'perp' AS market, round(funding_rate,6) AS value FROM funding " + _last.format("exchange, symbol"),
    "open_interest": "SELECT symbol, exchange, 'perp' AS market, round(open_interest,4) AS value FROM open_interest " + _last.format("exchange, symbol")}.items()))

# bars
_MID = "(SELECT exchange, market, symbol, (bid+ask)/2 AS mid, ts_ms, event_id FROM quotes WHERE (bid+ask)/2 > 0)"
_BARS = "SELECT exchange, market, symbol, '{0}' AS interval, ts_ms // {1} * {1} AS open_time_ms, ts_ms // {1} * {1} + {1} - 1 AS close_time_ms, round(arg_min(mid, (ts_ms, event_id)),4) AS open, round(max(mid),4) AS high, round(min(mid),4) AS low, round(arg_max(mid, (ts_ms, event_id)),4) AS close FROM " + _MID + " GROUP BY ALL"
register("klines", lambda s, d: rounded(bars.klines(A.quotes(s, d), ("1h", "4h", "1d")).drop("volume")), " UNION ALL ".join(_BARS.format(k, v) for k, v in (("1h", H1), ("4h", H4), ("1d", D1))))
register("kline_upsert", lambda s, d: rounded(bars.kline_upsert(A.klines_daily(s, d), A.klines_daily(s, d).where("symbol = 'BTCUSDT'").withColumn("close", F.col("close") + 1)).select(*bars.BAR, "open_time_ms", "close", "updated_at_ms")), "SELECT exchange, market, symbol, interval, open_time_ms, round(close + CASE WHEN symbol='BTCUSDT' THEN 1 ELSE 0 END,4) AS close, updated_at_ms FROM kl")
register("klines_query", lambda s, d: rounded(bars.klines_query(A.klines_daily(s, d), "binance", "spot", None, "1d", 800_000_000_000, 980_000_000_000, 300).select(*bars.BAR, "open_time_ms", "close", "volume")), "SELECT exchange, market, symbol, interval, open_time_ms, round(close,4) AS close, round(volume,4) AS volume FROM kl WHERE exchange='binance' AND market='spot' AND open_time_ms BETWEEN 800000000000 AND 980000000000 ORDER BY open_time_ms DESC, exchange, market, symbol, interval LIMIT 300")
_DAYKL = "(SELECT *, strftime(make_timestamp(open_time_ms*1000), '%Y-%m-%d') AS day FROM kl)"


def _quality(s, d):
    fine = bars.klines(A.quotes(s, d), ("1h",)).withColumn("updated_at_ms", F.expr("open_time_ms + 3600000 + open_time_ms div 3600000 % 7 * 900000"))
    return rounded(bars.lake_quality(fine.unionByName(fine.where("open_time_ms div 3600000 % 5 = 0"))), 6)


_HB = "hb0 AS (SELECT DISTINCT exchange, market, symbol, '1h' AS interval, ts_ms // 3600000 * 3600000 AS o FROM quotes WHERE (bid+ask)/2 > 0), hb AS (SELECT *, strftime(make_timestamp(o*1000), '%Y-%m-%d') AS day, o + 3600000 + (o // 3600000) % 7 * 900000 AS u, greatest(o + 3600000 + (o // 3600000) % 7 * 900000 - (o + 3599999), 0) AS lat FROM (SELECT * FROM hb0 UNION ALL SELECT * FROM hb0 WHERE o // 3600000 % 5 = 0)), hg AS (SELECT exchange, market, symbol, interval, day, sum(CASE WHEN dd > 3600000 THEN dd // 3600000 - 1 ELSE 0 END)::BIGINT AS gaps, count(*) AS dr FROM (SELECT *, o - lag(o) OVER (PARTITION BY exchange, market, symbol, interval, day ORDER BY o) AS dd FROM (SELECT DISTINCT exchange, market, symbol, interval, day, o FROM hb)) GROUP BY ALL)"
register("lake_quality", _quality, f"WITH {_HB} SELECT exchange, market, symbol, interval, day, count(*) AS row_count, min(o) AS first_ts, max(o) AS last_ts, max(u) AS watermark_ms, count(*) - any_value(dr) AS duplicates, any_value(gaps) AS gaps, round(least(any_value(dr) / ((max(o)-min(o)) // 3600000 + 1), 1),6) AS coverage, list_sort(list(lat))[(count(*)-1)*50//100+1] AS latency_p50, list_sort(list(lat))[(count(*)-1)*95//100+1] AS latency_p95, count(*) FILTER (lat > 3600000) AS stale_count FROM hb JOIN hg USING (exchange, market, symbol, interval, day) GROUP BY ALL")


def _manifest(s, d):
    q = bars.lake_quality(A.klines_daily(s, d))
    return bars.lake_manifest(q.withColumn("created_at_ms", F.lit(1).cast("long")), q.where("market = 'spot'").withColumn("created_at_ms", F.lit(2).cast("long")))


_MAN = f"mf AS (SELECT exchange, market, symbol, interval, day, count(*) * any_value(CASE WHEN market='spot' THEN 2 ELSE 1 END) AS row_count, 0 AS duplicates, 0 AS stale_count, min(open_time_ms) AS first_ts, max(open_time_ms) AS last_ts, max(updated_at_ms) AS watermark_ms, 1.0::DOUBLE AS coverage, any_value(CASE WHEN market='spot' THEN 2 ELSE 1 END) AS created_at_ms FROM {_DAYKL} GROUP BY ALL)"
register("lake_manifest", lambda s, d: rounded(_manifest(s, d)), f"WITH {_MAN} SELECT * FROM mf")
register("manifest_query", lambda s, d: rounded(bars.manifest_query(_manifest(s, d), 50, exchange="okx", market="spot", symbol="")), f"WITH {_MAN} SELECT * FROM mf WHERE exchange='okx' AND market='spot' ORDER BY last_ts DESC, exchange, market, symbol, interval, day LIMIT 50")


def _lake(s, d, delete=False):
    """All daily bars written to the lake by year and counted per partition read back."""
    root = shared_dir(s, "lake")
    b = A.klines_daily(s, d)
    bars.lake_write(b.withColumn("open_time_ms", F.expr("open_time_ms div 31536000000 * 31536000000")), root, "spot")
    if delete:
        return bars.lake_delete(s, root, exchange="okx", market="perp").select(F.regexp_extract("path", "(exchange=.*)$", 1).alias("partition"), "rows")
    return s.read.parquet(root).groupBy("exchange", "market", "symbol", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"))


_YEAR = "strftime(make_timestamp(open_time_ms // 31536000000 * 31536000000 * 1000), '%Y-%m-%d')"
register("lake_write", _lake, f"SELECT exchange, market, symbol, {_YEAR} AS day, count(*) AS rows FROM kl GROUP BY ALL")
register("lake_delete", lambda s, d: _lake(s, d, True), f"SELECT 'exchange=okx/market=perp/symbol=' || symbol || '/interval=1d/candle_type=spot/day=' || {_YEAR} AS partition, count(*) AS rows FROM kl WHERE exchange='okx' AND market='perp' GROUP BY ALL")


def _versions(s, d):
    """The manifest and the lake after a delete, partition by partition: they must agree."""
    root, manifest = shared_dir(s, "lake"), shared_dir(s, "manifest")
    bars.lake_write(A.klines_daily(s, d).withColumn("open_time_ms", F.expr("open_time_ms div 31536000000 * 31536000000")), root, "spot")
    bars.commit_manifest(s, manifest, bars.lake_files(s, root))
    bars.lake_delete(s, root, manifest, exchange="okx", market="perp")
    listed = bars.read_manifest(s, manifest).select("exchange", "market", "symbol", "day", F.col("rows").alias("manifest_rows"))
    there = bars.lake_files(s, root).select("exchange", "market", "symbol", "day", F.col("rows").alias("lake_rows"))
    return listed.join(there, ["exchange", "market", "symbol", "day"], "full")


register("lake_versions", _versions, f"SELECT exchange, market, symbol, {_YEAR} AS day, count(*) AS manifest_rows, count(*) AS lake_rows FROM kl WHERE NOT (exchange='okx' AND market='perp') GROUP BY ALL")
_B = "exchange, market, symbol, interval"
register("top_volume", lambda s, d: rounded(bars.top_volume(A.klines_daily(s, d), limit=20), 2), f"SELECT {_B}, round(sum(volume),2) AS base_volume, round(sum((open+high+low)/3*volume),2) AS quote_volume, count(*) AS bars FROM kl GROUP BY ALL ORDER BY sum((open+high+low)/3*volume) DESC, {_B} LIMIT 20")
_PC = f"pc AS (SELECT {_B}, arg_min(close, open_time_ms) AS first_close, arg_max(close, open_time_ms) AS last_close, count(*) AS bars FROM kl GROUP BY ALL)"
register("percent_change", lambda s, d: rounded(bars.percent_change(A.klines_daily(s, d), low=-90.0, order="asc", limit=25)), f"WITH {_PC} SELECT {_B}, round(first_close,4) AS first_close, round(last_close,4) AS last_close, bars, round((last_close-first_close)/first_close*100,4) AS change_pct FROM pc WHERE first_close>0 AND (last_close-first_close)/first_close*100 >= -90 ORDER BY (last_close-first_close)/first_close, {_B} LIMIT 25")
_RET = f"rt AS (SELECT *, ln(close/prev) AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY {_B} ORDER BY open_time_ms) AS prev FROM kl) WHERE close>0 AND prev>0)"
_VOL = f"rv AS (SELECT {_B}, stddev_pop(ret)*sqrt(count(*)) AS realized_vol, count(*) AS n_returns FROM rt GROUP BY ALL)"
_Z = f"zs AS (SELECT {_B}, CASE WHEN count(*)>=2 AND stddev_pop(close)>0 THEN (arg_max(close, open_time_ms)-avg(close))/stddev_pop(close) END AS close_zscore FROM kl GROUP BY ALL)"
_CORR = f"r2 AS (SELECT *, row_number() OVER (PARTITION BY {_B} ORDER BY open_time_ms DESC) AS i FROM rt), cr AS (SELECT a.exchange, a.market, a.symbol, a.interval, count(*) AS pairs, CASE WHEN stddev_pop(a.ret)>0 AND stddev_pop(b.ret)>0 THEN covar_pop(a.ret,b.ret)/(stddev_pop(a.ret)*stddev_pop(b.ret)) END AS correlation FROM r2 a JOIN r2 b ON a.exchange=b.exchange AND a.market=b.market AND a.interval=b.interval AND a.i=b.i AND b.symbol='BTCUSDT' AND a.symbol<>'BTCUSDT' GROUP BY ALL)"
register("realized_vol", lambda s, d: rounded(bars.realized_vol(A.klines_daily(s, d)), 6), f"WITH {_RET}, {_VOL} SELECT {_B}, round(realized_vol,6) AS realized_vol, n_returns FROM rv")
register("volatility", lambda s, d: rounded(bars.screen(bars.realized_vol(A.klines_daily(s, d)), "realized_vol", limit=10), 6), f"WITH {_RET}, {_VOL} SELECT {_B}, round(realized_vol,6) AS realized_vol, n_returns FROM rv ORDER BY rv.realized_vol DESC LIMIT 10")
register("close_zscore", lambda s, d: rounded(bars.close_zscore(A.klines_daily(s, d)), 6), f"WITH {_Z} SELECT {_B}, round(close_zscore,6) AS close_zscore FROM zs")
register("correlations", lambda s, d: rounded(bars.correlations(A.klines_daily(s, d), "BTCUSDT"), 6), f"WITH {_RET}, {_CORR} SELECT {_B}, pairs, round(correlation,6) AS correlation FROM cr")
_AGE = f"ag AS (SELECT {K}, min(open_time_ms) AS first_open_ms, max(open_time_ms) AS last_open_ms, count(*) AS bars, (1000000000000-min(open_time_ms))/86400000::DOUBLE AS age_days FROM kl GROUP BY ALL)"
register("age_filter", lambda s, d: rounded(bars.age_filter(A.klines_daily(s, d), 1_000_000_000_000, 100.0), 6), f"WITH {_AGE} SELECT {K}, first_open_ms, last_open_ms, bars, round(age_days,6) AS age_days FROM ag WHERE age_days>=100")
_NEW = "nl AS (SELECT *, (986000000000-min(open_time_ms) OVER (PARTITION BY exchange, market, symbol))/86400000::DOUBLE AS a FROM kl WHERE open_time_ms > 975000000000)"
register("new_listings", lambda s, d: rounded(bars.age_filter(A.klines_daily(s, d).where("open_time_ms > 975000000000"), 986_000_000_000, None, 130.0), 6), f"WITH {_NEW} SELECT {K}, min(open_time_ms) AS first_open_ms, max(open_time_ms) AS last_open_ms, count(*) AS bars, round(any_value(a),6) AS age_days FROM nl WHERE a<=130 GROUP BY ALL")
register("delist_risk", lambda s, d: bars.delist_risk(A.klines_daily(s, d), ticks(s, d).where("symbol <> 'SOLUSDT'"), now(s, d), 1_800_000), f"SELECT k.exchange, k.market, k.symbol, CASE WHEN l.ts_ms IS NULL THEN 'high' ELSE 'medium' END AS risk, t - l.ts_ms AS age_ms FROM (SELECT DISTINCT {K} FROM kl) k LEFT JOIN (SELECT * FROM lt WHERE symbol<>'SOLUSDT') l USING ({K}) WHERE l.ts_ms IS NULL OR t - l.ts_ms > 1800000")
register("failed_high", lambda s, d: rounded(bars.failed_high(A.klines_daily(s, d))), f"WITH fh AS (SELECT *, row_number() OVER (PARTITION BY {_B} ORDER BY open_time_ms DESC) AS i FROM kl) SELECT {_B}, round((max(close) FILTER (i=1)-arg_min(open,open_time_ms))/arg_min(open,open_time_ms)*100,4) AS return_pct, max(high) FILTER (i<=10) > max(high) FILTER (i>10) AND max(close) FILTER (i=1) < max(high) FILTER (i<=10)*0.997::DOUBLE AS failed_high FROM fh GROUP BY ALL")
_DIS = "dg AS (SELECT market, symbol, count(*) AS venues, (max((bid+ask)/2)-min((bid+ask)/2))/avg((bid+ask)/2)*10000 AS disagreement_bps FROM lt WHERE (bid+ask)/2>0 GROUP BY ALL HAVING count(*)>=2)"
register("exchange_disagreement", lambda s, d: rounded(bars.exchange_disagreement(ticks(s, d))), f"WITH {_DIS} SELECT market, symbol, venues, round(disagreement_bps,4) AS disagreement_bps FROM dg")


def features(s, d):
    return bars.research_features(A.klines_daily(s, d), state.market_states(A.unified_events(s, d), now(s, d), TTL))


_BS = f"bk AS (SELECT {K}, min(price) FILTER (side='bid' AND lvl=0) AS bid, min(price) FILTER (side='ask' AND lvl=0) AS ask, sum(price*qty) AS depth_notional FROM lb GROUP BY ALL), bks AS (SELECT *, depth_notional/(1+greatest((ask-bid)/((bid+ask)/2)*10000,0)) AS liquidity_score FROM bk WHERE bid>0 AND ask>=bid)"
_FEAT = f"{_BASIS}, {_RET}, {_VOL}, {_Z}, {_CORR}, {_DIS}, {_BS}, lf AS (SELECT * FROM funding {_last.format('exchange, symbol')}), lo AS (SELECT * FROM open_interest {_last.format('exchange, symbol')}), ft AS (SELECT k.exchange, k.market, k.symbol, k.interval, k.bars, CASE WHEN a>0 THEN (z-a)/a*100 END AS return_pct, k.volume, rv.realized_vol, zs.close_zscore, cr.correlation, lf.funding_rate, lo.open_interest, (bs.perp_mid-bs.spot_mid)/bs.spot_mid*10000 AS basis_bps, (lt.ask-lt.bid)/((lt.bid+lt.ask)/2)*10000 AS spread_bps, bks.depth_notional, bks.liquidity_score, dg.disagreement_bps FROM (SELECT {_B}, count(*) AS bars, arg_min(close,open_time_ms) AS a, arg_max(close,open_time_ms) AS z, sum(volume) AS volume FROM kl GROUP BY ALL) k LEFT JOIN rv USING ({_B}) LEFT JOIN zs USING ({_B}) LEFT JOIN cr USING ({_B}) LEFT JOIN lf ON k.exchange=lf.exchange AND k.symbol=lf.symbol LEFT JOIN lo ON k.exchange=lo.exchange AND k.symbol=lo.symbol LEFT JOIN bs ON k.exchange=bs.exchange AND k.symbol=bs.symbol LEFT JOIN lt ON k.exchange=lt.exchange AND k.market=lt.market AND k.symbol=lt.symbol LEFT JOIN bks ON k.exchange=bks.exchange AND k.market=bks.market AND k.symbol=bks.symbol LEFT JOIN dg ON k.market=dg.market AND k.symbol=dg.symbol)"
_NUM = ("return_pct", "volume", "realized_vol", "close_zscore", "correlation", "funding_rate", "open_interest", "basis_bps", "spread_bps", "depth_notional", "liquidity_score", "disagreement_bps")
_LABELS = "CASE WHEN basis_bps IS NULL THEN 'unknown' WHEN basis_bps>25 THEN 'perp_premium' WHEN basis_bps<-25 THEN 'perp_discount' ELSE 'flat' END AS basis_regime, CASE WHEN funding_rate>0.0003::DOUBLE THEN 'positive_funding' || CASE WHEN open_interest IS NOT NULL THEN '_with_oi' ELSE '' END WHEN funding_rate<-0.0003::DOUBLE THEN 'negative_funding' || CASE WHEN open_interest IS NOT NULL THEN '_with_oi' ELSE '' END WHEN funding_rate IS NOT NULL THEN 'neutral_funding' WHEN open_interest IS NOT NULL THEN 'oi_only' ELSE 'unknown' END AS funding_regime, CASE WHEN spread_bps>30 THEN 'wide_spread' WHEN liquidity_score>1000000 THEN 'deep' WHEN liquidity_score>100000 THEN 'normal' WHEN liquidity_score IS NOT NULL THEN 'thin' ELSE 'unknown' END AS liquidity_regime"
register("research_features", lambda s, d: rounded(features(s, d), 4), f"WITH {_FEAT} SELECT {_B}, bars, " + ", ".join(f"round({c},4) AS {c}" for c in _NUM) + f", {_LABELS} FROM ft")
register("market_regime", lambda s, d: rounded(bars.market_regime(features(s, d)), 4), f"WITH {_FEAT}, md AS (SELECT count(*) AS n_rows, " + ", ".join(f"median({c}) AS {c}" for c in ("disagreement_bps", "realized_vol", "funding_rate", "basis_bps", "liquidity_score")) + ") FROM ft)" .replace(") FROM ft)", " FROM ft)") + " SELECT n_rows, round(disagreement_bps,4) AS disagreement_bps, round(realized_vol,4) AS realized_vol, round(funding_rate,4) AS funding_rate, round(basis_bps,4) AS basis_bps, round(liquidity_score,4) AS liquidity_score, CASE WHEN disagreement_bps>20 THEN 'fragmented' WHEN realized_vol>0.08 THEN 'high_volatility' WHEN abs(funding_rate)>0.0005 THEN 'leveraged' ELSE 'normal' END AS regime FROM md")

# flow
_FLOW = f"fl0 AS (SELECT {K}, w AS window_ms, ts_ms // w * w AS bucket_start_ms, coalesce(sum(qty) FILTER (side='buy'),0) AS buy_qty, coalesce(sum(qty) FILTER (side='sell'),0) AS sell_qty, coalesce(sum(price*qty) FILTER (side='buy'),0) AS buy_notional, coalesce(sum(price*qty) FILTER (side='sell'),0) AS sell_notional, count(*) AS trade_count, count(*) FILTER (side='buy') AS buy_count, count(*) FILTER (side='sell') AS sell_count, count(*) FILTER (price*qty>=10000) AS large_trade_count FROM trades, (VALUES (3600000), (14400000), (86400000)) v(w) WHERE price*qty>0 GROUP BY ALL), fl AS (SELECT *, buy_qty-sell_qty AS delta_qty, buy_notional-sell_notional AS delta_notional, CASE WHEN buy_count+sell_count>0 THEN buy_count/(buy_count+sell_count) END AS aggressive_buy_ratio, CASE WHEN buy_count+sell_count>0 THEN sell_count/(buy_count+sell_count) END AS aggressive_sell_ratio, sum(buy_qty-sell_qty) OVER w AS cumulative_delta_qty, sum(buy_notional-sell_notional) OVER w AS cumulative_delta_notional FROM fl0 WINDOW w AS (PARTITION BY {K}, window_ms ORDER BY bucket_start_ms))"
_FC = f"{K}, window_ms, bucket_start_ms, trade_count, buy_count, sell_count, large_trade_count, " + ", ".join(f"round({c},4) AS {c}" for c in ("buy_qty", "sell_qty", "buy_notional", "sell_notional", "delta_qty", "delta_notional", "aggressive_buy_ratio", "aggressive_sell_ratio", "cumulative_delta_qty", "cumulative_delta_notional"))


def order_flow(s, d):
    return flow.order_flow(A.trades(s, d), (H1, H4, D1), 10_000.0)


register("order_flow", lambda s, d: rounded(order_flow(s, d)), f"WITH {_FLOW} SELECT {_FC} FROM fl")
register("order_flow_windows", lambda s, d: rounded(flow.order_flow_windows(order_flow(s, d))), f"WITH {_FLOW} SELECT {_FC} FROM fl QUALIFY row_number() OVER (PARTITION BY window_ms ORDER BY bucket_start_ms DESC, {K}) <= 50")
register("bucket_retention", lambda s, d: rounded(flow.bucket_retention(order_flow(s, d), now(s, d), 6)), f"WITH {_FLOW} SELECT {_FC} FROM (SELECT fl.* FROM fl, now WHERE t - bucket_start_ms <= 86400000) QUALIFY row_number() OVER (PARTITION BY {K}, window_ms ORDER BY bucket_start_ms DESC) <= 6")
_FP = f"fp AS (SELECT {K}, ts_ms//86400000*86400000 AS bucket_start_ms, CAST(round(price/20) AS BIGINT) AS bin, coalesce(sum(qty) FILTER (side='buy'),0) AS ask_qty, coalesce(sum(qty) FILTER (side='sell'),0) AS bid_qty, coalesce(sum(price*qty) FILTER (side='buy'),0) AS ask_notional, coalesce(sum(price*qty) FILTER (side='sell'),0) AS bid_notional, count(*) FILTER (side<>'unknown') AS trades FROM trades WHERE price*qty>0 GROUP BY ALL), fi AS (SELECT *, bin*20::DOUBLE AS price, ask_qty+bid_qty AS total_qty, ask_qty-bid_qty AS delta_qty, coalesce(ask_qty+bid_qty>=0 AND lead(ask_qty) OVER w>0 AND bid_qty>3*lead(ask_qty) OVER w, false) AS bid_imbalance, coalesce(lag(ask_qty+bid_qty) OVER w>=0 AND lag(bid_qty) OVER w>0 AND ask_qty>3*lag(bid_qty) OVER w, false) AS ask_imbalance FROM fp WINDOW w AS (PARTITION BY {K}, bucket_start_ms ORDER BY bin))"
_FPC = f"{K}, bucket_start_ms, bin, trades, " + ", ".join(f"round({c},4) AS {c}" for c in ("ask_qty", "bid_qty", "ask_notional", "bid_notional", "price", "total_qty", "delta_qty"))


def fp_levels(s, d):
    return flow.footprint_levels(A.trades(s, d), D1, 20.0)


register("footprint_levels", lambda s, d: rounded(fp_levels(s, d)), f"WITH {_FP} SELECT {_FPC} FROM fi")
register("footprint_imbalance", lambda s, d: rounded(flow.footprint_imbalance(fp_levels(s, d))), f"WITH {_FP} SELECT {_FPC}, bid_imbalance, ask_imbalance FROM fi")
_ST = f"isl AS (SELECT *, row_number() OVER (PARTITION BY {K}, bucket_start_ms ORDER BY bin) - row_number() OVER (PARTITION BY {K}, bucket_start_ms, ask_imbalance ORDER BY bin) AS g FROM fi), st AS (SELECT *, row_number() OVER w AS pos, first_value(price) OVER w AS run_start_price FROM isl WHERE ask_imbalance WINDOW w AS (PARTITION BY {K}, bucket_start_ms, g ORDER BY bin))"
register("stacked_imbalance", lambda s, d: rounded(flow.stacked_imbalance(flow.footprint_imbalance(fp_levels(s, d)), "ask", 2)), f"WITH {_FP}, {_ST} SELECT {K}, bucket_start_ms, round(run_start_price,4) AS run_start_price, bin AS level_bin FROM st WHERE pos>=2")
_CD = f"rn AS (SELECT *, ts_ms//86400000*86400000 AS bucket_start_ms, CASE side WHEN 'buy' THEN qty WHEN 'sell' THEN -qty ELSE 0 END AS sg FROM trades), rn2 AS (SELECT *, sum(sg) OVER (PARTITION BY {K}, bucket_start_ms ORDER BY ts_ms, event_id) AS run FROM rn)"
register(
    "footprint", lambda s, d: rounded(flow.footprint(A.trades(s, d), D1, 20.0, stack=2).withColumns({"n_levels": F.size("levels"), "n_stacked_ask": F.size("stacked_ask")}).drop("levels", "stacked_bid", "stacked_ask")),
    f"WITH {_FP}, {_ST}, {_CD} SELECT {K}, bucket_start_ms, round(arg_min(price,(ts_ms,event_id)),4) AS open, round(max(price),4) AS high, round(min(price),4) AS low, round(arg_max(price,(ts_ms,event_id)),4) AS close, count(*) AS trade_count, round(sum(qty),4) AS total_qty, round(sum(sg),4) AS delta_qty, round(least(0,min(run)),4) AS min_delta_qty, round(greatest(0,max(run)),4) AS max_delta_qty, count(DISTINCT CAST(round(price/20) AS BIGINT)) AS n_levels, (SELECT count(*) FROM st WHERE pos>=2 AND st.exchange=rn2.exchange AND st.market=rn2.market AND st.symbol=rn2.symbol AND st.bucket_start_ms=rn2.bucket_start_ms) AS n_stacked_ask FROM rn2 GROUP BY exchange, market, symbol, bucket_start_ms",
)
_SGN = "CASE side WHEN 'buy' THEN price*qty WHEN 'sell' THEN -price*qty ELSE 0 END"
register("trade_imbalance", lambda s, d: rounded(flow.trade_imbalance(A.trades(s, d), now(s, d), 86_400_000), 4), f"SELECT {K}, round(sum({_SGN}),4) AS signed_notional, round(sum(abs({_SGN})),4) AS absolute_notional, count(*) AS n, round(CASE WHEN sum(abs({_SGN}))=0 THEN 0 ELSE sum({_SGN})/sum(abs({_SGN})) END,4) AS imbalance FROM trades, now WHERE t-ts_ms<=86400000 GROUP BY ALL")
register("liquidation_burst", lambda s, d: rounded(flow.trade_imbalance(A.liquidations(s, d), now(s, d), 86_400_000, ("exchange", "symbol")), 4), f"SELECT exchange, symbol, round(sum({_SGN}),4) AS signed_notional, round(sum(abs({_SGN})),4) AS absolute_notional, count(*) AS n, round(CASE WHEN sum(abs({_SGN}))=0 THEN 0 ELSE sum({_SGN})/sum(abs({_SGN})) END,4) AS imbalance FROM liquidations, now WHERE t-ts_ms<=86400000 GROUP BY ALL")
register("liquidation_15m", lambda s, d: rounded(flow.liquidation_totals(A.liquidations(s, d), now(s, d), 43_200_000)), "SELECT exchange, symbol, round(sum(price*qty) FILTER (side='buy'),4) AS buy_liquidation_notional, round(sum(price*qty) FILTER (side='sell'),4) AS sell_liquidation_notional FROM liquidations, now WHERE t-ts_ms<=43200000 AND price*qty>0 GROUP BY ALL")
register("tick_rate", lambda s, d: flow.tick_rate(A.quotes(s, d), 60_000), "SELECT market, symbol, exchange, ts_ms//60000*60000 AS bucket_start_ms, CAST(round(count(*)/60.0) AS BIGINT) AS rate FROM quotes GROUP BY ALL")
register("oi_change", lambda s, d: rounded(flow.oi_change(A.open_interest(s, d))), "SELECT exchange, symbol, event_id, ts_ms, round(open_interest,4) AS open_interest, round(open_interest-p,4) AS delta, round((open_interest-p)/p*100,4) AS change_pct FROM (SELECT *, lag(open_interest) OVER (PARTITION BY exchange, symbol ORDER BY ts_ms, event_id) AS p FROM open_interest) WHERE p>0")

# books
_EX = f"xp AS (SELECT event_id, {K}, ts_ms, side, price, qty, sum(CASE WHEN qty>0 AND price>0 THEN price*qty ELSE 0 END) OVER (PARTITION BY event_id, side ORDER BY lvl) AS cum FROM lv), xq AS (SELECT event_id, {K}, ts_ms, side, max(cum) AS tot, sum(CASE WHEN qty>0 THEN greatest(least(1000-(cum-price*qty), price*qty),0)/price ELSE 0 END) AS got FROM xp GROUP BY ALL), xr AS (SELECT event_id, {K}, ts_ms, max(CASE WHEN side='bid' AND tot>=1000 THEN 1000/got END) AS sell_price, max(CASE WHEN side='ask' AND tot>=1000 THEN 1000/got END) AS buy_price FROM xq GROUP BY ALL)"
register("exec_price", lambda s, d: rounded(books.exec_price(A.order_books(s, d), 1000.0), 6), f"WITH {_EX} SELECT event_id, {K}, ts_ms, round(sell_price,6) AS sell_price, round(buy_price,6) AS buy_price FROM xr")


def _press(k):
    return f"SELECT event_id, {K}, coalesce(sum(price*qty) FILTER (side='bid'),0) AS bid_notional, coalesce(sum(price*qty) FILTER (side='ask'),0) AS ask_notional FROM lv WHERE lvl<{k} GROUP BY ALL"


register("depth_pressure", lambda s, d: rounded(books.depth_pressure(A.order_books(s, d)), 6), f"WITH dp AS ({_press(5)}) SELECT event_id, {K}, round(bid_notional,6) AS bid_notional, round(ask_notional,6) AS ask_notional, round(CASE WHEN bid_notional+ask_notional>0 THEN (bid_notional-ask_notional)/(bid_notional+ask_notional) END,6) AS pressure FROM dp")
register("depth_ratio", lambda s, d: rounded(books.depth_ratio(A.order_books(s, d)), 6), f"WITH dp AS ({_press(10)}) SELECT event_id, {K}, round(bid_notional,6) AS bid_notional, round(ask_notional,6) AS ask_notional, round((bid_notional-ask_notional)/(bid_notional+ask_notional),6) AS pressure, round(CASE WHEN ask_notional>0 THEN bid_notional/ask_notional END,6) AS ratio FROM dp WHERE market='perp'")
register("book_stats", lambda s, d: rounded(books.book_stats(last("order_books", KEY)(s, d)), 4), f"WITH {_BS} SELECT {K}, round(bid,4) AS bid, round(ask,4) AS ask, round(depth_notional,4) AS depth_notional, round(liquidity_score,4) AS liquidity_score FROM bks")
register("weakest_ratio", lambda s, d: rounded(books.weakest_ratio(last("order_books", KEY)(s, d)), 6), "SELECT symbol, round(min(r),6) AS weakest_ratio FROM (SELECT exchange, symbol, sum(price*qty) FILTER (side='bid')/sum(price*qty) FILTER (side='ask') AS r FROM lb WHERE market='perp' GROUP BY ALL) GROUP BY ALL")
_OFI = "tp AS (SELECT event_id, exchange, symbol, ts_ms, max(price) FILTER (side='bid') AS bp, max(qty) FILTER (side='bid') AS bq, max(price) FILTER (side='ask') AS ap, max(qty) FILTER (side='ask') AS aq FROM lv WHERE lvl=0 AND market='perp' GROUP BY ALL), tq AS (SELECT *, lag(bp) OVER w AS pbp, lag(bq) OVER w AS pbq, lag(ap) OVER w AS pap, lag(aq) OVER w AS paq FROM tp WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts_ms, event_id)), fo AS (SELECT event_id, exchange, symbol, ts_ms, (CASE WHEN bp>pbp THEN bq WHEN bp<pbp THEN -pbq ELSE bq-pbq END - CASE WHEN ap<pap THEN aq WHEN ap>pap THEN -paq ELSE aq-paq END) * CASE WHEN bp>0 AND ap>=bp THEN (bp+ap)/2 ELSE 1 END AS ofi FROM tq WHERE pbp IS NOT NULL)"
register("ofi", lambda s, d: rounded(books.ofi(A.order_books(s, d))), f"WITH {_OFI} SELECT event_id, exchange, symbol, ts_ms, round(ofi,4) AS ofi FROM fo")
register("option_depth", lambda s, d: books.option_depth(last("order_books", KEY)(s, d), 5).select(*KEY, F.size("bids").alias("n"), R(F.element_at("asks", -1).price, 4).alias("worst_ask"), "venue_depth"), f"SELECT {K}, count(*) FILTER (side='bid') AS n, round(max(price) FILTER (side='ask'),4) AS worst_ask, 10 AS venue_depth FROM lb WHERE lvl<5 GROUP BY ALL")

# signals
_CP = "cp AS (SELECT b.market, b.symbol, b.exchange AS buy_exchange, b.ask, s.exchange AS sell_exchange, s.bid FROM lt b JOIN lt s ON b.market=s.market AND b.symbol=s.symbol AND b.exchange<>s.exchange WHERE NOT b.stale AND NOT s.stale AND b.bid>0 AND s.bid>0 AND b.ask>0 AND s.ask>0 QUALIFY row_number() OVER (PARTITION BY b.market, b.symbol ORDER BY s.bid-b.ask DESC, b.exchange, s.exchange)=1)"
_PROFIT = "market, symbol, buy_exchange, round(ask,4) AS ask, sell_exchange, round(bid,4) AS bid, buy_fee_bps, sell_fee_bps, round(bid-ask,4) AS gross, round((bid-ask)/ask*10000,4) AS gross_bps, round(ask*buy_fee_bps/10000,4) AS buy_fee, round(bid*sell_fee_bps/10000,4) AS sell_fee, round((ask+bid)/2/10000,4) AS slip, round(bid-ask-ask*buy_fee_bps/10000-bid*sell_fee_bps/10000-(ask+bid)/2/10000,4) AS net, round((bid-ask-ask*buy_fee_bps/10000-bid*sell_fee_bps/10000-(ask+bid)/2/10000)/ask*10000,4) AS net_bps, bid-ask-ask*buy_fee_bps/10000-bid*sell_fee_bps/10000-(ask+bid)/2/10000>=1 AND (bid-ask-ask*buy_fee_bps/10000-bid*sell_fee_bps/10000-(ask+bid)/2/10000)/ask*10000>=0.5::DOUBLE AS eligible"
_TAKER = "(CASE {} WHEN 'binance' THEN 7.5 WHEN 'okx' THEN 8 ELSE 10 END)::DOUBLE"


def fees(s):
    return s.range(1).selectExpr("inline(array(struct('binance' as exchange, 1.5D as maker_bps, 7.5D as taker_bps), struct('okx' as exchange, 2.5D as maker_bps, 8D as taker_bps)))")


register("cross_pair", lambda s, d: rounded(signals.cross_pair(ticks(s, d))), f"WITH {_CP} SELECT market, symbol, buy_exchange, round(ask,4) AS ask, sell_exchange, round(bid,4) AS bid FROM cp")
register("spread_signal", lambda s, d: rounded(signals.spread_signal(ticks(s, d), fees(s))), f"WITH {_CP} SELECT {_PROFIT} FROM (SELECT *, {_TAKER.format('buy_exchange')} AS buy_fee_bps, {_TAKER.format('sell_exchange')} AS sell_fee_bps FROM cp)")


def book_prices(s, d):
    return books.exec_price(last("order_books", KEY)(s, d), 1000.0)


_BCP = f"{_EX}, xl AS (SELECT * FROM xr WHERE event_id IN (SELECT event_id FROM lb)), cp AS (SELECT b.market, b.symbol, b.exchange AS buy_exchange, b.buy_price AS ask, s.exchange AS sell_exchange, s.sell_price AS bid FROM xl b JOIN xl s ON b.market=s.market AND b.symbol=s.symbol AND b.exchange<>s.exchange WHERE b.buy_price IS NOT NULL AND s.sell_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY b.market, b.symbol ORDER BY s.sell_price-b.buy_price DESC, b.exchange, s.exchange)=1)"
register("book_cross_pair", lambda s, d: rounded(signals.book_cross_pair(book_prices(s, d))), f"WITH {_BCP} SELECT market, symbol, buy_exchange, round(ask,4) AS ask, sell_exchange, round(bid,4) AS bid FROM cp")
register("book_signal", lambda s, d: rounded(signals.book_signal(book_prices(s, d), None, "maker")), f"WITH {_BCP} SELECT {_PROFIT} FROM (SELECT *, 2::DOUBLE AS buy_fee_bps, 2::DOUBLE AS sell_fee_bps FROM cp)")


def _reports(s, d):
    f = flow.order_flow(A.trades(s, d), (D1,))
    return f.groupBy("market", "symbol", F.col("bucket_start_ms").alias("ts_ms")).agg((F.sum("delta_notional") > 0).alias("eligible"))


register("signal_state", lambda s, d: signals.signal_state(_reports(s, d), ("market", "symbol"), 2 * D1), "WITH rp AS (SELECT market, symbol, ts_ms//86400000*86400000 AS ts_ms, sum(CASE side WHEN 'buy' THEN price*qty WHEN 'sell' THEN -price*qty ELSE 0 END)>0 AS eligible FROM trades GROUP BY ALL), rq AS (SELECT *, count(*) FILTER (NOT eligible) OVER (PARTITION BY market, symbol ORDER BY ts_ms) AS g FROM rp) SELECT market, symbol, ts_ms, eligible, CASE WHEN NOT eligible THEN 'FILTERED' WHEN ts_ms - min(CASE WHEN eligible THEN ts_ms END) OVER (PARTITION BY market, symbol, g) >= 172800000 THEN 'TRIGGER' ELSE 'HOLDING' END AS state FROM rq")


def _tiers(s, d):
    tiers = s.range(1).selectExpr("explode(array('binance', 'okx', 'bybit')) as exchange").selectExpr("exchange", "inline(array(struct(50000D as min_volume, 10D as maker, 12D as taker), struct(100000D as min_volume, 8D as maker, 9D as taker), struct(200000D as min_volume, 6D as maker, 7D as taker)))")
    return signals.fee_tier(A.trades(s, d).groupBy("exchange", "market", "symbol").agg(F.sum("qty").alias("volume")).withColumn("volume", F.col("volume") * 20), tiers)


register("fee_tier", _tiers, f"SELECT {K}, volume, CASE WHEN volume>=200000 THEN 6 WHEN volume>=100000 THEN 8 ELSE 10 END::DOUBLE AS maker, CASE WHEN volume>=200000 THEN 7 WHEN volume>=100000 THEN 9 ELSE 12 END::DOUBLE AS taker FROM (SELECT {K}, sum(qty)*20 AS volume FROM trades GROUP BY ALL)")
register("funding_divergence", lambda s, d: rounded(signals.funding_divergence(last("funding", ("exchange", "symbol"))(s, d), now(s, d), TTL), 8), f"WITH fd AS (SELECT f.* FROM (SELECT * FROM funding {_last.format('exchange, symbol')}) f, now WHERE t-ts_ms<=7200000) SELECT symbol, arg_min(exchange, (funding_rate, exchange)) AS min_exchange, round(min(funding_rate),8) AS min_rate, arg_min(exchange, (-funding_rate, exchange)) AS max_exchange, round(max(funding_rate),8) AS max_rate, count(*) AS venues, round(max(funding_rate)-min(funding_rate),8) AS spread, round((max(funding_rate)-min(funding_rate))*10000,8) AS spread_bps FROM fd GROUP BY symbol HAVING count(*)>=2")
register("spread_filter", lambda s, d: rounded(signals.spread_filter(ticks(s, d), 60.0).select(*KEY, "mid", "spread_bps")), f"SELECT {K}, round((bid+ask)/2,4) AS mid, round((ask-bid)/((bid+ask)/2)*10000,4) AS spread_bps FROM lt WHERE NOT stale AND bid>0 AND ask>=bid AND (ask-bid)/((bid+ask)/2)*10000<=60")
register("cross_market", lambda s, d: signals.cross_market(ticks(s, d)).select("symbol", F.array_join("spot_sources", ",").alias("spot_sources"), F.array_join("perp_sources", ",").alias("perp_sources"), "has_both"), "SELECT symbol, string_agg(exchange, ',' ORDER BY exchange) FILTER (market='spot') AS spot_sources, string_agg(exchange, ',' ORDER BY exchange) FILTER (market='perp') AS perp_sources, true AS has_both FROM lt WHERE NOT stale GROUP BY symbol HAVING count(*) FILTER (market='spot')>0 AND count(*) FILTER (market='perp')>0")
register("market_cap", lambda s, d: rounded(signals.market_cap(last("signals", ("source", "category", "symbol", "metric"))(s, d), 10)), f"SELECT source, symbol, round(value,4) AS value, row_number() OVER (ORDER BY value DESC, source, symbol) AS rank FROM (SELECT * FROM signals {_last.format('source, category, symbol, metric')}) WHERE metric='market_cap' ORDER BY rank LIMIT 10")
