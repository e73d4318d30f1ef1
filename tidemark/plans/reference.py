"""Queries over coverage, scoring, listings, normalisers, options and prediction markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import bars, contracts, coverage, listings, normalize, scoring, state
from tidemark.plans.market import _OFI, K, last, now, ticks
from tidemark.plans.registry import D1, R, register, rounded
from tidemark.sources import adapters as A
from tidemark.sources import exports, schemas
from tidemark.sources.shared import shared_dir

ES = ("exchange", "symbol")


def pts(s, d):
    return coverage.points(ticks(s, d))


def _sym(s, d):
    return coverage.coverage_symbols(pts(s, d))


def _exc(s, d):
    return coverage.coverage_exchanges(pts(s, d), ["binance", "okx", "bybit", "kraken"])


def _summary(s, d):
    return coverage.coverage_summary(_sym(s, d), _exc(s, d), pts(s, d), ["binance", "okx", "bybit", "kraken"])


_PCT = "list_sort(list(latency_ms))[CAST(round((count(*)-1)*{}) AS BIGINT)+1]"
_CS0 = f"cs0 AS (SELECT market, symbol, count(*) AS exchanges_total, count(funding_rate) AS exchanges_with_funding, count(*) FILTER (stale) AS exchanges_stale, min(latency_ms) AS latency_ms_min, max(latency_ms) AS latency_ms_max, avg(latency_ms) AS latency_ms_avg, max(ts_ms) AS updated_at, count(funding_rate)/count(*) AS funding_coverage_ratio, count(*) FILTER (stale)/count(*) AS stale_ratio, {_PCT.format(0.5)} AS latency_ms_p50, {_PCT.format(0.95)} AS latency_ms_p95 FROM lt GROUP BY ALL)"
_CS = _CS0 + ", cs AS (SELECT *, CASE WHEN market='perp' AND exchanges_with_funding=0 THEN 'no funding available across exchanges' WHEN stale_ratio>=0.6::DOUBLE THEN 'critical stale ratio ' || printf('%.1f', stale_ratio*100) || '%' WHEN latency_ms_p95>=5000 THEN 'critical p95 latency ' || latency_ms_p95 || 'ms' END AS crit, concat_ws('; ', CASE WHEN exchanges_total<2 THEN 'single-exchange coverage' END, CASE WHEN stale_ratio>=0.25::DOUBLE THEN 'elevated stale ratio ' || printf('%.1f', stale_ratio*100) || '%' END, CASE WHEN latency_ms_p95>=1500 THEN 'elevated p95 latency ' || latency_ms_p95 || 'ms' END, CASE WHEN market='perp' AND exchanges_with_funding<2 THEN 'low funding coverage (' || exchanges_with_funding || '/' || exchanges_total || ')' END) AS warn FROM cs0), cv AS (SELECT * EXCLUDE (crit, warn), coalesce(crit, warn) AS alerts, CASE WHEN crit IS NOT NULL THEN 'critical' WHEN warn<>'' THEN 'warning' ELSE 'healthy' END AS health_status FROM cs)"
_CE = f"ce0 AS (SELECT exchange, count(*) FILTER (NOT stale)>0 AS online, count(DISTINCT market || ':' || symbol) AS symbols_total, count(DISTINCT symbol) FILTER (market='spot') AS spot_symbols, count(DISTINCT symbol) FILTER (market='perp') AS perp_symbols, count(*) AS points_total, count(*) FILTER (stale) AS stale_points, count(*) FILTER (market='perp') AS perp_points, count(funding_rate) AS funding_points, avg(latency_ms) AS latency_ms_avg, max(latency_ms) AS latency_ms_max, max(ts_ms) AS updated_at, {_PCT.format(0.5)} AS latency_ms_p50, {_PCT.format(0.95)} AS latency_ms_p95 FROM lt GROUP BY ALL UNION ALL SELECT 'kraken', false, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), ce1 AS (SELECT *, CASE WHEN points_total=0 THEN 0 ELSE stale_points/points_total END AS stale_ratio, CASE WHEN perp_points>0 THEN funding_points/perp_points ELSE 1 END AS funding_coverage_ratio FROM ce0), ce AS (SELECT *, CASE WHEN NOT online OR stale_ratio>=0.6::DOUBLE OR latency_ms_p95>=5000 THEN 'critical' WHEN stale_ratio>=0.25::DOUBLE OR latency_ms_p95>=1500 OR (perp_points>0 AND funding_coverage_ratio<0.5::DOUBLE) THEN 'warning' ELSE 'healthy' END AS health_status FROM ce1)"
_SUM = f"sm0 AS (SELECT count(*) AS total_symbols, sum(exchanges_total)::BIGINT AS total_points, count(*) FILTER (health_status='healthy') AS healthy_symbols, count(*) FILTER (health_status='warning') AS warning_symbols, count(*) FILTER (health_status='critical') AS critical_symbols, sum(exchanges_stale)::BIGINT AS stale_points, coalesce(sum(exchanges_total) FILTER (market='perp'),0)::BIGINT AS perp_points, coalesce(sum(exchanges_with_funding) FILTER (market='perp'),0)::BIGINT AS funding_points FROM cv), sm1 AS (SELECT count(*) FILTER (points_total>0) AS exchange_count_seen, count(*) FILTER (online) AS online_exchange_count, 4 AS expected_exchange_count FROM ce), sm2 AS (SELECT {_PCT.format(0.5)} AS latency_ms_p50, {_PCT.format(0.95)} AS latency_ms_p95 FROM lt), sm AS (SELECT *, stale_points/total_points AS stale_ratio, CASE WHEN perp_points>0 THEN funding_points/perp_points ELSE 1 END AS funding_coverage_ratio, online_exchange_count/expected_exchange_count AS exchange_online_ratio FROM sm0, sm1, sm2)"
_R6 = "round({0},6) AS {0}"


def r6(*names):
    return ", ".join(_R6.format(n) for n in names)


register("funding_view", lambda s, d: rounded(coverage.funding_view(ticks(s, d), include_stale=True).drop("points"), 8), "SELECT symbol, count(*) AS exchanges_total, count(funding_rate) AS exchanges_with_funding, round(min(funding_rate),8) AS min_funding, round(max(funding_rate),8) AS max_funding, max(ts_ms) AS updated_at, round(max(funding_rate)-min(funding_rate),8) AS funding_spread FROM lt WHERE market='perp' AND funding_rate IS NOT NULL GROUP BY symbol")
register("coverage_symbols", lambda s, d: rounded(_sym(s, d).withColumn("alerts", F.concat_ws("; ", "alerts")), 6), f"WITH {_CS} SELECT * REPLACE ({r6('funding_coverage_ratio', 'stale_ratio', 'latency_ms_avg')}) FROM cv")
register("coverage_exchanges", lambda s, d: rounded(_exc(s, d), 6), f"WITH {_CE} SELECT * REPLACE ({r6('funding_coverage_ratio', 'stale_ratio', 'latency_ms_avg')}) FROM ce")
register("coverage_summary", lambda s, d: rounded(_summary(s, d), 6), f"WITH {_CS}, {_CE}, {_SUM} SELECT * REPLACE ({r6('funding_coverage_ratio', 'stale_ratio', 'exchange_online_ratio')}) FROM sm")
register("coverage_markets", lambda s, d: rounded(coverage.coverage_markets(_sym(s, d)), 6), f"WITH {_CS} SELECT market, count(*) AS symbols, sum(exchanges_total)::BIGINT AS points, count(*) FILTER (health_status='healthy') AS healthy_symbols, count(*) FILTER (health_status='warning') AS warning_symbols, count(*) FILTER (health_status='critical') AS critical_symbols, round(sum(exchanges_stale)/sum(exchanges_total),6) AS stale_ratio, round(CASE WHEN market='perp' THEN sum(exchanges_with_funding)/sum(exchanges_total) ELSE 1 END,6) AS funding_coverage_ratio, round(sum(exchanges_total)/count(*),6) AS avg_exchanges_per_symbol FROM cv GROUP BY market")
register("coverage_alerts", lambda s, d: coverage.coverage_alerts(_sym(s, d), _exc(s, d), _summary(s, d)), f"WITH {_CS}, {_CE}, {_SUM} SELECT health_status AS level, 'symbol' AS scope, market || ':' || symbol AS target, alerts AS message FROM cv WHERE health_status<>'healthy' UNION ALL SELECT health_status, 'exchange', exchange, CASE WHEN NOT online THEN 'exchange currently offline (no fresh points)' WHEN stale_ratio>=0.6::DOUBLE THEN 'high stale ratio ' || printf('%.1f', stale_ratio*100) || '%' WHEN latency_ms_p95>=1500 THEN 'elevated p95 latency ' || latency_ms_p95 || 'ms' ELSE 'exchange quality degraded' END FROM ce WHERE health_status<>'healthy' UNION ALL SELECT 'warning', 'global', 'coverage', 'online exchange ratio ' || printf('%.1f', exchange_online_ratio*100) || '% (' || online_exchange_count || '/' || expected_exchange_count || ')' FROM sm WHERE exchange_online_ratio<1 UNION ALL SELECT CASE WHEN stale_ratio>=0.6::DOUBLE THEN 'critical' ELSE 'warning' END, 'global', 'coverage', 'global stale ratio ' || printf('%.1f', stale_ratio*100) || '%' FROM sm WHERE stale_ratio>=0.25::DOUBLE")


def metrics(s, d):
    return scoring.symbol_metrics(A.unified_events(s, d), now(s, d), D1, D1)


_SG = "CASE side WHEN 'buy' THEN price*qty WHEN 'sell' THEN -price*qty ELSE 0 END"
_MET = f"""{_OFI}, pr AS (SELECT exchange, symbol, ts_ms, event_id, 0 AS r, coalesce(mark, (bid+ask)/2) AS price FROM quotes WHERE bid>0 AND ask>=bid UNION ALL SELECT exchange, symbol, ts_ms, event_id, 1, mark_price FROM funding
 UNION ALL SELECT exchange, symbol, ts_ms, event_id, 2, price FROM trades WHERE side<>'unknown' UNION ALL SELECT exchange, symbol, ts_ms, event_id, 3, price FROM liquidations UNION ALL SELECT exchange, symbol, ts_ms, event_id, 4, (bp+ap)/2 FROM tp WHERE bp>0 AND ap>=bp),
 m1 AS (SELECT exchange, symbol, arg_max(price, (ts_ms, event_id, r)) AS latest_price FROM pr GROUP BY ALL), m2 AS (SELECT exchange, symbol, arg_max(funding_rate, (ts_ms, event_id)) AS funding_rate FROM funding GROUP BY ALL),
 m3 AS (SELECT exchange, symbol, arg_max(open_interest, (ts_ms, event_id)) AS open_interest FROM open_interest GROUP BY ALL),
 m4 AS (SELECT exchange, symbol, arg_max((open_interest-p)/p*100, (ts_ms, event_id)) AS oi_change_pct FROM (SELECT *, lag(open_interest) OVER (PARTITION BY exchange, symbol ORDER BY ts_ms, event_id) AS p FROM open_interest) WHERE p>0 GROUP BY ALL),
 m5 AS (SELECT exchange, symbol, sum({_SG}) FILTER (market='spot') AS spot_cvd, sum({_SG}) FILTER (market='perp') AS perp_cvd FROM trades, now WHERE t-ts_ms<=86400000 AND side<>'unknown' GROUP BY ALL),
 m6 AS (SELECT exchange, symbol, sum(price*qty) FILTER (side='buy') AS buy_liquidation, sum(price*qty) FILTER (side='sell') AS sell_liquidation FROM liquidations, now WHERE t-ts_ms<=86400000 GROUP BY ALL),
 m7 AS (SELECT exchange, symbol, sum(price*qty) FILTER (side='bid') AS bid_depth, sum(price*qty) FILTER (side='ask') AS ask_depth FROM (SELECT * FROM lv WHERE market='perp' QUALIFY dense_rank() OVER (PARTITION BY exchange, symbol ORDER BY ts_ms DESC, event_id DESC)=1) GROUP BY ALL),
 m8 AS (SELECT exchange, symbol, sum(ofi) AS ofi FROM fo, now WHERE t-ts_ms<=86400000 GROUP BY ALL),
 mt AS (SELECT *, CASE WHEN spot_cvd>0 AND perp_cvd<0 THEN 'spot_up_perp_down' WHEN spot_cvd<0 AND perp_cvd>0 THEN 'spot_down_perp_up' WHEN spot_cvd>0 AND perp_cvd>0 THEN 'both_up' WHEN spot_cvd<0 AND perp_cvd<0 THEN 'both_down' WHEN spot_cvd IS NOT NULL AND perp_cvd IS NOT NULL THEN 'flat_or_mixed' END AS cvd_divergence, CASE WHEN ask_depth>0 THEN bid_depth/ask_depth END AS depth_ratio, CASE WHEN bid_depth+ask_depth>0 THEN (bid_depth-ask_depth)/(bid_depth+ask_depth) END AS depth_pressure
 FROM m1 FULL JOIN m2 USING (exchange, symbol) FULL JOIN m3 USING (exchange, symbol) FULL JOIN m4 USING (exchange, symbol) FULL JOIN m5 USING (exchange, symbol) FULL JOIN m6 USING (exchange, symbol) FULL JOIN m7 USING (exchange, symbol) FULL JOIN m8 USING (exchange, symbol))"""
_MC = ("latest_price", "funding_rate", "open_interest", "oi_change_pct", "spot_cvd", "perp_cvd", "buy_liquidation", "sell_liquidation", "bid_depth", "ask_depth", "ofi", "depth_ratio", "depth_pressure")
register("symbol_metrics", lambda s, d: rounded(metrics(s, d), 5), f"WITH {_MET} SELECT exchange, symbol, cvd_divergence, " + ", ".join(f"round({c},5) AS {c}" for c in _MC) + " FROM mt")
_SQ = _MET + """, sq0 AS (SELECT *, CASE WHEN funding_rate<=-0.0005::DOUBLE THEN 2 WHEN funding_rate<0 THEN 1 ELSE 0 END + CASE WHEN oi_change_pct>=15 THEN 3 WHEN oi_change_pct>=3 THEN 1 ELSE 0 END + CASE WHEN cvd_divergence='spot_up_perp_down' THEN 3 ELSE 0 END + CASE WHEN ofi>0 THEN 1 ELSE 0 END + CASE WHEN buy_liquidation>0 THEN 1 ELSE 0 END AS squeeze_score,
 CASE WHEN funding_rate>=0.0005::DOUBLE THEN 2 WHEN funding_rate>0 THEN 1 ELSE 0 END + CASE WHEN oi_change_pct<=-10 THEN 3 WHEN oi_change_pct<0 THEN 1 ELSE 0 END + CASE WHEN perp_cvd<0 THEN 1 ELSE 0 END + CASE WHEN depth_ratio<0.65::DOUBLE THEN 2 WHEN depth_ratio<1 THEN 1 ELSE 0 END + CASE WHEN ofi<0 THEN 1 ELSE 0 END AS exhaustion_score FROM mt),
 sq AS (SELECT *, CASE WHEN squeeze_score>=8 THEN 'triggered_long_squeeze' WHEN cvd_divergence='spot_up_perp_down' THEN 'spot_absorption' WHEN oi_change_pct>=3 THEN 'chip_accumulation' WHEN funding_rate<0 THEN 'short_crowding' ELSE 'neutral' END AS squeeze_state,
 CASE WHEN exhaustion_score>=8 THEN 'triggered_short_exhaustion' WHEN depth_ratio<0.65::DOUBLE THEN 'book_vacuum' WHEN oi_change_pct<0 THEN 'fuel_exhaustion' WHEN funding_rate>0 THEN 'long_crowding' ELSE 'neutral' END AS exhaustion_state FROM sq0)"""


def states(s, d):
    return scoring.exhaustion_state(scoring.squeeze_state(metrics(s, d)))


register("squeeze_state", lambda s, d: scoring.squeeze_state(metrics(s, d)).select(*ES, "squeeze_score", F.concat_ws(",", "squeeze_progress").alias("progress"), "squeeze_state", "squeeze_invalidated", F.concat_ws("; ", "squeeze_reasons").alias("reasons"), F.concat_ws("; ", "squeeze_invalidation").alias("invalidation")), f"WITH {_SQ} SELECT exchange, symbol, squeeze_score, concat_ws(',', CASE WHEN funding_rate<=-0.0005::DOUBLE THEN 'crowded_shorts' WHEN funding_rate<0 THEN 'short_bias' END, CASE WHEN oi_change_pct>=15 THEN 'oi_stack' WHEN oi_change_pct>=3 THEN 'oi_rising' END, CASE WHEN cvd_divergence='spot_up_perp_down' THEN 'spot_absorption' END, CASE WHEN ofi>0 THEN 'book_confirming' END, CASE WHEN buy_liquidation>0 THEN 'liquidation_fuel' END) AS progress, squeeze_state, coalesce(depth_pressure<-0.4::DOUBLE, false) AS squeeze_invalidated, concat_ws('; ', CASE WHEN funding_rate<=-0.0005::DOUBLE THEN 'funding deeply negative: ' || printf('%.4f', funding_rate*100) || '%' END, CASE WHEN oi_change_pct>=15 THEN 'OI expansion is extreme: +' || printf('%.2f', oi_change_pct) || '%' END, CASE WHEN cvd_divergence='spot_up_perp_down' THEN 'spot CVD up while perp CVD down' END) AS reasons, CASE WHEN depth_pressure<-0.4::DOUBLE THEN 'top-10 book is ask-heavy; squeeze needs aggressive buy confirmation' ELSE '' END AS invalidation FROM sq")
register("exhaustion_state", lambda s, d: states(s, d).select(*ES, "exhaustion_score", F.concat_ws(",", "exhaustion_progress").alias("progress"), "exhaustion_state", "exhaustion_invalidated", F.concat_ws("; ", "exhaustion_reasons").alias("reasons"), F.concat_ws("; ", "exhaustion_invalidation").alias("invalidation")), f"WITH {_SQ} SELECT exchange, symbol, exhaustion_score, concat_ws(',', CASE WHEN funding_rate>=0.0005::DOUBLE THEN 'crowded_longs' WHEN funding_rate>0 THEN 'long_bias' END, CASE WHEN oi_change_pct<=-10 THEN 'fuel_exhausted' WHEN oi_change_pct<0 THEN 'oi_slipping' END, CASE WHEN perp_cvd<0 THEN 'sell_flow_confirming' END, CASE WHEN depth_ratio<0.65::DOUBLE THEN 'book_vacuum' WHEN depth_ratio<1 THEN 'bids_weaker_than_asks' END, CASE WHEN ofi<0 THEN 'ofi_negative' END) AS progress, exhaustion_state, coalesce(buy_liquidation>0, false) AS exhaustion_invalidated, concat_ws('; ', CASE WHEN funding_rate>=0.0005::DOUBLE THEN 'funding extremely positive: ' || printf('%.4f', funding_rate*100) || '%' END, CASE WHEN oi_change_pct<=-10 THEN 'OI dropped sharply: ' || printf('%.2f', oi_change_pct) || '%' END, CASE WHEN depth_ratio<0.65::DOUBLE THEN 'bid depth is thin versus asks: ' || printf('%.2f', depth_ratio) END) AS reasons, CASE WHEN buy_liquidation>0 THEN 'recent short liquidation fuel still exists; avoid early short without failed breakout confirmation' ELSE '' END AS invalidation FROM sq")
register("risk_context", lambda s, d: rounded(scoring.risk_context(states(s, d))), f"WITH {_SQ} SELECT exchange, symbol, round(CASE WHEN squeeze_state='triggered_long_squeeze' THEN latest_price*0.985::DOUBLE WHEN exhaustion_state='triggered_short_exhaustion' THEN latest_price*1.015::DOUBLE END,4) AS suggested_hard_stop, CASE WHEN squeeze_state='triggered_long_squeeze' OR exhaustion_state='triggered_short_exhaustion' THEN 150 END AS suggested_trailing_stop_bps FROM sq")
_MON = _MET + ", mo AS (SELECT symbol, min(funding_rate) AS min_funding, max(funding_rate) AS max_funding, max(oi_change_pct) AS max_oi_change, min(oi_change_pct) AS min_oi_change, sum(spot_cvd) AS spot_cvd, sum(perp_cvd) AS perp_cvd, sum(buy_liquidation) AS buy_liquidation, min(depth_ratio) AS weakest_ratio FROM mt GROUP BY symbol)"


def _monitor(s, d):
    m = metrics(s, d).groupBy("symbol").agg(
        F.min("funding_rate").alias("min_funding"), F.max("funding_rate").alias("max_funding"), F.max("oi_change_pct").alias("max_oi_change"), F.min("oi_change_pct").alias("min_oi_change"),
        F.sum("spot_cvd").alias("spot_cvd"), F.sum("perp_cvd").alias("perp_cvd"), F.sum("buy_liquidation").alias("buy_liquidation"), F.min("depth_ratio").alias("weakest_ratio"),
    )
    agg = A.signals(s, d).where("source = 'coinglass' and symbol is not null").groupBy("symbol").agg(F.max_by("value", F.struct("ts_ms", "event_id")).alias("aggregate_value"))
    high = bars.failed_high(A.klines_daily(s, d).where("exchange = 'binance' and market = 'perp'")).select("symbol", "failed_high")
    flows = state.dedupe_transfers(A.transfers(s, d))
    inflow = scoring.cex_inflow(flows, "BTC").unionByName(scoring.cex_inflow(flows, "ETH")).select(F.concat("asset", F.lit("USDT")).alias("symbol"), F.col("inflow_usd").alias("cex_inflow"))
    return m.join(agg, "symbol", "left").join(high, "symbol", "left").join(inflow, "symbol", "left")


_DT = "dt AS (SELECT * FROM transfers QUALIFY row_number() OVER (PARTITION BY source, chain, tx_hash ORDER BY ts_ms, event_id, tie) = 1), ci AS (SELECT upper(asset) AS asset, nullif(sum(amount_usd), 0) AS inflow_usd FROM dt WHERE regexp_matches(lower(to_address), 'binance|coinbase|okx|bybit|kraken|kucoin|gate') GROUP BY 1)"
register("cex_inflow", lambda s, d: rounded(scoring.cex_inflow(state.dedupe_transfers(A.transfers(s, d)), "BTC").unionByName(scoring.cex_inflow(state.dedupe_transfers(A.transfers(s, d)), "ETH")), 2), f"WITH {_DT} SELECT asset, round(inflow_usd,2) AS inflow_usd FROM ci")
register("squeeze_monitor", lambda s, d: scoring.squeeze_monitor(_monitor(s, d)).select("symbol", "score", "verdict"), f"WITH {_MON}, sc AS (SELECT symbol, CASE WHEN min_funding<=-0.0005::DOUBLE THEN 2 WHEN min_funding<0 THEN 1 ELSE 0 END + CASE WHEN max_oi_change>=3 THEN 2 WHEN max_oi_change>0 THEN 1 ELSE 0 END + CASE WHEN spot_cvd>0 AND perp_cvd<0 THEN 3 ELSE 0 END + CASE WHEN buy_liquidation>0 THEN 1 ELSE 0 END + CASE WHEN symbol IN (SELECT symbol FROM signals WHERE source='coinglass') THEN 1 ELSE 0 END AS score FROM mo) SELECT *, CASE WHEN score>=7 THEN 'strong squeeze setup' WHEN score>=4 THEN 'watchlist' ELSE 'not enough confluence' END AS verdict FROM sc")
register("exhaustion_monitor", lambda s, d: scoring.exhaustion_monitor(_monitor(s, d)).select("symbol", "score", "verdict"), f"WITH {_MON}, {_DT}, fh AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) AS i FROM kl WHERE exchange='binance' AND market='perp'), hi AS (SELECT symbol, max(high) FILTER (i<=10) > max(high) FILTER (i>10) AND max(close) FILTER (i=1) < max(high) FILTER (i<=10)*0.997::DOUBLE AS failed FROM fh GROUP BY symbol), sc AS (SELECT symbol, CASE WHEN max_funding>=0.0005::DOUBLE THEN 2 WHEN max_funding>0 THEN 1 ELSE 0 END + CASE WHEN failed THEN 2 ELSE 0 END + CASE WHEN min_oi_change<=-3 THEN 2 WHEN min_oi_change<0 THEN 1 ELSE 0 END + CASE WHEN perp_cvd<0 THEN 1 ELSE 0 END + CASE WHEN weakest_ratio<0.65::DOUBLE THEN 2 WHEN weakest_ratio<1 THEN 1 ELSE 0 END + CASE WHEN (SELECT max(inflow_usd) FROM ci WHERE asset || 'USDT' = symbol)>=1000000 THEN 1 ELSE 0 END AS score FROM mo LEFT JOIN hi USING (symbol)) SELECT *, CASE WHEN score>=8 THEN 'strong exhaustion short setup' WHEN score>=5 THEN 'watchlist' ELSE 'not enough confluence' END AS verdict FROM sc")

# listings and funding tables
LI = ("exchange", "market", "symbol", "native_symbol", "base", "quote", "active")
register("listings", lambda s, d: listings.listings_view(A.listings(s, d), ["binance", "okx"], "perp", None, "USDT").select(*LI), f"SELECT {', '.join(LI)} FROM listings WHERE active AND exchange IN ('binance','okx') AND market='perp' AND quote='USDT' ORDER BY exchange, market, symbol LIMIT 5000")
PF = ("exchange", "symbol", "active", "funding_rate", "funding_rate_pct", "ts_ms")
register("perp_funding", lambda s, d: rounded(listings.perp_funding_view(A.perp_funding(s, d), quote="usdc").select(*PF), 6), "SELECT exchange, symbol, active, round(funding_rate,6) AS funding_rate, round(funding_rate_pct,6) AS funding_rate_pct, ts_ms FROM pf WHERE coalesce(active, true) AND quote='USDC' ORDER BY exchange, symbol LIMIT 5000")
register("funding_extremes", lambda s, d: rounded(listings.funding_extremes(A.perp_funding(s, d), -2.05, -0.105).select("exchange", "symbol", "funding_rate_pct"), 6), "SELECT exchange, symbol, round(funding_rate_pct,6) AS funding_rate_pct FROM pf WHERE funding_rate_pct BETWEEN -2.05::DOUBLE AND -0.105::DOUBLE")
register("extremes_by_exchange", lambda s, d: listings.extremes_by_exchange(A.perp_funding(s, d), 1.505).select("exchange", "count", F.element_at("rows", 1).symbol.alias("first")), "SELECT exchange, count(*) AS count, arg_min(symbol, (funding_rate_pct, symbol)) AS first FROM pf WHERE funding_rate_pct<=-1.505::DOUBLE OR funding_rate_pct>=1.505::DOUBLE GROUP BY exchange")
register("funding_spread", lambda s, d: rounded(listings.funding_spread(A.perp_funding(s, d), 1.0001), 6), "SELECT symbol, count(*) AS exchanges, round(min(funding_rate_pct),6) AS min_pct, round(max(funding_rate_pct),6) AS max_pct, round(max(funding_rate_pct)-min(funding_rate_pct),6) AS spread_pct FROM pf GROUP BY symbol HAVING count(*)>=2 AND max(funding_rate_pct)-min(funding_rate_pct)>=1.0001::DOUBLE")
register("top_funding", lambda s, d: rounded(listings.top_funding(A.perp_funding(s, d), 20).select("exchange", "symbol", "funding_rate_pct"), 6), "SELECT exchange, symbol, round(funding_rate_pct,6) AS funding_rate_pct FROM pf ORDER BY pf.funding_rate_pct, exchange, symbol LIMIT 20")
register("watchlist", lambda s, d: listings.watchlist(listings.funding_extremes(A.perp_funding(s, d), -2.05, -0.505)), "SELECT DISTINCT symbol FROM pf WHERE funding_rate_pct BETWEEN -2.05::DOUBLE AND -0.505::DOUBLE")
register("missing_funding", lambda s, d: listings.missing_funding(A.listings(s, d), A.perp_funding(s, d)), "SELECT exchange, symbol FROM listings WHERE market='perp' AND active EXCEPT SELECT exchange, symbol FROM pf")
register("listings_fallback", lambda s, d: listings.listings_fallback(A.listings(s, d).where("p_partkey % 2 = 0 or exchange = 'okx'"), A.perp_funding(s, d), "A7").unionByName(listings.listings_fallback(A.listings(s, d), A.perp_funding(s, d), "A10")), "SELECT exchange, market, symbol, native_symbol, base, quote, 'discovery' AS source FROM listings WHERE (base='A7' AND exchange='okx') OR base='A10' UNION ALL SELECT exchange, 'perp', symbol, native_symbol, base, quote, 'funding' FROM pf WHERE base='A7' AND exchange<>'okx'")
register("perp_contracts", lambda s, d: listings.perp_contracts(A.listings(s, d)).select("exchange", "total", "returned", F.size("bases").alias("n_bases"), F.array_join("contracts", ",").alias("contracts")), "SELECT exchange, count(*) AS total, least(count(*),50) AS returned, count(DISTINCT base) AS n_bases, array_to_string(list_sort(list(symbol))[1:50], ',') AS contracts FROM listings WHERE market='perp' AND active GROUP BY exchange")
register("catalog_search", lambda s, d: listings.catalog_search(A.listings(s, d), "a10-usdt", active_only=False).union(listings.catalog_search(A.listings(s, d), "A7", active_only=False)).select(*LI, F.concat_ws(",", "domains").alias("domains")), f"SELECT {', '.join(LI)}, CASE WHEN market='perp' THEN 'market_quote,funding,open_interest,liquidation' ELSE 'market_quote' END AS domains FROM listings WHERE symbol='A10USDT' OR base='A7'")
register("catalog_search_summary", lambda s, d: listings.catalog_search_summary(listings.catalog_search(A.listings(s, d), quote="usdc")), "SELECT market, count(*) AS listings, count(DISTINCT exchange) AS exchanges, count(DISTINCT base) AS bases FROM listings WHERE active AND quote='USDC' GROUP BY market")


def _curve(s, d):
    return A.funding(s, d).withColumn("pct", F.col("funding_rate") * 1000)


register("typical_interval", lambda s, d: listings.typical_interval(_curve(s, d)), "SELECT exchange, symbol, coalesce(list_sort(list(dd) FILTER (dd>0))[count(*) FILTER (dd>0)//2+1], 0) AS interval_ms FROM (SELECT *, ts_ms-lag(ts_ms) OVER (PARTITION BY exchange, symbol ORDER BY ts_ms, event_id) AS dd FROM funding) GROUP BY ALL")
register("funding_runs", lambda s, d: rounded(listings.funding_runs(_curve(s, d), -0.2005, 0.5), 6), "WITH cu AS (SELECT *, funding_rate*1000 AS pct FROM funding), c2 AS (SELECT *, lead(ts_ms) OVER w AS nxt, lag(ts_ms) OVER w AS prv, count(*) FILTER (pct>-0.2005::DOUBLE) OVER (PARTITION BY exchange, symbol ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM cu WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts_ms, event_id)), rr AS (SELECT exchange, symbol, run, min(ts_ms) AS start_ms, arg_max(coalesce(nxt, ts_ms+greatest(ts_ms-prv,0), ts_ms), (ts_ms, event_id)) AS end_ms, count(*) AS points, min(pct) AS min_pct, max(pct) AS max_pct FROM c2 WHERE pct<=-0.2005::DOUBLE GROUP BY ALL) SELECT exchange, symbol, start_ms, end_ms, points, round(min_pct,6) AS min_pct, round(max_pct,6) AS max_pct, round((end_ms-start_ms)/3600000,6) AS duration_hours FROM rr WHERE (end_ms-start_ms)/3600000>=0.5::DOUBLE")


def _export(s, d):
    """Extremes written as CSV and read back."""
    path = shared_dir(s, "csv")
    listings.funding_extremes(A.perp_funding(s, d), -2.05, -0.105).select("exchange", "symbol", R("funding_rate_pct", 4).alias("funding_rate_pct")).write.option("header", True).csv(path)
    return s.read.schema("exchange string, symbol string, funding_rate_pct double").option("header", True).csv(path)


register("export_csv", _export, "SELECT exchange, symbol, round(funding_rate_pct,4) AS funding_rate_pct FROM pf WHERE funding_rate_pct BETWEEN -2.05::DOUBLE AND -0.105::DOUBLE")


def _written(s, df, kind, name):
    """Rows written in a format and read back."""
    path = shared_dir(s, name)
    exports.write(df, path, kind)
    return exports.read(s, path, kind, df.schema)


register("export_json", lambda s, d: rounded(_written(s, listings.funding_runs(_curve(s, d), -0.2005, 0.5), "json", "runs"), 6), "WITH cu AS (SELECT *, funding_rate*1000 AS pct FROM funding), c2 AS (SELECT *, lead(ts_ms) OVER w AS nxt, lag(ts_ms) OVER w AS prv, count(*) FILTER (pct>-0.2005::DOUBLE) OVER (PARTITION BY exchange, symbol ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM cu WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts_ms, event_id)), rr AS (SELECT exchange, symbol, run, min(ts_ms) AS start_ms, arg_max(coalesce(nxt, ts_ms+greatest(ts_ms-prv,0), ts_ms), (ts_ms, event_id)) AS end_ms, count(*) AS points, min(pct) AS min_pct, max(pct) AS max_pct FROM c2 WHERE pct<=-0.2005::DOUBLE GROUP BY ALL) SELECT exchange, symbol, start_ms, end_ms, points, round(min_pct,6) AS min_pct, round(max_pct,6) AS max_pct, round((end_ms-start_ms)/3600000,6) AS duration_hours FROM rr WHERE (end_ms-start_ms)/3600000>=0.5::DOUBLE")
register("export_curves", lambda s, d: rounded(_written(s, _curve(s, d).select("exchange", "symbol", "ts_ms", "event_id", R("pct", 6).alias("pct")), "csv", "curves"), 6), "SELECT exchange, symbol, ts_ms, event_id, round(funding_rate*1000,6) AS pct FROM funding")
register("export_text", lambda s, d: _written(s, listings.watchlist(listings.funding_extremes(A.perp_funding(s, d), -2.05, -0.505)), "text", "watchlist"), "SELECT DISTINCT symbol FROM pf WHERE funding_rate_pct BETWEEN -2.05::DOUBLE AND -0.505::DOUBLE")
register("funding_history", lambda s, d: rounded(normalize.funding_history_candles(A.funding(s, d)), 8), "SELECT exchange, symbol, ts_ms AS open_time_ms, ts_ms+28799999 AS close_time_ms, round(funding_rate,8) AS open, round(funding_rate,8) AS high, round(funding_rate,8) AS low, round(funding_rate,8) AS close FROM funding")
register("aggregator_keys", lambda s, d: ticks(s, d).select("exchange", "market", "symbol", S.aggregator_key(F.concat(F.lower(F.left("symbol", F.lit(3))), F.lit("-/"), F.substring("symbol", 4, 9)), F.col("market")).alias("key")), f"SELECT {K}, symbol || CASE WHEN market='perp' THEN '_PERP' ELSE '' END AS key FROM lt")


def _loaded(s, d):
    """The quotes landed as JSON and loaded with their declared schema."""
    path = shared_dir(s, "landed")
    A.quotes(s, d).write.json(path)
    return schemas.load(s, path, "quotes", "json")


register("load_quotes", lambda s, d: rounded(_loaded(s, d), 8), f"SELECT event_id, {K}, round(bid,8) AS bid, round(ask,8) AS ask, round(mark,8) AS mark, round(funding_rate,8) AS funding_rate, ts_ms FROM quotes")


# normalisers
def raw(s, d):
    """Payloads as venues send them: numbers as text for even k, some fields missing, some rows broken."""
    return A.ev(s, d).selectExpr(
        "event_id", "exchange", "market", "symbol", "k", "event_type", "value", "ts_ms as received_at_ms",
        "case when event_id % 31 = 0 then '{broken' when k % 2 = 0 then to_json(named_struct('bid', cast(100D + value as string), 'ask', cast(101D + value as string), 'fundingRate', case when k % 3 = 0 then '0.0001' end, 'openInterest', case when k % 5 = 0 then cast(k as string) end, 'ts', ts_ms, 'side', 'BUY', 'p', cast(100D + value as string), 'q', cast(k + 1 as string)))"
        " else to_json(named_struct('b', 100D + value, 'a', case when k % 7 = 0 then -1D else 101D + value end, 'markPrice', case when k % 3 = 0 then 100.5D + value end, 'side', 'ask', 'price', 100D + value, 'qty', k + 1)) end as payload",
    )


register("norm_quotes", lambda s, d: rounded(normalize.normalize_quotes(raw(s, d)), 6), "SELECT event_id, exchange, market, symbol, round(100+value,6) AS bid, round(101+value,6) AS ask, CASE WHEN k % 2 = 1 AND k % 3 = 0 THEN round(100.5::DOUBLE+value,6) END AS mark, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 0.0001::DOUBLE END AS funding_rate, ts_ms FROM ev WHERE event_id % 31 <> 0 AND (k % 2 = 0 OR k % 7 <> 0)")
register("norm_trades", lambda s, d: rounded(normalize.normalize_trades(raw(s, d)).drop("trade_id"), 6), "SELECT event_id, exchange, market, symbol, round(100+value,6) AS price, (k+1)::DOUBLE AS qty, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, ts_ms FROM ev WHERE event_id % 31 <> 0")
register("norm_funding", lambda s, d: rounded(normalize.normalize_funding(raw(s, d)).select("event_id", "exchange", "symbol", "funding_rate"), 6), "SELECT event_id, exchange, symbol, 0.0001::DOUBLE AS funding_rate FROM ev WHERE event_id % 31 <> 0 AND k % 6 = 0")
register("norm_oi", lambda s, d: rounded(normalize.normalize_oi(raw(s, d)).select("event_id", "exchange", "symbol", "open_interest"), 6), "SELECT event_id, exchange, symbol, k::DOUBLE AS open_interest FROM ev WHERE event_id % 31 <> 0 AND k % 10 = 0")


def raw_books(s, d):
    return A.ev(s, d).where("event_type = 'view'").selectExpr(
        "event_id", "exchange", "market", "symbol", "ts_ms as received_at_ms",
        "case when k % 2 = 0 then concat('{\"b\":[[\"', 100 + k, '\",\"', k, '\"],[\"x\",\"1\"],[\"99\"]],\"a\":[[\"', 101 + k, '\",\"2\"],[\"', 102 + k, '\",\"3\"]]}') else concat('{\"b\":[{\"px\":\"', 100 + k, '\",\"sz\":\"', k, '\"}],\"a\":[{\"px\":\"', 101 + k, '\",\"sz\":\"oops\"},{\"px\":\"', 102 + k, '\",\"sz\":\"3\"}]}') end as payload",
    )


register("norm_books", lambda s, d: normalize.normalize_books(raw_books(s, d)).select("event_id", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), F.col("bids")[0].price.alias("bid"), F.col("bids")[0].qty.alias("bid_qty"), F.col("asks")[0].price.alias("ask")), "SELECT event_id, 1 AS n_bids, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n_asks, (100+k)::DOUBLE AS bid, k::DOUBLE AS bid_qty, CASE WHEN k % 2 = 0 THEN 101+k ELSE 102+k END::DOUBLE AS ask FROM ev WHERE event_type='view'")
register("dead_letters", lambda s, d: normalize.dead_letters(raw(s, d), ["$.ask"]).select("event_id", "reason"), "SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'invalid json' ELSE 'missing $.ask' END AS reason FROM ev WHERE event_id % 31 = 0 OR k % 2 = 1")
register("synthetic_quotes", lambda s, d: rounded(normalize.synthetic_quotes(A.ev(s, d).select("event_id", F.expr("value - 5D").alias("price")), 10.0), 6), "SELECT event_id, round(value-5,6) AS price, CASE WHEN value>5 THEN round((value-5)*0.9995::DOUBLE,6) END AS bid, CASE WHEN value>5 THEN round((value-5)*1.0005::DOUBLE,6) END AS ask FROM ev")
register("swap_price", lambda s, d: rounded(normalize.swap_price(A.ev(s, d).select("event_id", F.expr("1e9 * (k % 4)").alias("in_amount"), F.expr("value * 1e6").alias("out_amount"), F.lit(9).alias("in_decimals"), F.lit(6).alias("out_decimals"))).select("event_id", "price"), 6), "SELECT event_id, CASE WHEN k % 4 > 0 THEN round(value/(k % 4),6) END AS price FROM ev")
register("pair_ratio", lambda s, d: rounded(normalize.pair_ratio(A.read(s, d, "supplier").select(F.col("s_suppkey").alias("mint"), F.col("s_acctbal").alias("usd")), A.read(s, d, "part").select("p_partkey", F.expr("p_partkey % 150").alias("base_mint"), F.expr("p_size").alias("quote_mint"))).select("p_partkey", "ratio"), 6), "SELECT p_partkey, CASE WHEN b.s_acctbal>0 AND q.s_acctbal>0 THEN round(b.s_acctbal/q.s_acctbal,6) END AS ratio FROM part LEFT JOIN supplier b ON b.s_suppkey=p_partkey%150 LEFT JOIN supplier q ON q.s_suppkey=p_size")
register("pool_price", lambda s, d: rounded(normalize.pool_price(A.ev(s, d).select("event_id", F.expr("k % 3 = 0").alias("invert"), F.expr("value").alias("token0_price"), F.expr("1D / (value + 1D)").alias("token1_price"))).select("event_id", "price"), 6), "SELECT event_id, round(CASE WHEN k % 3 = 0 THEN value ELSE 1/(value+1) END,6) AS price FROM ev")


def _dex(s, d):
    rows = A.ev(s, d).select(
        F.expr("concat('pair', event_id % 500) as pair"), F.expr("case when event_id % 2 = 0 then 'Solana' else 'Ethereum' end as chain"), F.expr("case when k % 2 = 0 then 'raydium' else 'orca' end as dex"), F.col("event_id").alias("position"),
        F.expr("value * 100 as liquidity"), F.expr("case when k % 4 <> 0 then value end as volume_m5"), F.expr("value * 2 as volume_h1"), F.expr("value * 24 as volume_h24"), F.expr("cast(k as double) as buys_h1"), F.expr("cast(k + 1 as double) as sells_h1"),
    )
    return normalize.dex_metrics(rows, "solana", "raydium")


register("dex_metrics", lambda s, d: rounded(_dex(s, d)), "WITH dx AS (SELECT 'pair' || (event_id % 500) AS pair, value, k FROM ev WHERE event_id % 2 = 0 AND k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id)=1) SELECT pair, metric, round(v,4) AS value FROM (SELECT pair, 'liquidity_usd' AS metric, value*100 AS v FROM dx UNION ALL SELECT pair, 'swap_volume_m5', CASE WHEN k%4<>0 THEN value END FROM dx UNION ALL SELECT pair, 'swap_volume_h1', value*2 FROM dx UNION ALL SELECT pair, 'swap_volume_h24', value*24 FROM dx UNION ALL SELECT pair, 'swap_buys_h1', k FROM dx UNION ALL SELECT pair, 'swap_sells_h1', k+1 FROM dx) WHERE v IS NOT NULL")
register("signal_values", lambda s, d: rounded(normalize.signal_values(A.ev(s, d).select("event_id", F.col("exchange").alias("source"), F.expr("case k % 4 when 0 then concat('{\"a\":{\"b\":[', value, ']}}') when 1 then concat('{\"data\":[{\"fundingRate\":\"', value, '\"}]}') when 2 then concat('{\"series\":[1,', value, ',\"x\"]}') else '{}' end").alias("payload")), {"binance": "$.a.b[0]", "okx": "$.nothing"})), "SELECT event_id, exchange AS source, CASE k % 4 WHEN 0 THEN round(value,4) WHEN 1 THEN round(value,4) WHEN 2 THEN round(value,4) END AS value FROM ev")
register("news_score", lambda s, d: normalize.news_score(A.ev(s, d).select("event_id", F.expr("case when k % 3 <> 0 then k end as positive"), F.expr("k % 7 as negative"), F.expr("case when k % 2 = 0 then 5 end as important"))).select("event_id", "score"), "SELECT event_id, (CASE WHEN k%3<>0 THEN k ELSE 0 END - k%7 + CASE WHEN k%2=0 THEN 5 ELSE 0 END)::DOUBLE AS score FROM ev")
register("epoch_norm", lambda s, d: A.ev(s, d).withColumn("raw", F.expr("case k % 4 when 0 then cast(ts_ms as string) when 1 then cast(ts_ms div 1000 as string) when 2 then '5000' else date_format(timestamp_millis(ts_ms), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") end")).select("event_id", normalize.epoch_norm(F.col("raw"), 1_700_000_000_000).alias("ms")), "SELECT event_id, CASE k % 4 WHEN 0 THEN ts_ms WHEN 1 THEN ts_ms//1000*1000 WHEN 2 THEN 1700000005000 ELSE ts_ms END AS ms FROM ev")
register("history_candles", lambda s, d: rounded(normalize.history_candles(A.klines_daily(s, d).selectExpr("exchange", "market", "lower(symbol) as symbol", "case when open_time_ms % 172800000 = 0 then concat('[', open_time_ms, ',\"', open, '\",', high, ',', low, ',\"', close, '\",', volume, ',', open_time_ms + 99, ']') when open_time_ms % 5 = 1 then '[1,2]' else concat('[', open_time_ms, ',', open, ',', high, ',', low, ',', close, ',\"', volume, '\"]') end as payload"), "1d")), "SELECT exchange, market, symbol, interval, open_time_ms, CASE WHEN open_time_ms % 172800000 = 0 THEN open_time_ms+99 ELSE close_time_ms END AS close_time_ms, round(open,4) AS open, round(high,4) AS high, round(low,4) AS low, round(close,4) AS close, round(volume,4) AS volume FROM kl")
register("norm_transfers", lambda s, d: rounded(normalize.normalize_transfers(A.read(s, d, "orders").select("o_orderkey", F.expr("case o_custkey % 3 when 0 then 'sat' when 1 then 'wei' else 'coin' end as unit"), F.expr("case o_custkey % 3 when 0 then o_totalprice * 1e4 when 1 then o_totalprice * 1e15 else o_totalprice end as raw_amount"), F.expr("concat('A', o_custkey % 9) as to_address"), F.expr("concat('A', o_custkey % 7) as from_address"), F.expr("unix_millis(cast(o_orderdate as timestamp)) div 1000 as ts_s")), 10.0, 150.0, ["a3", "a5"]), 6), "SELECT o_orderkey, 'A' || (o_custkey%9) AS to_address, 'A' || (o_custkey%7) AS from_address, round(a,6) AS amount, CASE WHEN o_custkey%9 IN (3,5) THEN 'inbound' WHEN o_custkey%7 IN (3,5) THEN 'outbound' END AS direction, epoch_us(o_orderdate)//1000000*1000 AS ts_ms FROM (SELECT *, CASE o_custkey%3 WHEN 0 THEN o_totalprice*1e4::DOUBLE/1e8::DOUBLE WHEN 1 THEN o_totalprice*1e15::DOUBLE/1e18::DOUBLE ELSE o_totalprice END AS a FROM orders) WHERE a >= CASE o_custkey%3 WHEN 0 THEN 10 WHEN 1 THEN 150 ELSE 0 END")
_SHAPES = ["{b}{q}", "{b}-{q}", "{b}_{q}", "{b}/{q}", "{b}PERP", "{b}-PERP", "XBTUSD", "PF_XBTUSD", "{b}-PERPETUAL", "BTCUSDT", "0X{b}", "{b}_{q}_Perp", "BTCPERP"]


def shaped(s, d):
    """Symbols in the shapes that people and venues use."""
    key = F.col("p_partkey")
    base = F.upper(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4))
    quote = F.get(F.array(*map(F.lit, ["USDT", "USDC", "EUR"])), (key % 3).cast("int"))
    shape = F.get(F.array(*map(F.lit, _SHAPES)), (key % len(_SHAPES)).cast("int"))
    return A.read(s, d, "part").select(F.replace(F.replace(shape, F.lit("{b}"), base), F.lit("{q}"), quote).alias("symbol")).distinct()


def _split(x):
    known = "coalesce(" + ", ".join(f"CASE WHEN {x} LIKE '%{q}' THEN '{q}' END" for q in S.VENUE_QUOTES) + ")"
    base = f"CASE WHEN {known} IS NOT NULL THEN left({x}, length({x})-length({known})) WHEN length({x}) >= 6 THEN left({x}, length({x})-4) ELSE {x} END"
    return f"({base})", f"coalesce({known}, CASE WHEN length({x}) >= 6 THEN right({x}, 4) END, 'USDT')"


_B, _Q = _split("u")
_X = f"CASE WHEN {_B}='BTC' THEN 'XBT' ELSE {_B} END"
_SB, _SQ1 = _split("z")
_ub, _uq = _split("y")
_pb, _ = _split("p")
_gb, _gq = _split("g")
_WHOLE = "CASE WHEN u LIKE '%PERP' THEN left(u, length(u)-4) ELSE " + _B + " END"
_FORM_SQL = {
    "binance": "u", "okx": f"{_B} || '-' || {_Q}", "kraken": f"{_B} || '/' || {_Q}", "gate": f"{_B} || '_' || {_Q}", "okx_swap": f"{_B} || '-' || {_Q} || '-SWAP'", "bitfinex": f"'t' || {_B} || {_Q}",
    "bitfinex_perp": f"'t' || {_B} || 'F0:' || CASE WHEN {_Q}='USDT' THEN 'UST' ELSE {_Q} END || 'F0'", "kucoin_perp": f"{_X} || {_Q} || 'M'",
    "kraken_perp": f"CASE WHEN symbol LIKE 'PF\\_%' ESCAPE '\\' OR symbol LIKE 'PI\\_%' ESCAPE '\\' THEN symbol ELSE 'PF_' || {_X} || CASE WHEN {_Q}='USDT' THEN 'USD' ELSE {_Q} END END", "hyperliquid": _B, "dydx": f"{_B} || '-' || {_Q}",
    "derive_perp": f"CASE WHEN contains(u, '-') THEN u ELSE {_WHOLE} || '-PERP' END", "cryptocom_spot": f"CASE WHEN contains(u, '_') THEN u ELSE {_B} || '_' || {_Q} END", "cryptocom_perp": f"CASE WHEN contains(u, '-') THEN u WHEN u LIKE '%PERP' THEN {_pb} || 'USD-PERP' ELSE {_B} || 'USD-PERP' END",
    "coinex": "z", "phemex_perp": "z", "upbit": f"CASE WHEN contains(u, '-') THEN u ELSE {_uq} || '-' || {_ub} END", "woo_spot": f"'SPOT_' || {_B} || '_' || {_Q}", "woo_perp": f"'PERP_' || {_SB} || '_' || {_SQ1}",
    "bitmex_perp": f"CASE WHEN u LIKE 'XBT%' OR u LIKE '%USD' THEN u ELSE CASE WHEN {_WHOLE}='BTC' THEN 'XBT' ELSE {_WHOLE} END || 'USD' END", "aevo_perp": f"CASE WHEN contains(u, '-') THEN u ELSE {_WHOLE} || '-PERP' END",
    "pacifica_perp": f"CASE WHEN contains(u, '-') THEN split_part(u, '-', 1) ELSE {_WHOLE} END", "grvt_perp": f"CASE WHEN contains(symbol, '_') THEN symbol ELSE {_gb} || '_' || {_gq} || '_Perp' END", "injective_perp": f"{_B} || '/' || {_Q} || '-PERP'",
    "architect_perp": f"CASE WHEN contains(u, '-') THEN u ELSE {_WHOLE} || '-PERP' END", "decibel_perp": f"CASE WHEN contains(u, '/') OR contains(u, '-') THEN replace(u, '/', '-') ELSE {_B} || '-USD' END", "deribit_perp": f"CASE WHEN contains(u, '-PERPETUAL') THEN u ELSE {_B} || '-PERPETUAL' END",
    "evedex_perp": f"CASE WHEN u LIKE '%USD' AND NOT contains(u, '-') OR contains(u, '-') OR contains(u, '/') THEN translate(u, '-/', '') ELSE {_WHOLE} || 'USD' END",
}
_SHAPED = "WITH sh AS (SELECT DISTINCT replace(replace(" + str(_SHAPES) + f"[p_partkey % {len(_SHAPES)} + 1], '{{b}}', upper(substr(md5(p_partkey::VARCHAR),1,4))), '{{q}}', ['USDT','USDC','EUR'][p_partkey % 3 + 1]) AS symbol FROM part), su AS (SELECT symbol, upper(symbol) AS u FROM sh), sv AS (SELECT *, regexp_replace(regexp_replace(u, '[-_]PERP|PERP', '', 'g'), '[-_/]', '', 'g') AS z, translate(u, '_/', '') AS y, CASE WHEN u LIKE '%PERP' THEN left(u, length(u)-4) ELSE u END AS p, replace(regexp_replace(u, '-PERP$', ''), '-', '') AS g FROM su) "
register("venue_symbols", lambda s, d: normalize.venue_symbols(shaped(s, d)), _SHAPED + " UNION ALL ".join(f"SELECT symbol, '{k}' AS venue, {v} AS venue_symbol FROM sv" for k, v in _FORM_SQL.items()))


def nested(s, d):
    """Payloads that hide their number up to seven levels down, behind texts, empty lists and later numbers."""
    value, k = F.col("value").cast("string"), F.col("k")
    inner = F.when(k % 3 == 0, F.format_string('{"fundingRate":"%s","aaa":5,"zz":[1,2]}', value)).when(k % 3 == 1, F.format_string('{"b":["x",null,{"rate":true,"total":%s}],"c":7}', value)).otherwise(F.format_string('[[],{},"text",[%s,3]]', value))
    for level in range(4):
        wrapped = [F.format_string('{"m":{"q":"none"},"n":%s,"zzz":9}', inner), F.format_string('[false,[],%s]', inner)][level % 2]
        inner = F.when(k % 5 > level, wrapped).otherwise(inner)
    return A.ev(s, d).select("event_id", F.when(F.col("event_id") % 29 == 0, "{bad").when(F.col("event_id") % 31 == 0, '{"only":"text"}').otherwise(inner).alias("payload"))


register("numeric_leaf", lambda s, d: rounded(normalize.numeric_leaf(nested(s, d))), "SELECT event_id, round(value,4) AS value FROM ev WHERE event_id % 29 <> 0 AND event_id % 31 <> 0")
_OWN_PATHS = [("binance", ["$.b"], ["$.a"], ["$.p"], [], ["$.E"]), ("okx", ["$.bidPx"], ["$.askPx"], ["$.markPx"], ["$.r"], ["$.ts"]), ("*", ["$.bid", "$.bestBid"], ["$.ask"], ["$.mark"], ["$.fundingRate"], ["$.T"])]


def raw_by_venue(s, d):
    """Payloads of three venues with keys of their own; a wrong venue's keys stand beside them."""
    payload = F.when(F.col("exchange") == "binance", F.to_json(F.struct(F.expr("cast(100D + value as string) as b"), F.expr("101D + value as a"), F.lit(1.0).alias("bid"), F.expr("ts_ms + 7 as E")))).when(
        F.col("exchange") == "okx", F.to_json(F.struct(F.expr("100D + value as bidPx"), F.expr("cast(101D + value as string) as askPx"), F.expr("100.5D + value as markPx"), F.expr("'0.0001' as r"), F.lit(5.0).alias("b")))
    ).otherwise(F.to_json(F.struct(F.expr("case when k % 2 = 0 then 'n/a' else '50' end as bid"), F.expr("100D + value as bestBid"), F.expr("101D + value as ask"))))
    return A.ev(s, d).select("event_id", "exchange", "market", "symbol", F.col("ts_ms").alias("received_at_ms"), payload.alias("payload"))


register("norm_quotes_by_venue", lambda s, d: rounded(normalize.normalize_quotes(raw_by_venue(s, d), _OWN_PATHS), 6), "SELECT event_id, exchange, market, symbol, CASE WHEN exchange='bybit' AND k % 2 = 1 THEN 50::DOUBLE ELSE round(100+value,6) END AS bid, round(101+value,6) AS ask, CASE WHEN exchange='okx' THEN round(100.5::DOUBLE+value,6) END AS mark, CASE WHEN exchange='okx' THEN 0.0001::DOUBLE END AS funding_rate, CASE WHEN exchange='binance' THEN ts_ms+7 ELSE ts_ms END AS ts_ms FROM ev")


#: Every quote with one of the separators before it, and texts without a known quote.
_SUFFIXES = [sep + q for q, sep in zip([*S.VENUE_QUOTES, "BRL"], ["", "-", "/", "_", ":"] * 5, strict=False)] + ["-ETH-SWAP", "ABCD", "", "_PERP"]


def typed(s, d):
    """Symbols as people type them, from the keys of the parts."""
    key = F.col("p_partkey")
    base = F.when(key % 7 == 0, "xbt").otherwise(F.substring(F.md5(key.cast("string").cast("binary")), 1, 3))
    suffix = F.get(F.array(*map(F.lit, _SUFFIXES)), (key % len(_SUFFIXES)).cast("int"))
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", base.alias("base"), suffix.alias("suffix"))
    return rows.select("p_partkey", "base", "suffix", F.concat(F.when(key % 5 == 0, " t").otherwise(""), "base", "suffix").alias("raw"))


_TYPED = "WITH ty AS (SELECT p_partkey, base, suffix, CASE WHEN p_partkey % 5 = 0 THEN ' t' ELSE '' END || base || suffix AS raw FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'xbt' ELSE substr(md5(p_partkey::VARCHAR),1,3) END AS base, " + str(_SUFFIXES) + f"[p_partkey % {len(_SUFFIXES)} + 1] AS suffix FROM part)), tc AS (SELECT *, upper(translate(regexp_replace(trim(raw), '^t+', ''), '-/_:', '')) AS c FROM ty) "
_VENUE = "coalesce(" + ", ".join(f"CASE WHEN c LIKE '%{q}' THEN '{q}' END" for q in S.VENUE_QUOTES) + ")"
_PRODUCT = "coalesce(" + ", ".join(f"CASE WHEN c LIKE '_%{q}' THEN '{q}' END" for q in S.PRODUCT_QUOTES) + ")"
register("venue_split", lambda s, d: typed(s, d).withColumn("c", S.plain_symbol(F.col("raw"))).withColumn("s", S.venue_split(F.col("c"))).select("p_partkey", F.col("c").alias("symbol"), "s.base", "s.quote"), _TYPED + f", ts AS (SELECT *, {_VENUE} AS k FROM tc) SELECT p_partkey, c AS symbol, CASE WHEN k IS NOT NULL THEN left(c, length(c)-length(k)) WHEN length(c) >= 6 THEN left(c, length(c)-4) ELSE c END AS base, coalesce(k, CASE WHEN length(c) >= 6 THEN right(c, 4) END, 'USDT') AS quote FROM ts")
register("product_text", lambda s, d: typed(s, d).withColumn("s", S.product_text(F.col("raw"))).select("p_partkey", "raw", "s.*"), _TYPED + f", ts AS (SELECT *, {_PRODUCT} AS k FROM tc) SELECT p_partkey, raw, CASE WHEN k IS NOT NULL THEN left(c, length(c)-length(k)) WHEN c <> '' THEN c END AS base, CASE WHEN k IS NOT NULL THEN c END AS symbol, k AS quote FROM ts")
register("pair_names", lambda s, d: typed(s, d).select("p_partkey", S.pair_name(F.when(F.col("p_partkey") % 2 == 0, F.col("base")), F.when(F.col("p_partkey") % 3 > 0, F.lit("usdt")), F.concat("base", "suffix")).alias("pair")), _TYPED + "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN CASE WHEN base = 'xbt' THEN 'BTC' ELSE upper(base) END || 'USDT' ELSE upper(translate(regexp_replace(base || suffix, '[-_](SWAP|PERP)', '', 'g'), '-_/:', '')) END AS pair FROM tc")


_UNIFIED = {
    "quote": ("quotes", ["bid", "ask", "mark", "funding_rate"]), "trade": ("trades", ["price", "qty", "side", "trade_id"]), "order_book": ("order_books", ["bids", "asks"]),
    "funding": ("funding", ["funding_rate", "next_funding_time_ms", "mark_price", "index_price"]), "open_interest": ("open_interest", ["open_interest", "open_interest_value"]),
    "liquidation": ("liquidations", ["side", "price", "qty"]), "signal": ("signals", ["category", "metric", "value"]),
}


def unified(s, d, broken=0):
    """The event log of all seven types with full payloads; ids that ``broken`` divides have a broken one."""
    out = None
    for kind, (name, fields) in _UNIFIED.items():
        df = getattr(A, name)(s, d)
        source = F.col("source" if kind == "signal" else "exchange")
        market = F.col("market") if "market" in df.columns else F.lit(None).cast("string")
        payload = F.to_json(F.struct("event_id", *fields))
        payload = F.when(F.col("event_id") % broken == 0, "{bad").otherwise(payload) if broken else payload
        part = df.select(F.lit(kind).alias("type"), source.alias("exchange"), market.alias("market"), "symbol", "ts_ms", payload.alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


_R4 = lambda *names: ", ".join(f"round({n},4) AS {n}" for n in names)
#: The seven typed tables as one relation; {} takes a condition on event_id.
TYPED_SQL = " UNION ALL BY NAME ".join([
    f"SELECT 'quote' AS \"table\", {K}, ts_ms, {_R4('bid', 'ask', 'mark', 'funding_rate')} FROM quotes WHERE {{0}}", f"SELECT 'trade' AS \"table\", {K}, ts_ms, {_R4('price', 'qty')}, side, trade_id FROM trades WHERE {{0}}",
    f"SELECT 'order_book' AS \"table\", {K}, ts_ms, round(max(price) FILTER (side='bid'),4) AS best_bid, round(min(price) FILTER (side='ask'),4) AS best_ask, NULL::BIGINT AS last_update_id, 10 AS n_bids, 10 AS n_asks, round(sum(price*qty) FILTER (side='bid'),4) AS bids_notional, round(sum(price*qty) FILTER (side='ask'),4) AS asks_notional FROM lv WHERE {{0}} GROUP BY {K}, ts_ms, event_id",
    f"SELECT 'funding' AS \"table\", exchange, symbol, ts_ms, {_R4('funding_rate', 'mark_price', 'index_price')}, next_funding_time_ms FROM funding WHERE {{0}}", f"SELECT 'open_interest' AS \"table\", exchange, symbol, ts_ms, {_R4('open_interest', 'open_interest_value')} FROM open_interest WHERE {{0}}",
    f"SELECT 'liquidation' AS \"table\", exchange, symbol, ts_ms, side, {_R4('price', 'qty')} FROM liquidations WHERE {{0}}", "SELECT 'signal' AS \"table\", source AS exchange, symbol, ts_ms, category, metric, round(value,4) AS value, NULL::DOUBLE AS score, NULL::VARCHAR AS title, NULL::VARCHAR AS url FROM signals WHERE {0}",
])


def _fanout(s, d):
    """The seven tables written in one pass and read back by type."""
    path = shared_dir(s, "tables")
    normalize.write_fanout(unified(s, d), path)
    out = None
    for name, table in normalize.fanout_tables(s.read.parquet(path)).items():
        part = normalize.summary(table.withColumn("table", F.lit(name)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return rounded(out)


register("fanout_tables", _fanout, TYPED_SQL.format("true"))


def _log(s, d):
    """The log of all types with the event's id as payload, so that its text can be counted in SQL."""
    return unified(s, d).withColumn("payload", F.to_json(F.struct(F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))))


_LOGGED = " UNION ALL ".join(f"SELECT '{k}' AS type, {'source' if k == 'signal' else 'exchange'} AS exchange, {'market' if k in ('quote', 'trade', 'order_book') else 'NULL::VARCHAR'} AS market, symbol, ts_ms, event_id FROM {'lv' if k == 'order_book' else n}" + (" WHERE side='bid' AND lvl=0" if k == "order_book" else "") for k, (n, _) in _UNIFIED.items())
register("event_log", lambda s, d: normalize.event_log(_log(s, d)).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")), f"WITH el AS ({_LOGGED}), eg AS (SELECT 'ticks:' || CASE type WHEN 'quote' THEN 'quote_' || market ELSE type END || ':' || exchange || ':' || coalesce(symbol, '*') AS key, length('{{\"type\":\"\",\"exchange\":\"\",\"ts_ms\":,\"payload\":\"{{\\\"event_id\\\":}}\"}}') + length(type) + length(exchange) + coalesce(length(market) + length('\"market\":\"\",'), 0) + coalesce(length(symbol) + length('\"symbol\":\"\",'), 0) + length(ts_ms::VARCHAR) + length(event_id::VARCHAR) AS c FROM el) SELECT key, count(*) AS n, sum(c)::BIGINT AS chars FROM eg GROUP BY key")

# options and prediction markets
_PO = "po AS (SELECT *, split_part(instrument_name,'-',1) AS currency, split_part(instrument_name,'-',3)::DOUBLE AS strike, CASE split_part(instrument_name,'-',4) WHEN 'C' THEN 'call' ELSE 'put' END AS option_type, CASE p_partkey%4 WHEN 0 THEN '2026-06-26T08:00:00Z' WHEN 1 THEN '2027-03-26T08:00:00Z' WHEN 2 THEN '2026-06-05T08:00:00Z' ELSE '2026-01-01T08:00:00Z' END AS expiry_time FROM options_raw)"
OC = ("p_partkey", "venue", "instrument_name", "currency", "expiry_time", "strike", "option_type", "received_at_ms")


def opts(s, d):
    return contracts.parse_options(A.options_raw(s, d)).select(*OC)


register("parse_options", opts, f"WITH {_PO} SELECT {', '.join(OC)} FROM po")
register("option_chain", lambda s, d: contracts.option_chain(opts(s, d), "binance", "btc", "call", 5000.0, 40000.0, "2026-06-01", None, False, 1_700_002_400_000, 1_200_000), f"WITH {_PO} SELECT {', '.join(OC)} FROM po WHERE venue='binance' AND currency='BTC' AND option_type='call' AND strike BETWEEN 5000 AND 40000 AND expiry_time>='2026-06-01' AND 1700002400000-received_at_ms<=1200000")
register("option_replace", lambda s, d: contracts.option_replace(opts(s, d)).select(*OC), f"WITH {_PO} SELECT {', '.join(OC)} FROM po WHERE received_at_ms = (SELECT max(received_at_ms) FROM po p2 WHERE p2.venue=po.venue AND p2.currency=po.currency)")
register("option_merge", lambda s, d: rounded(contracts.option_merge(A.options_raw(s, d).select("p_partkey", "venue", F.expr("concat(instrument_name, '#', p_partkey) as instrument_name"), F.col("p_retailprice").alias("mark_price"), F.lit(None).cast("double").alias("delta")), A.options_raw(s, d).where("p_partkey % 3 = 0").select("venue", F.expr("concat(instrument_name, '#', p_partkey) as instrument_name"), F.expr("case when p_partkey % 2 = 0 then p_size * 1D end as mark_price"), F.lit(0.5).alias("delta")), ["mark_price", "delta"])), "SELECT p_partkey, venue, instrument_name || '#' || p_partkey AS instrument_name, round(CASE WHEN p_partkey%6=0 THEN p_size ELSE p_retailprice END,4) AS mark_price, CASE WHEN p_partkey%3=0 THEN 0.5::DOUBLE END AS delta FROM options_raw")
register("parse_prediction", lambda s, d: rounded(contracts.parse_prediction(A.prediction_markets_raw(s, d)).select("p_partkey", "base_asset", "strike", "direction", "rule_type", "yes_token_id", "no_token_id", "parser_confidence")), "SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN 'BTC' ELSE 'ETH' END AS base_asset, (regexp_extract(question, '\\$([0-9]+)k', 1)::DOUBLE)*1000 AS strike, CASE WHEN question LIKE '%below%' THEN 'below' ELSE 'above' END AS direction, CASE WHEN question LIKE '%reach%' THEN 'touch' ELSE 'terminal' END AS rule_type, p_partkey || CASE WHEN swapped THEN 'n' ELSE 'y' END AS yes_token_id, p_partkey || CASE WHEN swapped THEN 'y' ELSE 'n' END AS no_token_id, CASE WHEN question LIKE '%reach%' THEN 0.7 ELSE 0.85 END::DOUBLE AS parser_confidence FROM pm_raw WHERE active AND p_partkey%3<2")
register("prediction_markets", lambda s, d: rounded(contracts.prediction_markets(A.prediction_markets_raw(s, d)).withColumn("token_ids", F.array_join("token_ids", ","))), "SELECT condition_id AS market_id, question, round(coalesce(volume_clob, volume_num, volume),4) AS volume, p_partkey || 'y,' || p_partkey || 'n' AS token_ids FROM pm_raw WHERE active")


def _listed(s, d):
    """Token ids that come as an array or as a text that holds one, or as neither."""
    m = A.prediction_markets_raw(s, d)
    ids = F.concat(F.lit('["'), F.col("p_partkey"), F.lit('y","'), F.col("p_partkey"), F.lit('n"]'))
    asis = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"ids":'), ids, F.lit("}"))).when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(ids.alias("ids")))).otherwise('{"ids":7}')
    return m.select("p_partkey", F.array_join(contracts.texts(asis, "$.ids"), ",").alias("ids"))


register("string_or_array", _listed, "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_partkey || 'y,' || p_partkey || 'n' END AS ids FROM part")
register("prediction_points", lambda s, d: contracts.token_points(contracts.prediction_history(A.prediction_events(s, d).where("best_bid is not null").withColumn("price", F.col("best_bid")), 720, 1_704_500_000_000)).select("asset_id", F.size("points").alias("n"), F.col("points")[0].t.alias("first_t"), R(F.element_at("points", -1).p, 6).alias("last_p")), "WITH ph AS (SELECT asset_id, ts_ms//43200000*43200000 AS t, arg_max(best_bid,(ts_ms,event_id)) AS p FROM pe WHERE best_bid IS NOT NULL AND ts_ms>=1704500000000 GROUP BY 1, 2) SELECT asset_id, count(*) AS n, min(t) AS first_t, round(arg_max(p, t),6) AS last_p FROM ph GROUP BY 1")
register("option_envelopes", lambda s, d: state.option_envelopes(opts(s, d), 1_700_002_400_000, 1_200_000).select("domain", F.col("source_ref.venue").alias("venue"), "instrument_ref.instrument_id", "instrument_ref.product_type", "instrument_ref.base", "freshness.ts_source", "freshness.stale", R("payload.strike").alias("strike"), "payload.option_type", "payload.position"), f"WITH {_PO} SELECT 'option_chain' AS domain, venue, instrument_name AS instrument_id, 'option' AS product_type, currency AS base, received_at_ms AS ts_source, 1700002400000-received_at_ms>1200000 AS stale, round(strike,4) AS strike, option_type, p_partkey AS position FROM po")
register("prediction_envelopes", lambda s, d: state.prediction_envelopes(A.prediction_events(s, d), 1_706_000_000_000, 7_200_000).select("domain", F.col("source_ref.source").alias("source"), "instrument_ref.market_id", "freshness.ts_source", "freshness.stale", R("payload.best_bid").alias("best_bid"), R("payload.ask_depth", 2).alias("ask_depth"), "payload.position"), "SELECT 'prediction_book' AS domain, 'polymarket' AS source, asset_id AS market_id, ts_ms AS ts_source, greatest(1706000000000-ts_ms,0)>7200000 AS stale, round(best_bid,4) AS best_bid, round(ask_depth,2) AS ask_depth, event_id AS position FROM pe")
register("token_ids", lambda s, d: contracts.token_ids(A.prediction_markets_raw(s, d).where("active")), "SELECT p_partkey || x AS token_id FROM pm_raw, (VALUES ('y'), ('n')) v(x) WHERE active")
_PS = "pq AS (SELECT *, count(*) FILTER (event_type='book') OVER (PARTITION BY asset_id ORDER BY ts_ms, event_id) AS e FROM pe), ps AS (SELECT asset_id, event_id, event_type, ts_ms, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("best_bid", "best_ask", "bid_depth", "ask_depth")) + " FROM pq WINDOW w AS (PARTITION BY asset_id, e ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING)), pl AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts_ms DESC, event_id DESC)=1)"
_PC = ", ".join(f"round({c},4) AS {c}" for c in ("best_bid", "best_ask", "bid_depth", "ask_depth"))


def books_now(s, d):
    return contracts.prediction_latest(A.prediction_events(s, d))


register("prediction_state", lambda s, d: rounded(contracts.prediction_state(A.prediction_events(s, d))), f"WITH {_PS} SELECT asset_id, event_id, event_type, ts_ms, {_PC}, round(best_ask-best_bid,4) AS spread FROM ps")
register("prediction_latest", lambda s, d: rounded(books_now(s, d)), f"WITH {_PS} SELECT asset_id, {_PC}, event_type AS last_event_type, ts_ms, round(best_ask-best_bid,4) AS spread FROM pl")
register("prediction_books", lambda s, d: rounded(contracts.prediction_books(books_now(s, d), ["tok3", "tok1", "tok3", "none"]).select("position", "asset_id", "best_bid", "best_ask")), f"WITH {_PS} SELECT position, asset_id, round(best_bid,4) AS best_bid, round(best_ask,4) AS best_ask FROM (VALUES (0,'tok3'),(1,'tok1'),(2,'tok3'),(3,'none')) v(position, asset_id) JOIN pl USING (asset_id)")
register("prediction_midpoints", lambda s, d: books_now(s, d).where("spread is not null").select("asset_id", R((F.col("best_bid") + F.col("best_ask")) / 2, 6).alias("midpoint")), f"WITH {_PS} SELECT asset_id, round((best_bid+best_ask)/2,6) AS midpoint FROM pl WHERE best_bid IS NOT NULL AND best_ask IS NOT NULL")
register("prediction_spreads", lambda s, d: rounded(books_now(s, d).where("spread is not null").select("asset_id", "spread"), 6), f"WITH {_PS} SELECT asset_id, round(best_ask-best_bid,6) AS spread FROM pl WHERE best_ask-best_bid IS NOT NULL")
register("prediction_prices", lambda s, d: rounded(contracts.prediction_prices(books_now(s, d)), 6), f"WITH {_PS} SELECT asset_id, side, round(CASE WHEN side='BUY' THEN best_ask ELSE best_bid END,6) AS price FROM pl, (VALUES ('BUY'),('SELL')) v(side)")
register("prediction_last_trade", lambda s, d: rounded(A.trades(s, d).withColumn("asset_id", F.expr("concat('tok', event_id % 20)")).groupBy("asset_id").agg(F.max_by("price", F.struct("ts_ms", "event_id")).alias("price"), F.max_by("side", F.struct("ts_ms", "event_id")).alias("side")), 4), "SELECT 'tok' || (event_id % 20) AS asset_id, round(arg_max(price,(ts_ms,event_id)),4) AS price, arg_max(side,(ts_ms,event_id)) AS side FROM trades GROUP BY 1")
register("prediction_summary", lambda s, d: rounded(contracts.prediction_summary(A.order_books(s, d).select(F.expr("cast(event_id as string) as asset_id"), F.expr("transform(reverse(bids), x -> struct(cast(x.price as string) as price, cast(x.qty as string) as size)) as bids"), F.expr("transform(asks, x -> struct(cast(x.price as string) as price, cast(x.qty as string) as size)) as asks")))), "SELECT event_id::VARCHAR AS asset_id, round(max(price) FILTER (side='bid'),4) AS best_bid, round(min(price) FILTER (side='ask'),4) AS best_ask, sum(qty) FILTER (side='bid') AS bid_depth, sum(qty) FILTER (side='ask') AS ask_depth, 10 AS bid_levels, 10 AS ask_levels, round(min(price) FILTER (side='ask')-max(price) FILTER (side='bid'),4) AS spread FROM lv GROUP BY event_id")
register("prediction_history", lambda s, d: rounded(contracts.prediction_history(A.prediction_events(s, d).where("best_bid is not null").withColumn("price", F.col("best_bid")), 720, 1_704_500_000_000), 6), "SELECT asset_id, ts_ms//43200000*43200000 AS t, round(arg_max(best_bid,(ts_ms,event_id)),6) AS p FROM pe WHERE best_bid IS NOT NULL AND ts_ms>=1704500000000 GROUP BY 1, 2")
