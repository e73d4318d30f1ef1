"""Domain tables derived from the driver's tables; PREFIX is the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.state import EVENT


def read(spark: SparkSession, d: str | DataFrame, name: str) -> DataFrame:
    """A table of the folder ``d``; a stream of that table may be given in its place."""
    return d if isinstance(d, DataFrame) else spark.read.parquet(f"{d}/{name}.parquet")


def _pick(names: list[str], index: str):
    return F.element_at(F.array(*map(F.lit, names)), F.expr(f"cast({index} as int) + 1"))


EXCHANGES = ["binance", "okx", "bybit"]
SYMBOLS = ["BTCUSDT", "ETHUSDT", "SOLUSDT", "XRPUSDT", "DOGEUSDT"]


def ev(spark: SparkSession, d: str | DataFrame) -> DataFrame:
    return read(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        _pick(EXCHANGES, "user_id % 3").alias("exchange"),
        _pick(SYMBOLS, "(user_id div 3) % 5").alias("symbol"),
        F.when(F.col("event_id") % 2 == 0, "spot").otherwise("perp").alias("market"),
    )


def trades(spark, d) -> DataFrame:
    return ev(spark, d).selectExpr(
        "event_id", "exchange", "market", "symbol", "100D + value as price", "cast(k + 1 as double) as qty",
        "case when event_type in ('click', 'view') then 'buy' when event_type in ('purchase', 'error') then 'sell' else 'unknown' end as side",
        "concat('t', event_id) as trade_id", "ts_ms",
    )


def quotes(spark, d) -> DataFrame:
    return (
        ev(spark, d).withColumn("bid", F.expr("100D + value"))
        .withColumn("ask", F.expr("case when event_id % 97 = 0 then bid - 1D else bid * (1D + (k + 1) / 10000D) end"))
        .selectExpr(
            "event_id", "exchange", "market", "symbol", "bid", "ask", "case when k % 10 <> 0 then (bid + ask) / 2D end as mark",
            "case when market = 'perp' and k % 4 <> 0 then (k - 50) / 100000D end as funding_rate", "ts_ms",
        )
    )


def funding(spark, d) -> DataFrame:
    return ev(spark, d).where("market = 'perp'").selectExpr(
        "event_id", "exchange", "symbol", "(k - 50) / 100000D as funding_rate", "(ts_ms div 28800000 + 1) * 28800000 as next_funding_time_ms",
        "100D + value as mark_price", "100D + 0.999D * value as index_price", "ts_ms",
    )


def open_interest(spark, d) -> DataFrame:
    return ev(spark, d).where("market = 'perp'").selectExpr(
        "event_id", "exchange", "symbol", "1000D * value as open_interest",
        "case when k % 5 <> 0 then 1000D * value * (100D + value) end as open_interest_value", "ts_ms",
    )


def liquidations(spark, d) -> DataFrame:
    return ev(spark, d).where("market = 'perp' and event_type in ('error', 'purchase')").selectExpr(
        "event_id", "exchange", "symbol", "case when event_type = 'error' then 'sell' else 'buy' end as side",
        "100D + value as price", "(k + 1) / 10D as qty", "ts_ms",
    )


def order_books(spark, d) -> DataFrame:
    level = "transform(sequence(0, 9), l -> struct({} as price, cast((7 * event_id + 13 * l + {}) % 11 as double) as qty))"
    return ev(spark, d).where("event_type = 'view'").selectExpr(
        "event_id", "exchange", "market", "symbol", level.format("100D + value - 0.5D * l", 0) + " as bids",
        level.format("100.1D + value + 0.5D * l", 5) + " as asks", "ts_ms",
    )


def signals(spark, d) -> DataFrame:
    return ev(spark, d).select(
        "event_id", _pick(["coingecko", "coinglass", "cryptopanic"], "user_id % 3").alias("source"),
        _pick(["price", "derivatives", "news"], "user_id % 3").alias("category"),
        F.expr("case when k % 20 <> 0 then symbol end as symbol"),
        F.expr("case when event_type = 'signup' then 'market_cap' else event_type end as metric"),
        F.expr("1000000D * value as value"), "ts_ms",
    )


def klines_daily(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select(
        _pick(EXCHANGES, "l_suppkey % 3").alias("exchange"), F.expr("case when l_linenumber % 2 = 0 then 'spot' else 'perp' end as market"),
        _pick(SYMBOLS, "l_partkey % 5").alias("symbol"), F.expr("l_extendedprice / l_quantity as price"), "l_quantity",
        F.expr("unix_millis(cast(l_shipdate as timestamp)) div 86400000 * 86400000 as open_time_ms"),
        F.expr("struct(l_orderkey, l_linenumber, l_extendedprice / l_quantity as p) as ord"),
    )
    return rows.groupBy("exchange", "market", "symbol", "open_time_ms").agg(
        F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"), F.sum("l_quantity").alias("volume"),
    ).selectExpr(
        "exchange", "market", "symbol", "'1d' as interval", "open_time_ms", "open_time_ms + 86399999 as close_time_ms", "open", "high", "low",
        "close", "volume", "'rest' as source", "open_time_ms + 86400000 as updated_at_ms",
    )


def transfers(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(
        _pick(["whale_alert", "mempool", "etherscan"], "o_custkey % 3").alias("source"), _pick(["bitcoin", "bitcoin", "ethereum"], "o_custkey % 3").alias("chain"),
        F.expr("concat('tx', o_orderkey % 1000) as tx_hash"), F.expr("concat('from', o_custkey % 11) as from_address"),
        _pick(["Binance 7", "coinbase hot", "cold wallet", "OKX deposit", "unknown", "kraken", "private"], "o_custkey % 7").alias("to_address"),
        _pick(["BTC", "btc", "ETH"], "o_custkey % 3").alias("asset"), F.expr("o_totalprice / 1000D as amount"),
        F.expr("case when o_orderpriority <> '5-LOW' then 10D * o_totalprice end as amount_usd"),
        F.expr("unix_millis(cast(o_orderdate as timestamp)) as ts_ms"), F.col("o_orderkey").alias("event_id"), F.expr("o_totalprice as tie"),
    )


def options_raw(spark, d) -> DataFrame:
    return read(spark, d, "part").selectExpr(
        "p_partkey", "p_size", "p_retailprice",
        "case p_partkey % 4 when 0 then concat('BTC-260626-', 1000 * (p_size + 1), '-C') when 1 then concat('ETH-26MAR27-', 1000 * (p_size + 1), '-P')"
        " when 2 then concat('BTC-5JUN26-', 1000 * (p_size + 1), '-C-USDT') else concat('SOL-260101-', 1000 * (p_size + 1), '-P') end as instrument_name",
        "case p_partkey % 4 when 0 then 'binance' when 1 then 'deribit' when 2 then 'bybit' else 'okx' end as venue",
        "cast(1700000000000 + (p_partkey % 5) * 600000 as long) as received_at_ms",
    )


def prediction_markets_raw(spark, d) -> DataFrame:
    return read(spark, d, "part").select(
        "p_partkey", F.expr("concat('cond', p_partkey) as condition_id"), F.expr("concat('slug-', p_partkey) as slug"),
        F.concat(F.lit("Will "), _pick(["Bitcoin", "Ethereum", "Doge"], "p_partkey % 3"), F.lit(" "), _pick(["be above", "be below", "reach"], "(p_partkey div 3) % 3"), F.expr("concat(' $', p_size + 1, 'k?')")).alias("question"),
        F.expr("p_size % 7 <> 0 as active"), F.expr("case when p_partkey % 2 = 0 then cast(p_retailprice as string) end as volume_clob"),
        F.expr("case when p_partkey % 3 = 0 then p_retailprice * 2D end as volume_num"), F.expr("cast(p_partkey as string) as volume"),
        F.expr("concat('[\"', p_partkey, 'y\",\"', p_partkey, 'n\"]') as clob_token_ids"), F.expr("case when p_partkey % 5 = 0 then '[\"No\",\"Yes\"]' else '[\"Yes\",\"No\"]' end as outcomes"),
    )


def prediction_events(spark, d) -> DataFrame:
    return ev(spark, d).where("event_type in ('click', 'view', 'purchase')").selectExpr(
        "event_id", "concat('tok', user_id % 20) as asset_id",
        "case event_type when 'click' then 'book' when 'view' then 'best_bid_ask' else 'price_change' end as event_type",
        "case when k % 3 <> 0 then k / 200D end as best_bid", "case when k % 5 <> 0 then (k + 4) / 200D end as best_ask",
        "case when event_type = 'click' then 10D * value end as bid_depth", "case when event_type = 'click' then 5D * value end as ask_depth", "ts_ms",
    )


def listings(spark, d) -> DataFrame:
    return read(spark, d, "part").select("*", F.explode(F.array(*map(F.lit, EXCHANGES))).alias("exchange")).selectExpr(
        "exchange", "case when p_partkey % 4 = 0 then 'spot' else 'perp' end as market", "p_partkey", "p_size",
        "concat('A', p_partkey, case when p_size % 2 = 0 then 'USDT' else 'USDC' end) as symbol",
        "concat('A', p_partkey, '-', case when p_size % 2 = 0 then 'USDT' else 'USDC' end) as native_symbol",
        "concat('A', p_partkey) as base", "case when p_size % 2 = 0 then 'USDT' else 'USDC' end as quote", "p_size % 7 <> 0 as active", "'discovery' as source",
    )


def perp_funding(spark, d) -> DataFrame:
    return listings(spark, d).where("market = 'perp' and p_partkey % 3 <> 0").selectExpr(
        "exchange", "symbol", "native_symbol", "base", "quote", "case when p_size % 11 <> 0 then active end as active",
        "((p_partkey * 37 + length(exchange) * 101) % 401 - 200) / 10000D as funding_rate", "cast(p_partkey * 1000 as long) as ts_ms",
    ).withColumn("funding_rate_pct", F.expr("funding_rate * 100D"))


def unified_events(spark, d) -> DataFrame:
    """All six market domains as rows of one schema (:data:`state.EVENT`), from one scan."""
    level = "transform(sequence(0, 9), l -> struct({} as price, cast((7 * event_id + 13 * l + {}) % 11 as double) as qty))"
    perp = F.col("market") == "perp"
    price, ask = F.expr("100D + value"), F.expr("case when event_id % 97 = 0 then 99D + value else (100D + value) * (1D + (k + 1) / 10000D) end")
    side = F.when(F.col("event_type").isin("click", "view"), "buy").when(F.col("event_type").isin("purchase", "error"), "sell").otherwise("unknown")
    own = [
        ("quote", F.lit(True), {"bid": price, "ask": ask, "mark": F.when(F.col("k") % 10 != 0, (price + ask) / 2)}),
        ("funding", perp, {"funding_rate": F.expr("(k - 50) / 100000D"), "mark_price": price}), ("open_interest", perp, {"open_interest": F.expr("1000D * value")}),
        ("trade", F.lit(True), {"price": price, "qty": F.expr("cast(k + 1 as double)"), "side": side}),
        ("liquidation", perp & F.col("event_type").isin("error", "purchase"), {"price": price, "qty": F.expr("(k + 1) / 10D"), "side": F.when(F.col("event_type") == "error", "sell").otherwise("buy")}),
        ("order_book", F.col("event_type") == "view", {"bids": F.expr(level.format("100D + value - 0.5D * l", 0)), "asks": F.expr(level.format("100.1D + value + 0.5D * l", 5))}),
    ]
    shared = ("exchange", "market", "symbol", "ts_ms", "event_id")
    fields = {c: k for c, k in EVENT.items() if c not in (*shared, "domain")}
    kinds = [F.when(cond, F.struct(F.lit(name).alias("domain"), *[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in fields.items()])) for name, cond, given in own]
    return ev(spark, d).select(*shared, F.explode(F.array_compact(F.array(*kinds))).alias("e")).select("e.domain", *shared, *[f"e.{c}" for c in fields])


PREFIX = """
WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  ['binance','okx','bybit'][user_id % 3 + 1] AS exchange, ['BTCUSDT','ETHUSDT','SOLUSDT','XRPUSDT','DOGEUSDT'][(user_id // 3) % 5 + 1] AS symbol,
  CASE WHEN event_id % 2 = 0 THEN 'spot' ELSE 'perp' END AS market FROM events),
trades AS (SELECT event_id, exchange, market, symbol, 100::DOUBLE + value AS price, (k + 1)::DOUBLE AS qty,
  CASE WHEN event_type IN ('click','view') THEN 'buy' WHEN event_type IN ('purchase','error') THEN 'sell' ELSE 'unknown' END AS side, 't' || event_id AS trade_id, ts_ms FROM ev),
quotes AS (SELECT event_id, exchange, market, symbol, bid, ask, CASE WHEN k % 10 <> 0 THEN (bid + ask) / 2 END AS mark,
  CASE WHEN market = 'perp' AND k % 4 <> 0 THEN (k - 50) / 100000::DOUBLE END AS funding_rate, ts_ms
  FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN bid - 1 ELSE bid * (1::DOUBLE + (k + 1) / 10000::DOUBLE) END AS ask FROM (SELECT *, 100::DOUBLE + value AS bid FROM ev))),
funding AS (SELECT event_id, exchange, symbol, (k - 50) / 100000::DOUBLE AS funding_rate, (ts_ms // 28800000 + 1) * 28800000 AS next_funding_time_ms,
  100::DOUBLE + value AS mark_price, 100::DOUBLE + 0.999::DOUBLE * value AS index_price, ts_ms FROM ev WHERE market = 'perp'),
open_interest AS (SELECT event_id, exchange, symbol, 1000::DOUBLE * value AS open_interest,
  CASE WHEN k % 5 <> 0 THEN 1000::DOUBLE * value * (100::DOUBLE + value) END AS open_interest_value, ts_ms FROM ev WHERE market = 'perp'),
liquidations AS (SELECT event_id, exchange, symbol, CASE WHEN event_type = 'error' THEN 'sell' ELSE 'buy' END AS side, 100::DOUBLE + value AS price,
  (k + 1) / 10::DOUBLE AS qty, ts_ms FROM ev WHERE market = 'perp' AND event_type IN ('error','purchase')),
lv AS (SELECT event_id, exchange, market, symbol, ts_ms, s AS side, l AS lvl,
  CASE WHEN s = 'bid' THEN 100::DOUBLE + value - 0.5::DOUBLE * l ELSE 100.1::DOUBLE + value + 0.5::DOUBLE * l END AS price,
  ((7 * event_id + 13 * l + CASE WHEN s = 'ask' THEN 5 ELSE 0 END) % 11)::DOUBLE AS qty
  FROM ev, range(10) r(l), (VALUES ('bid'), ('ask')) v(s) WHERE event_type = 'view'),
signals AS (SELECT event_id, ['coingecko','coinglass','cryptopanic'][user_id % 3 + 1] AS source, ['price','derivatives','news'][user_id % 3 + 1] AS category,
  CASE WHEN k % 20 <> 0 THEN symbol END AS symbol, CASE WHEN event_type = 'signup' THEN 'market_cap' ELSE event_type END AS metric, 1000000::DOUBLE * value AS value, ts_ms FROM ev),
kl AS (SELECT exchange, market, symbol, '1d' AS interval, open_time_ms, open_time_ms + 86399999 AS close_time_ms, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, ord) AS close, sum(q) AS volume, 'rest' AS source, open_time_ms + 86400000 AS updated_at_ms FROM (
  SELECT ['binance','okx','bybit'][l_suppkey % 3 + 1] AS exchange, CASE WHEN l_linenumber % 2 = 0 THEN 'spot' ELSE 'perp' END AS market,
  ['BTCUSDT','ETHUSDT','SOLUSDT','XRPUSDT','DOGEUSDT'][l_partkey % 5 + 1] AS symbol, l_extendedprice / l_quantity AS price, l_quantity AS q,
  epoch_us(l_shipdate) // 1000 // 86400000 * 86400000 AS open_time_ms, (l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS ord FROM lineitem) GROUP BY ALL),
transfers AS (SELECT ['whale_alert','mempool','etherscan'][o_custkey % 3 + 1] AS source, ['bitcoin','bitcoin','ethereum'][o_custkey % 3 + 1] AS chain, 'tx' || (o_orderkey % 1000) AS tx_hash,
  'from' || (o_custkey % 11) AS from_address, ['Binance 7','coinbase hot','cold wallet','OKX deposit','unknown','kraken','private'][o_custkey % 7 + 1] AS to_address,
  ['BTC','btc','ETH'][o_custkey % 3 + 1] AS asset, o_totalprice / 1000::DOUBLE AS amount, CASE WHEN o_orderpriority <> '5-LOW' THEN 10::DOUBLE * o_totalprice END AS amount_usd,
  epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderkey AS event_id, o_totalprice AS tie FROM orders),
options_raw AS (SELECT p_partkey, p_size, p_retailprice, CASE p_partkey % 4 WHEN 0 THEN 'BTC-260626-' || (1000 * (p_size + 1)) || '-C' WHEN 1 THEN 'ETH-26MAR27-' || (1000 * (p_size + 1)) || '-P'
  WHEN 2 THEN 'BTC-5JUN26-' || (1000 * (p_size + 1)) || '-C-USDT' ELSE 'SOL-260101-' || (1000 * (p_size + 1)) || '-P' END AS instrument_name,
  CASE p_partkey % 4 WHEN 0 THEN 'binance' WHEN 1 THEN 'deribit' WHEN 2 THEN 'bybit' ELSE 'okx' END AS venue, 1700000000000 + (p_partkey % 5) * 600000 AS received_at_ms FROM part),
pm_raw AS (SELECT p_partkey, 'cond' || p_partkey AS condition_id, 'slug-' || p_partkey AS slug,
  'Will ' || ['Bitcoin','Ethereum','Doge'][p_partkey % 3 + 1] || ' ' || ['be above','be below','reach'][(p_partkey // 3) % 3 + 1] || ' $' || (p_size + 1) || 'k?' AS question,
  p_size % 7 <> 0 AS active, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS volume_clob, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 END AS volume_num, p_partkey::DOUBLE AS volume,
  p_partkey % 5 = 0 AS swapped FROM part),
pe AS (SELECT event_id, 'tok' || (user_id % 20) AS asset_id, CASE event_type WHEN 'click' THEN 'book' WHEN 'view' THEN 'best_bid_ask' ELSE 'price_change' END AS event_type,
  CASE WHEN k % 3 <> 0 THEN k / 200::DOUBLE END AS best_bid, CASE WHEN k % 5 <> 0 THEN (k + 4) / 200::DOUBLE END AS best_ask,
  CASE WHEN event_type = 'click' THEN 10::DOUBLE * value END AS bid_depth, CASE WHEN event_type = 'click' THEN 5::DOUBLE * value END AS ask_depth, ts_ms FROM ev WHERE event_type IN ('click','view','purchase')),
listings AS (SELECT exchange, CASE WHEN p_partkey % 4 = 0 THEN 'spot' ELSE 'perp' END AS market, p_partkey, p_size, 'A' || p_partkey || CASE WHEN p_size % 2 = 0 THEN 'USDT' ELSE 'USDC' END AS symbol,
  'A' || p_partkey || '-' || CASE WHEN p_size % 2 = 0 THEN 'USDT' ELSE 'USDC' END AS native_symbol, 'A' || p_partkey AS base, CASE WHEN p_size % 2 = 0 THEN 'USDT' ELSE 'USDC' END AS quote,
  p_size % 7 <> 0 AS active, 'discovery' AS source FROM part, (VALUES ('binance'), ('okx'), ('bybit')) v(exchange)),
pf AS (SELECT exchange, symbol, native_symbol, base, quote, CASE WHEN p_size % 11 <> 0 THEN active END AS active,
  ((p_partkey * 37 + length(exchange) * 101) % 401 - 200) / 10000::DOUBLE AS funding_rate, p_partkey * 1000 AS ts_ms,
  ((p_partkey * 37 + length(exchange) * 101) % 401 - 200) / 10000::DOUBLE * 100 AS funding_rate_pct FROM listings WHERE market = 'perp' AND p_partkey % 3 <> 0),
now AS (SELECT max(ts_ms) AS t FROM ev),
lt AS (SELECT *, t - ts_ms AS latency_ms, t - ts_ms > 7200000 AS stale FROM quotes, now QUALIFY row_number() OVER (PARTITION BY exchange, market, symbol ORDER BY ts_ms DESC, event_id DESC) = 1),
lb AS (SELECT * FROM lv QUALIFY dense_rank() OVER (PARTITION BY exchange, market, symbol ORDER BY ts_ms DESC, event_id DESC) = 1),
"""


def event_stream(spark: SparkSession, d: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a file stream, with the batch table's schema."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{d}/events.parque[t]")
