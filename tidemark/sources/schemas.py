"""Typed schema of every domain table (times are epoch milliseconds, UTC)."""

LEVELS = "array<struct<price:double,qty:double>>"
DOMAINS = {
    "quotes": "event_id long, exchange string, market string, symbol string, bid double, ask double, mark double, funding_rate double, ts_ms long",
    "funding": "event_id long, exchange string, symbol string, funding_rate double, next_funding_time_ms long, mark_price double, index_price double, ts_ms long",
    "open_interest": "event_id long, exchange string, symbol string, open_interest double, open_interest_value double, ts_ms long",
    "trades": "event_id long, exchange string, market string, symbol string, price double, qty double, side string, trade_id string, ts_ms long",
    "liquidations": "event_id long, exchange string, symbol string, side string, price double, qty double, ts_ms long",
    "order_books": f"event_id long, exchange string, market string, symbol string, bids {LEVELS}, asks {LEVELS}, ts_ms long",
    "signals": "event_id long, source string, category string, symbol string, metric string, value double, score double, title string, url string, raw string, ts_ms long",
    "klines": "exchange string, market string, symbol string, interval string, open_time_ms long, close_time_ms long, open double, high double, low double, close double, volume double, source string, updated_at_ms long",
    "transfers": "source string, chain string, tx_hash string, from_address string, to_address string, asset string, amount double, amount_usd double, direction string, block_height long, ts_ms long",
    "listings": "exchange string, market string, symbol string, native_symbol string, base string, quote string, active boolean, status string, contract_type string, settle_asset string, source string",
    "perp_funding": "exchange string, symbol string, native_symbol string, funding_rate double, funding_rate_pct double, next_funding_time_ms long, mark_price double, index_price double, active boolean, source string, ts_ms long",
}


def load(spark, path: str, domain: str, kind: str = "parquet"):
    """A landed domain table with its declared schema, never an inferred one."""
    return spark.read.schema(DOMAINS[domain]).format(kind).load(path)
