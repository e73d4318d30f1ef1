"""Latest state per key, filters over it, and the joins between domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import scans

KEY = ("exchange", "market", "symbol")


def as_of(df: DataFrame) -> Column:
    """The default clock: the time of the latest event, as a scalar subquery of the plan that uses it."""
    return df.agg(F.coalesce(F.max("ts_ms"), F.lit(0)).alias("now")).scalar()


def latest(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The last row per key by (ts_ms, event_id): one partial aggregate, no sort of the history."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("ts_ms", "event_id")).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def with_freshness(df: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    latency = F.greatest(F.lit(now) - F.col("ts_ms"), F.lit(0))
    return df.withColumns({"latency_ms": latency, "stale": latency > ttl_ms})


def latest_ticks(quotes: DataFrame, now: int | Column | None = None, ttl_ms: int = 1500) -> DataFrame:
    now = as_of(quotes) if now is None else now
    return with_freshness(latest(quotes, KEY), now, ttl_ms)


def prune_snapshots(state: DataFrame, now: int, ttl_ms: int, max_keys: int = 100_000) -> DataFrame:
    """Rows no older than 120 ttl (5 minutes to 1 hour), then the newest ``max_keys``."""
    retention = min(max(ttl_ms * 120, 300_000), 3_600_000)
    return state.where(F.lit(now) - F.col("ts_ms") <= retention).orderBy(F.desc("ts_ms"), *[c for c in KEY if c in state.columns]).limit(max_keys)


def in_set(col: Column, values: list[str] | None, fold=F.upper) -> Column:
    return F.lit(True) if values is None else fold(col).isin(values)


def filter_market(df: DataFrame, symbols=None, exchanges=None, market: str | None = None) -> DataFrame:
    """Set filters; ``market`` counts only where the domain has one."""
    out = df.where(in_set(F.col("symbol"), symbols) & in_set(F.col("exchange"), exchanges, F.lower))
    return out.where(F.col("market") == market) if market and "market" in df.columns else out


def quotes_view(ticks: DataFrame, symbols=None, exchanges=None, market=None, include_stale: bool = False) -> DataFrame:
    out = filter_market(ticks, symbols, exchanges, market)
    return out if include_stale else out.where(~F.col("stale"))


def signals_view(df: DataFrame, sources=None, categories=None, symbols=None, metrics=None) -> DataFrame:
    """Signals by sets; a row without a symbol passes the symbol filter."""
    keep = in_set(F.col("source"), sources, F.lower) & in_set(F.col("category"), categories, F.lower) & in_set(F.col("metric"), metrics, F.lower)
    return df.where(keep & (F.col("symbol").isNull() | in_set(F.col("symbol"), symbols)))


def stream_filter(df: DataFrame, symbols=None, exchanges=None, market=None, include_stale=False) -> DataFrame:
    """The filter of live streams: with symbols given, a row without one is dropped."""
    out = filter_market(df, symbols, exchanges, market) if "exchange" in df.columns else df.where(F.lit(True) if symbols is None else F.upper("symbol").isin(symbols))
    return out if include_stale or "stale" not in df.columns else out.where(~F.col("stale"))


def basis(ticks: DataFrame, symbols=None, exchanges=None) -> DataFrame:
    """Perp minus spot mid of fresh quotes, per exchange and symbol."""
    fresh = quotes_view(ticks, symbols, exchanges, include_stale=True).where("bid > 0 and ask > 0 and not stale")
    side = lambda m: fresh.where(F.col("market") == m).select("exchange", "symbol", ((F.col("bid") + F.col("ask")) / 2).alias(m), F.col("ts_ms").alias(f"{m}_ts"))
    diff = F.col("perp") - F.col("spot")
    return side("spot").join(side("perp"), ["exchange", "symbol"]).select(
        "exchange", "symbol", F.col("spot").alias("spot_mid"), F.col("perp").alias("perp_mid"), diff.alias("basis"),
        (diff / F.col("spot") * 10_000).alias("basis_bps"), F.greatest("spot_ts", "perp_ts").alias("ts_ms"),
    )


def dedupe_trades(trades: DataFrame) -> DataFrame:
    """The first row per (exchange, market, symbol, trade_id); rows without an id all stay."""
    keys = [*KEY, "trade_id"]
    rest = [c for c in trades.columns if c not in keys]
    first = trades.where("trade_id is not null").groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ts_ms", "event_id")).alias("_r"))
    return first.select(*keys, "_r.*").unionByName(trades.where("trade_id is null"))


def dedupe_transfers(transfers: DataFrame) -> DataFrame:
    """The first transfer per (source, chain, tx_hash)."""
    keys = ["source", "chain", "tx_hash"]
    rest = [c for c in transfers.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("ts_ms", "event_id", "tie")).alias("_r")
    return transfers.groupBy(*keys).agg(best).select(*keys, "_r.*")


def transfers_view(df: DataFrame, source=None, chain=None, asset=None, min_amount_usd=None, limit: int = 500) -> DataFrame:
    for col, value in (("source", source), ("chain", chain), ("asset", asset)):
        if value is not None:
            df = df.where(F.lower(col) == value.lower())
    if min_amount_usd is not None:
        df = df.where(F.col("amount_usd") >= min_amount_usd)
    return df.orderBy(F.desc("ts_ms"), F.desc("event_id"), F.desc("tie")).limit(limit)


#: Quotes that an instrument's name may end with (fixed values).
ENVELOPE_QUOTES = ["USDT", "USDC", "USD", "BTC", "ETH"]


def instrument_id(symbol: Column, market: Column) -> Column:
    s = S.split_symbol(F.regexp_replace(F.trim(symbol), "^t+", ""), ENVELOPE_QUOTES)
    return F.concat_ws("-", s.base, s.quote, F.upper(market))


ENVELOPE = ("version", "domain", "source_ref", "instrument_ref", "freshness", "payload")


def _envelope(df: DataFrame, domain: str, source: dict, instrument: dict, freshness: dict, payload: list[str]) -> DataFrame:
    """Rows in their envelope: source and instrument references, freshness and payload as structs; what is unknown is null."""
    pack = lambda names, given: F.struct(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    return df.select(
        F.lit("v1").alias("version"), F.lit(domain).alias("domain"), pack(("source_type", "source", "venue", "chain", "protocol"), source).alias("source_ref"),
        pack(("asset_class", "product_type", "instrument_id", "symbol", "base", "quote", "market_id"), instrument).alias("instrument_ref"),
        F.struct(*[v.alias(n) for n, v in freshness.items()]).alias("freshness"), F.struct(*payload).alias("payload"),
    )


def envelopes(ticks: DataFrame) -> DataFrame:
    """Quotes in their envelope."""
    parts = S.split_symbol(F.regexp_replace(F.trim("symbol"), "^t+", ""), ENVELOPE_QUOTES)
    return _envelope(
        ticks, "market_quote", {"source_type": F.lit("cex"), "source": F.col("exchange"), "venue": F.col("exchange")},
        {"asset_class": F.lit("crypto"), "product_type": F.col("market"), "instrument_id": instrument_id(F.col("symbol"), F.col("market")), "symbol": F.col("symbol"), "base": parts.base, "quote": parts.quote},
        {"ts_source": F.col("ts_ms"), "ts_received": F.col("ts_ms") + F.col("latency_ms"), "latency_ms": F.col("latency_ms"), "stale": F.col("stale")}, ["bid", "ask", "mark", "funding_rate"],
    )


def option_envelopes(options: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    """Option summaries (venue, instrument_name, currency, expiry_time, strike, option_type, received_at_ms) in their envelope."""
    age = F.greatest(F.lit(now) - F.col("received_at_ms"), F.lit(0))
    rows = options.withColumn("position", F.col("p_partkey") if "p_partkey" in options.columns else F.lit(0))
    return _envelope(
        rows, "option_chain", {"source_type": F.lit("exchange"), "source": F.col("venue"), "venue": F.col("venue")},
        {"asset_class": F.lit("crypto"), "product_type": F.lit("option"), "instrument_id": F.col("instrument_name"), "symbol": F.col("instrument_name"), "base": F.col("currency")},
        {"ts_source": F.col("received_at_ms"), "ts_received": F.col("received_at_ms"), "latency_ms": F.lit(0).cast("long"), "stale": age > ttl_ms},
        ["expiry_time", "strike", "option_type", "position"],
    )


def prediction_envelopes(books: DataFrame, now: int, ttl_ms: int, source: str = "polymarket") -> DataFrame:
    """Prediction-market books (asset_id, event_id, sides and depths, ts_ms) in their envelope."""
    age = F.greatest(F.lit(now) - F.col("ts_ms"), F.lit(0))
    return _envelope(
        books.withColumn("position", F.col("event_id")), "prediction_book", {"source_type": F.lit("prediction_market"), "source": F.lit(source), "venue": F.lit(source)},
        {"asset_class": F.lit("prediction"), "product_type": F.lit("binary"), "instrument_id": F.col("asset_id"), "market_id": F.col("asset_id")},
        {"ts_source": F.col("ts_ms"), "ts_received": F.col("ts_ms"), "latency_ms": F.lit(0).cast("long"), "stale": age > ttl_ms},
        ["best_bid", "best_ask", "bid_depth", "ask_depth", "position"],
    )


def finite_events(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & S.finite(F.col(c))
    return df.where(keep)


def instruments(quotes: DataFrame, options: DataFrame, books: DataFrame) -> DataFrame:
    """One row per instrument; quotes win over options, options over prediction books."""
    every = (
        quotes.select(instrument_id(F.col("symbol"), F.col("market")).alias("instrument_id"), F.lit(0).alias("rank"), F.lit("market").alias("kind"))
        .union(options.select("instrument_name", F.lit(1), F.lit("option")))
        .union(books.select("asset_id", F.lit(2), F.lit("prediction")))
    )
    return every.groupBy("instrument_id").agg(F.min_by("kind", "rank").alias("kind"))


def catalog_health(*parts: DataFrame) -> DataFrame:
    """Per (source, domain): records, stale ones, last received, and a status."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = every.groupBy("source", "domain").agg(
        F.count("*").alias("records"), F.count_if("stale").alias("stale_records"), F.max("ts_ms").alias("last_received_ms")
    )
    status = F.when(F.col("records") == 0, "no_data").when(F.col("stale_records") == 0, "healthy").when(F.col("stale_records") == F.col("records"), "stale").otherwise("degraded")
    return out.withColumn("status", status)


def event_counts(*typed: tuple[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in typed:
        part = df.agg(F.lit(name).alias("type"), F.count("*").alias("events"))
        out = part if out is None else out.union(part)
    return out


def asof_mid(events: DataFrame, quotes: DataFrame, width_ms: int = scans.WIDTH) -> DataFrame:
    """Each event with the mid of the last quote of its key at or before it."""
    q = quotes.select(*KEY, "ts_ms", "event_id", S.mid_uncrossed(F.col("bid"), F.col("ask")).alias("mid"), F.lit(0).alias("kind"))
    e = events.select(*KEY, "ts_ms", "event_id", F.lit(None).cast("double").alias("mid"), F.lit(1).alias("kind"))
    both = scans.last_known(q.unionByName(e), KEY, {"asof_mid": "mid"}, order=("ts_ms", "event_id", "kind"), width_ms=width_ms)
    return both.where("kind = 1").select(*KEY, "event_id", "asof_mid")


#: Columns of the unified events (:func:`market_states`, :func:`scoring.symbol_metrics`) and their types.
EVENT = {
    "domain": "string", "exchange": "string", "market": "string", "symbol": "string", "ts_ms": "long", "event_id": "long", "bid": "double", "ask": "double", "mark": "double", "funding_rate": "double",
    "mark_price": "double", "open_interest": "double", "price": "double", "qty": "double", "side": "string", "bids": "array<struct<price:double,qty:double>>", "asks": "array<struct<price:double,qty:double>>",
}


def market_states(events: DataFrame, now: int | Column | None = None, ttl_ms: int = 1500, k: int = 10) -> DataFrame:
    """The state of every (exchange, market, symbol) from one scan of the unified events.

    One conditional aggregate per (exchange, symbol) keeps the last quote and
    book of each market, the last funding rate and open interest; spreads,
    depth and basis come from that row, the disagreement of venues from the
    rows of a symbol.
    """
    quotes = events.where("domain = 'quote'")
    now = as_of(quotes) if now is None else now
    place = F.struct("ts_ms", "event_id")
    bps = lambda lo, hi: (hi - lo) / ((lo + hi) / 2) * 10_000
    b, a = F.col("bids")[0].price, F.col("asks")[0].price
    depth = S.book_sum(F.col("bids"), k, False) + S.book_sum(F.col("asks"), k, False)
    book = F.when((b > 0) & (a >= b), F.struct(depth.alias("depth"), (depth / (1 + F.greatest(bps(b, a), F.lit(0.0)))).alias("score")))
    rows = events.select("domain", "exchange", "market", "symbol", "ts_ms", "event_id", "bid", "ask", "funding_rate", "open_interest", book.alias("book"))
    of = lambda domain, market=None: F.when((F.col("domain") == domain) & (F.lit(True) if market is None else F.col("market") == market), place)
    markets = ("spot", "perp")
    aggs = [F.max_by("funding_rate", of("funding")).alias("funding_rate"), F.max_by("open_interest", of("open_interest")).alias("open_interest")]
    for m in markets:
        aggs += [F.max_by(F.struct("bid", "ask", "ts_ms"), of("quote", m)).alias(f"q_{m}"), F.max_by("book", of("order_book", m)).alias(f"b_{m}")]
    one = rows.groupBy("exchange", "symbol").agg(*aggs)
    priced = {m: (F.col(f"q_{m}").bid > 0) & (F.col(f"q_{m}").ask > 0) for m in markets}
    oldest = F.least(F.col("q_spot").ts_ms, F.col("q_perp").ts_ms)
    mid = {m: (F.col(f"q_{m}").bid + F.col(f"q_{m}").ask) / 2 for m in markets}
    basis = F.when(priced["spot"] & priced["perp"] & (F.greatest(F.lit(now) - oldest, F.lit(0)) <= ttl_ms), (mid["perp"] - mid["spot"]) / mid["spot"] * 10_000)
    each = F.explode(F.array(*[
        F.struct(F.lit(m).alias("market"), F.col(f"q_{m}").isNotNull().alias("quoted"), mid[m].alias("mid"), bps(F.col(f"q_{m}").bid, F.col(f"q_{m}").ask).alias("spread_bps"), F.col(f"b_{m}").depth.alias("depth_notional"), F.col(f"b_{m}").score.alias("liquidity_score"))
        for m in markets])).alias("m")
    flat = one.select("exchange", "symbol", "funding_rate", "open_interest", basis.alias("basis_bps"), each).select("exchange", "symbol", "m.*", "funding_rate", "open_interest", "basis_bps")
    venues = W.partitionBy("market", "symbol")
    seen = F.when(F.col("mid") > 0, F.col("mid"))
    apart = F.when(F.count(seen).over(venues) >= 2, (F.max(seen).over(venues) - F.min(seen).over(venues)) / F.avg(seen).over(venues) * 10_000)
    return flat.withColumn("disagreement_bps", apart)


def context_bundle(limit: int, **sections: DataFrame) -> DataFrame:
    """The first ``limit`` rows of each section by (symbol, source)."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), "symbol", F.col("exchange").alias("source"), "market", "value").orderBy("symbol", "exchange", "market").limit(limit)
        out = part if out is None else out.unionByName(part)
    return out
