"""Cross-venue signals: best pairs, fees, profit, funding and spread screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import scans


def best_pair(legs: DataFrame, keys: tuple[str, ...], sell: str, buy: str) -> DataFrame:
    """Per key the pair of venues with the greatest ``sell - buy``.

    The best partner of a venue that sells is the cheapest other venue, which
    is the cheapest or, for the cheapest itself, the second: two rows per key
    instead of a self-join of all venues.  Ties go to the first (buy, sell) by name.
    """
    rows = legs.where(F.col(sell).isNotNull() | F.col(buy).isNotNull())
    asks = F.sort_array(F.collect_list(F.when(F.col(buy).isNotNull(), F.struct(F.col(buy).alias("p"), F.col("exchange").alias("x")))))  # one entry per venue
    bids = F.sort_array(F.collect_list(F.when(F.col(sell).isNotNull(), F.struct((-F.col(sell)).alias("p"), F.col("exchange").alias("x")))))
    two = rows.groupBy(*keys).agg(asks.alias("a"), bids.alias("b"))
    # equal prices may stand anywhere in the order: keep all venues at the two best prices
    second = lambda c: F.array_distinct(F.transform(c, lambda e: e.p))
    near = two.select(
        *keys, F.filter("a", lambda e: e.p <= F.coalesce(F.get(second("a"), 1), e.p)).alias("a"), F.filter("b", lambda e: e.p <= F.coalesce(F.get(second("b"), 1), e.p)).alias("b")
    )
    pairs = near.select(*keys, F.explode("a").alias("a"), "b").select(*keys, "a", F.explode("b").alias("b")).where("a.x <> b.x")
    found = pairs.select(*keys, F.col("a.x").alias("buy_exchange"), F.col("a.p").alias("ask"), F.col("b.x").alias("sell_exchange"), (-F.col("b.p")).alias("bid"))
    rank = F.struct((F.col("ask") - F.col("bid")).alias("d"), "buy_exchange", "sell_exchange")
    return found.groupBy(*keys).agg(F.min_by(F.struct("buy_exchange", "ask", "sell_exchange", "bid"), rank).alias("_r")).select(*keys, "_r.*")


def cross_pair(ticks: DataFrame) -> DataFrame:
    return best_pair(ticks.where("not stale and bid > 0 and ask > 0"), ("market", "symbol"), "bid", "ask")


def leg_fees(pairs: DataFrame, fees: DataFrame | None, mode: str = "taker", maker: float = 2.0, taker: float = 10.0) -> DataFrame:
    """Fee per leg by mode, from the venue's table or the fallback.

    ``fees`` (exchange, maker_bps, taker_bps) has a row per venue; Spark
    broadcasts it by its own size threshold.
    """
    kinds = {"taker": ("taker", "taker"), "maker": ("maker", "maker"), "maker_buy_taker_sell": ("maker", "taker"), "taker_buy_maker_sell": ("taker", "maker")}[mode]
    back = {"maker": maker, "taker": taker}
    for leg, kind in zip(("buy", "sell"), kinds, strict=True):
        if fees is None:
            pairs = pairs.withColumn(f"{leg}_fee_bps", F.lit(back[kind]))
            continue
        own = fees.select(F.col("exchange").alias(f"{leg}_exchange"), F.col(f"{kind}_bps").alias("_f"))
        pairs = pairs.join(own, f"{leg}_exchange", "left").withColumn(f"{leg}_fee_bps", F.coalesce("_f", F.lit(back[kind]))).drop("_f")
    return pairs


def profit(pairs: DataFrame, slippage_bps: float = 0.5) -> DataFrame:
    ask, bid = F.col("ask"), F.col("bid")
    out = pairs.withColumns(
        {
            "gross": bid - ask,
            "gross_bps": F.when(ask > 0, (bid - ask) / ask * 10_000).otherwise(0.0),
            "buy_fee": ask * F.col("buy_fee_bps") / 10_000,
            "sell_fee": bid * F.col("sell_fee_bps") / 10_000,
            "slip": (ask + bid) / 2 * (2 * slippage_bps) / 10_000,
        }
    )
    net = F.col("gross") - F.col("buy_fee") - F.col("sell_fee") - F.col("slip")
    return out.withColumn("net", net).withColumn("net_bps", F.when(ask > 0, F.col("net") / ask * 10_000).otherwise(0.0))


def spread_signal(ticks, fees=None, mode="taker", slippage_bps=0.5, min_profit=1.0, min_bps=0.5) -> DataFrame:
    out = profit(leg_fees(cross_pair(ticks), fees, mode), slippage_bps)
    return out.withColumn("eligible", (F.col("net") >= min_profit) & (F.col("net_bps") >= min_bps))


def book_cross_pair(prices: DataFrame) -> DataFrame:
    """Best pair over average execution prices (exchange, market, symbol, sell_price, buy_price)."""
    return best_pair(prices, ("market", "symbol"), "sell_price", "buy_price")


def book_signal(prices, fees=None, mode="taker", slippage_bps=0.5, min_profit=1.0, min_bps=0.5) -> DataFrame:
    out = profit(leg_fees(book_cross_pair(prices), fees, mode), slippage_bps)
    return out.withColumn("eligible", (F.col("net") >= min_profit) & (F.col("net_bps") >= min_bps))


def signal_state(signals: DataFrame, keys: tuple[str, ...], hold_ms: int = 500, order: tuple[str, ...] = ("ts_ms",), width_ms: int = scans.WIDTH) -> DataFrame:
    """FILTERED, HOLDING or TRIGGER for every report (ts_ms, eligible) of a key."""
    near = scans.neighbours(signals, keys, before={"_was": "eligible"}, order=order, width_ms=width_ms)
    starts = near.withColumn("_at", F.when(F.col("eligible") & ~F.coalesce("_was", F.lit(False)), F.col("ts_ms")))
    out = scans.last_known(starts, keys, {"_start": "_at"}, order=order, width_ms=width_ms)
    state = F.when(~F.col("eligible"), "FILTERED").when(F.col("ts_ms") - F.col("_start") >= hold_ms, "TRIGGER").otherwise("HOLDING")
    return out.withColumn("state", state).drop("_was", "_at", "_start")


def fee_tier(volumes: DataFrame, tiers: DataFrame) -> DataFrame:
    """The tier with the highest minimum at or under the volume, else the first tier.

    Tiers enter as one sorted array on every row of their venue (a few entries).
    """
    grouped = tiers.groupBy("exchange").agg(F.sort_array(F.collect_list(F.struct("min_volume", "maker", "taker"))).alias("tiers"))
    fit = F.filter("tiers", lambda t: t.min_volume <= F.col("volume"))
    pick = F.when(F.size(fit) > 0, F.element_at(fit, -1)).otherwise(F.get("tiers", 0))
    return volumes.join(grouped, "exchange").withColumn("t", pick).select(*volumes.columns, F.col("t.maker").alias("maker"), F.col("t.taker").alias("taker"))


def funding_divergence(funding: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    fresh = funding.where(F.lit(now) - F.col("ts_ms") <= ttl_ms)
    out = fresh.groupBy("symbol").agg(
        F.min_by("exchange", F.struct("funding_rate", "exchange")).alias("min_exchange"), F.min("funding_rate").alias("min_rate"),
        F.min_by("exchange", F.struct(-F.col("funding_rate"), F.col("exchange"))).alias("max_exchange"), F.max("funding_rate").alias("max_rate"), F.count("*").alias("venues"),
    )
    return out.where("venues >= 2").withColumn("spread", F.col("max_rate") - F.col("min_rate")).withColumn("spread_bps", F.col("spread") * 10_000)


def spread_filter(ticks: DataFrame, max_spread_bps: float = 1000.0) -> DataFrame:
    mid = S.mid_uncrossed(F.col("bid"), F.col("ask"))
    out = ticks.where("not stale").withColumn("mid", mid).where("mid is not null").withColumn("spread_bps", (F.col("ask") - F.col("bid")) / F.col("mid") * 10_000)
    return out.where(F.col("spread_bps") <= max_spread_bps).orderBy("spread_bps", "exchange", "market", "symbol")


def cross_market(ticks: DataFrame, require_both: bool = True) -> DataFrame:
    """Venues with spot and with perp quotes, per symbol."""
    side = lambda m: F.array_sort(F.collect_set(F.when(F.col("market") == m, F.col("exchange"))))
    out = ticks.where("not stale").groupBy("symbol").agg(side("spot").alias("spot_sources"), side("perp").alias("perp_sources"))
    out = out.withColumn("has_both", (F.size("spot_sources") > 0) & (F.size("perp_sources") > 0))
    return out.where("has_both") if require_both else out


def market_cap(latest_signals: DataFrame, limit: int = 100) -> DataFrame:
    """The largest latest market caps with their ranks; only the ``limit`` rows that stay are ranked in one place."""
    order = [F.desc("value"), "source", "symbol"]
    rows = latest_signals.where("metric = 'market_cap' and value is not null").orderBy(*order).limit(limit)
    return rows.select("source", "symbol", "value", F.row_number().over(W.orderBy(*order)).alias("rank"))
