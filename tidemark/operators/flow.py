"""Order flow, footprints, and trailing flow windows over trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import scans
from tidemark.operators.state import KEY

BUCKET = (*KEY, "window_ms", "bucket_start_ms")


def _sum(cond: Column, value: Column, name: str) -> Column:
    return F.sum(F.when(cond, value).otherwise(0.0)).alias(name)


def order_flow(trades: DataFrame, windows_ms=(60_000, 300_000, 900_000), large: float = 100_000.0) -> DataFrame:
    """Buy and sell flow per bucket with the running delta of its key and window.

    Trades without a positive notional are ignored.  Buckets of the smallest
    window that divides all others are aggregated first and rolled up, so each
    trade is shuffled once whatever the number of windows.
    """
    fine = min(windows_ms)
    if any(w % fine for w in windows_ms):
        raise ValueError("every window must be a multiple of the smallest")
    notional = F.col("price") * F.col("qty")
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    sums = ["buy_qty", "sell_qty", "buy_notional", "sell_notional", "trade_count", "buy_count", "sell_count", "large_trade_count"]
    base = (
        trades.where((notional > 0) & (notional < float("inf"))).withColumn("bucket_start_ms", S.bucket_start(F.col("ts_ms"), fine))
        .groupBy(*KEY, "bucket_start_ms")
        .agg(
            _sum(buy, F.col("qty"), "buy_qty"), _sum(sell, F.col("qty"), "sell_qty"), _sum(buy, notional, "buy_notional"), _sum(sell, notional, "sell_notional"),
            F.count("*").alias("trade_count"), F.count_if(buy).alias("buy_count"), F.count_if(sell).alias("sell_count"),
            F.count_if(notional >= large).alias("large_trade_count"),
        )
    )
    every = base.withColumn("window_ms", F.explode(F.array(*[F.lit(w).cast("long") for w in windows_ms])))
    rolled = every.withColumn("bucket_start_ms", S.bucket_start(F.col("bucket_start_ms"), F.col("window_ms"))).groupBy(*BUCKET).agg(*[F.sum(c).alias(c) for c in sums])
    running = W.partitionBy(*KEY, "window_ms").orderBy("bucket_start_ms").rowsBetween(W.unboundedPreceding, 0)
    known = F.col("buy_count") + F.col("sell_count")
    return rolled.withColumns(
        {
            "delta_qty": F.col("buy_qty") - F.col("sell_qty"),
            "delta_notional": F.col("buy_notional") - F.col("sell_notional"),
            "aggressive_buy_ratio": F.when(known > 0, F.col("buy_count") / known),
            "aggressive_sell_ratio": F.when(known > 0, F.col("sell_count") / known),
        }
    ).withColumns({"cumulative_delta_qty": F.sum("delta_qty").over(running), "cumulative_delta_notional": F.sum("delta_notional").over(running)})


def order_flow_windows(flow: DataFrame, limit_per_window: int = 50) -> DataFrame:
    """The newest buckets of each window."""
    w = W.partitionBy("window_ms").orderBy(F.desc("bucket_start_ms"), *KEY)
    return flow.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= limit_per_window).drop("_i")


def bucket_retention(flow: DataFrame, now: int, n: int = 500, max_age_ms: int = 86_400_000) -> DataFrame:
    w = W.partitionBy(*KEY, "window_ms").orderBy(F.desc("bucket_start_ms"))
    young = flow.where(F.lit(now) - F.col("bucket_start_ms") <= max_age_ms)
    return young.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def footprint_levels(trades: DataFrame, interval_ms: int = 60_000, scale: float = 1.0) -> DataFrame:
    """Per bucket and price bin: buy volume as ask, sell volume as bid.

    A trade of unknown side makes its bin, with nothing in it.
    """
    ask, bid = F.col("side") == "buy", F.col("side") == "sell"
    notional = F.col("price") * F.col("qty")
    rows = trades.where(notional > 0).withColumns({"bucket_start_ms": S.bucket_start(F.col("ts_ms"), interval_ms), "bin": F.round(F.col("price") / scale).cast("long")})
    out = rows.groupBy(*KEY, "bucket_start_ms", "bin").agg(
        _sum(ask, F.col("qty"), "ask_qty"), _sum(bid, F.col("qty"), "bid_qty"), _sum(ask, notional, "ask_notional"), _sum(bid, notional, "bid_notional"),
        F.count_if(ask | bid).alias("trades"),
    )
    return out.withColumns({"price": F.col("bin") * scale, "total_qty": F.col("ask_qty") + F.col("bid_qty"), "delta_qty": F.col("ask_qty") - F.col("bid_qty")})


def footprint_imbalance(levels: DataFrame, ratio: float = 3.0, volume: float = 0.0) -> DataFrame:
    """Diagonal imbalance flags between a level and the next present one."""
    w = W.partitionBy(*KEY, "bucket_start_ms").orderBy("bin")
    next_ask, prev_bid, prev_total = F.lead("ask_qty").over(w), F.lag("bid_qty").over(w), F.lag("total_qty").over(w)
    near = levels.withColumns({"na": next_ask, "pb": prev_bid, "pt": prev_total})
    bid = (F.col("total_qty") >= volume) & (F.col("na") > 0) & (F.col("bid_qty") > ratio * F.col("na"))
    ask = (F.col("pt") >= volume) & (F.col("pb") > 0) & (F.col("ask_qty") > ratio * F.col("pb"))
    return near.withColumns({"bid_imbalance": F.coalesce(bid, F.lit(False)), "ask_imbalance": F.coalesce(ask, F.lit(False))}).drop("na", "pb", "pt")


def stacked_imbalance(flagged: DataFrame, side: str = "ask", stack: int = 3) -> DataFrame:
    """For runs of flagged levels: the start price, once for each level from the ``stack``-th on."""
    keys = [*KEY, "bucket_start_ms"]
    f = F.col(f"{side}_imbalance")
    island = F.row_number().over(W.partitionBy(*keys).orderBy("bin")) - F.row_number().over(W.partitionBy(*keys, f).orderBy("bin"))
    runs = flagged.withColumn("island", island).where(f)
    w = W.partitionBy(*keys, "island").orderBy("bin")
    out = runs.withColumns({"pos": F.row_number().over(w), "run_start_price": F.first("price").over(w)})
    return out.where(F.col("pos") >= stack).select(*keys, "run_start_price", F.col("bin").alias("level_bin"))


def footprint(trades: DataFrame, interval_ms: int = 60_000, scale: float = 1.0, ratio: float = 3.0, volume: float = 0.0, stack: int = 3) -> DataFrame:
    """One candle per bucket with its levels, running-delta extremes and stacked imbalances."""
    keys = [*KEY, "bucket_start_ms"]
    rows = trades.where("price * qty > 0").withColumn("bucket_start_ms", S.bucket_start(F.col("ts_ms"), interval_ms))
    signed = F.when(F.col("side") == "buy", F.col("qty")).when(F.col("side") == "sell", -F.col("qty")).otherwise(0.0)
    run = F.sum(signed).over(W.partitionBy(*keys).orderBy("ts_ms", "event_id").rowsBetween(W.unboundedPreceding, 0))
    first, last = F.min_by("price", F.struct("ts_ms", "event_id")), F.max_by("price", F.struct("ts_ms", "event_id"))
    candles = rows.withColumns({"run": run, "signed": signed}).groupBy(*keys).agg(
        first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), F.count("*").alias("trade_count"),
        F.sum("qty").alias("total_qty"), F.sum("signed").alias("delta_qty"), F.least(F.lit(0.0), F.min("run")).alias("min_delta_qty"), F.greatest(F.lit(0.0), F.max("run")).alias("max_delta_qty"),
    )
    flagged = footprint_imbalance(footprint_levels(trades, interval_ms, scale), ratio, volume)
    level = F.struct("bin", "price", "bid_qty", "ask_qty", "total_qty", "delta_qty", "trades", "bid_imbalance", "ask_imbalance")
    levels = flagged.groupBy(*keys).agg(F.sort_array(F.collect_list(level)).alias("levels"))  # bounded by the bucket's price bins
    out = candles.join(levels, keys)
    for side in ("bid", "ask"):
        stacks = stacked_imbalance(flagged, side, stack).groupBy(*keys).agg(F.sort_array(F.collect_list("run_start_price")).alias(f"stacked_{side}"))
        out = out.join(stacks, keys, "left").withColumn(f"stacked_{side}", F.coalesce(f"stacked_{side}", F.array().cast("array<double>")))
    return out


def trade_imbalance(flows: DataFrame, now: int, window_ms: int = 60_000, keys=KEY) -> DataFrame:
    """Signed, absolute and relative flow of the trailing window; unknown sides count without flow."""
    rows = flows.where((F.lit(now) - F.col("ts_ms") <= window_ms) & (F.col("ts_ms") <= now))
    signed = S.signed_notional(F.col("side"), F.col("price"), F.col("qty"))
    out = rows.withColumn("s", signed).groupBy(*keys).agg(F.sum("s").alias("signed_notional"), F.sum(F.abs("s")).alias("absolute_notional"), F.count("*").alias("n"))
    return out.withColumn("imbalance", S.ratio(F.col("signed_notional"), F.col("absolute_notional")))


def liquidation_totals(liquidations: DataFrame, now: int, window_ms: int = 900_000) -> DataFrame:
    rows = liquidations.where((F.lit(now) - F.col("ts_ms") <= window_ms) & (F.col("ts_ms") <= now) & (F.col("price") * F.col("qty") > 0))
    notional = F.col("price") * F.col("qty")
    out = rows.groupBy("exchange", "symbol").agg(_sum(F.col("side") == "buy", notional, "b"), _sum(F.col("side") == "sell", notional, "s"))
    return out.select("exchange", "symbol", F.nullif(F.col("b"), F.lit(0.0)).alias("buy_liquidation_notional"), F.nullif(F.col("s"), F.lit(0.0)).alias("sell_liquidation_notional"))


def tick_rate(quotes: DataFrame, interval_ms: int = 1000) -> DataFrame:
    out = quotes.withColumn("bucket_start_ms", S.bucket_start(F.col("ts_ms"), interval_ms)).groupBy("market", "symbol", "exchange", "bucket_start_ms").agg(F.count("*").alias("n"))
    return out.select("market", "symbol", "exchange", "bucket_start_ms", F.round(F.col("n") / (interval_ms / 1000)).cast("long").alias("rate"))


def oi_change(open_interest: DataFrame, width_ms: int = scans.WIDTH) -> DataFrame:
    """Change against the last tick of the key, where that was positive."""
    out = scans.neighbours(open_interest, ("exchange", "symbol"), before={"prev": "open_interest"}, width_ms=width_ms).where("prev > 0")
    d = F.col("open_interest") - F.col("prev")
    return out.select("exchange", "symbol", "event_id", "ts_ms", "open_interest", d.alias("delta"), (d / F.col("prev") * 100).alias("change_pct"))
