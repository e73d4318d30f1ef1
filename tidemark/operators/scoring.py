"""Strategy metrics per symbol, and the scores and states made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import books, scans, state

ES = ["exchange", "symbol"]


def symbol_metrics(events: DataFrame, now: int | Column | None = None, window_ms: int = 60_000, liq_ms: int = 900_000, width_ms: int = scans.WIDTH) -> DataFrame:
    """Fifteen metrics per (exchange, symbol) at ``now`` from the unified events (:data:`state.EVENT`).

    Changes of open interest and of the best book level are taken against the
    row before in its domain by a two-level scan; one conditional aggregate
    per symbol makes the rest.  The latest price is that of the last event
    among quotes (mark, else mid), funding marks, trades, liquidations and
    perp book mids.
    """
    now = state.as_of(events) if now is None else now
    is_ = lambda d: F.col("domain") == d
    notional = F.col("price") * F.col("qty")
    quote_mid = S.mid_uncrossed(F.col("bid"), F.col("ask"))
    top = {"bp": F.col("bids")[0].price, "bq": F.col("bids")[0].qty, "ap": F.col("asks")[0].price, "aq": F.col("asks")[0].qty}
    book_mid = S.mid_uncrossed(top["bp"], top["ap"])
    candidate = F.coalesce(
        F.when(is_("quote") & quote_mid.isNotNull(), F.coalesce("mark", quote_mid)), F.when(is_("funding"), F.col("mark_price")), F.when(is_("trade") & (F.col("side") != "unknown") & (notional != 0), F.col("price")),
        F.when(is_("liquidation") & (notional > 0), F.col("price")), F.when(is_("order_book"), book_mid),
    )
    rank = F.array_position(F.array(*map(F.lit, ["quote", "funding", "trade", "liquidation", "order_book"])), F.col("domain"))
    kept = events.where(~is_("order_book") | ((F.col("market") == "perp") & (F.size("bids") > 0) & (F.size("asks") > 0)))
    rows = kept.select(
        *ES, "domain", "market", "ts_ms", "event_id", rank.alias("rank"), candidate.alias("candidate"), "side", notional.alias("notional"), S.signed_notional(F.col("side"), F.col("price"), F.col("qty")).alias("signed"),
        "funding_rate", "open_interest", *[F.when(is_("order_book"), v).alias(c) for c, v in top.items()], F.coalesce(book_mid, F.lit(1.0)).alias("mid"),
        S.book_sum(F.col("bids"), 10).alias("bid_depth"), S.book_sum(F.col("asks"), 10).alias("ask_depth"), (F.lit(now) - F.col("ts_ms")).alias("age"),
    )
    near = scans.neighbours(rows, (*ES, "domain"), before={f"p_{c}": c for c in ("open_interest", *top)}, width_ms=width_ms)
    at, age = F.struct("ts_ms", "event_id"), F.col("age")
    within = lambda w: (age <= w) & (age >= 0)
    last = lambda c, cond: F.max_by(c, F.when(cond, at))
    change = F.when(F.col("p_open_interest") > 0, (F.col("open_interest") - F.col("p_open_interest")) / F.col("p_open_interest") * 100)
    flow = books.level_flow(*[F.col(c) for c in ("p_bp", "p_bq", "p_ap", "p_aq", "bp", "bq", "ap", "aq")]) * F.col("mid")
    cvd = lambda m: F.sum(F.when(is_("trade") & (F.col("market") == m) & within(window_ms) & (F.col("signed") != 0), F.col("signed")))
    liquidated = lambda s: F.sum(F.when(is_("liquidation") & (F.col("side") == s) & within(liq_ms) & (F.col("notional") > 0), F.col("notional")))
    out = near.groupBy(*ES).agg(
        F.max_by("candidate", F.when(F.col("candidate").isNotNull(), F.struct("ts_ms", "event_id", "rank"))).alias("latest_price"), last("funding_rate", is_("funding")).alias("funding_rate"),
        last("open_interest", is_("open_interest")).alias("open_interest"), last(change, change.isNotNull()).alias("oi_change_pct"), cvd("spot").alias("spot_cvd"), cvd("perp").alias("perp_cvd"),
        liquidated("buy").alias("buy_liquidation"), liquidated("sell").alias("sell_liquidation"), last("bid_depth", is_("order_book")).alias("bid_depth"), last("ask_depth", is_("order_book")).alias("ask_depth"),
        F.sum(F.when(is_("order_book") & F.col("p_bp").isNotNull() & within(window_ms), flow)).alias("ofi"),
    )
    s, p, b, a = (F.col(c) for c in ("spot_cvd", "perp_cvd", "bid_depth", "ask_depth"))
    split = F.when((s > 0) & (p < 0), "spot_up_perp_down").when((s < 0) & (p > 0), "spot_down_perp_up").when((s > 0) & (p > 0), "both_up").when((s < 0) & (p < 0), "both_down")
    return out.withColumns(
        {
            "cvd_divergence": F.coalesce(split, F.when(s.isNotNull() & p.isNotNull(), "flat_or_mixed")),
            "depth_ratio": F.when(a > 0, b / a), "depth_pressure": F.when(a + b > 0, (b - a) / (a + b)),
        }
    )


def _sum(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _points(*rules) -> tuple[Column, Column]:
    """Score and progress of rules, each a list of (condition, points, name) of which the first true one counts."""
    score, names = [], []
    for rule in rules:
        points, name = F.lit(0), F.lit(None).cast("string")
        for cond, n, label in reversed(rule):
            points, name = F.when(cond, n).otherwise(points), F.when(cond, label).otherwise(name)
        score.append(points)
        names.append(name)
    return _sum(*score), F.array_compact(F.array(*names))


def _texts(*rules: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in rules]))


def squeeze_state(m: DataFrame) -> DataFrame:
    """Long-squeeze score (0 to 10), its progress, and the state that it reaches."""
    rate, oi, buy = F.col("funding_rate"), F.col("oi_change_pct"), F.col("buy_liquidation")
    score, progress = _points(
        [(rate <= -0.0005, 2, "crowded_shorts"), (rate < 0, 1, "short_bias")], [(oi >= 15, 3, "oi_stack"), (oi >= 3, 1, "oi_rising")],
        [(F.col("cvd_divergence") == "spot_up_perp_down", 3, "spot_absorption")], [(F.col("ofi") > 0, 1, "book_confirming")], [(buy > 0, 1, "liquidation_fuel")],
    )
    out = m.withColumns({"squeeze_score": score, "squeeze_progress": progress})
    has = lambda *x: reduce(lambda a, b: a | b, [F.array_contains("squeeze_progress", n) for n in x])
    label = (
        F.when(F.col("squeeze_score") >= 8, "triggered_long_squeeze").when(has("spot_absorption"), "spot_absorption").when(has("oi_stack", "oi_rising"), "chip_accumulation")
        .when(has("crowded_shorts", "short_bias"), "short_crowding").otherwise("neutral")
    )
    reasons = _texts(
        (rate <= -0.0005, F.format_string("funding deeply negative: %.4f%%", rate * 100)), (oi >= 15, F.format_string("OI expansion is extreme: +%.2f%%", oi)),
        (F.col("cvd_divergence") == "spot_up_perp_down", F.lit("spot CVD up while perp CVD down")),
    )
    against = _texts((F.col("depth_pressure") < -0.4, F.lit("top-10 book is ask-heavy; squeeze needs aggressive buy confirmation")))
    return out.withColumns({"squeeze_state": label, "squeeze_reasons": reasons, "squeeze_invalidation": against, "squeeze_invalidated": F.size(against) > 0})


def exhaustion_state(m: DataFrame) -> DataFrame:
    """Short-exhaustion score (0 to 10), its progress, and the state that it reaches."""
    rate, oi, r = F.col("funding_rate"), F.col("oi_change_pct"), F.col("depth_ratio")
    score, progress = _points(
        [(rate >= 0.0005, 2, "crowded_longs"), (rate > 0, 1, "long_bias")], [(oi <= -10, 3, "fuel_exhausted"), (oi < 0, 1, "oi_slipping")],
        [(F.col("perp_cvd") < 0, 1, "sell_flow_confirming")], [(r < 0.65, 2, "book_vacuum"), (r < 1, 1, "bids_weaker_than_asks")], [(F.col("ofi") < 0, 1, "ofi_negative")],
    )
    out = m.withColumns({"exhaustion_score": score, "exhaustion_progress": progress})
    has = lambda *x: reduce(lambda a, b: a | b, [F.array_contains("exhaustion_progress", n) for n in x])
    label = (
        F.when(F.col("exhaustion_score") >= 8, "triggered_short_exhaustion").when(has("book_vacuum"), "book_vacuum").when(has("fuel_exhausted", "oi_slipping"), "fuel_exhaustion")
        .when(has("crowded_longs", "long_bias"), "long_crowding").otherwise("neutral")
    )
    reasons = _texts(
        (rate >= 0.0005, F.format_string("funding extremely positive: %.4f%%", rate * 100)), (oi <= -10, F.format_string("OI dropped sharply: %.2f%%", oi)),
        (r < 0.65, F.format_string("bid depth is thin versus asks: %.2f", r)),
    )
    against = _texts((F.col("buy_liquidation") > 0, F.lit("recent short liquidation fuel still exists; avoid early short without failed breakout confirmation")))
    return out.withColumns({"exhaustion_state": label, "exhaustion_reasons": reasons, "exhaustion_invalidation": against, "exhaustion_invalidated": F.size(against) > 0})


def risk_context(states: DataFrame) -> DataFrame:
    """Stop levels where a state is triggered."""
    long, short = F.col("squeeze_state") == "triggered_long_squeeze", F.col("exhaustion_state") == "triggered_short_exhaustion"
    stop = F.when(long, F.col("latest_price") * 0.985).when(short, F.col("latest_price") * 1.015)
    return states.select(*ES, stop.alias("suggested_hard_stop"), F.when(long | short, 150.0).alias("suggested_trailing_stop_bps"))


def squeeze_monitor(m: DataFrame) -> DataFrame:
    """Score 0 to 9 and verdict per symbol from (min_funding, max_oi_change, spot_cvd, perp_cvd, buy_liquidation, aggregate_value)."""
    f, oi = F.col("min_funding"), F.col("max_oi_change")
    score, _ = _points(
        [(f <= -0.0005, 2, "a"), (f < 0, 1, "a")], [(oi >= 3, 2, "b"), (oi > 0, 1, "b")], [((F.col("spot_cvd") > 0) & (F.col("perp_cvd") < 0), 3, "c")],
        [(F.col("buy_liquidation") > 0, 1, "d")], [(F.col("aggregate_value").isNotNull(), 1, "e")],
    )
    out = m.withColumn("score", score)
    return out.withColumn("verdict", F.when(F.col("score") >= 7, "strong squeeze setup").when(F.col("score") >= 4, "watchlist").otherwise("not enough confluence"))


def exhaustion_monitor(m: DataFrame) -> DataFrame:
    """Score 0 to 10 and verdict from (max_funding, failed_high, min_oi_change, perp_cvd, weakest_ratio, cex_inflow)."""
    f, oi, r = F.col("max_funding"), F.col("min_oi_change"), F.col("weakest_ratio")
    score, _ = _points(
        [(f >= 0.0005, 2, "a"), (f > 0, 1, "a")], [(F.col("failed_high"), 2, "b")], [(oi <= -3, 2, "c"), (oi < 0, 1, "c")], [(F.col("perp_cvd") < 0, 1, "d")],
        [(r < 0.65, 2, "e"), (r < 1, 1, "e")], [(F.col("cex_inflow") >= 1_000_000, 1, "f")],
    )
    out = m.withColumn("score", score)
    return out.withColumn("verdict", F.when(F.col("score") >= 8, "strong exhaustion short setup").when(F.col("score") >= 5, "watchlist").otherwise("not enough confluence"))


#: Exchange names that mark a receiving address (fixed values).
VENUE_NAMES = ["binance", "coinbase", "okx", "bybit", "kraken", "kucoin", "gate"]


def cex_inflow(transfers: DataFrame, asset: str) -> DataFrame:
    """Sum of USD sent to exchange addresses; a null asset passes; no inflow gives null."""
    to = F.lower("to_address").rlike("|".join(VENUE_NAMES))
    rows = transfers.where((F.col("asset").isNull() | (F.upper("asset") == asset.upper())) & to)
    return rows.agg(F.nullif(F.sum("amount_usd"), F.lit(0.0)).alias("inflow_usd")).withColumn("asset", F.lit(asset))
