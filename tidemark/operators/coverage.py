"""Funding views and venue coverage: per symbol, exchange and market, with alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.state import in_set

#: Thresholds of the health rules (fixed values).
WARN_STALE, CRIT_STALE, WARN_LATENCY, CRIT_LATENCY = 0.25, 0.60, 1500, 5000


def canonical(df: DataFrame) -> DataFrame:
    name = F.when(F.col("market") == "perp", S.canonical_perp(F.col("symbol"))).otherwise(S.canonical_spot(F.col("symbol")))
    return df.withColumn("unified", name)


def points(ticks: DataFrame, symbols=None, exchanges=None, market=None, include_stale=True, only_with_funding=False) -> DataFrame:
    out = canonical(ticks).where(in_set(F.col("exchange"), exchanges, F.lower))
    if symbols is not None:
        out = out.where(F.col("unified").isin(symbols) | F.upper("symbol").isin(symbols))
    if market is not None:
        out = out.where(F.lower("market") == market.strip().lower())
    if not include_stale:
        out = out.where(~F.col("stale"))
    return out.where(F.col("funding_rate").isNotNull()) if only_with_funding else out


def funding_view(ticks: DataFrame, symbols=None, exchanges=None, only_with_funding=True, include_stale=False) -> DataFrame:
    """Funding of one perp across venues: totals, extremes, spread, and the points behind them."""
    p = points(ticks, symbols, exchanges, "perp", include_stale, only_with_funding)
    point = F.struct("exchange", F.col("symbol").alias("raw_symbol"), "funding_rate", "mark", "ts_ms", "latency_ms", "stale")
    out = p.groupBy(F.col("unified").alias("symbol")).agg(
        F.count("*").alias("exchanges_total"), F.count("funding_rate").alias("exchanges_with_funding"), F.min("funding_rate").alias("min_funding"),
        F.max("funding_rate").alias("max_funding"), F.max("ts_ms").alias("updated_at"), F.sort_array(F.collect_list(point)).alias("points"),
    )
    return out.withColumn("funding_spread", F.col("max_funding") - F.col("min_funding"))


def _percent(c):
    return F.format_string("%.1f%%", c * 100)


def coverage_symbols(p: DataFrame) -> DataFrame:
    """Counts, latency percentiles, health and alerts per (market, canonical symbol)."""
    out = p.groupBy("market", F.col("unified").alias("symbol")).agg(
        F.count("*").alias("exchanges_total"), F.count("funding_rate").alias("exchanges_with_funding"), F.count_if("stale").alias("exchanges_stale"),
        F.collect_list("latency_ms").alias("lat"), F.min("latency_ms").alias("latency_ms_min"), F.max("latency_ms").alias("latency_ms_max"),
        F.avg("latency_ms").alias("latency_ms_avg"), F.max("ts_ms").alias("updated_at"),
    )
    out = out.withColumns(
        {
            "funding_coverage_ratio": S.ratio(F.col("exchanges_with_funding"), F.col("exchanges_total")),
            "stale_ratio": S.ratio(F.col("exchanges_stale"), F.col("exchanges_total")),
            "latency_ms_p50": S.pct_rounded(F.col("lat"), 0.50), "latency_ms_p95": S.pct_rounded(F.col("lat"), 0.95),
        }
    ).drop("lat")
    return health(out)


def health(f: DataFrame) -> DataFrame:
    """Health and alerts; a critical rule stops at its own alert, warnings add up."""
    total, fund, stale, p95 = (F.col(c) for c in ("exchanges_total", "exchanges_with_funding", "stale_ratio", "latency_ms_p95"))
    perp = F.col("market") == "perp"
    critical = (
        F.when(total == 0, "no exchange points available").when(perp & (fund == 0), "no funding available across exchanges")
        .when(stale >= CRIT_STALE, F.concat(F.lit("critical stale ratio "), _percent(stale)))
        .when(p95 >= CRIT_LATENCY, F.format_string("critical p95 latency %dms", p95))
    )
    warnings = F.array_compact(F.array(
        F.when(total < 2, "single-exchange coverage"), F.when(stale >= WARN_STALE, F.concat(F.lit("elevated stale ratio "), _percent(stale))),
        F.when(p95 >= WARN_LATENCY, F.format_string("elevated p95 latency %dms", p95)), F.when(perp & (fund < 2), F.format_string("low funding coverage (%d/%d)", fund, total)),
    ))
    out = f.withColumn("_c", critical).withColumn("alerts", F.when(F.col("_c").isNotNull(), F.array("_c")).otherwise(warnings))
    return out.withColumn("health_status", F.when(F.col("_c").isNotNull(), "critical").when(F.size("alerts") > 0, "warning").otherwise("healthy")).drop("_c")


def coverage_exchanges(p: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Per exchange; requested exchanges without points are rows of zeros."""
    perp = F.col("market") == "perp"
    out = p.groupBy("exchange").agg(
        F.count_if(~F.col("stale")).alias("fresh"), F.countDistinct("market", "unified").alias("symbols_total"),
        F.countDistinct(F.when(F.col("market") == "spot", F.col("unified"))).alias("spot_symbols"), F.countDistinct(F.when(perp, F.col("unified"))).alias("perp_symbols"),
        F.count("*").alias("points_total"), F.count_if("stale").alias("stale_points"), F.count_if(perp).alias("perp_points"), F.count("funding_rate").alias("funding_points"),
        F.collect_list("latency_ms").alias("lat"), F.avg("latency_ms").alias("latency_ms_avg"), F.max("latency_ms").alias("latency_ms_max"), F.max("ts_ms").alias("updated_at"),
    )
    if requested:
        names = p.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, requested))).alias("exchange"))
        out = names.join(out, "exchange", "full")
        zero = {c: 0 for c, t in out.dtypes if t in ("bigint", "double")}
        out = out.fillna(zero).withColumn("lat", F.coalesce("lat", F.array().cast("array<bigint>")))
    out = out.withColumns(
        {
            "online": F.col("fresh") > 0, "stale_ratio": S.ratio(F.col("stale_points"), F.col("points_total")),
            "funding_coverage_ratio": F.when(F.col("perp_points") > 0, S.ratio(F.col("funding_points"), F.col("perp_points"))).otherwise(1.0),
            "latency_ms_p50": S.pct_rounded(F.col("lat"), 0.50), "latency_ms_p95": S.pct_rounded(F.col("lat"), 0.95),
        }
    ).drop("lat", "fresh")
    stale, p95 = F.col("stale_ratio"), F.col("latency_ms_p95")
    status = F.when(~F.col("online") | (stale >= CRIT_STALE) | (p95 >= CRIT_LATENCY), "critical").when(
        (stale >= WARN_STALE) | (p95 >= WARN_LATENCY) | ((F.col("perp_points") > 0) & (F.col("funding_coverage_ratio") < 0.5)), "warning"
    )
    return out.withColumn("health_status", F.coalesce(status, F.lit("healthy")))


def _status(name):
    return F.count_if(F.col("health_status") == name).alias(f"{name}_symbols")


def coverage_markets(symbols: DataFrame) -> DataFrame:
    perp = F.col("market") == "perp"
    out = symbols.groupBy("market").agg(
        F.count("*").alias("symbols"), F.sum("exchanges_total").alias("points"), _status("healthy"), _status("warning"), _status("critical"), F.sum("exchanges_stale").alias("stale"),
        F.sum(F.when(perp, F.col("exchanges_total")).otherwise(0)).alias("pp"), F.sum(F.when(perp, F.col("exchanges_with_funding")).otherwise(0)).alias("fp"),
    )
    return out.withColumns(
        {
            "stale_ratio": S.ratio(F.col("stale"), F.col("points")), "funding_coverage_ratio": F.when(F.col("pp") > 0, S.ratio(F.col("fp"), F.col("pp"))).otherwise(1.0),
            "avg_exchanges_per_symbol": S.ratio(F.col("points"), F.col("symbols")),
        }
    ).drop("stale", "pp", "fp")


def coverage_summary(symbols: DataFrame, exchanges: DataFrame, p: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """One row over all: the roll-ups of symbols and exchanges, put side by side."""
    perp = F.col("market") == "perp"
    a = symbols.agg(
        F.count("*").alias("total_symbols"), F.sum("exchanges_total").alias("total_points"), _status("healthy"), _status("warning"), _status("critical"),
        F.sum("exchanges_stale").alias("stale_points"), F.sum(F.when(perp, F.col("exchanges_total")).otherwise(0)).alias("perp_points"),
        F.sum(F.when(perp, F.col("exchanges_with_funding")).otherwise(0)).alias("funding_points"), F.lit(1).alias("one"),
    )
    b = exchanges.agg(F.count_if(F.col("points_total") > 0).alias("exchange_count_seen"), F.count("*").alias("rows"), F.count_if("online").alias("online_exchange_count"), F.lit(1).alias("one"))
    c = p.agg(F.collect_list("latency_ms").alias("lat"), F.lit(1).alias("one"))  # latest state only: a row per key
    out = a.join(b, "one").join(c, "one")
    expected = F.lit(len(requested)).cast("long") if requested else F.col("rows")
    return out.withColumns(
        {
            "stale_ratio": S.ratio(F.col("stale_points"), F.col("total_points")), "funding_coverage_ratio": F.when(F.col("perp_points") > 0, S.ratio(F.col("funding_points"), F.col("perp_points"))).otherwise(1.0),
            "expected_exchange_count": expected, "exchange_online_ratio": S.ratio(F.col("online_exchange_count"), expected),
            "latency_ms_p50": S.pct_rounded(F.col("lat"), 0.50), "latency_ms_p95": S.pct_rounded(F.col("lat"), 0.95),
        }
    ).drop("one", "rows", "lat")


def coverage_alerts(symbols: DataFrame, exchanges: DataFrame, summary: DataFrame) -> DataFrame:
    level = F.col("health_status").alias("level")
    one = symbols.where("health_status <> 'healthy'").select(level, F.lit("symbol").alias("scope"), F.concat_ws(":", "market", "symbol").alias("target"), F.concat_ws("; ", "alerts").alias("message"))
    stale, p95 = F.col("stale_ratio"), F.col("latency_ms_p95")
    text = (
        F.when(~F.col("online"), "exchange currently offline (no fresh points)").when(stale >= CRIT_STALE, F.concat(F.lit("high stale ratio "), _percent(stale)))
        .when(p95 >= WARN_LATENCY, F.format_string("elevated p95 latency %dms", p95)).otherwise("exchange quality degraded")
    )
    two = exchanges.where("health_status <> 'healthy'").select(level, F.lit("exchange").alias("scope"), F.col("exchange").alias("target"), text.alias("message"))
    o = F.col("exchange_online_ratio")
    three = summary.where(o < 1).select(
        F.lit("warning").alias("level"), F.lit("global").alias("scope"), F.lit("coverage").alias("target"),
        F.concat(F.lit("online exchange ratio "), _percent(o), F.format_string(" (%d/%d)", "online_exchange_count", "expected_exchange_count")).alias("message"),
    )
    four = summary.where(stale >= WARN_STALE).select(
        F.when(stale >= CRIT_STALE, "critical").otherwise("warning").alias("level"), F.lit("global").alias("scope"), F.lit("coverage").alias("target"), F.concat(F.lit("global stale ratio "), _percent(stale)).alias("message")
    )
    return one.union(two).union(three).union(four)
