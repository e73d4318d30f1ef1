"""Market listings, perp funding tables, and funding curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import scans
from tidemark.operators.state import in_set


def listings_view(df: DataFrame, exchanges=None, market=None, base=None, quote=None, active_only=True, limit: int = 5000) -> DataFrame:
    """The first row per (exchange, market, SYMBOL), filtered and sorted."""
    keys = ["exchange", "market", "_sym"]
    rest = [c for c in df.columns if c not in keys]
    out = df.withColumn("_sym", F.upper("symbol")).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("source", "native_symbol")).alias("_r")).select("exchange", "market", "_r.*")
    out = out.where(in_set(F.col("exchange"), exchanges, F.lower))
    for c, v in (("market", market), ("base", base), ("quote", quote)):
        if v is not None:
            out = out.where(F.upper(c) == v.upper())
    if active_only:
        out = out.where("active")
    return out.orderBy("exchange", "market", "symbol").limit(min(max(limit, 1), 50_000))


def perp_funding_view(df: DataFrame, exchanges=None, symbols=None, quote=None, active_only=True, limit: int = 5000) -> DataFrame:
    """Funding rows; an unknown activity counts as active; the quote comes from the symbol."""
    out = df.where(in_set(F.col("exchange"), exchanges, F.lower) & in_set(F.col("symbol"), symbols))
    if active_only:
        out = out.where(F.coalesce("active", F.lit(True)))
    if quote is not None:
        out = out.where(S.split_symbol(F.col("symbol")).quote == quote.upper())
    return out.orderBy("exchange", "symbol").limit(min(max(limit, 1), 50_000))


def listings_fallback(listed: DataFrame, funding: DataFrame, base: str) -> DataFrame:
    """Listings of a base, with rows made from funding where discovery has none."""
    own = listed.where(F.col("base") == base).select("exchange", "market", "symbol", "native_symbol", "base", "quote", F.lit("discovery").alias("source"))
    made = funding.where(F.col("base") == base).select("exchange", F.lit("perp").alias("market"), "symbol", "native_symbol", "base", "quote", F.lit("funding").alias("source"))
    return own.unionByName(made.join(own, ["exchange", "market", "symbol"], "left_anti"))


def missing_funding(listed: DataFrame, funding: DataFrame) -> DataFrame:
    return listed.where("market = 'perp' and active").select("exchange", "symbol").distinct().join(funding, ["exchange", "symbol"], "left_anti")


def perp_contracts(listed: DataFrame, limit: int = 50) -> DataFrame:
    """Perp contracts per exchange: totals, sorted bases, and the first contracts."""
    rows = listed.where("market = 'perp' and active")
    n = F.row_number().over(W.partitionBy("exchange").orderBy("symbol"))
    out = rows.withColumn("_n", n).groupBy("exchange").agg(
        F.count("*").alias("total"), F.array_sort(F.collect_set("base")).alias("bases"), F.sort_array(F.collect_list(F.when(F.col("_n") <= limit, F.col("symbol")))).alias("contracts")
    )
    return out.withColumn("returned", F.size("contracts").cast("long"))


def catalog_search(listed: DataFrame, symbol=None, base=None, quote=None, active_only=True) -> DataFrame:
    out = listed.where("active") if active_only else listed
    if symbol is not None:
        name = "".join(c for c in symbol.upper() if c.isalnum())
        out = out.where((S.canonical_spot(F.col("symbol")) == name) | (S.canonical_spot(F.col("native_symbol")) == name) | (F.upper("base") == name))
    if base is not None:
        out = out.where(F.upper("base") == base.upper())
    if quote is not None:
        out = out.where(F.upper("quote") == quote.upper())
    domains = F.when(F.col("market") == "perp", F.array(*map(F.lit, ["market_quote", "funding", "open_interest", "liquidation"]))).otherwise(F.array(F.lit("market_quote")))
    return out.withColumn("domains", domains)


def catalog_search_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("market").agg(F.count("*").alias("listings"), F.countDistinct("exchange").alias("exchanges"), F.countDistinct("base").alias("bases"))


def funding_extremes(funding: DataFrame, min_pct: float = -2.0, max_pct: float = -0.1) -> DataFrame:
    return funding.where(F.col("funding_rate_pct").between(min_pct, max_pct)).orderBy("funding_rate_pct", "exchange", "symbol")


def beyond(funding: DataFrame, threshold_pct: float) -> DataFrame:
    return funding.where((F.col("funding_rate_pct") <= -threshold_pct) | (F.col("funding_rate_pct") >= threshold_pct))


def extremes_by_exchange(funding: DataFrame, threshold_pct: float) -> DataFrame:
    row = F.struct("funding_rate_pct", "symbol")
    return beyond(funding, threshold_pct).groupBy("exchange").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(row)).alias("rows"))


def funding_spread(funding: DataFrame, min_spread_pct: float | None = None) -> DataFrame:
    out = funding.groupBy("symbol").agg(
        F.count("*").alias("exchanges"), F.min("funding_rate_pct").alias("min_pct"), F.max("funding_rate_pct").alias("max_pct"), (F.max("funding_rate_pct") - F.min("funding_rate_pct")).alias("spread_pct")
    ).where("exchanges >= 2")
    return out.where(F.col("spread_pct") >= min_spread_pct) if min_spread_pct is not None else out


def top_funding(funding: DataFrame, n: int = 20, side: str = "negative") -> DataFrame:
    by = F.asc("funding_rate_pct") if side == "negative" else F.desc("funding_rate_pct")
    return funding.orderBy(by, "exchange", "symbol").limit(n)


def watchlist(extremes: DataFrame) -> DataFrame:
    return extremes.select("symbol").distinct().orderBy("symbol")


def typical_interval(points: DataFrame, keys=("exchange", "symbol"), width_ms: int = scans.WIDTH) -> DataFrame:
    """The upper middle of the positive steps between points; 0 where there are none."""
    steps = scans.neighbours(points.select(*keys, *scans.ORDER), keys, before={"prev": "ts_ms"}, width_ms=width_ms).withColumn("d", F.col("ts_ms") - F.col("prev"))
    middle = scans.upper_middle(steps.where("d > 0"), keys, "d", "interval_ms")
    return points.select(*keys).distinct().join(middle, list(keys), "left").select(*keys, F.coalesce("interval_ms", F.lit(0)).alias("interval_ms"))


def funding_runs(points: DataFrame, threshold_pct: float = -0.2, min_run_hours: float = 0.0, keys=("exchange", "symbol"), width_ms: int = scans.WIDTH) -> DataFrame:
    """Maximal runs of points at or under the threshold.

    A run ends at the next point; the last run of a key ends one step after
    its last point.
    """
    low = F.coalesce(F.col("pct") <= threshold_pct, F.lit(False))
    out = scans.neighbours(points, keys, before={"prv": "ts_ms"}, after={"nxt": "ts_ms"}, width_ms=width_ms)
    out = scans.running_count(out, keys, ~low, "run", width_ms=width_ms)
    end = F.coalesce("nxt", F.col("ts_ms") + F.greatest(F.col("ts_ms") - F.col("prv"), F.lit(0)), F.col("ts_ms"))
    runs = out.where(low).groupBy(*keys, "run").agg(
        F.min("ts_ms").alias("start_ms"), F.max_by(end, F.struct("ts_ms", "event_id")).alias("end_ms"), F.count("*").alias("points"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct")
    )
    out = runs.withColumn("duration_hours", F.greatest((F.col("end_ms") - F.col("start_ms")) / 3_600_000, F.lit(0.0)))
    return out.where(F.col("duration_hours") >= min_run_hours).drop("run")
