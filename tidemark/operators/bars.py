"""Bars, the candle lake, and screens and research features over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.state import KEY

BAR = (*KEY, "interval")


def klines(quotes: DataFrame, intervals=("1m", "5m", "15m", "1h")) -> DataFrame:
    """OHLC bars of mids.

    The finest interval is aggregated from the ticks; coarser ones that it
    divides are rolled up from its bars, so ticks are read and shuffled once.
    """
    mids = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).where((F.col("mid") > 0) & (F.col("mid") < float("inf")))
    widths = sorted(S.INTERVALS[i] for i in intervals)
    names = {v: k for k, v in S.INTERVALS.items()}
    fine = widths[0]
    if any(w % fine for w in widths):
        raise ValueError("every interval must be a multiple of the finest")
    first = (
        mids.withColumn("open_time_ms", S.bucket_start(F.col("ts_ms"), fine)).groupBy(*KEY, "open_time_ms")
        .agg(
            F.min(F.struct("ts_ms", "event_id", "mid")).alias("o"), F.max("mid").alias("high"), F.min("mid").alias("low"),
            F.max(F.struct("ts_ms", "event_id", "mid")).alias("c"),
        )
    )
    spread = first.withColumn("width", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])))
    out = spread.withColumn("open_time_ms", S.bucket_start(F.col("open_time_ms"), F.col("width"))).groupBy(*KEY, "width", "open_time_ms").agg(
        F.min("o").alias("o"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("c").alias("c")
    )
    label = F.lit(None).cast("string")
    for w in widths:
        label = F.when(F.col("width") == w, F.lit(names[w])).otherwise(label)
    return out.select(
        *KEY, label.alias("interval"), "open_time_ms", (F.col("open_time_ms") + F.col("width") - 1).alias("close_time_ms"),
        F.col("o.mid").alias("open"), "high", "low", F.col("c.mid").alias("close"), F.lit(None).cast("double").alias("volume"),
    )


def kline_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last written bar per key."""
    keys = [*BAR, "open_time_ms"]
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated_at_ms", "_n")).alias("_r")).select(*keys, "_r.*")


def klines_query(bars, exchange=None, market=None, symbol=None, interval=None, start_ms=None, end_ms=None, limit: int = 500) -> DataFrame:
    """The newest ``limit`` bars that match, in the order of time."""
    for c, v in (("exchange", exchange), ("market", market), ("symbol", symbol), ("interval", interval)):
        if v is not None:
            bars = bars.where(F.col(c) == v)
    if start_ms is not None:
        bars = bars.where(F.col("open_time_ms") >= start_ms)
    if end_ms is not None:
        bars = bars.where(F.col("open_time_ms") <= end_ms)
    newest = bars.orderBy(F.desc("open_time_ms"), *BAR).limit(limit)
    return newest.orderBy("open_time_ms", *BAR)


def lake_quality(bars: DataFrame) -> DataFrame:
    """Per partition: rows, duplicates, gaps, coverage, latency percentiles and stale rows, from one pass over the bars.

    Bars of a key and time are counted first, so gaps are steps between these rows.
    """
    width = S.interval_ms(F.col("interval"))
    keys = [*BAR, "day"]
    part = bars.withColumns({"day": S.utc_day(F.col("open_time_ms")), "w": width, "lat": F.greatest(F.col("updated_at_ms") - F.col("close_time_ms"), F.lit(0))})
    step = F.col("open_time_ms") - F.lag("open_time_ms").over(W.partitionBy(*keys).orderBy("open_time_ms"))
    times = part.groupBy(*keys, "w", "open_time_ms").agg(F.count("*").alias("n"), F.max("updated_at_ms").alias("updated"), F.collect_list("lat").alias("lats"), F.count_if(F.col("lat") > F.col("w")).alias("stale"))
    stats = times.withColumn("d", step).groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.min("open_time_ms").alias("first_ts"), F.max("open_time_ms").alias("last_ts"), F.max("updated").alias("watermark_ms"), F.flatten(F.collect_list("lats")).alias("lats"),
        F.sum("stale").alias("stale_count"), F.sum(F.when(F.col("d") > F.col("w"), F.floor(F.col("d") / F.col("w")) - 1).otherwise(0)).cast("long").alias("gaps"),
        F.count("*").alias("distinct_rows"), F.first("w").alias("w"),
    )
    expected = F.floor((F.col("last_ts") - F.col("first_ts")) / F.col("w")) + 1
    return stats.select(
        *keys, "row_count", "first_ts", "last_ts", "watermark_ms", (F.col("row_count") - F.col("distinct_rows")).alias("duplicates"), "gaps",
        F.least(F.col("distinct_rows") / expected, F.lit(1.0)).alias("coverage"), S.pct_floored(F.col("lats"), 50).alias("latency_p50"),
        S.pct_floored(F.col("lats"), 95).alias("latency_p95"), "stale_count",
    )


def lake_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merged manifest rows: counts add up, bounds widen, the rest is the newest."""
    keys = [*BAR, "day"]
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.sum("duplicates").alias("duplicates"), F.sum("stale_count").alias("stale_count"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("watermark_ms").alias("watermark_ms"),
        F.max_by("coverage", "created_at_ms").alias("coverage"), F.max("created_at_ms").alias("created_at_ms"),
    )


def manifest_query(manifest: DataFrame, limit: int = 200, **filters) -> DataFrame:
    for c, v in filters.items():
        if v not in (None, ""):
            manifest = manifest.where(F.col(c) == v)
    return manifest.orderBy(F.desc("last_ts"), *BAR, "day").limit(limit)


LAKE_PARTS = ["domain", "exchange", "market", "symbol", "interval", "candle_type", "day"]


def lake_write(bars: DataFrame, root: str, candle_type: str = "spot") -> None:
    """Append bars to the Hive layout domain/exchange/market/symbol/interval/candle_type/day."""
    out = bars.withColumns({"domain": F.lit("klines"), "candle_type": F.lit(candle_type), "day": S.utc_day(F.col("open_time_ms"))})
    for c in ("exchange", "market", "symbol"):
        out = out.withColumn(c, S.path_value(F.col(c)))
    out.repartition(*LAKE_PARTS).sortWithinPartitions("open_time_ms").write.mode("append").partitionBy(*LAKE_PARTS).parquet(root)


def lake_files(spark, root: str) -> DataFrame:
    """A manifest row per lake partition: files, bytes, rows and bounds, read off the files."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
    bars = spark.read.parquet(root).select(*[F.col(c).cast("string").alias(c) for c in LAKE_PARTS], "open_time_ms", *meta)
    files = bars.groupBy(*LAKE_PARTS, "file", "size").agg(F.count("*").alias("rows"), F.min("open_time_ms").alias("first_ts"), F.max("open_time_ms").alias("last_ts"))
    return files.groupBy(*LAKE_PARTS).agg(
        F.min(F.regexp_replace("file", "/[^/]+$", "")).alias("path"), F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def _versions(spark, manifest: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("v_")) for p in done if p.getName().startswith("v_"))


def commit_manifest(spark, manifest: str, rows: DataFrame) -> int:
    """A new version of the manifest; readers see it once Spark's writer has marked it complete."""
    number = max(_versions(spark, manifest), default=0) + 1
    rows.write.mode("overwrite").parquet(f"{manifest}/v_{number}")
    return number


def read_manifest(spark, manifest: str, version: int | None = None) -> DataFrame:
    """The manifest as of a version, by default the last."""
    return spark.read.parquet(f"{manifest}/v_{version or _versions(spark, manifest)[-1]}")


def lake_delete(spark, root: str, manifest: str | None = None, **filters) -> DataFrame:
    """Delete the lake partitions that match; refuses to run without a filter; returns (path, files, rows, bytes) of what went.

    With a manifest, the rows that match are those of its last version, and a
    version without them (an anti-join) is committed before any file goes, so
    no reader of the manifest is sent to a partition that is gone; a delete
    that dies half way can be run again on the version before.  Without one
    the lake's own folders are listed, by the filters alone.  A folder outside
    ``root`` is an error.
    """
    filters = {k: v for k, v in filters.items() if v not in (None, "")}
    if not filters or not set(filters) <= set(LAKE_PARTS):
        raise ValueError(f"a filter on some of {', '.join(LAKE_PARTS)} is required")
    known = read_manifest(spark, manifest) if manifest else lake_files(spark, root)
    hit = known
    for k, v in filters.items():
        hit = hit.where(F.col(k) == F.lit(str(v)))
    gone = hit.select("path", "files", "rows", "bytes").collect()  # one row per partition folder that goes
    where = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath().rstrip("/") + "/"
    if any(not where(r.path).startswith(where(root)) for r in gone):
        raise ValueError(f"a partition lies outside {root}")
    if manifest and gone:
        commit_manifest(spark, manifest, known.join(hit.select(*LAKE_PARTS), LAKE_PARTS, "left_anti"))
    for r in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.createDataFrame(gone, "path string, files long, rows long, bytes long")


def screen(df: DataFrame, value: str, low=None, high=None, order: str = "desc", limit: int = 100, ties=BAR) -> DataFrame:
    """Band filter, sort by value (descending unless ``asc``), limit of 1 to 1000."""
    if low is not None:
        df = df.where(F.col(value) >= low)
    if high is not None:
        df = df.where(F.col(value) <= high)
    by = F.asc(value) if order == "asc" else F.desc(value)
    return df.orderBy(by, *[t for t in ties if t in df.columns]).limit(min(max(limit, 1), 1000))


def top_volume(bars: DataFrame, **kw) -> DataFrame:
    typical = (F.col("open") + F.col("high") + F.col("low")) / 3
    out = bars.where("volume is not null").groupBy(*BAR).agg(F.sum("volume").alias("base_volume"), F.sum(typical * F.col("volume")).alias("quote_volume"), F.count("*").alias("bars"))
    return screen(out, "quote_volume", **kw)


def percent_change(bars: DataFrame, **kw) -> DataFrame:
    ends = bars.groupBy(*BAR).agg(F.min_by("close", "open_time_ms").alias("first_close"), F.max_by("close", "open_time_ms").alias("last_close"), F.count("*").alias("bars"))
    out = ends.where("first_close > 0").withColumn("change_pct", (F.col("last_close") - F.col("first_close")) / F.col("first_close") * 100)
    return screen(out, "change_pct", **kw)


def returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(W.partitionBy(*BAR).orderBy("open_time_ms"))
    return bars.withColumn("prev", before).where("close > 0 and prev > 0").withColumn("ret", F.log(F.col("close") / F.col("prev")))


def realized_vol(bars: DataFrame) -> DataFrame:
    return returns(bars).groupBy(*BAR).agg((F.stddev_pop("ret") * F.sqrt(F.count("*"))).alias("realized_vol"), F.count("*").alias("n_returns"))


def close_zscore(bars: DataFrame) -> DataFrame:
    out = bars.groupBy(*BAR).agg(F.max_by("close", "open_time_ms").alias("last"), F.avg("close").alias("m"), F.stddev_pop("close").alias("sd"), F.count("*").alias("n"))
    return out.select(*BAR, F.when((F.col("n") >= 2) & (F.col("sd") > 0), (F.col("last") - F.col("m")) / F.col("sd")).alias("close_zscore"))


def age_filter(bars: DataFrame, now: int, low=None, high=None, limit: int = 100) -> DataFrame:
    out = bars.groupBy(*KEY).agg(F.min("open_time_ms").alias("first_open_ms"), F.max("open_time_ms").alias("last_open_ms"), F.count("*").alias("bars"))
    out = out.withColumn("age_days", (F.lit(now) - F.col("first_open_ms")) / 86_400_000)
    return screen(out, "age_days", low, high, "asc", limit)


def delist_risk(bars: DataFrame, ticks: DataFrame, now: int, stale_after_ms: int = 86_400_000) -> DataFrame:
    """Instruments with bars but no quote (high) or an old one (medium)."""
    known = bars.select(*KEY).distinct()
    out = known.join(ticks.select(*KEY, F.col("ts_ms").alias("quote_ts")), list(KEY), "left")
    age = F.lit(now) - F.col("quote_ts")
    risk = F.when(F.col("quote_ts").isNull(), "high").when(age > stale_after_ms, "medium")
    return out.select(*KEY, risk.alias("risk"), age.alias("age_ms")).where("risk is not null")


def correlations(bars: DataFrame, benchmark: str) -> DataFrame:
    """Correlation of log returns with the benchmark symbol's, paired from the end of both series."""
    back = F.row_number().over(W.partitionBy(*BAR).orderBy(F.desc("open_time_ms"))).alias("i")
    r = returns(bars).select(*BAR, "ret", back)
    bench = r.where(F.col("symbol") == benchmark).select("exchange", "market", "interval", "i", F.col("ret").alias("b"))
    both = r.where(F.col("symbol") != benchmark).join(bench, ["exchange", "market", "interval", "i"])
    out = both.groupBy(*BAR).agg(F.covar_pop("ret", "b").alias("c"), F.stddev_pop("ret").alias("s"), F.stddev_pop("b").alias("t"), F.count("*").alias("pairs"))
    return out.select(*BAR, "pairs", F.when((F.col("s") > 0) & (F.col("t") > 0), F.col("c") / (F.col("s") * F.col("t"))).alias("correlation"))


def failed_high(bars: DataFrame, recent: int = 10) -> DataFrame:
    """Did the last bars push above all before and close well under their high?"""
    back = F.row_number().over(W.partitionBy(*BAR).orderBy(F.desc("open_time_ms")))
    r = bars.withColumn("i", back).groupBy(*BAR).agg(
        F.max(F.when(F.col("i") <= recent, F.col("high"))).alias("recent_high"), F.max(F.when(F.col("i") > recent, F.col("high"))).alias("previous_high"),
        F.max(F.when(F.col("i") == 1, F.col("close"))).alias("last_close"), F.min_by("open", "open_time_ms").alias("first_open"),
    )
    failed = (F.col("recent_high") > F.col("previous_high")) & (F.col("last_close") < F.col("recent_high") * 0.997)
    return r.select(*BAR, F.when(F.col("first_open") > 0, (F.col("last_close") - F.col("first_open")) / F.col("first_open") * 100).alias("return_pct"), failed.alias("failed_high"))


def exchange_disagreement(ticks: DataFrame) -> DataFrame:
    mids = ticks.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).where("mid > 0")
    out = mids.groupBy("market", "symbol").agg(F.max("mid").alias("hi"), F.min("mid").alias("lo"), F.avg("mid").alias("m"), F.count("*").alias("venues"))
    return out.where("venues >= 2").select("market", "symbol", "venues", ((F.col("hi") - F.col("lo")) / F.col("m") * 10_000).alias("disagreement_bps"))


def regimes(f: DataFrame) -> DataFrame:
    """Labels; the first rule that matches wins."""
    b, rate, oi, spread, score = (F.col(c) for c in ("basis_bps", "funding_rate", "open_interest", "spread_bps", "liquidity_score"))
    with_oi = F.when(oi.isNotNull(), "_with_oi").otherwise("")
    return f.withColumns(
        {
            "basis_regime": F.when(b.isNull(), "unknown").when(b > 25, "perp_premium").when(b < -25, "perp_discount").otherwise("flat"),
            "funding_regime": F.when(rate > 3e-4, F.concat(F.lit("positive_funding"), with_oi)).when(rate < -3e-4, F.concat(F.lit("negative_funding"), with_oi))
            .when(rate.isNotNull(), "neutral_funding").when(oi.isNotNull(), "oi_only").otherwise("unknown"),
            "liquidity_regime": F.when(spread > 30, "wide_spread").when(score > 1_000_000, "deep").when(score > 100_000, "normal").when(score.isNotNull(), "thin").otherwise("unknown"),
        }
    )


def bar_features(bars: DataFrame, benchmark: str = "BTCUSDT") -> DataFrame:
    """Return, volume, realised volatility, z-score and benchmark correlation per key, from one pass over the bars.

    A window per key gives each bar its return and its place from the end; a
    window over the symbols of a place brings the benchmark's return; one
    aggregate makes all statistics.
    """
    by = W.partitionBy(*BAR).orderBy("open_time_ms")
    back = W.partitionBy(*BAR).orderBy(F.desc("open_time_ms")).rowsBetween(W.unboundedPreceding, 0)
    ret = F.when((F.col("close") > 0) & (F.col("prev") > 0), F.log(F.col("close") / F.col("prev")))
    rows = bars.select(*BAR, "open_time_ms", "close", "volume", F.lag("close").over(by).alias("prev")).withColumn("ret", ret)
    rows = rows.withColumn("i", F.when(F.col("ret").isNotNull(), F.count("ret").over(back)))
    is_benchmark = F.col("symbol") == benchmark
    rows = rows.withColumn("bench", F.when(F.col("i").isNotNull(), F.max(F.when(is_benchmark, F.col("ret"))).over(W.partitionBy("exchange", "market", "interval", "i"))))
    paired = F.when(~is_benchmark & F.col("bench").isNotNull(), F.col("ret"))
    other = F.when(paired.isNotNull(), F.col("bench"))
    out = rows.groupBy(*BAR).agg(
        F.count("*").alias("bars"), F.min_by("close", "open_time_ms").alias("a"), F.max_by("close", "open_time_ms").alias("z"), F.sum("volume").alias("volume"),
        (F.stddev_pop("ret") * F.sqrt(F.count("ret"))).alias("realized_vol"), F.avg("close").alias("m"), F.stddev_pop("close").alias("sd"),
        F.covar_pop(paired, other).alias("cv"), F.stddev_pop(paired).alias("s"), F.stddev_pop(other).alias("t"),
    )
    return out.select(
        *BAR, "bars", F.when(F.col("a") > 0, (F.col("z") - F.col("a")) / F.col("a") * 100).alias("return_pct"), "volume", "realized_vol",
        F.when((F.col("bars") >= 2) & (F.col("sd") > 0), (F.col("z") - F.col("m")) / F.col("sd")).alias("close_zscore"),
        F.when((F.col("s") > 0) & (F.col("t") > 0), F.col("cv") / (F.col("s") * F.col("t"))).alias("correlation"),
    )


def research_features(bars: DataFrame, states: DataFrame, benchmark: str = "BTCUSDT") -> DataFrame:
    """One row of features and regimes per (exchange, market, symbol, interval), from bars and :func:`state.market_states`."""
    return regimes(bar_features(bars, benchmark).join(states.drop("mid", "quoted"), list(KEY), "left"))


def market_regime(features: DataFrame) -> DataFrame:
    m = features.agg(
        F.count("*").alias("n_rows"), F.median("disagreement_bps").alias("disagreement_bps"), F.median("realized_vol").alias("realized_vol"), F.median("funding_rate").alias("funding_rate"),
        F.median("basis_bps").alias("basis_bps"), F.median("liquidity_score").alias("liquidity_score"),
    )
    label = F.when(F.col("disagreement_bps") > 20, "fragmented").when(F.col("realized_vol") > 0.08, "high_volatility").when(F.abs("funding_rate") > 5e-4, "leveraged").otherwise("normal")
    return m.withColumn("regime", label)
