"""Streaming twins of the batch operators that aggregate, filter or fan out; :mod:`stateful` has those with timers.

Aggregating streams run under an event-time watermark as long as the
retention, so their state is bounded.  :class:`Upserts` keeps the last version
of every key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import normalize, state
from tidemark.operators.state import KEY
from tidemark.sources.shared import shared_root
from tidemark.streaming.stateful import END_MS, timed


def sink_dir(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder of the cluster."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


class Upserts:
    """A keyed table fed by micro-batches: deltas by batch id, folded now and then into a snapshot.

    ``data/_batch_id=N`` has the rows of a batch; a batch that is run again
    replaces its own.  Every ``every`` batches the last version of each key is
    written as ``snapshots/g_N``: all batches up to N.  Readers take the
    snapshot of the highest N that Spark's writer has marked complete, and the
    deltas after it, so the switch is the one file of that mark, and a
    compaction that dies half way is never seen.  What no reader of the last
    two snapshots needs is deleted, so the number of files stays bounded.
    Without ``keys`` all rows stay.  ``order`` breaks ties within a batch;
    ``gone`` names a boolean column of rows that delete their key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], every: int = 10, order: tuple[str, ...] = (), gone: str | None = None):
        self.spark, self.path, self.keys, self.every, self.order, self.gone = spark, path, keys, every, order, gone

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the complete parts of a folder."""
        path, fs = self._files(folder)
        if not fs.exists(path):
            return []
        parts = [s.getPath() for s in fs.listStatus(path)]
        done = [p.getName() for p in parts if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix(prefix)) for n in done if n.startswith(prefix))

    def _drop(self, folder: str) -> None:
        path, fs = self._files(folder)
        fs.delete(path, True)

    def write(self, batch: DataFrame, number: int) -> None:
        snapshots = self._numbers("snapshots", "g_")
        if snapshots and number <= snapshots[-1]:
            return  # run again after a restart; the snapshot has it
        batch.write.mode("overwrite").parquet(f"{self.path}/data/_batch_id={number}")
        if number - (snapshots[-1] if snapshots else -1) >= self.every:
            self.compact(number)

    def compact(self, number: int) -> None:
        self._merged(number).write.mode("overwrite").parquet(f"{self.path}/snapshots/g_{number}")
        snapshots = self._numbers("snapshots", "g_")
        for old in snapshots[:-2]:
            self._drop(f"snapshots/g_{old}")
        if len(snapshots) > 1:  # readers of the snapshot before still need the deltas after it
            for n in self._numbers("data", "_batch_id="):
                if n <= snapshots[-2]:
                    self._drop(f"data/_batch_id={n}")

    def _merged(self, upto: int | None = None) -> DataFrame:
        snapshots = [n for n in self._numbers("snapshots", "g_") if upto is None or n < upto]
        base = snapshots[-1] if snapshots else -1
        deltas = [n for n in self._numbers("data", "_batch_id=") if n > base and (upto is None or n <= upto)]
        read = lambda folder, n: self.spark.read.parquet(f"{self.path}/{folder}").withColumn("_batch", F.lit(n))
        parts = [read(f"snapshots/g_{base}", -1) for _ in snapshots[-1:]] + [read(f"data/_batch_id={n}", n) for n in deltas]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if not self.keys:
            return rows.drop("_batch")
        rest = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        last = F.max_by(F.struct(F.lit(0).alias("_"), *rest), F.struct("_batch", *self.order)).alias("_r")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, *[F.col("_r")[c].alias(c) for c in rest])

    def read(self) -> DataFrame:
        """The last version of every key that is not gone."""
        out = self._merged()
        return out.where(~F.col(self.gone)).drop(self.gone) if self.gone else out

    def feed(self, stream: DataFrame, mode: str = "update", trigger: dict | None = None):
        """Start a query that writes each micro-batch of a stream."""
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(self.write)
        return query.trigger(**(trigger or {"availableNow": True})).start()


def run(stream: DataFrame, keys: tuple[str, ...], mode: str = "update", **kw) -> DataFrame:
    """Process what is there, then return the upserted result."""
    table = Upserts(stream.sparkSession, sink_dir(stream.sparkSession), keys, **kw)
    table.feed(stream, mode).awaitTermination()
    return table.read()


def run_whole(make: Callable[[DataFrame], DataFrame], feed: DataFrame, keys: tuple[str, ...], mode: str = "append", **kw) -> DataFrame:
    """Process what is there, then close the feed, so that nothing waits for a watermark that never comes.

    ``make`` gives the stream over ``feed``, which has a ts_ms.  A second feed,
    empty at first, joins it; when the first is done it brings one row at the
    end of time, and the query goes on from its checkpoint.
    """
    spark, path = feed.sparkSession, sink_dir(feed.sparkSession)
    last = spark.range(1).select(*[(F.lit(END_MS) if c == "ts_ms" else F.lit(None)).cast(t).alias(c) for c, t in feed.dtypes])
    last.where("false").write.parquet(f"{path}/end")
    stream = make(feed.unionByName(spark.readStream.schema(last.schema).parquet(f"{path}/end")))
    table = Upserts(spark, path, keys, **kw)
    table.feed(stream, mode).awaitTermination()
    last.write.mode("append").parquet(f"{path}/end")
    table.feed(stream, mode).awaitTermination()
    return table.read()


def _by_widths(df: DataFrame, widths: dict, delay: str) -> tuple[DataFrame, list]:
    """Rows once per width with the start of their bucket, and what to group by.

    The widest tumbling window stands among the groups, so buckets of all
    widths leave the state when it closes; partial sums are made before the
    one shuffle.
    """
    most = max(widths.values())
    if any(most % w for w in widths.values()):
        raise ValueError("every width must divide the widest")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(w).cast("long").alias("ms")) for k, w in widths.items()])).alias("_w")
    rows = timed(df, delay).select("*", each).withColumn("_start", S.bucket_start(F.col("ts_ms"), F.col("_w.ms")))
    return rows, [F.window("event_time", f"{most} milliseconds").alias("_widest"), F.col("_w.name").alias("_name"), F.col("_w.ms").alias("_ms"), F.col("_start")]


def stream_klines(quotes: DataFrame, intervals: tuple[str, ...] = ("1m", "5m", "15m", "1h"), delay: str = "24 hours") -> DataFrame:
    """Tumbling bars of mids for several intervals; ticks are read and shuffled once."""
    mid = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).where("mid > 0 and mid < double('infinity')")
    rows, groups = _by_widths(mid, {i: S.INTERVALS[i] for i in intervals}, delay)
    order = F.struct("ts_ms", "event_id")
    out = rows.groupBy(*KEY, *groups).agg(F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"))
    return out.select(*KEY, F.col("_name").alias("interval"), F.col("_start").alias("open_time_ms"), (F.col("_start") + F.col("_ms") - 1).alias("close_time_ms"), "open", "high", "low", "close")


def stream_order_flow(trades: DataFrame, windows_ms: tuple[int, ...] = (60_000, 300_000, 900_000), delay: str = "24 hours") -> DataFrame:
    """Tumbling order-flow buckets for several windows; the running delta is :func:`stateful.stream_cvd`."""
    n = F.col("price") * F.col("qty")
    side = lambda s, v, name: F.sum(F.when(F.col("side") == s, v).otherwise(0.0)).alias(name)
    rows, groups = _by_widths(trades.where("price * qty > 0"), {str(w): w for w in windows_ms}, delay)
    out = rows.groupBy(*KEY, *groups).agg(
        side("buy", F.col("qty"), "buy_qty"), side("sell", F.col("qty"), "sell_qty"), side("buy", n, "buy_notional"), side("sell", n, "sell_notional"), F.count("*").alias("trade_count")
    )
    return out.select(*KEY, F.col("_ms").alias("window_ms"), F.col("_start").alias("bucket_start_ms"), "buy_qty", "sell_qty", "buy_notional", "sell_notional", "trade_count")


def stream_imbalance(flows: DataFrame, keys: tuple[str, ...] = KEY, window: str = "60 seconds", slide: str = "1 second", delay: str = "5 minutes") -> DataFrame:
    """Sliding signed and absolute flow of trades or of liquidations, in append mode.

    Sums of one slide are made first and the windows from these, so a trade is
    one row and not one per window that holds it.
    """
    s = S.signed_notional(F.col("side"), F.col("price"), F.col("qty"))
    sums = lambda n: [F.sum("signed_notional").alias("signed_notional"), F.sum("absolute_notional").alias("absolute_notional"), n.alias("n")]
    rows = timed(flows, delay).withColumns({"signed_notional": s, "absolute_notional": F.abs(s)})
    fine = rows.groupBy(*keys, F.window("event_time", slide).alias("f")).agg(*sums(F.count("*")))
    out = fine.groupBy(*keys, F.window(F.window_time("f"), window, slide).alias("w")).agg(*sums(F.sum("n")))
    return out.select(*keys, F.unix_millis("w.end").alias("window_end_ms"), "signed_notional", "absolute_notional", "n", S.ratio(F.col("signed_notional"), F.col("absolute_notional")).alias("imbalance"))


def stream_option_merge(options: DataFrame, fields: tuple[str, ...], keys=("venue", "instrument_name"), every: str = "24 hours", delay: str = "24 hours") -> DataFrame:
    """Per instrument and tumbling window the last value of each field that was not null; state ends with the window.

    The upserted table takes the latest window of an instrument; what a window
    has not seen is filled from the ones before by :func:`merge_windows`.
    """
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("received_at_ms"))).alias(c)
    rows = options.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    out = rows.groupBy(*keys, F.window("event_time", every).alias("w")).agg(*[last(f) for f in fields], F.max("received_at_ms").alias("received_at_ms"))
    return out.select(*keys, F.unix_millis("w.start").alias("window_ms"), *fields, "received_at_ms")


def merge_windows(parts: DataFrame, fields: tuple[str, ...], keys=("venue", "instrument_name")) -> DataFrame:
    """The merged options of all windows."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("window_ms"))).alias(c)
    return parts.groupBy(*keys).agg(*[last(f) for f in fields], F.max("received_at_ms").alias("received_at_ms"))


def stream_dedupe(df: DataFrame, keys: tuple[str, ...], delay: str = "1 hour") -> DataFrame:
    return timed(df, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_filter(df: DataFrame, **kw) -> DataFrame:
    return state.stream_filter(df, **kw)


def stream_fanout(events: DataFrame, path: str, every: int = 10, trigger: dict | None = None):
    """One pass over the event log that feeds a table per type, the keyed log, and dead letters.

    Payloads are parsed once; the typed rows of all types are one write per
    batch, and each table is its rows and columns (:func:`read_fanout`).
    """
    spark = events.sparkSession
    typed, log, dead = (Upserts(spark, f"{path}/{name}", (), every) for name in ("tables", "log", "dead"))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("v", F.try_parse_json("payload")).persist()
        typed.write(normalize.typed_rows(batch), number)
        log.write(normalize.event_log(normalize.parsed(batch)), number)
        dead.write(normalize.dead_letters(batch.drop("v"), []), number)
        batch.unpersist()

    return events.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def read_fanout(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The typed tables, the log and the dead letters that :func:`stream_fanout` has written."""
    part = lambda name: Upserts(spark, f"{path}/{name}", ()).read()
    return {**normalize.fanout_tables(part("tables")), "log": part("log"), "dead": part("dead")}
