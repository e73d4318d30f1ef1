"""Stateful streams with timers and several states per key.

Rows of a key may come out of order within the watermark's delay.  Those that
depend on order wait in the state until the watermark has passed their tick;
then a timer hands them on in (ts_ms, event_id) order.  A tick's rows are all
that is held in memory at once, however long a key's history is.  Results
therefore reach up to the watermark.

All of these run on the RocksDB state store; :func:`use_rocksdb` sets it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import scalars as S

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The end of time, at which a feed that is over is closed.
END_MS = 253_402_214_400_000
#: Rows that are cut into packs at once.
PACK = 200_000
#: Stands for a null long, last in order.
NO_LONG = 2**63 - 1


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class InOrder(StatefulProcessor):
    """Hands a key's rows on in event order, tick by tick, once the watermark has passed them.

    A subclass says what it does with the sorted rows of a tick (``step``), and
    reads and writes its own state before and after (``load``, ``save``).  Rows
    are columns of numbers: longs, doubles (null and NaN apart) and, for
    ``texts``, strings.  They are packed into bytes by key and tick where they
    are read (``pack``), before the shuffle, so that work by row is done in as
    many tasks as there is input, and calls to the state are made per pack and
    not per row.  The first columns of ``longs`` are those that rows are sorted
    by; the very first is ts_ms.
    """

    longs: tuple[str, ...] = ("ts_ms", "event_id")
    doubles: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    sorted_by = 2
    tick_ms = 60_000

    def columns(self) -> list:
        """What :meth:`pack` takes of a row; ``_nulls`` tells null doubles from NaN."""
        nulls = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(self.doubles)]
        longs = [F.col("ts_ms"), *[F.coalesce(F.col(c).cast("long"), F.lit(NO_LONG)).alias(c) for c in self.longs[1:]]]
        return [*longs, *[F.col(c).cast("double").alias(c) for c in self.doubles], *self.texts, reduce(lambda x, y: x + y, nulls, F.lit(0).cast("long")).alias("_nulls")]

    def pack(self, frame: pd.DataFrame, keys: tuple[str, ...]) -> pd.DataFrame:
        """Rows of any keys and ticks as one row per key and tick; ``ts_ms`` is the last time in it."""
        rows = {c: frame[c].to_numpy(np.int64) for c in (*self.longs, "_nulls")} | {c: frame[c].to_numpy(np.float64) for c in self.doubles}
        names = []
        for c in self.texts:
            code, seen = pd.factorize(frame[c])
            rows[c] = np.where(code < 0, -1, code + len(names)).astype(np.int64)
            names += list(seen)
        codes = [pd.factorize(frame[k])[0] for k in keys]
        ends = self._end(rows["ts_ms"])
        order = np.lexsort([ends, *codes])
        parts = np.stack([ends, *codes])[:, order]
        starts = np.flatnonzero(np.r_[True, (parts[:, 1:] != parts[:, :-1]).any(axis=0)])
        out, firsts = [], order[starts]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            part = {c: v[order[a:b]] for c, v in rows.items()}
            numbers = np.concatenate([v.view(np.int64) for v in self.reduced(part).values()])
            out.append((int(ends[order[a]]), int(part["ts_ms"].max()), zlib.compress(numbers.tobytes(), 1), names))
        packs = pd.DataFrame(out, columns=["tick", "ts_ms", "numbers", "names"])
        return packs.assign(**{k: frame[k].to_numpy()[firsts] for k in keys})[[*keys, *packs.columns]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packs = handle.getMapState("packs", "tick long", "n int")
        self.waiting = handle.getMapState("waiting", "tick long, n int", "numbers binary, names array<string>")
        self.wakes = handle.getMapState("wakes", "tick long", "is boolean")
        self.rung_at: dict[tuple, int] = {}
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """Set up the subclass's states."""

    def load(self) -> None:
        """Before the ticks that are due."""

    def step(self, key: tuple, tick: int, rows: dict[str, np.ndarray]) -> pd.DataFrame | None:
        """The sorted rows, perhaps none, of the tick that ends at ``tick``."""
        raise NotImplementedError

    def save(self) -> None:
        """After them."""

    def reduced(self, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """What of a tick's rows, in no order and perhaps not all of them, has to wait."""
        return rows

    def wake_at(self, tick: int) -> None:
        """Work on the tick that ends at ``tick`` even if it has no rows."""
        if tick <= self.passed:
            heappush(self.due, tick)
        else:
            self.wakes.updateValue((tick,), (True,))
            self.handle.registerTimer(tick)

    def _end(self, ts):
        """When the tick of a time is over."""
        return (ts // self.tick_ms + 1) * self.tick_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for frame in rows:
            for tick, numbers, names in zip(frame.tick.tolist(), frame.numbers, frame.names, strict=True):
                if tick not in counts:
                    counts[tick] = self.packs.getValue((tick,))[0] if self.packs.containsKey((tick,)) else 0
                self.waiting.updateValue((tick, counts[tick]), (bytes(numbers), list(names)))
                counts[tick] += 1
        for tick, n in counts.items():
            self.packs.updateValue((tick,), (n,))
            self.handle.registerTimer(tick)
        return iter(())

    def _take(self, tick: int) -> dict[str, np.ndarray]:
        """The sorted rows of a tick, which wait no longer."""
        columns, packs = (*self.longs, "_nulls", *self.doubles, *self.texts), []
        if tick in self.counts:
            for n in range(self.counts[tick]):
                numbers, names = self.waiting.getValue((tick, n))
                pack = dict(zip(columns, np.frombuffer(zlib.decompress(numbers), np.int64).reshape(len(columns), -1), strict=True))
                pack |= {c: np.array([*names, None], object)[pack[c]] for c in self.texts} | {c: pack[c].view(np.float64) for c in self.doubles}
                packs.append(pack)
                self.waiting.removeKey((tick, n))
            self.packs.removeKey((tick,))
        if not packs:
            return {c: np.zeros(0, np.float64 if c in self.doubles else object if c in self.texts else np.int64) for c in columns}
        rows = {c: np.concatenate([p[c] for p in packs]) for c in columns}
        order = np.lexsort([rows[c] for c in reversed(self.longs[: self.sorted_by])])
        return {c: v[order] for c, v in rows.items()}

    def is_null(self, rows: dict[str, np.ndarray], column: str) -> np.ndarray:
        return (rows["_nulls"] >> self.doubles.index(column)) & 1 == 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All ticks that the watermark has passed, in order; also those that come up on the way."""
        self.passed = timerValues.getCurrentWatermarkInMs()
        if self.rung_at.get(key) == self.passed:
            return  # the first of the timers that are due has done all
        self.rung_at[key] = self.passed
        self.counts = {t: n for (t,), (n,) in self.packs.iterator() if t <= self.passed}
        wakes = {t for (t,) in self.wakes.keys() if t <= self.passed}
        self.due = sorted({*self.counts, *wakes})
        if not self.due:
            return
        done = -1
        self.load()
        while self.due:
            tick = heappop(self.due)
            if tick > done:
                if tick in wakes:
                    self.wakes.removeKey((tick,))
                out = self.step(key, tick, self._take(tick))
                if out is not None and len(out):
                    yield out
                done = tick
        self.save()


def _table(n: int, key: dict, **columns) -> pd.DataFrame:
    """Rows of one key; what goes out is put in order and kind by the schema."""
    return pd.DataFrame(columns, index=range(n)).assign(**key)


def _doubles(values: np.ndarray, nulls: np.ndarray | None = None) -> pd.arrays.FloatingArray:
    """Doubles in which only ``nulls`` are null, and NaN is NaN."""
    return pd.arrays.FloatingArray(np.asarray(values, np.float64), np.zeros(len(values), bool) if nulls is None else nulls)


def _longs(values: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(values, values == NO_LONG)


def _last(mask: np.ndarray) -> np.ndarray:
    """For each place the last one up to it that is marked, else -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, np.int64)


class HoldTimer(InOrder):
    """FILTERED, HOLDING or TRIGGER per report, and TRIGGER when the hold ends, also without a report.

    The timer rings if no report that is not eligible comes up to its
    millisecond; reports of that millisecond come first.
    """

    longs = ("ts_ms", "event_id", "eligible")

    def __init__(self, hold_ms: int, tick_ms: int):
        self.hold_ms, self.tick_ms = hold_ms, tick_ms

    def prepare(self, handle):
        self.held = handle.getValueState("held", "since long, rung boolean")

    def load(self):
        self.since, self.rung = self.held.get() if self.held.exists() else (None, False)

    def save(self):
        if self.since is None:
            self.held.clear()
        else:
            self.held.update((self.since, self.rung))

    def step(self, key, tick, rows):
        ts, eligible = rows["ts_ms"], rows["eligible"] == 1
        n = len(ts)
        begins = eligible & ~np.r_[self.since is not None, eligible[:-1]] if n else eligible
        since = np.r_[ts, self.since or 0][_last(begins)]
        state = np.where(~eligible, "FILTERED", np.where(ts - since >= self.hold_ms, "TRIGGER", "HOLDING"))
        # holds that may ring now: since when, and up to when nothing ends them
        starts = ts[begins]
        if self.since is not None and not self.rung:
            starts = np.r_[self.since, starts]
        ends = np.flatnonzero(~eligible)
        at = np.flatnonzero(begins) if len(starts) == begins.sum() else np.r_[0, np.flatnonzero(begins)]
        until = np.r_[ts[ends], tick][np.searchsorted(ends, at)]
        rings = starts + self.hold_ms < until
        if n and not eligible[-1]:
            self.since, self.rung = None, False
        else:
            fresh = bool(begins.any()) or (self.since is not None and not self.rung)
            if begins.any():
                self.since = int(starts[-1])
            if fresh:
                self.rung = bool(rings[-1])
                if not self.rung:
                    self.wake_at(self._end(self.since + self.hold_ms))
        by_timer = starts[rings] + self.hold_ms
        own = dict(zip(("market", "symbol"), key, strict=True))
        reports = _table(n, own, ts_ms=ts, event_id=_longs(rows["event_id"]), state=state.astype(object), by_timer=False)
        timers = _table(len(by_timer), own, ts_ms=by_timer, event_id=_longs(np.full(len(by_timer), NO_LONG)), state="TRIGGER", by_timer=True)
        return reports if not len(timers) else timers if not n else pd.concat([reports, timers])


class RunningDelta(InOrder):
    """Every trade with its key's signed quantity and notional so far; a silent key starts anew."""

    doubles = ("signed_qty", "signed_notional")

    def __init__(self, ttl_ms: int, tick_ms: int):
        self.ttl_ms, self.tick_ms = ttl_ms, tick_ms

    def prepare(self, handle):
        self.sums = handle.getValueState("sums", "qty double, notional double, ts_ms long")

    def load(self):
        self.now = tuple(self.sums.get()) if self.sums.exists() else None

    def save(self):
        if self.now is None:
            self.sums.clear()
        else:
            self.sums.update(self.now)

    def step(self, key, tick, rows):
        ts = rows["ts_ms"]
        if not len(ts):
            if self.now and self._end(self.now[2] + self.ttl_ms) <= tick:
                self.now = None
            return None
        q, n, last = self.now or (0.0, 0.0, int(ts[0]))
        anew = np.flatnonzero(np.diff(np.r_[last, ts]) > self.ttl_ms).tolist()
        out = {}
        for c, carried in zip(self.doubles, (q, n), strict=True):
            values = np.where(self.is_null(rows, c), 0.0, rows[c])
            parts = [np.cumsum(np.r_[0.0 if a in anew else carried, values[a:b]])[1:] for a, b in zip([0, *anew], [*anew, len(ts)], strict=True) if a < b]
            out[c] = np.concatenate(parts)
        self.now = (float(out["signed_qty"][-1]), float(out["signed_notional"][-1]), int(ts[-1]))
        self.wake_at(self._end(self.now[2] + self.ttl_ms))
        own = dict(zip(("exchange", "market", "symbol"), key, strict=True))
        return _table(len(ts), own, event_id=_longs(rows["event_id"]), ts_ms=ts, cvd_qty=_doubles(out["signed_qty"]), cvd_notional=_doubles(out["signed_notional"]))


class BookPatches(InOrder):
    """Book state after every event: a ``book`` resets, patches overwrite what they carry; a silent book is forgotten."""

    sides = ("best_bid", "best_ask", "bid_depth", "ask_depth")
    doubles, texts = sides, ("event_type",)

    def __init__(self, ttl_ms: int, tick_ms: int):
        self.ttl_ms, self.tick_ms = ttl_ms, tick_ms

    def prepare(self, handle):
        self.book = handle.getValueState("book", "ts_ms long, " + ", ".join(f"{s} double" for s in self.sides))

    def load(self):
        self.now = tuple(self.book.get()) if self.book.exists() else None

    def save(self):
        if self.now is None:
            self.book.clear()
        else:
            self.book.update(self.now)

    def step(self, key, tick, rows):
        ts = rows["ts_ms"]
        if not len(ts):
            if self.now and self._end(self.now[0] + self.ttl_ms) <= tick:
                self.now = None
            return None
        reset, out = _last(rows["event_type"] == "book"), {}
        for c, carried in zip(self.sides, self.now[1:] if self.now else (None,) * 4, strict=True):
            known = _last(~self.is_null(rows, c))
            known = np.where(known < reset, -1, known)
            values = np.r_[rows[c], np.nan if carried is None else carried][known]
            out[c] = _doubles(values, (known < 0) & ((reset >= 0) | (carried is None)))
        self.now = (int(ts[-1]), *[None if v[-1] is pd.NA else float(v[-1]) for v in out.values()])
        self.wake_at(self._end(self.now[0] + self.ttl_ms))
        return _table(len(ts), {"asset_id": key[0]}, event_id=_longs(rows["event_id"]), event_type=rows["event_type"], ts_ms=ts, **out)


class SymbolState(InOrder):
    """Metrics of a symbol after every tick that changes them, from events of six domains.

    Latest values lie in one state, the top of the last book in another, so
    that the flow imbalance between books is made as they come, and the sums
    of each tick in a third.  Trailing sums add up the ticks of their window;
    ticks leave by a timer, so sums fall also when nothing comes any more.
    Of what waits for a tick's end, only open interest and books stay rows:
    other domains leave their last values and their sums.
    """

    schema = "ts_ms long, event_id long, rank int, domain string, market string, side string, price double, qty double, value double, ask double, ask_qty double, bid_depth double, ask_depth double"
    longs, sorted_by = ("ts_ms", "event_id", "rank", "kind"), 3
    book = ("a", "b", "c", "d", "e", "f")
    doubles = ("new_price", *book)
    latest = ("latest_price", "funding_rate", "open_interest", "oi_change_pct", "bid_depth", "ask_depth")
    flows = ("spot_cvd", "perp_cvd", "ofi", "buy_liquidation", "sell_liquidation")
    PRICE, FUNDING, OPEN_INTEREST, SPOT, PERP, BUY, SELL, BOOK = range(8)

    def __init__(self, window_ms: int, liquidation_ms: int, tick_ms: int):
        if window_ms % tick_ms or liquidation_ms % tick_ms:
            raise ValueError("windows are whole ticks")
        self.windows = (*[window_ms] * 3, *[liquidation_ms] * 2)
        self.tick_ms = tick_ms

    @classmethod
    def coded(cls, events: DataFrame) -> DataFrame:
        """Events of :attr:`schema` by kind: the price they make the latest, and their value, signed notional or book."""
        is_, side = lambda d: F.col("domain") == d, F.col("side")
        notional = F.coalesce("price", F.lit(0.0)) * F.coalesce("qty", F.lit(0.0))
        sided = side.isin("buy", "sell")
        trade, liquidation = is_("trade") & sided & (notional != 0), is_("liquidation") & (notional > 0)
        mid = F.when((F.col("price") > 0) & (F.col("ask") >= F.col("price")), (F.col("price") + F.col("ask")) / 2)
        kind = F.when(is_("book"), cls.BOOK).when(is_("funding"), cls.FUNDING).when(is_("open_interest"), cls.OPEN_INTEREST)
        kind = kind.when(trade & (F.col("market") == "spot"), cls.SPOT).when(trade & (F.col("market") == "perp"), cls.PERP)
        kind = kind.when(liquidation & (side == "buy"), cls.BUY).when(liquidation & (side == "sell"), cls.SELL).otherwise(cls.PRICE)
        price = F.when(is_("quote"), F.col("value")).when(is_("funding") | trade | liquidation, F.col("price")).when(is_("book"), mid)
        own = F.when(is_("book"), F.col("price")).when(is_("funding") | is_("open_interest"), F.col("value"))
        own = own.when(trade, F.when(side == "buy", notional).otherwise(-notional)).when(liquidation, notional)
        rest = {"b": "qty", "c": "ask", "d": "ask_qty", "e": "bid_depth", "f": "ask_depth"}
        return events.select("*", kind.alias("kind"), price.alias("new_price"), own.alias("a"), *[F.when(is_("book"), F.col(c)).alias(n) for n, c in rest.items()])

    def prepare(self, handle):
        self.values = handle.getValueState("values", ", ".join(f"{c} double" for c in self.latest))
        self.top = handle.getValueState("top", "bid double, bid_qty double, ask double, ask_qty double")
        self.sums = handle.getMapState("sums", "tick long", ", ".join(f"{c} double" for c in self.flows))

    def load(self):
        self.now = dict(zip(self.latest, self.values.get() if self.values.exists() else [None] * len(self.latest), strict=True))
        self.held = tuple(self.top.get()) if self.top.exists() else None
        self.ticks = {at: tuple(sums) for (at,), sums in self.sums.iterator()}
        self.saved = set(self.ticks)

    def save(self):
        self.values.update(tuple(self.now.values()))
        if self.held is not None:
            self.top.update(self.held)
        for at in self.saved - set(self.ticks):
            self.sums.removeKey((at,))
        for at in set(self.ticks) - self.saved:
            self.sums.updateValue((at,), self.ticks[at])

    def reduced(self, rows):
        kind, places = rows["kind"], np.lexsort([rows[c] for c in ("rank", "event_id", "ts_ms")])
        keep = {p for p in (self._of(places, ~self.is_null(rows, "new_price")), self._of(places, (kind == self.FUNDING) & ~self.is_null(rows, "a"))) if p is not None}
        out = np.zeros(len(kind), bool)
        out[sorted(keep)] = True
        rows = {c: v.copy() for c, v in rows.items()}
        for k in (self.SPOT, self.PERP, self.BUY, self.SELL):
            at = np.flatnonzero((kind == k) & ~self.is_null(rows, "a"))
            if len(at):  # one row has the sum, and its place as price only if it is the last price
                first = next((p for p in at.tolist() if p in keep), at[0])
                total = rows["a"][at].sum()
                rows["a"][first] = total
                out[first] = True
        out |= (kind == self.OPEN_INTEREST) | (kind == self.BOOK)
        if not out.any():
            out[places[-1:]] = True  # the tick is given out all the same
        return {c: v[out] for c, v in rows.items()}

    @staticmethod
    def _of(places: np.ndarray, mask: np.ndarray) -> int | None:
        """The last of the sorted places that is marked."""
        marked = places[mask[places]]
        return int(marked[-1]) if len(marked) else None

    def step(self, key, tick, rows):
        kind, now, added = rows["kind"], self.now, dict.fromkeys(self.flows)
        n = len(kind)
        own = lambda k: np.flatnonzero((kind == k) & ~self.is_null(rows, "a"))
        if len(priced := np.flatnonzero(~self.is_null(rows, "new_price"))):
            now["latest_price"] = float(rows["new_price"][priced[-1]])
        if len(at := own(self.FUNDING)):
            now["funding_rate"] = float(rows["a"][at[-1]])
        if len(at := own(self.OPEN_INTEREST)):
            values = np.r_[np.nan if now["open_interest"] is None else now["open_interest"], rows["a"][at]]
            before, value = values[:-1], values[1:]
            if len(grown := np.flatnonzero(before > 0)):
                now["oi_change_pct"] = float((value[grown[-1]] - before[grown[-1]]) / before[grown[-1]] * 100)
            now["open_interest"] = float(value[-1])
        for k, flow in ((self.SPOT, "spot_cvd"), (self.PERP, "perp_cvd"), (self.BUY, "buy_liquidation"), (self.SELL, "sell_liquidation")):
            if len(at := own(k)):
                added[flow] = float(rows["a"][at].sum())
        if len(at := np.flatnonzero(kind == self.BOOK)):
            top = np.stack([rows[c][at] for c in self.book[:4]])
            mid = np.where(self.is_null(rows, "new_price")[at], 1.0, rows["new_price"][at])
            old = top if self.held is None else np.c_[np.array(self.held, float), top]
            if old.shape[1] > 1:
                added["ofi"] = float((flow_imbalance(old[:, :-1], old[:, 1:]) * mid[len(mid) - old.shape[1] + 1 :]).sum())
            self.held = tuple(map(float, top[:, -1]))
            for c, name in (("e", "bid_depth"), ("f", "ask_depth")):
                now[name] = None if self.is_null(rows, c)[at[-1]] else float(rows[c][at[-1]])
        if any(v is not None for v in added.values()):
            self.ticks[tick] = tuple(added.values())
            for w in set(self.windows):
                self.wake_at(tick + w)
        total, left = dict.fromkeys(self.flows), False
        for at, sums in list(self.ticks.items()):
            for c, w, v in zip(self.flows, self.windows, sums, strict=True):
                if v is not None and at > tick - w:
                    total[c] = (total[c] or 0.0) + v
                left |= v is not None and at == tick - w
            if at <= tick - max(self.windows):
                del self.ticks[at]
        if n or left:
            numbers = {c: _doubles([np.nan if v is None else v], np.array([v is None])) for c, v in {**now, **total}.items()}
            return _table(1, dict(zip(("exchange", "symbol"), key, strict=True)), tick_ms=tick, **numbers)
        return None


def flow_imbalance(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Change of the best bid's size less that of the best ask's, by the prices' moves."""
    (b0, p0, a0, q0), (b1, p1, a1, q1) = old, new
    bid = np.where(b1 > b0, p1, np.where(b1 < b0, -p0, p1 - p0))
    ask = np.where(a1 < a0, q1, np.where(a1 > a0, -q0, q1 - q0))
    return bid - ask


class LatestWithRetention(StatefulProcessor):
    """The last row of a key by (ts_ms, event_id); a key of which nothing came for the retention goes, and says so."""

    def __init__(self, schema: str, keys: tuple[str, ...], retention_ms: int):
        self.schema, self.keys, self.retention_ms = schema, keys, retention_ms
        self.fields = [c.split()[0] for c in schema.split(", ")]

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _row(self, key, values, gone):
        return Row(*self.keys, *self.fields, "gone")(*key, *values, gone)

    def handleInputRows(self, key, rows, timerValues):
        at = [self.fields.index(c) for c in ("ts_ms", "event_id")]
        place = lambda v: (v[at[0]], v[at[1]])
        before = best = tuple(self.last.get()) if self.last.exists() else None
        for r in rows:
            values = tuple(r[f] for f in self.fields)
            if best is None or place(values) > place(best):
                best = values
        if best != before:
            self.last.update(best)
            if before is not None:
                self.handle.deleteTimer(before[at[0]] + self.retention_ms)
            self.handle.registerTimer(best[at[0]] + self.retention_ms)
            yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            values = tuple(self.last.get())
            if values[self.fields.index("ts_ms")] + self.retention_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield self._row(key, values, True)


class Snapshots(StatefulProcessor):
    """The whole held state once an interval of processing time, changed or not; a key that is silent for the TTL goes."""

    def __init__(self, every_ms: int, ttl_ms: int):
        self.every_ms, self.ttl_ms = every_ms, ttl_ms

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms long, event_id long, envelope string", self.ttl_ms)

    def _next(self, now: int) -> int:
        return (now // self.every_ms + 1) * self.every_ms

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.last.get()) if self.last.exists() else None
        if held is None:
            self.handle.registerTimer(self._next(timerValues.getCurrentProcessingTimeInMs()))
        best = held
        for r in rows:
            if best is None or (r.ts_ms, r.event_id) > best[:2]:
                best = (r.ts_ms, r.event_id, r.envelope)
        if best != held:
            self.last.update(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            self.handle.registerTimer(self._next(timerValues.getCurrentProcessingTimeInMs()))
            ts, event_id, envelope = self.last.get()
            at = timerValues.getCurrentProcessingTimeInMs() // self.every_ms * self.every_ms
            yield Row(domain=key[0], id=key[1], snapshot_ms=at, ts_ms=ts, event_id=event_id, envelope=envelope)


def timed(df: DataFrame, delay: str) -> DataFrame:
    """The stream under a watermark; a row at ``END_MS`` moves it and goes no further."""
    rows = df.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    return rows.where(F.col("event_time").isNull() | (F.col("event_time") < F.timestamp_millis(F.lit(END_MS))))


def _by_event_time(df: DataFrame, keys: tuple[str, ...], processor: StatefulProcessor, out: str, delay: str) -> DataFrame:
    use_rocksdb(df.sparkSession)
    return timed(df, delay).groupBy(*keys).transformWithState(processor, out, "append", "eventTime")


def _in_order(df: DataFrame, keys: tuple[str, ...], processor: InOrder, out: str, delay: str) -> DataFrame:
    """The processor over packs; a pack is late if all of its rows are."""
    use_rocksdb(df.sparkSession)

    def packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += len(batch)
            if n >= PACK:
                yield processor.pack(pd.concat(some), keys)
                some, n = [], 0
        if n:
            yield processor.pack(pd.concat(some), keys)

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", tick long, ts_ms long, numbers binary, names array<string>"
    rows = df.select(*keys, *processor.columns()).mapInPandas(packs, schema)
    return timed(rows, delay).groupBy(*keys).transformWithStateInPandas(processor, out, "append", "eventTime")


def stream_signal_state(signals: DataFrame, hold_ms: int = 500, delay: str = "1 minute", tick_ms: int = 60_000) -> DataFrame:
    """States over reports (market, symbol, event_id, ts_ms, eligible), with rows that the hold timer makes (no event_id)."""
    out = "market string, symbol string, ts_ms long, event_id long, state string, by_timer boolean"
    return _in_order(signals.withColumn("eligible", F.coalesce("eligible", F.lit(False))), ("market", "symbol"), HoldTimer(hold_ms, tick_ms), out, delay)


def stream_cvd(trades: DataFrame, delay: str = "1 minute", ttl_ms: int = 86_400_000, tick_ms: int = 60_000) -> DataFrame:
    """Every trade with its key's running signed quantity and notional."""
    out = "exchange string, market string, symbol string, event_id long, ts_ms long, cvd_qty double, cvd_notional double"
    qty = F.when(F.col("side") == "buy", 1.0).when(F.col("side") == "sell", -1.0).otherwise(0.0) * F.col("qty")
    signed = trades.withColumns({"signed_qty": qty, "signed_notional": qty * F.col("price")})
    return _in_order(signed, ("exchange", "market", "symbol"), RunningDelta(ttl_ms, tick_ms), out, delay)


def stream_prediction_state(events: DataFrame, delay: str = "1 minute", ttl_ms: int = 86_400_000, tick_ms: int = 60_000) -> DataFrame:
    out = "asset_id string, event_id long, event_type string, ts_ms long, " + ", ".join(f"{s} double" for s in BookPatches.sides)
    return _in_order(events, ("asset_id",), BookPatches(ttl_ms, tick_ms), out, delay)


def stream_symbol_state(events: DataFrame, window_ms: int = 60_000, liquidation_ms: int = 900_000, delay: str = "10 seconds", tick_ms: int = 1_000) -> DataFrame:
    """Metrics per (exchange, symbol) and tick over the union of domains that :func:`symbol_events` makes."""
    out = "exchange string, symbol string, tick_ms long, " + ", ".join(f"{c} double" for c in (*SymbolState.latest, *SymbolState.flows))
    return _in_order(SymbolState.coded(events), ("exchange", "symbol"), SymbolState(window_ms, liquidation_ms, tick_ms), out, delay)


def symbol_events(quotes: DataFrame, funding: DataFrame, open_interest: DataFrame, trades: DataFrame, liquidations: DataFrame, books: DataFrame) -> DataFrame:
    """Six domains as rows of one schema; ranks order events of the same millisecond and id."""
    names = [c.split() for c in SymbolState.schema.split(", ")]
    mid = S.mid_uncrossed(F.col("bid"), F.col("ask"))
    level = lambda side, field: F.col(side)[0][field]
    domains = [
        ("quote", quotes.where(mid.isNotNull()), {"value": F.coalesce("mark", mid)}),
        ("funding", funding, {"value": F.col("funding_rate"), "price": F.col("mark_price")}),
        ("open_interest", open_interest, {"value": F.col("open_interest")}),
        ("trade", trades, {c: F.col(c) for c in ("market", "side", "price", "qty")}),
        ("liquidation", liquidations, {c: F.col(c) for c in ("side", "price", "qty")}),
        ("book", books.where("market = 'perp' and size(bids) > 0 and size(asks) > 0"), {
            "price": level("bids", "price"), "qty": level("bids", "qty"), "ask": level("asks", "price"), "ask_qty": level("asks", "qty"),
            "bid_depth": S.book_sum(F.col("bids"), 10), "ask_depth": S.book_sum(F.col("asks"), 10)}),
    ]
    rows = []
    for rank, (domain, df, own) in enumerate(domains):
        own = {"ts_ms": F.col("ts_ms"), "event_id": F.col("event_id"), "rank": F.lit(rank), "domain": F.lit(domain), **own}
        rows.append(df.select("exchange", "symbol", *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in names]))
    return reduce(DataFrame.union, rows)


def retention_ms(ttl_ms: int) -> int:
    """How long a latest value is kept: 120 times its time to live, 5 minutes at least and an hour at most."""
    return min(max(ttl_ms * 120, 300_000), 3_600_000)


def stream_latest(df: DataFrame, keys: tuple[str, ...], ttl_ms: int = 1_500, delay: str = "10 seconds") -> DataFrame:
    """Changes of the latest row per key, and a row with ``gone`` when the watermark has passed its retention."""
    rest = ", ".join(f"{c} {t}" for c, t in df.dtypes if c not in keys)
    kinds = dict(df.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {rest}, gone boolean"
    return _by_event_time(df, keys, LatestWithRetention(rest, keys, retention_ms(ttl_ms)), out, delay)


def stream_snapshots(held: DataFrame, every_ms: int = 1_000, ttl_ms: int = 3_600_000) -> DataFrame:
    """Rows (domain, id, ts_ms, event_id, envelope) held per (domain, id) and given out whole each interval."""
    use_rocksdb(held.sparkSession)
    out = "domain string, id string, snapshot_ms long, ts_ms long, event_id long, envelope string"
    return held.groupBy("domain", "id").transformWithState(Snapshots(every_ms, ttl_ms), out, "append", "processingTime")
