"""Ordered scans of long keys in two levels.

A window over a key's whole history sorts that history in one task.  Here a
key is cut into time buckets.  Each bucket is first reduced to what it hands
on (its last row, its last known values, its count), a row per key and bucket
by partial aggregation; these few rows are scanned per key; then every bucket
is scanned by itself, behind a row that holds what came in.  No task sorts
more than a bucket of rows, rows are shuffled once, and the only long window
stands on one row per bucket.

Rows of a key are ordered by ``order``, whose first column is the time in
milliseconds that the buckets are cut by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("ts_ms", "event_id")
#: Width of a time bucket: a day.
WIDTH = 86_400_000


def _bucketed(df: DataFrame, width_ms: int, time: str) -> DataFrame:
    return df.withColumns({"_b": F.floor(F.col(time) / width_ms).cast("long"), "_edge": F.lit(0)})


def _inside(keys: tuple[str, ...], order: tuple[str, ...], *more: str):
    """Rows of a bucket in order, between the rows that stand at its edges."""
    return W.partitionBy(*keys, "_b", *more).orderBy("_edge", *order)


def _with_edges(rows: DataFrame, *edges: DataFrame) -> DataFrame:
    for e in edges:
        rows = rows.unionByName(e, allowMissingColumns=True)
    return rows


def neighbours(df: DataFrame, keys: tuple[str, ...], before: dict[str, str] | None = None, after: dict[str, str] | None = None, order: tuple[str, ...] = ORDER, width_ms: int = WIDTH) -> DataFrame:
    """Columns of the row before and of the row after, under new names (``{new: column}``); null at a key's ends."""
    rows, place = _bucketed(df, width_ms, order[0]), F.struct(*order)
    by, inside = W.partitionBy(*keys).orderBy("_b"), _inside(keys, order)
    edges, found = [], {}
    for names, last, shift, edge in ((before, F.max_by, F.lag, -1), (after, F.min_by, F.lead, 1)):
        if names:
            pack, tag = F.struct(*[F.col(c).alias(n) for n, c in names.items()]), "_before" if edge < 0 else "_after"
            ends = rows.groupBy(*keys, "_b").agg(last(pack, place).alias("_end"))
            edges.append(ends.select(*keys, "_b", shift("_end").over(by).alias(tag), F.lit(edge).alias("_edge")))
            rows = rows.withColumn(tag, pack)
            found |= {n: shift(tag).over(inside)[n] for n in names}
    out = _with_edges(rows, *edges).withColumns(found).where("_edge = 0")
    return out.drop("_b", "_edge", "_before", "_after")


def running_count(df: DataFrame, keys: tuple[str, ...], what: Column, name: str, order: tuple[str, ...] = ORDER, width_ms: int = WIDTH) -> DataFrame:
    """How many rows of the key up to and with this one satisfy ``what``."""
    rows = _bucketed(df, width_ms, order[0]).withColumn("_n", F.when(what, 1).otherwise(0).cast("long"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    edge = rows.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")).select(*keys, "_b", F.sum("_n").over(earlier).alias("_n"), F.lit(-1).alias("_edge"))
    upto = _inside(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return _with_edges(rows, edge).withColumn(name, F.sum("_n").over(upto)).where("_edge = 0").drop("_b", "_edge", "_n")


def last_known(df: DataFrame, keys: tuple[str, ...], fields: dict[str, str], reset: Column | None = None, order: tuple[str, ...] = ORDER, width_ms: int = WIDTH) -> DataFrame:
    """The last value that was not null of each column up to and with this row, under new names (``{new: column}``).

    A row that satisfies ``reset`` forgets what came before it; its own values
    count.
    """
    held = {n: f"_v_{n}" for n in fields}  # a new name may be that of a column it is made from
    rows = _bucketed(df, width_ms, order[0]).withColumns({held[n]: F.col(c) for n, c in fields.items()})
    rows = rows.withColumn("_reset", F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False))
    place = F.struct(*order)
    at = lambda cond: F.when(cond, place)
    seen = {n: F.max_by(F.struct(place.alias("at"), F.col(v).alias("value")), at(F.col(v).isNotNull())).alias(v) for n, v in held.items()}
    ends = rows.groupBy(*keys, "_b").agg(F.max(at(F.col("_reset"))).alias("_cut"), *seen.values())
    alive = lambda v: F.when(F.col("_cut").isNull() | (F.col(v)["at"] >= F.col("_cut")), F.col(v)["value"])
    ends = ends.select(*keys, "_b", "_cut", *[alive(v).alias(v) for v in held.values()])
    by = W.partitionBy(*keys).orderBy("_b")
    ends = ends.withColumn("_section", F.count("_cut").over(by.rowsBetween(W.unboundedPreceding, 0)))  # buckets since the same reset
    since = W.partitionBy(*keys, "_section").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    hand = F.struct(*[F.last(v, ignorenulls=True).over(since).alias(v) for v in held.values()])
    came = ends.withColumn("_hand", hand).withColumn("_in", F.lag("_hand").over(by))
    edge = came.select(*keys, "_b", *[F.col("_in")[v].alias(v) for v in held.values()], F.lit(False).alias("_reset"), F.lit(-1).alias("_edge"))
    both = _with_edges(rows, edge)
    if reset is not None:
        both = both.withColumn("_part", F.count_if("_reset").over(_inside(keys, order).rowsBetween(W.unboundedPreceding, 0)))
    upto = _inside(keys, order, *["_part"] * (reset is not None)).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumns({n: F.last(v, ignorenulls=True).over(upto) for n, v in held.items()})
    return out.where("_edge = 0").drop("_b", "_edge", "_reset", "_part", *held.values())


def upper_middle(df: DataFrame, keys: tuple[str, ...], value: str, name: str, coarse: int = 65_536) -> DataFrame:
    """Per key the whole number at place n // 2 (from 0) of its sorted values; keys without values give no row.

    Counts of coarse ranges find the range that holds the place, counts of the
    distinct values of that range find the value: no list of values is built.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("_x"), F.floor(F.col(value) / coarse).cast("long").alias("_r"))
    upto = lambda *by: W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    ranges = rows.groupBy(*keys, "_r").agg(F.count("*").alias("_n")).withColumns({"_upto": F.sum("_n").over(upto("_r")), "_all": F.sum("_n").over(W.partitionBy(*keys))})
    at = F.floor(F.col("_all") / 2)
    hit = ranges.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)).select(*keys, "_r", (at - (F.col("_upto") - F.col("_n"))).alias("_at"))
    named = hit.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_r")], "_at")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_r")])
    values = rows.join(named, same).groupBy(*keys, "_x").agg(F.count("*").alias("_n"), F.first("_at").alias("_at"))
    found = values.withColumn("_upto", F.sum("_n").over(upto("_x")))
    return found.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).select(*keys, F.col("_x").alias(name))
