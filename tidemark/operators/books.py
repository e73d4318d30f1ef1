"""Order books: execution prices, depth, pressure and order-flow imbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import scans
from tidemark.operators.state import KEY


def average_price(levels: Column, notional: float) -> Column:
    """Average price at which ``notional`` of quote fills against the levels; null if they are too few."""
    start = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("qty"))

    def step(a, x):
        spend = F.least(a.left, x.price * x.qty)
        take = (x.price > 0) & (x.qty > 0) & (a.left > 0)
        return F.when(take, F.struct((a.left - spend).alias("left"), (a.qty + spend / x.price).alias("qty"))).otherwise(a)

    done = lambda a: F.when((a.left <= 2.220446049250313e-16) & (a.qty > 0), F.lit(float(notional)) / a.qty)
    return F.aggregate(levels, start, step, done) if notional > 0 else F.lit(None).cast("double")


def exec_price(books: DataFrame, notional: float = 1000.0) -> DataFrame:
    rest = [c for c in ("event_id", *KEY, "ts_ms") if c in books.columns]
    return books.select(*rest, average_price(F.col("bids"), notional).alias("sell_price"), average_price(F.col("asks"), notional).alias("buy_price"))


def depth_pressure(books: DataFrame, k: int = 5) -> DataFrame:
    b, a = S.book_sum(F.col("bids"), k), S.book_sum(F.col("asks"), k)
    out = books.select("event_id", *KEY, b.alias("bid_notional"), a.alias("ask_notional"))
    total = F.col("bid_notional") + F.col("ask_notional")
    return out.withColumn("pressure", F.when(total > 0, (F.col("bid_notional") - F.col("ask_notional")) / total))


def depth_ratio(books: DataFrame, k: int = 10) -> DataFrame:
    """Perp books: bid over ask notional of the first levels, and their pressure."""
    out = depth_pressure(books.where("market = 'perp'"), k)
    return out.withColumn("ratio", F.when(F.col("ask_notional") > 0, F.col("bid_notional") / F.col("ask_notional")))


def book_stats(books: DataFrame, k: int = 10) -> DataFrame:
    """Depth and liquidity score of uncrossed books."""
    b, a = F.col("bids")[0].price, F.col("asks")[0].price
    out = books.select(*KEY, b.alias("bid"), a.alias("ask"), (S.book_sum(F.col("bids"), k, False) + S.book_sum(F.col("asks"), k, False)).alias("depth_notional"))
    bps = (F.col("ask") - F.col("bid")) / ((F.col("bid") + F.col("ask")) / 2) * 10_000
    return out.where("bid > 0 and ask >= bid").withColumn("liquidity_score", F.col("depth_notional") / (1 + F.greatest(bps, F.lit(0.0))))


def weakest_ratio(latest_books: DataFrame) -> DataFrame:
    """The smallest bid/ask ratio of the first ten levels across venues, per symbol."""
    b, a = S.book_sum(F.col("bids"), 10, False), S.book_sum(F.col("asks"), 10, False)
    out = latest_books.where("market = 'perp'").select("symbol", F.when(a > 0, b / a).alias("r"))
    return out.groupBy("symbol").agg(F.min("r").alias("weakest_ratio"))


def level_flow(bp0: Column, bq0: Column, ap0: Column, aq0: Column, bp: Column, bq: Column, ap: Column, aq: Column) -> Column:
    """Change of the best bid's size less that of the best ask's, by the prices' moves, between two books."""
    bid = F.when(bp > bp0, bq).when(bp < bp0, -bq0).otherwise(bq - bq0)
    ask = F.when(ap < ap0, aq).when(ap > ap0, -aq0).otherwise(aq - aq0)
    return bid - ask


def ofi(books: DataFrame, width_ms: int = scans.WIDTH) -> DataFrame:
    """Best-level order-flow imbalance between consecutive perp books, in quote notional."""
    top = books.where("market = 'perp' and size(bids) > 0 and size(asks) > 0").select(
        "event_id", "exchange", "symbol", "ts_ms", F.col("bids")[0].price.alias("bp"), F.col("bids")[0].qty.alias("bq"),
        F.col("asks")[0].price.alias("ap"), F.col("asks")[0].qty.alias("aq"),
    )
    prev = scans.neighbours(top, ("exchange", "symbol"), before={f"p_{c}": c for c in ("bp", "bq", "ap", "aq")}, width_ms=width_ms).where("p_bp is not null")
    flow = level_flow(*[F.col(c) for c in ("p_bp", "p_bq", "p_ap", "p_aq", "bp", "bq", "ap", "aq")])
    mid = F.coalesce(S.mid_uncrossed(F.col("bp"), F.col("ap")), F.lit(1.0))
    return prev.select("event_id", "exchange", "symbol", "ts_ms", (flow * mid).alias("ofi"))


def option_depth(books: DataFrame, depth: int = 10) -> DataFrame:
    """Books cut to ``depth`` levels a side, with the depth that the venue serves for it."""
    served = next((d for d in (10, 20, 50, 100) if depth <= d), 1000)
    return books.withColumns({"bids": F.slice("bids", 1, depth), "asks": F.slice("asks", 1, depth), "venue_depth": F.lit(served)})
