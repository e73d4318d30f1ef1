"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Interval labels and their milliseconds (fixed values).
INTERVALS = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}
#: Quote assets in the order in which suffixes are tried (fixed values; USD stands before FDUSD).
LISTING_QUOTES = ["USDT", "USDC", "USD", "FDUSD", "BUSD", "TUSD", "EUR", "GBP", "JPY", "KRW", "TRY", "BRL", "BTC", "ETH", "BNB"]


def interval_ms(label: Column) -> Column:
    """Milliseconds of an interval label; null for any other label."""
    out = F.lit(None).cast("long")
    for k, v in INTERVALS.items():
        out = F.when(label == k, F.lit(v).cast("long")).otherwise(out)
    return out


def bucket_start(ts: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return (F.floor(ts / width) * width).cast("long")


def utc_day(ts: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd")


def mid_uncrossed(bid: Column, ask: Column) -> Column:
    """Mid of a quote with bid > 0 and ask >= bid, else null."""
    return F.when((bid > 0) & (ask >= bid), (bid + ask) / 2)


def mid_positive(bid: Column, ask: Column) -> Column:
    """Mid of a quote with both sides positive, crossed or not, else null."""
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 2)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def signed_notional(side: Column, price: Column, qty: Column) -> Column:
    return F.when(side == "buy", price * qty).when(side == "sell", -(price * qty)).otherwise(0.0)


def pct_rounded(values: Column, p: float) -> Column:
    """Nearest-rank percentile of an array, its index rounded half away from zero; 0 if empty."""
    at = F.round((F.size(values) - 1) * F.lit(p)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), at)).otherwise(0)


def pct_floored(values: Column, pct: int) -> Column:
    """Nearest-rank percentile of an array, its index floored; null if empty."""
    at = F.floor((F.size(values) - 1) * pct / 100).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), at))


def finite(c: Column) -> Column:
    """True for null and for finite numbers."""
    return c.isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))


def canonical_spot(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(symbol), "[^A-Z0-9]", "")


def canonical_perp(symbol: Column) -> Column:
    """One name per perp: only letters and digits, without T…F0, SWAP, PERP and a last M."""
    s = canonical_spot(symbol)
    s = F.when(s.startswith("T") & s.contains("F0"), F.replace(F.regexp_replace(s, "^T+", ""), F.lit("F0"), F.lit(""))).otherwise(s)
    s = F.regexp_replace(s, "SWAP$", "")
    s = F.regexp_replace(s, "PERP$", "")
    return F.regexp_replace(s, "M$", "")


def aggregator_key(symbol: Column, market: Column) -> Column:
    return F.concat(canonical_spot(symbol), F.when(market == "perp", "_PERP").otherwise(""))


def split_symbol(symbol: Column, quotes: list[str] = LISTING_QUOTES) -> Column:
    """struct(base, quote) by the first quote that ends the symbol; no match gives the base only."""
    s = canonical_spot(symbol)
    ends = F.array_compact(F.array(*[F.when(s.endswith(q) & (F.length(s) > len(q)), F.lit(q)) for q in quotes]))
    quote = F.try_element_at(ends, F.lit(1))
    base = F.substring(s, F.lit(1), F.length(s) - F.coalesce(F.length(quote), F.lit(0)))
    return F.struct(base.alias("base"), quote.alias("quote"))


def path_value(c: Column) -> Column:
    """A partition value with anything but letters, digits, dash, dot and underscore replaced."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def book_sum(levels: Column, k: int, positive: bool = True) -> Column:
    """Notional of the first ``k`` levels; levels without price or size do not count if ``positive``."""
    top = F.slice(levels, 1, k)
    if positive:
        top = F.filter(top, lambda x: (x.price > 0) & (x.qty > 0))
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x.price * x.qty)


#: Quotes of venue symbols and of product texts, in the order in which they are tried (fixed values).
VENUE_QUOTES = ["FDUSD", "USDT", "USDC", "BUSD", "TUSD", "USDP", "USDS", "USD", "EUR", "GBP", "TRY", "KRW", "JPY", "AUD", "CAD", "BTC", "ETH", "BNB", "SOL", "XRP"]
PRODUCT_QUOTES = ["USDT", "USDC", "FDUSD", "USD", "TRY", "EUR", "BTC", "ETH", "BNB", "BRL", "KRW", "JPY", "GBP", "AUD", "CAD"]


def _first_suffix(s: Column, quotes: list[str]) -> Column:
    return F.coalesce(*[F.when(s.endswith(q), F.lit(q)) for q in quotes])


def venue_split(symbol: Column) -> Column:
    """struct(base, quote) of a canonical symbol: by a known quote, else the last four letters of six or more, else USDT."""
    known = _first_suffix(symbol, VENUE_QUOTES)
    size = F.length(symbol)
    quote = F.coalesce(known, F.when(size >= 6, F.right(symbol, F.lit(4))), F.lit("USDT"))
    base = F.when(known.isNotNull() | (size >= 6), F.left(symbol, size - F.length(quote))).otherwise(symbol)
    return F.struct(base.alias("base"), quote.alias("quote"))


def plain_symbol(raw: Column) -> Column:
    """A symbol as typed, without white space around it, leading small t and separators, in capitals."""
    return F.upper(F.translate(F.regexp_replace(F.trim(raw), "^t+", ""), "-/_:", ""))


def product_text(raw: Column) -> Column:
    """struct(base, symbol, quote) of a typed product: symbol and quote only where a known quote ends it; an empty text has none."""
    clean = plain_symbol(raw)
    quote = F.coalesce(*[F.when(clean.endswith(q) & (F.length(clean) > len(q)), F.lit(q)) for q in PRODUCT_QUOTES])
    base = F.when(quote.isNotNull(), F.left(clean, F.length(clean) - F.length(quote))).when(clean != "", clean)
    return F.struct(base.alias("base"), F.when(quote.isNotNull(), clean).alias("symbol"), quote.alias("quote"))


def pair_name(base: Column, quote: Column, fallback: Column) -> Column:
    """One name of a pair; XBT counts as BTC; without base or quote the fallback, less its contract suffix and separators."""
    own = F.when(F.upper(base) == "XBT", "BTC").otherwise(F.upper(base))
    bare = F.upper(F.translate(F.regexp_replace(fallback, "[-_](SWAP|PERP)", ""), "-_/:", ""))
    return F.when(base.isNotNull() & quote.isNotNull(), F.concat(own, F.upper(quote))).otherwise(bare)
