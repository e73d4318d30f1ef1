"""Options and prediction markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scans


def parse_options(df: DataFrame) -> DataFrame:
    """Currency, expiry, strike and type of an instrument name (BASE-EXPIRY-STRIKE-C|P[-QUOTE])."""
    part = F.split("instrument_name", "-")
    day = F.try_element_at(part, F.lit(2))
    num = F.try_to_timestamp(F.when(day.rlike("^[0-9]{6}$"), day), F.lit("yyMMdd"))
    named = F.when(day.rlike("^[0-9]{1,2}[A-Z]{3}[0-9]{2}$"), F.concat(F.lpad(F.regexp_extract(day, "^([0-9]+)", 1), 2, "0"), F.initcap(F.regexp_extract(day, "([A-Z]{3})", 1)), F.regexp_extract(day, "([0-9]{2})$", 1)))
    expiry = F.coalesce(num, F.try_to_timestamp(named, F.lit("ddMMMyy")))
    kind = F.try_element_at(part, F.lit(4))
    return df.withColumns(
        {
            "currency": F.upper(F.try_element_at(part, F.lit(1))), "expiry_time": F.concat(F.date_format(expiry, "yyyy-MM-dd"), F.lit("T08:00:00Z")),
            "strike": F.try_element_at(part, F.lit(3)).try_cast("double"), "option_type": F.when(kind == "C", "call").when(kind == "P", "put"),
        }
    ).where("expiry_time is not null and strike is not null and option_type is not null")


def option_chain(df: DataFrame, venue=None, currency=None, option_type=None, strike_min=None, strike_max=None, expiry_after=None, expiry_before=None, include_stale=True, now=None, ttl_ms=600_000) -> DataFrame:
    """Filters of the chain; expiries compare as text, which their fixed format allows."""
    for c, v in (("venue", venue), ("currency", currency and currency.upper()), ("option_type", option_type)):
        if v is not None:
            df = df.where(F.col(c) == v)
    for c, op, v in (("strike", ">=", strike_min), ("strike", "<=", strike_max), ("expiry_time", ">=", expiry_after), ("expiry_time", "<=", expiry_before)):
        if v is not None:
            df = df.where(F.col(c) >= v if op == ">=" else F.col(c) <= v)
    return df if include_stale else df.where(F.lit(now) - F.col("received_at_ms") <= ttl_ms)


def option_replace(snapshots: DataFrame) -> DataFrame:
    """The newest batch of each (venue, currency) replaces the whole slice."""
    newest = snapshots.groupBy("venue", "currency").agg(F.max("received_at_ms").alias("received_at_ms"))
    return snapshots.join(newest, ["venue", "currency", "received_at_ms"], "left_semi")


def option_merge(old: DataFrame, live: DataFrame, fields: list[str], keys=("venue", "instrument_name")) -> DataFrame:
    """Live values win where they are not null; descriptive columns stay."""
    new = live.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    out = old.join(new, list(keys), "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def _word(text: Column, *words: str) -> Column:
    return text.rlike("(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)")


def parse_prediction(m: DataFrame) -> DataFrame:
    """Base asset, strike, direction, rule, tokens and confidence of active crypto markets."""
    text = F.lower(F.concat_ws(" ", "question", "slug"))
    base = F.when(_word(text, "bitcoin", "btc"), "BTC").when(_word(text, "ethereum", "ether", "eth"), "ETH")
    raw = F.replace(F.regexp_extract(text, r"\$([0-9.,km]+)", 1), F.lit(","), F.lit(""))
    times = F.when(raw.endswith("k"), 1e3).when(raw.endswith("m"), 1e6).otherwise(1.0)
    strike = F.regexp_replace(raw, "[km]$", "").try_cast("double") * times
    below = text.rlike("below|under|lower than|less than")
    touch = text.rlike("touch|hit |reach|at any point")
    tokens, outcomes = F.from_json("clob_token_ids", "array<string>"), F.transform(F.from_json("outcomes", "array<string>"), F.lower)
    at = lambda label: F.try_element_at(tokens, F.nullif(F.array_position(outcomes, label).cast("int"), F.lit(0)))
    yes = F.coalesce(at("yes"), F.when(F.size(tokens) >= 2, tokens[0]))
    no = F.when(at("yes").isNotNull(), at("no")).otherwise(F.when(F.size(tokens) >= 2, tokens[1]))
    out = m.where("active").withColumns({
        "base_asset": base, "strike": strike, "direction": F.when(below, "below").otherwise("above"), "rule_type": F.when(touch, "touch").otherwise("terminal"), "yes_token_id": yes, "no_token_id": no,
    })
    sure = 0.5 + F.when(F.col("yes_token_id").isNotNull() & F.col("no_token_id").isNotNull(), 0.20).otherwise(0.0) + F.when(F.col("rule_type") == "terminal", 0.15).otherwise(0.0)
    if "end_date" in m.columns:
        sure = sure + F.when(F.col("end_date").isNotNull(), 0.15).otherwise(0.0)
    return out.where("base_asset is not null and strike is not null").withColumn("parser_confidence", F.least(sure, F.lit(1.0)))


def prediction_markets(m: DataFrame) -> DataFrame:
    """Summaries of active markets, each number from its first source that has it."""
    num = lambda c: F.col(c).try_cast("double")
    return m.where("active").select(
        F.coalesce("condition_id", "slug").alias("market_id"), "question", F.coalesce(num("volume_clob"), num("volume_num"), num("volume")).alias("volume"), F.from_json("clob_token_ids", "array<string>").alias("token_ids")
    )


def texts(payload: Column, path: str) -> Column:
    """The array of texts at a path of a JSON payload, also where it is written as a text; null if it is neither."""
    at = F.get_json_object(payload, path)
    return F.when(at.startswith("["), F.from_json(at, "array<string>"))


def token_points(history: DataFrame) -> DataFrame:
    """The points (t, p) of each token in order; a token has as many as its buckets."""
    return history.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("t", "p"))).alias("points"))


def token_ids(m: DataFrame) -> DataFrame:
    return m.select(F.explode(F.from_json("clob_token_ids", "array<string>")).alias("token_id")).distinct()


def prediction_state(events: DataFrame, width_ms: int = scans.WIDTH) -> DataFrame:
    """Book state after every event: a ``book`` resets all, patches overwrite what they carry."""
    fields = {c: c for c in ("best_bid", "best_ask", "bid_depth", "ask_depth")}
    out = scans.last_known(events, ("asset_id",), fields, F.col("event_type") == "book", width_ms=width_ms)
    return out.withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def prediction_latest(events: DataFrame) -> DataFrame:
    """The last state per asset, by aggregates alone: the last book, then the last patch of each side after it."""
    o = F.struct("ts_ms", "event_id")
    base = events.groupBy("asset_id").agg(F.max(F.when(F.col("event_type") == "book", o)).alias("reset"))
    after = events.join(base, "asset_id").where(F.col("reset").isNull() | (o >= F.col("reset")))
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), o)).alias(c)
    out = after.groupBy("asset_id").agg(*[last(c) for c in ("best_bid", "best_ask", "bid_depth", "ask_depth")], F.max_by("event_type", o).alias("last_event_type"), F.max("ts_ms").alias("ts_ms"))
    return out.withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def prediction_books(state: DataFrame, token_ids: list[str] | None = None) -> DataFrame:
    """State by ids, in the order asked for and as often."""
    if token_ids is None:
        return state
    asked = state.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, token_ids))).alias("position", "asset_id"))
    return asked.join(state, "asset_id")


def prediction_summary(books: DataFrame) -> DataFrame:
    """Best prices, depths and level counts of unsorted books of text levels."""
    num = lambda c, f: F.transform(c, lambda x: x[f].try_cast("double"))
    bid, ask = F.array_max(num("bids", "price")), F.array_min(num("asks", "price"))
    depth = lambda c: F.aggregate(num(c, "size"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    out = books.select("asset_id", bid.alias("best_bid"), ask.alias("best_ask"), depth("bids").alias("bid_depth"), depth("asks").alias("ask_depth"), F.size("bids").alias("bid_levels"), F.size("asks").alias("ask_levels"))
    return out.withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def prediction_prices(state: DataFrame, sides: tuple[str, ...] = ("BUY", "SELL")) -> DataFrame:
    """Executable price per side: a buyer pays the ask, a seller gets the bid."""
    if not set(sides) <= {"BUY", "SELL"}:
        raise ValueError("sides are BUY and SELL")
    side = F.explode(F.array(*map(F.lit, sorted(sides)))).alias("side")
    return state.select("asset_id", side, "best_bid", "best_ask").select("asset_id", "side", F.when(F.col("side") == "BUY", F.col("best_ask")).otherwise(F.col("best_bid")).alias("price"))


def prediction_history(prices: DataFrame, fidelity_min: int, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """The last price of each bucket of ``fidelity_min`` minutes per token."""
    if start_ms is not None:
        prices = prices.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        prices = prices.where(F.col("ts_ms") <= end_ms)
    width = fidelity_min * 60_000
    bucket = (F.floor(F.col("ts_ms") / width) * width).cast("long")
    return prices.groupBy("asset_id", bucket.alias("t")).agg(F.max_by("price", F.struct("ts_ms", "event_id")).alias("p"))
