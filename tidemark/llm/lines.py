"""Line deduplication by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Word counts are kept by hash bucket, so the order of rarity has a fixed size.
BUCKETS = 1 << 16
#: A table of up to this many rows and list entries is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


#: Lines of up to these many words have a bitmap of 64 or 128 bits of their words; longer ones of 256 bits.
ONE_MAP, TWO_MAPS = 48, 112


def _split(line):
    """Lower-case parts between white space; single spaces, the usual case, need no pattern."""
    low = F.lower(line)
    other = low.contains("\t") | low.contains("\r") | low.contains("\x0b") | low.contains("\x0c")
    return F.when(other, F.split(low, r"\s")).otherwise(F.split(low, " "))


def _spoken(line: str):
    """Whether a line has anything but white space; it stops at the first other character."""
    return F.ltrim(F.col(line), F.lit(" \t\n\x0b\x0c\r")) != ""


def _hashes(line):
    """64-bit hashes of the distinct lower-case words of a line."""
    return F.array_remove(F.array_distinct(F.transform(_split(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _small(df: DataFrame, of: DataFrame, lists: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if ``of``, the table it comes from, is small; entries of ``lists`` count as rows."""
    held = of.agg((F.count("*") + (F.sum(F.size(lists)) if lists else F.lit(0))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if held <= BROADCAST_ROWS else df


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """Remove every line that is similar to an earlier one; all columns of ``docs`` stay.

    Lines are the parts of a text between line feeds, in the order (doc_id,
    hash of the text, line number); null ids come first.  Their tokens are the
    distinct lower-case words.  A line goes if an earlier line, in any
    document, has Jaccard similarity of at least ``num/den`` (0.8).  Lines
    without words stay.  ``text`` becomes the lines that are left, and
    n_lines and n_removed are added, in place of columns of those names; other
    columns of any name stay as they are.  A null text counts as empty.  Rows that
    repeat both id and text get the same result.  An empty table gives no rows.

    Copies of a whole line go first.  The join: words are ordered by the size of their counts over all lines; a
    line's rarest ``n - ceil(0.8 n) + 1`` words are its prefix, and similar
    lines share a prefix word.  Prefix rows carry length, position and a bitmap
    of the words.  A semi-join keeps the prefix rows that have another line
    within the length, positional and bitmap filters.  Of what is left, every
    line is compared with the earliest line of each of its words, one pair per
    line and word; of the lines that no such pair settles, two more semi-joins
    over prefix rows keep those with an earlier match within the filters, and
    those matches; a last one compares their words.  Jaccard is verified on 64-bit
    hashes of the words.  No step gives a row per pair of a group of many
    similar lines.
    """
    base = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn(
        "_hash", F.xxhash64("_text")
    )
    # the outer forms of explode keep Spark from evaluating their arguments once more as a filter
    lines = base.select("_id", "_hash", F.posexplode_outer(F.split("_text", "\n")).alias("_line", "line")).where(_spoken("line"))
    spot = F.struct("_id", "_hash", "_line")
    one, two = F.xxhash64("line"), F.xxhash64(F.lit("second"), F.col("line"))

    # exact copies: all but the first line of a text
    marks = cut(lines.select("_id", "_hash", "_line", one.alias("h1"), two.alias("h2")))
    firsts = cut(marks.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = marks.join(_small(firsts, firsts), ["h1", "h2"]).where(spot != F.col("first")).select("_id", "_hash", "_line")

    by_doc = cut(copies.groupBy("_id", "_hash").agg(F.collect_list("_line").alias("_gone")))
    few = _small(by_doc.withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"}), by_doc, "_gone")
    apart = base.withColumn("_parts", F.split("_text", "\n")).join(few, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    every = F.sequence(F.lit(0), F.size("_parts") - 1)
    left = F.when(F.col("_gone").isNull(), every).otherwise(F.array_except(every, "_gone"))
    lines = (
        apart.select("_id", "_hash", "_parts", F.explode_outer(left).alias("_line"))
        .select("_id", "_hash", "_line", F.get("_parts", F.col("_line")).alias("line")).where(_spoken("line"))
    )

    # the order of rarity
    low = F.lit(BUCKETS - 1)
    seen = base.select(F.explode_outer(F.split(F.replace("_text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    seen = seen.groupBy(F.xxhash64("w").bitwiseAND(low).alias("b")).count()
    classes = ["0"] * BUCKETS  # the logarithm of each bucket's count
    for r in seen.collect():  # at most BUCKETS rows
        classes[r["b"]] = str(int(r["count"]).bit_length())
    rarity = F.split(F.lit(",".join(classes)), ",").cast("array<tinyint>")  # a constant, folded once
    mask = (1 << 43) - 1

    def key(h):
        own = F.coalesce(F.get(rarity, h.bitwiseAND(low).cast("int")), F.lit(0).cast("tinyint"))  # not null: the keys sort as plain numbers
        return F.shiftleft(own.cast("long"), 43).bitwiseOR(h.bitwiseAND(F.lit(mask)))

    # prefix rows; maps of quarters of the hashes' range lie between three marks in their order
    marks4 = "array(-4611686018427387904L, 0L, 4611686018427387904L)"
    keyed = lines.select(one.alias("h"), _hashes(F.col("line")).alias("hashes")).select(
        "h", "hashes", F.size("hashes").alias("n"), F.sort_array(F.transform("hashes", key)).alias("keys"),
        F.expr(f"if(size(hashes) > {ONE_MAP}, sort_array(concat(hashes, {marks4})), null)").alias("spread"),
    )
    cuts = [F.expr(f"cast(array_position(spread, {marks4}[{i}]) as int)").alias(f"c{i + 1}") for i in range(3)]
    bits = lambda array, start="0L": f"aggregate({array}, {start}, (a, k) -> a | shiftleft(1L, cast(k & 63 as int)))"
    q1, q2 = "slice(spread, 1, c1 - 1)", "slice(spread, c1 + 1, c2 - c1 - 1)"
    q3, q4 = "slice(spread, c2 + 1, c3 - c2 - 1)", "slice(spread, c3 + 1, size(spread) - c3)"
    signed = keyed.select("*", *cuts).select(
        "h", "n", F.slice("keys", 1, F.expr(f"n - cast(({num} * n + {den} - 1) div {den} as int) + 1")).alias("prefix"),
        F.expr(f"case when n <= {ONE_MAP} then {bits('hashes')} when n <= {TWO_MAPS} then {bits(q2, bits(q1))} else {bits(q1)} end").alias("s1"),
        F.expr(f"case when n <= {ONE_MAP} then 0L when n <= {TWO_MAPS} then {bits(q4, bits(q3))} else {bits(q3)} end").alias("s2"),
        F.expr(f"if(n <= {TWO_MAPS}, 0L, {bits(q2)})").alias("s3"), F.expr(f"if(n <= {TWO_MAPS}, 0L, {bits(q4)})").alias("s4"),
    )
    rows = signed.select("h", "n", "s1", "s2", "s3", "s4", F.posexplode_outer("prefix").alias("p", "k")).select(
        "k", "h", "s1", "s2", "s3", "s4", F.expr("shiftleft(cast(n as long), 32) | p").alias("np")
    )
    n, p = "cast(shiftrightunsigned({0}.np, 32) as long)", "({0}.np & 4294967295)"
    nx, ny, px, py = n.format("x"), n.format("y"), p.format("x"), p.format("y")
    whole = num + den  # J >= num/den  <=>  overlap * whole >= num * (|x| + |y|)
    within = (
        f"x.k = y.k and x.h <> y.h and least({nx}, {ny}) * {den} >= greatest({nx}, {ny}) * {num}"
        f" and (1 + least({nx} - {px} - 1, {ny} - {py} - 1)) * {whole} >= {num} * ({nx} + {ny})"
        # maps of lines on two sides of a bound are folded to the form that both have
        f" and case when {nx} > {TWO_MAPS} and {ny} > {TWO_MAPS} then bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2) + bit_count(x.s3 ^ y.s3) + bit_count(x.s4 ^ y.s4)"
        f" when {nx} > {ONE_MAP} and {ny} > {ONE_MAP} then bit_count((x.s1 | x.s3) ^ (y.s1 | y.s3)) + bit_count((x.s2 | x.s4) ^ (y.s2 | y.s4))"
        f" else bit_count((x.s1 | x.s2 | x.s3 | x.s4) ^ (y.s1 | y.s2 | y.s3 | y.s4)) end * {whole} <= {den - num} * ({nx} + {ny})"
    )
    near = F.expr(within)
    slim = ["k", "h", "s1", "s2", "s3", "s4", "np"]
    found = cut(rows.alias("x").join(rows.alias("y"), near, "left_semi").select(*slim))

    # verification, over the first line of each text that is left
    wanted = found.select(F.col("h").alias("h0")).distinct()
    again = cut(
        lines.withColumn("h", one).join(_small(wanted, wanted), F.col("h") == F.col("h0"), "left_semi")
        .select(spot.alias("spot"), "h", _hashes(F.col("line")).alias("words"))
    )
    alike = lambda x, y: f"size(array_intersect({x}, {y})) * {whole} >= {num} * (size({x}) + size({y}))"
    ready = cut(found.join(again.select("h", "spot"), "h").select(*slim, "spot"))
    hubs = ready.groupBy("k").agg(F.min(F.struct("spot", *slim[1:])).alias("y"))
    placed = ready.alias("x").join(hubs, "k").where("y.spot < x.spot")
    words = lambda name: again.select(F.col("spot").alias(name), F.col("words").alias(f"{name}_words"))
    close = F.expr(within.replace("x.k = y.k and ", ""))
    pairs = placed.where(close).select("x.spot", F.col("y.spot").alias("hub")).distinct()
    sure = cut(
        pairs.join(words("spot"), "spot").join(words("hub"), "hub").where(alike("spot_words", "hub_words")).select("spot").distinct()
    )
    # both sides of the wide join shrink first, by the filters over narrow rows
    open_ = placed.select("x.*").join(sure, "spot", "left_anti")
    open_ = cut(open_.alias("x").join(ready.alias("y"), near & F.expr("y.spot < x.spot"), "left_semi"))
    partners = ready.alias("x").join(open_.alias("y"), near & F.expr("x.spot < y.spot"), "left_semi")
    x = open_.select("k", "spot").join(words("spot"), "spot").alias("x")
    y = partners.select("k", "spot").join(words("spot"), "spot").alias("y")
    similar = F.expr(f"x.k = y.k and y.spot < x.spot and {alike('x.spot_words', 'y.spot_words')}")
    later = sure.union(x.join(y, similar, "left_semi").select("spot")).select("spot.*")

    # removal
    gone = cut(
        by_doc.select("_id", "_hash", F.explode("_gone").alias("_line")).union(later).distinct().groupBy("_id", "_hash").agg(F.collect_list("_line").alias("_gone"))
    )
    few = _small(gone.withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"}), gone, "_gone")
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_parts": F.split("_text", "\n")})
    joined = rows.join(few, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("_parts", i)), "\n")
    made = {
        text: F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept),
        "n_lines": F.size("_parts"),
        "n_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")),
    }
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    return joined.select(*[v.alias(c) for c, v in (own | made).items()])
