"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut


def radix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head: int = 32, growth: int = 4) -> DataFrame:
    """Groups of identical texts, found by splitting on successive bytes.

    The first digit is the byte length with the first ``head`` bytes; each
    later digit is the next run of bytes, ``growth`` times as long as the one
    before, so a text of n bytes takes log(n) levels.  A group is done when it
    has one row or its bytes have ended; only larger groups go on, and only
    their next run of bytes is moved.  Groups are named by their smallest row
    number, so no digest takes part in equality.  Counts are partial
    aggregates and members find their group in a join, which Spark can split:
    a group with a third of all rows is never gathered.

    Returns (doc_id, text_sha256, keep_id, group_size, kept), one row per
    input row.  A null text counts as empty.  The largest id of a group stays;
    null ids come last; of rows that repeat that id one stays.  An empty table
    gives no rows; other columns are ignored.
    """
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("bytes")
    ).withColumns({"size": F.octet_length("bytes"), "digit": F.substring("bytes", 1, head)})
    cells = base.groupBy("size", "digit").agg(F.count("*").alias("n")).where("n > 1")
    rows = cut(
        base.join(cells, ["size", "digit"], "left").select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("bytes", 256).alias("text_sha256"),
            "size",
            F.when(F.col("n").isNotNull(), F.col("bytes")).alias("bytes"),
        )
    )
    longer = rows.where("bytes is not null").select("row", "size", "bytes")
    state = longer.select("row", "size", F.col("size").cast("long").alias("grp"))
    done, at, width = [], 0, head
    while True:
        run = longer.where(F.col("size") >= at).select("row", F.expr(f"substring(bytes, {at + 1}, {width})").alias("digit"))
        digits = cut(state.join(run, "row"))
        cells = digits.groupBy("grp", "digit").agg(F.min("row").alias("next"), F.count("*").alias("n")).where("n > 1")
        level = cut(digits.join(cells, ["grp", "digit"]).select("row", "size", F.col("next").alias("grp")))
        drop_cut(digits)
        at, width = at + width, width * growth
        done.append(level.where(F.col("size") <= at).select("row", "grp"))
        state = level.where(F.col("size") > at)
        if state.isEmpty():
            break
    members = reduce(DataFrame.union, done)
    best = F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("back")))
    groups = (
        rows.select("row", "doc_id").join(members, "row").groupBy("grp")
        .agg(F.count("*").alias("group_size"), best.alias("best"))
        .select("grp", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.back")).alias("keep_row"))
    )
    return (
        rows.drop("bytes", "size")
        .join(members.join(groups, "grp"), "row", "left")
        .select(
            "doc_id",
            F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
            (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
            "text_sha256",
        )
    )
