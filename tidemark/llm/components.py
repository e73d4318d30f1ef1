"""Connected components of a link table, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): each node of ``edges`` with the smallest node it reaches.

    Large-star and small-star rounds take turns until the links stop changing;
    every round is written to the shared folder, so lineage stays one round
    long.  Each step is a partial-aggregated minimum by node and a join on it,
    which Spark can split when one node has very many links; no group is ever
    gathered.  Links with a null end and self links are dropped.  No links give
    no rows.
    """
    now = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = _print(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.union(low.where("u > m").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        drop_cut(now)
        now, after = new, _print(new)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _print(links: DataFrame) -> tuple:
    """Number of links and a sum over them that shows any change."""
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
