"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Rounds between two tests of convergence, blocks of rounds at most, and the relative miss of a marginal that ends them.
ROUNDS, BLOCKS, TOLERANCE = 10, 10, 1e-3
ALPHA, SEED = 0.7, 17
_KEYS = ("_source", "_lang", "_topic")
#: Up to this many cells are broadcast and scaled by windows; more are joined by shuffles.
BROADCAST_CELLS = 100_000


def topic(text):
    """A topic by surface form, for tables that have no topic column."""
    return (
        F.when(text.contains("icense") | text.contains("ights reserved"), "legal")
        .when(text.contains(" | "), "table")
        .when(text.contains("$$$") | text.contains("!!"), "markup")
        .otherwise("prose")
    )


def _key(column):
    """A cell's key; null is apart from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def rake(cells: DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Fit the cells' token weights to the marginals' targets.

    The target share of a source, language or topic is its observed share to
    the power ``alpha``, brought to sum 1: large ones give way to small ones.
    ``targets`` can hold tables (value, share) for some of "source", "lang" and
    "topic" instead; values that no row has are left out before shares are
    brought to sum 1, and values that the table does not name get nothing.
    A round scales the cells to each marginal in turn.  After each ``rounds``
    rounds the marginals are compared with the targets; fitting ends when all
    are within TOLERANCE, or after BLOCKS blocks where the cells cannot meet
    all targets (topics, scaled last, then hold).  Only cells are shuffled
    here, never documents; up to BROADCAST_CELLS of them are scaled by windows,
    more by aggregates and joins that no value's cells meet in one task for.
    """
    fitted = cells.withColumn("w", F.col("tokens").cast("double"))
    number, all_tokens = cells.agg(F.count("*"), F.sum("tokens")).first()
    total = F.lit(all_tokens or 0).cast("double")
    for k in _KEYS:
        shares = cells.groupBy(k).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("_raw"))
        given = (targets or {}).get(k[1:])
        if given is not None:
            of = given.groupBy(_key(F.col("value")).alias(k)).agg(F.sum(F.col("share").cast("double")).alias("_raw"))
            shares = cells.select(k).distinct().join(of, k, "left").select(k, F.coalesce("_raw", F.lit(0.0)).alias("_raw"))
        norm = F.lit(shares.agg(F.sum("_raw")).first()[0])
        fitted = fitted.join(shares.select(k, (total * F.col("_raw") / norm).alias(f"target{k}")), k)
    for _ in range(BLOCKS if number else 0):
        for i in range(rounds):
            for k in _KEYS:
                if number <= BROADCAST_CELLS:
                    now = fitted.withColumn("_held", F.sum("w").over(W.partitionBy(k)))
                else:
                    now = fitted.join(cut(fitted.groupBy(k).agg(F.sum("w").alias("_held"))), k)
                fitted = now.withColumn("w", F.when(F.col("_held") > 0, F.col("w") * F.col(f"target{k}") / F.col("_held")).otherwise(0.0)).drop("_held")
            if i % 5 == 4 or i == rounds - 1 or number > BROADCAST_CELLS:
                fitted = cut(fitted)
        held = [fitted.groupBy(k).agg(F.sum("w").alias("w"), F.first(f"target{k}").alias("t")) for k in _KEYS]
        miss = held[0].union(held[1]).union(held[2]).agg(F.max(F.abs(F.col("w") - F.col("t")) / F.greatest(F.col("t"), F.lit(1.0)))).first()[0]
        if miss <= TOLERANCE:
            break
    return fitted.withColumn("ratio", F.col("w") / F.col("tokens")).select(*_KEYS, "ratio")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    rounds: int = ROUNDS, alpha: float = ALPHA, seed: int = SEED,
    targets: dict[str, DataFrame] | None = None, topics: str = "topic", tokens: str | None = None,
) -> DataFrame:
    """``docs`` with topic, tokens, weight and copies added.

    A cell's weight is its raked tokens over its own.  A document is drawn
    ``copies`` times: the whole part of its weight, and once more with the rest
    as probability.  So expected tokens, copies counted, meet the targets.
    ``targets`` are given shares (see :func:`rake`).  Topics are the column
    ``topics``, or follow the surface form in a table without it.  ``tokens``
    names a column of token counts (null or less than 1 counts as 1), else they
    are a quarter of the characters, rounded up, at least 1.  The draw of a
    document depends on its id and ``seed`` alone: repeated ids share it, and a
    rerun or a lost executor changes nothing.  Null sources, languages and
    topics form cells of their own, a null text counts as empty, null ids draw
    as an empty id; an empty table gives no rows.  Columns named tokens, weight
    and copies are replaced; others of any name stay.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    own_topic = F.col(topics).cast("string") if topics in docs.columns else topic(full)
    counted = F.col(tokens) if tokens else F.ceil(F.length(full) / 4)
    rows = docs.select(
        F.struct("*").alias("_row"), _key(F.col(source)).alias("_source"), _key(F.col(lang)).alias("_lang"), _key(own_topic).alias("_topic"),
        F.greatest(F.coalesce(counted.cast("long"), F.lit(1)), F.lit(1)).cast("long").alias("_tokens"), own_topic.alias("_own"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"),
    )
    cells = cut(rows.groupBy(*_KEYS).agg(F.sum("_tokens").alias("tokens")))
    ratios = cut(rake(cells, rounds, alpha, targets).withColumnRenamed("ratio", "_w"))
    drawn = F.conv(F.substring(F.md5(F.concat("_id", F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10)
    more = drawn.cast("double") / F.lit(4294967296.0) < F.col("_w") - F.floor("_w")
    joined = rows.join(F.broadcast(ratios) if ratios.count() <= BROADCAST_CELLS else ratios, list(_KEYS))
    made = {"topic": F.col("_own"), "tokens": F.col("_tokens"), "weight": F.col("_w"), "copies": (F.floor("_w") + more.cast("long")).cast("long")}
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    return joined.select(*[v.alias(c) for c, v in (own | made).items()])


def drawn_rows(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`mix`, each as often as it was drawn."""
    return mixed.withColumn("copies", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def oracle_sql(rounds: int = ROUNDS, alpha: float = ALPHA, seed: int = SEED) -> str:
    """The same in SQL, every scaling step written out."""
    head = f"""
WITH rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS k0, coalesce('=' || lang, '') AS k1,
    CASE WHEN contains(coalesce(text, ''), 'icense') OR contains(coalesce(text, ''), 'ights reserved') THEN 'legal'
      WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
      WHEN contains(coalesce(text, ''), '$$$') OR contains(coalesce(text, ''), '!!') THEN 'markup' ELSE 'prose' END AS k2,
    greatest(CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT), 1) AS tokens
  FROM documents),
cells AS (SELECT k0, k1, k2, CAST(sum(tokens) AS DOUBLE) AS t FROM rows GROUP BY ALL),
""" + "\n".join(
        f"m{i} AS (SELECT k{i}, (SELECT sum(t) FROM cells) * pow(sum(t), CAST({alpha} AS DOUBLE)) /"
        f" (SELECT sum(r) FROM (SELECT pow(sum(t), CAST({alpha} AS DOUBLE)) AS r FROM cells GROUP BY k{i})) AS g{i} FROM cells GROUP BY k{i}),"
        for i in range(3)
    )
    steps = ["s0 AS MATERIALIZED (SELECT *, t AS w FROM cells JOIN m0 USING (k0) JOIN m1 USING (k1) JOIN m2 USING (k2))"]
    for i in range(rounds * 3):
        k = i % 3
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT k0, k1, k2, t, g0, g1, g2, w * g{k} / sum(w) OVER (PARTITION BY k{k}) AS w FROM s{i})")
    last = f"s{rounds * 3}"
    return head + ",\n".join(steps) + f"""
SELECT doc_id, k2 AS topic, tokens, round(w / t, 6) AS weight,
  CAST(floor(w / t) AS BIGINT) + CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296.0
    < w / t - floor(w / t) AS BIGINT) AS copies
FROM rows JOIN {last} USING (k0, k1, k2)"""
