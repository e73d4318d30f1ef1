"""SimHash fingerprints, and links between close ones by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ship
from tidemark.llm.components import connected_components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the text's word shingles in order, repeats kept; a shorter text is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and ASCII space only
    if not tokens:
        return np.zeros(0, "<u8")
    data = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], seed) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], dtype="<u8")


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats counted; 0 without words."""
    return simhash(shingle_hashes(text, words, seed))


def simhash(h: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 without hashes."""
    if not len(h):
        return 0
    by_byte = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed long; every row gets one."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, words, seed) for t in batch.text], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch.doc_id, "fp": fp.view(np.int64)})

    kind = docs.schema[doc_id].dataType.simpleString()
    as_text = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return as_text.mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast(kind).alias("doc_id"), "fp")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks over ``blocks - distance`` of the blocks: of two fingerprints within
    ``distance`` bits, at least one mask shows the same bits."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(c) for c in combinations(one, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_links(prints: DataFrame, distance: int = 4, direct: int = 32, tile: int = 2048, blocks: int | None = None, reach: int | None = None) -> DataFrame:
    """Links (a, b) that connect what fingerprints within ``distance`` bits connect.

    ``prints`` holds (fp, node), each fp once.  Every fp goes to one bucket per
    mask; the number of blocks grows with the number of fingerprints, so random
    meetings stay rare.  Buckets of up to ``direct`` members are joined and
    verified pair by pair.  A larger bucket is dealt into tiles of about
    ``tile`` members; every pair of tiles is searched in one task, which
    returns a spanning forest of the verified links, so rows grow with the
    members and no link is lost.  ``blocks`` replaces that number.  With
    ``reach``, fingerprints that meet in a bucket are linked up to so many bits,
    so many links beyond ``distance`` come too, but not all.
    """
    reach = distance if reach is None else reach
    if blocks is None:
        n = prints.count()
        blocks = distance + (2 if n < 1 << 22 else 3 if n < 1 << 27 else 4)
    masks = block_masks(distance, blocks)
    keyed = prints.select(
        "fp", "node",
        F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(x)).alias("k")) for i, x in enumerate(masks)])).alias("key"),
    ).select("key.m", "key.k", "fp", "node")
    sizes = keyed.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["m", "k"]))
    small = shared.where(F.col("n") <= direct)
    other = small.select("m", "k", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= reach
    pairs = small.join(other, (small.m == other.m) & (small.k == other.k) & (small.fp < other.fp2) & near).select(
        F.col("node").alias("a"), F.col("node2").alias("b")
    )
    large = (
        shared.where(F.col("n") > direct)
        .withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
        .withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("m", "k", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "fp", "node")
    )
    ship(prints.sparkSession)

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        fp, node = group.fp.to_numpy().view(np.uint64), group.node.to_numpy()
        left, links = np.arange(len(fp)), []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                hit = np.bitwise_count(fp[left] ^ fp[at]) <= reach
                links += [(node[at], node[x]) for x in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
        return pd.DataFrame(links, columns=["a", "b"])

    kind = prints.schema["node"].dataType.simpleString()
    tiles = large.groupBy("m", "k", "i", "j").applyInPandas(forest, f"a {kind}, b {kind}")
    return pairs.union(tiles)


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: (doc_id, fp, component_id).

    Documents of one fingerprint are one class, named by their smallest
    doc_id, so copies never meet in pairs.  component_id is the smallest
    doc_id reachable by links.  A text without words has fingerprint zero and
    links like any other.  A class whose ids are all null links with nothing
    and has a null component; repeated rows share a class; an empty table
    gives no rows.
    """
    prints = cut(fingerprints(docs, doc_id, text, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    parts = connected_components(close_links(classes.where("node is not null"), distance))
    named = classes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, all columns kept.

    Rows without an id stay.  Rows that repeat an id stay or go together.
    """
    of = simhash_components(docs, doc_id, text, words, distance).where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(of, docs[doc_id] == of["_keep"], "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
