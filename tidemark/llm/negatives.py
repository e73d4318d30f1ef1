"""Hard-negative mining by segment summary filtering."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut, ship

#: Components of a level's segments: means and deviations of long segments first, of short ones next, then exact scores.
SEGMENTS = (16, 4)
#: A group of the scan holds about so many vectors, and so many anchors; its memory does not grow with the table.
GROUP_ROWS, GROUP_ANCHORS = 4096, 1024
#: Quantised components saturate here, so that integer products of up to 512 components stay within 64 bits.
LARGEST = 2**27
#: Anchors and vectors of one bound matrix.
TILE = 512


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: int = 0) -> DataFrame:
    """(id, label, q): one row per id with whole components floor(256 x).

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part.  Of rows that share an id the one with the
    smallest (label, vector) stays.  With ``relabel`` the rows whose id it
    divides get the label (label + 1) % 10.
    """
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * 256.0), F.lit(LARGEST).cast("long")), F.lit(-LARGEST).cast("long")).cast("int"))
    named = F.col(label).cast("long")
    if relabel:
        named = F.when(F.col(vec_id) % relabel == 0, (named + 1) % 10).otherwise(named)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & fine)
    one = F.min(F.struct(named.alias("label"), whole.alias("q"))).alias("r")
    return rows.groupBy(F.col(vec_id).alias("id")).agg(one).select("id", "r.label", "r.q")


class Side:
    """Vectors of one side with the summaries of their segments: a level's scores lie within means ± deviations."""

    def __init__(self, part: pa.Table, width: int):
        self.ids = part.column("id").to_numpy()
        self.labels = part.column("label").to_numpy()
        flat = part.column("q").combine_chunks()
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.chunk(0)
        ends = flat.offsets.to_numpy()
        sizes = np.diff(ends)
        self.q = np.zeros((len(self.ids), width))
        self.q[np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)] = flat.values.to_numpy()[ends[0] : ends[-1]]
        self.levels = []
        for length in SEGMENTS:
            cuts = np.arange(0, width, length)
            sizes = np.diff(np.append(cuts, width))
            total = np.add.reduceat(self.q, cuts, axis=1)
            spread = np.add.reduceat(self.q**2, cuts, axis=1) - total**2 / sizes
            self.levels.append((total / np.sqrt(sizes), np.sqrt(np.maximum(spread, 0))))
        self.top = float(np.abs(self.q).max(initial=0))

    def take(self, rows: slice | np.ndarray) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.q, out.top = self.ids[rows], self.labels[rows], self.q[rows], self.top
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


def bounds(a: Side, b: Side, level: int, i: np.ndarray | None = None, j: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs, or of the pairs (i, j)."""
    (m, d), (n, e) = a.levels[level], b.levels[level]
    if i is None:
        mean, more = m @ n.T, d @ e.T
    else:
        mean, more = np.einsum("ij,ij->i", m[i], n[j]), np.einsum("ij,ij->i", d[i], e[j])
    more = more + 1e-9 * (np.abs(mean) + more) + 1e-6  # rounding of doubles
    return mean - more, mean + more


def scores(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer products of the pairs (i, j)."""
    out = np.empty(len(i), np.int64)
    kind = np.float64 if a.q.shape[1] * a.top * b.top < 2**53 else np.int64
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", a.q[i[s]].astype(kind, copy=False), b.q[j[s]].astype(kind, copy=False))
    return out


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def survivors(a: Side, b: Side, allowed: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the first k of an anchor under one of its ceilings.

    ``low`` and ``high`` (anchors x ceilings) are the ends of the ranges that
    a score must lie in.  Level by level, a pair goes if no range can hold its
    score, or if k others of that range surely beat it.
    """
    lower, upper = bounds(a, b, 0)
    alive = allowed
    for level in range(len(SEGMENTS)):
        if level:
            i, j = np.nonzero(alive)
            if len(i) > alive.size // 4:
                lower, upper = bounds(a, b, level)
            else:
                lo, up = bounds(a, b, level, i, j)
                lower[i, j], upper[i, j] = lo, up
        wanted = np.zeros_like(alive)
        for c in range(low.shape[1]):
            lo, hi = low[:, c, None], high[:, c, None]
            sure = np.where(alive & (upper <= hi), lower, -np.inf)
            wanted |= (upper >= np.maximum(kth(sure, k)[:, None], lo)) & (lower <= hi)
        alive = alive & wanted
    return np.nonzero(alive)


def first(keys: list[np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each key by (score down, id up)."""
    order = np.lexsort((ids, -score, *reversed(keys)))
    if not len(order):
        return order
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _width(*parts: pa.Table) -> int:
    sizes = [pc.max(pc.list_value_length(p.column("q"))).as_py() for p in parts]
    return max([1, *[s for s in sizes if s]])


def _tiles(n: int):
    return [slice(s, min(s + TILE, n)) for s in range(0, n, TILE)]


def _positives(k: int):
    """Per group: the first k other vectors of each anchor's label."""

    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = _width(anchors, rows)
        a, b = Side(anchors, width), Side(rows, width)
        found: list[list[np.ndarray]] = [[], [], []]
        for label in np.unique(a.labels):
            mine, theirs = a.take(np.nonzero(a.labels == label)[0]), b.take(np.nonzero(b.labels == label)[0])
            for s in _tiles(len(mine.ids)):
                x = mine.take(s)
                free = np.full((len(x.ids), 1), np.inf)
                i, j = survivors(x, theirs, x.ids[:, None] != theirs.ids[None, :], k, -free, free)
                score = scores(x, theirs, i, j)
                best = first([i], score, theirs.ids[j], k)
                for out, v in zip(found, (x.ids[i[best]], theirs.ids[j[best]], score[best]), strict=True):
                    out.append(v)
        cols = [np.concatenate(v) if v else np.empty(0, np.int64) for v in found]
        return pa.table(cols, names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, share: int):
    """Per group: for each anchor and positive, the first k vectors of other labels whose score lies in the range."""

    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = _width(anchors, rows)
        a, b = Side(anchors, width), Side(rows, width)
        lists = anchors.column("positives").to_pylist()
        most = max((len(x) for x in lists), default=0)
        ids, ceil_ = np.full((len(lists), most), -1, np.int64), np.zeros((len(lists), most), np.int64)
        there = np.zeros((len(lists), most), bool)
        for r, x in enumerate(lists):
            for c, p in enumerate(x):
                ids[r, c], ceil_[r, c], there[r, c] = p["positive_id"], p["positive_score"], True
        found: list[list[np.ndarray]] = [[] for _ in range(4)]
        for s in _tiles(len(a.ids)):
            for t in _tiles(len(b.ids)):
                x, y = a.take(s), b.take(t)
                high = np.where(there[s], ceil_[s], -np.inf)
                low = np.where(there[s], ceil_[s] * (share / 100) - 1e-6 * np.abs(ceil_[s]) - 1e-6, np.inf)
                i, j = survivors(x, y, x.labels[:, None] != y.labels[None, :], k, low, high)
                score = scores(x, y, i, j)
                for c in range(most):
                    p = ceil_[s][i, c]
                    ok = there[s][i, c] & (share * p <= 100 * score) & (score <= p)
                    u, v, w = i[ok], j[ok], score[ok]
                    best = first([u], w, y.ids[v], k)
                    for out, z in zip(found, (x.ids[u[best]], ids[s][u[best], c], y.ids[v[best]], w[best]), strict=True):
                        out.append(z)
        cols = [np.concatenate(v) if v else np.empty(0, np.int64) for v in found]
        if len(cols[0]):
            best = first([cols[0], cols[1]], cols[3], cols[2], k)
            cols = [c[best] for c in cols]
        return pa.table(cols, names=["anchor_id", "positive_id", "negative_id", "negative_score"])

    return run


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """Hard negatives of each anchor and positive among vectors (id, label, q) of :func:`quantised`.

    A score is the integer inner product; vectors of unequal length count as
    padded with zeros.  The positives of an anchor are its first ``positives``
    other vectors of the same label, higher scores first, ties by smaller id;
    the negatives of a positive are the first ``negatives`` vectors of other
    labels with share% of its score <= score <= its score.

    Anchors are a query set that is compared with all rows in blocks: rows are
    dealt by a hash of their ids into groups of about ``GROUP_ROWS``, anchors
    into blocks of about ``GROUP_ANCHORS``, and every (block, group) cell is a
    cogroup of its own, so no cell grows with the table and no label or id can
    be hot.  In a cell, means and deviations of segments bound the scores;
    what survives the long segments is bounded by short ones, and only what
    survives those is scored.  Each cell returns its first few rows per
    anchor, which a windowed rank merges.

    Rows (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score).  An anchor without another vector of its label, and a
    positive without negatives in its range, give no rows; neither does an
    empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(vectors.select("id", "label", "q"))
    anchors = rows.where(is_anchor(F.col("id")))
    n, n_anchors = rows.count(), anchors.count()
    groups, blocks = max(1, ceil(n / GROUP_ROWS)), max(1, ceil(n_anchors / GROUP_ANCHORS))
    if spark.sparkContext.defaultParallelism > groups * blocks:  # small tables still use all cores
        groups = min(spark.sparkContext.defaultParallelism, max(1, n // 256)) or 1
    spread = lambda df: df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    asked = lambda df: df.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cells = lambda left, right: left.groupBy("b", "g").cogroup(right.groupBy("b", "g"))
    near = cells(asked(anchors), spread(rows)).applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    by = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("i", F.row_number().over(by)).where(F.col("i") <= positives)
    lists = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # at most ``positives`` a row
    with_lists = cut(anchors.join(lists.withColumnRenamed("anchor_id", "id"), "id"))
    far = cells(asked(with_lists), spread(rows)).applyInArrow(_negatives(negatives, share), "anchor_id long, positive_id long, negative_id long, negative_score long")
    by = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    scored = with_lists.select(F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("anchor_id", "p.positive_id", "p.positive_score")
    out = cut(far.join(scored, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    drop_cut(rows)
    drop_cut(with_lists)
    return out
