"""Near-duplicate vectors through a robust-pruned flat graph."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ship
from tidemark.llm.components import connected_components

#: Members of a shard at most; vectors per shard that centroids are fitted on.
SHARD, FIT_ROWS = 1500, 4000
#: Out-degree after pruning, candidates before it, random long links among them, pruning slack, beam width.
DEGREE, CANDIDATES, LONG, SLACK, BEAM = 20, 40, 8, 1.2, 24
#: Shards that each vector goes to, in turn, until the audit finds enough of the links of its queries.
OVERLAPS, LEAST_RECALL, AUDITED = (2, 4), 0.97, 2000
#: Splitting rounds; centroids of up to this many shards travel with the tasks, more are joined.
ROUNDS, CARRIED = 5, 1024


def _unit(vecs) -> np.ndarray:
    v = np.array(list(vecs), np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _kmeans(v: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        own = (v @ centers.T).argmax(1)
        for i in range(len(centers)):
            if (own == i).any():
                c = v[own == i].sum(0)
                centers[i] = c / (np.linalg.norm(c) or 1)
    return centers.astype(np.float32)


def shards(points: DataFrame, overlap: int = OVERLAPS[0]) -> DataFrame:
    """Deal (node, size, label, vec) into overlapping shards of at most about SHARD members.

    A shard starts as a label and is split by centroids that are fitted on a
    bounded sample of it (about FIT_ROWS members); every member goes to its
    ``overlap`` nearest.  What is still too large after ROUNDS, a ball that no centroid
    splits, is dealt by hash so that each pair of its tiles becomes a shard:
    nothing is dropped, and no task gets more than a bounded number of rows.
    """
    done, state = [], cut(points.withColumn("shard", F.col("label").cast("string")))
    for level in range(ROUNDS):
        sizes = cut(state.groupBy("shard").agg(F.count("*").alias("n")))
        big = sizes.where(F.col("n") > SHARD)
        many = big.count()
        done.append(state.join(sizes.where(F.col("n") <= SHARD).select("shard"), "shard", "left_semi"))
        if not many:
            state = None
            break
        rest = state.join(big, "shard")
        drawn = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1_000_000)) * F.col("n") < F.lit(FIT_ROWS * 1_000_000)

        def centers(group: pd.DataFrame) -> pd.DataFrame:
            n = int(group.n.iloc[0])
            group = group.sort_values("node")
            c = _kmeans(_unit(group.vec), int(np.clip(-(-3 * overlap * n // (2 * SHARD)), 2 * overlap - 2, 32 * overlap)))
            return pd.DataFrame({"shard": [group.shard.iloc[0]], "centers": [c.tobytes()]})

        fitted = cut(rest.where(drawn).groupBy("shard").applyInPandas(centers, "shard string, centers binary"))
        carried = {r.shard: r.centers for r in fitted.collect()} if many <= CARRIED else None

        def deal(batches, carried=carried):
            for batch in batches:
                for shard, own in batch.groupby("shard"):
                    raw = carried[shard] if carried is not None else own.centers.iloc[0]
                    v = _unit(own.vec)
                    c = np.frombuffer(raw, np.float32).reshape(-1, v.shape[1])
                    near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :overlap]
                    for j in range(near.shape[1]):
                        yield own[["node", "size", "label", "vec"]].assign(shard=[f"{shard}/{x}" for x in near[:, j]])

        source = rest.drop("n") if carried is not None else rest.drop("n").join(fitted, "shard")
        schema = f"node long, size long, label string, vec {points.schema['vec'].dataType.simpleString()}, shard string"
        split = source.withColumn("label", F.col("label").cast("string")).mapInPandas(deal, schema)
        state = cut(split.dropDuplicates(["node", "shard"]))
    if state is not None:
        tiles = F.ceil(2 * F.col("n") / SHARD).cast("int")
        sizes = state.groupBy("shard").agg(F.count("*").alias("n"))
        left = state.join(sizes, "shard").withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
        left = left.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        done.append(left.select("node", "size", "label", "vec", F.concat_ws(":", "shard", F.least("t", "o"), F.greatest("t", "o")).alias("shard")))
    columns = [F.col("node").cast("long").alias("node"), F.col("size").cast("long").alias("size"), "vec", "shard"]
    return cut(reduce(DataFrame.union, [d.select(*columns) for d in done]))


def robust_prune(v: np.ndarray, candidates: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none), those that no kept one covers.

    A candidate is covered if it is closer to a kept neighbour, by SLACK, than
    to the point itself.  All rows take their next step together.
    """
    n, k = candidates.shape
    far = 2 - 2 * near
    alive = candidates >= 0
    kept = np.full((n, DEGREE), -1, np.int64)
    rows = np.arange(n)
    for j in range(DEGREE):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        pick = np.where(some, candidates[rows, first], -1)
        kept[:, j] = pick
        between = 2 - 2 * np.einsum("nkd,nd->nk", v[candidates], v[pick])
        alive &= (SLACK * between > far) & some[:, None]
        alive[rows, first] = False
    return kept


def build(v: np.ndarray, seed: int = 0) -> np.ndarray:
    """Pruned adjacency of one shard (rows of neighbour places, -1 for none)."""
    n = len(v)
    if n < 2:
        return np.full((n, 1), -1, np.int64)
    v = v.astype(np.float32)
    k = min(CANDIDATES, n - 1)
    sims = v @ v.T
    np.fill_diagonal(sims, -2)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(seed).integers(0, n, (n, LONG))
    candidates = np.concatenate([top, far], axis=1)
    near = np.take_along_axis(sims, candidates, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    candidates = np.where(near > -2, candidates, -1)
    return robust_prune(v, candidates, near)


def search(v: np.ndarray, adjacency: list[np.ndarray], least: float) -> np.ndarray:
    """For every point, the points found within ``least`` (boolean matrix), by greedy search.

    All points search together.  A search starts at the medoid and at the
    point's own node, always expands its best unexpanded node among the BEAM
    best, and every node within range besides; it ends when neither is left.
    Only visited nodes are compared.
    """
    n = len(v)
    u = v.astype(np.float32)
    degree = max(1, max(map(len, adjacency)))
    table = np.full((n, degree), n, np.int64)
    for i, own in enumerate(adjacency):
        table[i, : len(own)] = own
    mean = u.sum(0)
    medoid = int((u @ mean).argmax())
    sims = np.full((n, n + 1), -2, np.float32)
    open_ = np.zeros((n, n + 1), bool)
    rows = np.arange(n)
    for start in (np.full(n, medoid), rows):
        sims[rows, start] = np.einsum("nd,nd->n", u, u[start])
        open_[rows, start] = True
    slack = least - 1e-4
    width = min(BEAM, n)
    active = rows
    while len(active):
        s, o = sims[active], open_[active]
        cut_off = -np.partition(-s[:, :n], width - 1, axis=1)[:, width - 1]
        masked = np.where(o, s, -3)
        best = masked.argmax(1)
        reach = masked[np.arange(len(active)), best]
        go = (reach > -3) & (reach >= np.minimum(cut_off, slack))
        in_range = o & (s >= slack)
        in_range[np.arange(len(active))[go], best[go]] = True
        q, x = np.nonzero(in_range)
        keep = go[q]
        q, x = active[q[keep]], x[keep]
        if not len(q):
            break
        open_[q, x] = False
        for low in range(0, len(q), 20_000):
            a, b = q[low : low + 20_000], x[low : low + 20_000]
            nq, nx = np.repeat(a, degree), table[b].ravel()
            new = (nx < n) & (sims[nq, np.minimum(nx, n)] == -2)
            key = np.unique(nq[new] * n + nx[new])
            nq, nx = key // n, key % n
            sims[nq, nx] = np.einsum("nd,nd->n", u[nq], u[nx])
            open_[nq, nx] = True
        active = active[go]
    a, b = np.nonzero(sims[:, :n] >= slack)
    found = np.zeros((n, n), bool)
    for low in range(0, len(a), 200_000):
        p, q = a[low : low + 200_000], b[low : low + 200_000]
        ok = np.einsum("nd,nd->n", v[p], v[q]) >= least  # double precision
        found[p[ok], q[ok]] = True
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _smallest(found: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each place the smallest node that it reaches within the shard."""
    best = nodes.copy()
    out = best.copy()
    todo = np.argsort(nodes, kind="stable")
    seen = np.zeros(len(nodes), bool)
    for i in todo:
        if seen[i]:
            continue
        front = np.zeros(len(nodes), bool)
        front[i] = True
        group = front.copy()
        while front.any():
            front = found[front].any(0) & ~group
            group |= front
        seen |= group
        out[group] = nodes[i]
    return out


def _told(classes: DataFrame, overlap: int, least: float) -> DataFrame:
    """(node, links, low) of every member of every shard: its links that count there, and the smallest node it reaches there."""
    dealt = shards(classes, overlap)
    homes = dealt.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("homes"))  # a few shards a node

    def adjacency(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes = group.node.to_numpy()
        near = build(_unit(group.vec))
        return pd.DataFrame({"node": nodes, "near": [nodes[x[x >= 0]] for x in near]})

    lists = dealt.groupBy("shard").applyInPandas(adjacency, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = dealt.join(united, "node").join(homes, "node")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node").reset_index(drop=True)
        shard, nodes, size = group.shard.iloc[0], group.node.to_numpy(), group["size"].to_numpy()
        n = len(nodes)
        both: list[set] = [set() for _ in range(n)]
        for i, near in enumerate(group.near):  # links serve both ways
            at = np.searchsorted(nodes, near)
            for j in at[(at < n) & (nodes[np.minimum(at, n - 1)] == near)]:
                both[i].add(int(j))
                both[int(j)].add(i)
        found = search(_unit(group.vec), [np.array(sorted(x), np.int64) for x in both], least)
        lows = _smallest(found, nodes)
        # a pair counts in the first shard that both share
        first = np.zeros((n, n), bool) if n else None
        names = {h: k for k, h in enumerate(sorted({h for hs in group.homes for h in hs if h < shard}))}
        if names:
            inside = np.zeros((n, len(names)), np.float32)
            for i, hs in enumerate(group.homes):
                inside[i, [names[h] for h in hs if h in names]] = 1
            first = inside @ inside.T > 0
        count = (found & ~first) @ size
        return pd.DataFrame({"node": nodes, "links": count.astype(np.int64), "low": lows})

    return cut(ready.groupBy("shard").applyInPandas(links, "node long, links long, low long"))


def audit(classes: DataFrame, told: DataFrame, least: float, most: int = AUDITED) -> tuple[int, int]:
    """Links of a query set that were found, and all that there are by brute force.

    The queries are classes whose smallest id is divisible by 20, at most
    ``most`` of them (those with the smallest hashes), against every class of
    their label: one pass over all rows, with the bounded query set in every task.
    """
    drawn = classes.where(F.col("first_id") % 20 == 0).orderBy(F.xxhash64("node", F.lit(5)), "node").limit(most)
    queries: dict[str, tuple[list, list]] = {}
    for r in drawn.select("node", "label", "vec").collect():  # ``most`` rows
        nodes, vecs = queries.setdefault(r.label, ([], []))
        nodes.append(r.node)
        vecs.append(r.vec)
    units = {label: (np.array(nodes), _unit(vecs)) for label, (nodes, vecs) in queries.items()}

    def count(batches):
        for batch in batches:
            for label, own in batch.groupby("label"):
                if label in units:
                    nodes, u = units[label]
                    hit = (u @ _unit(own.vec).T >= least) & (nodes[:, None] != own.node.to_numpy()[None])
                    yield pd.DataFrame({"node": nodes, "every": hit @ own["size"].to_numpy()})

    every = classes.select("node", "size", "label", "vec").mapInPandas(count, "node long, every long").groupBy("node").agg(F.sum("every").alias("every"))
    found = every.join(told.groupBy("node").agg(F.sum("links").alias("links")), "node").agg(F.sum("links"), F.sum("every")).first()
    return int(found[0] or 0), int(found[1] or 0)


def near_vectors(vectors: DataFrame, least: float = 0.93, report: list | None = None) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    ``vectors`` has (vec_id, embedding, label); other columns are ignored.
    Only vectors of one non-null label are compared, by cosine in double
    precision.  Null and zero vectors, vectors with null or non-finite
    components, and vectors without a label or id link with nothing and are
    their own component.  Equal vectors are one class, whose members all link
    to each other; classes, not copies, enter the graph.  Vectors of another
    length than their label's most common one are compared among themselves
    (length is part of the label).  An empty table gives no rows.

    The graph is built on overlapping shards; a node's lists from its shards
    are united; greedy range-expanding searches run in every shard over the
    united lists.  A pair that meets in several shards is counted in the first
    of them only.  Rows that leave a shard are one per member: its verified
    number of links and the smallest node it reaches there.  Then the links of a
    query set are counted by brute force (:func:`audit`).  If fewer than
    LEAST_RECALL of them were found, the graph is built again with every vector
    in more shards, up to the last of OVERLAPS.  ``report``, a list, gets
    (overlap, links found, links there are) of each audit.  Rows that repeat a
    vec_id with different vectors are classes apart: each counts its own links,
    and component_id is the smallest id that a class reaches.
    """
    ship(vectors.sparkSession)
    good = F.expr(
        "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(embedding, x -> x <> 0)"
    )
    kind = "double" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "float"
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label")).withColumn("good", F.coalesce(good, F.lit(False)))
    # -0.0 becomes 0.0, so that equal vectors are equal arrays
    rows = cut(rows.withColumn("vec", F.when(F.col("good"), F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)))).drop("embedding"))
    grouped = rows.where("good").groupBy("label", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    within = classes.withColumn("label", F.concat_ws("#", "label", F.size("vec")))
    for overlap in OVERLAPS:
        told = _told(within.select("node", "size", "label", "vec"), overlap, least)
        found, there = audit(within, told, least)
        if report is not None:
            report.append((overlap, found, there))
        if found >= LEAST_RECALL * there:
            break
    parts = connected_components(told.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    totals = told.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(totals, "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = named.join(names, "component").select("label", "vec", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id")
    linked = rows.where("good").join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
