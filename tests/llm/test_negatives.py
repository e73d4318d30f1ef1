"""Hard negatives against brute force, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step=10, relabel=7):
    seen = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        y = (y + 1) % 10 if i % relabel == 0 else y
        seen[i] = min(seen.get(i, (y, q)), (y, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a in (i for i in seen if i % step == 0):
        y, q = seen[a]
        score = sorted((-dot(q, r), i) for i, (z, r) in seen.items() if i != a and z == y)[:5]
        for s, p in score:
            s = -s
            far = sorted((-dot(q, r), i) for i, (z, r) in seen.items() if z != y and 80 * s <= 100 * dot(q, r) <= 100 * s)[:5]
            out |= {(a, p, k + 1, i, s, -t) for k, (t, i) in enumerate(far)}
    return out


def got(spark, rows, step=10):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "q": F.lit("x"), "b": F.lit(0)})
    out = N.hard_negatives(N.quantised(df, relabel=7), lambda i: i % step == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return {tuple(r) for r in out.collect()}


@pytest.mark.parametrize("width,tile", [(64, 512), (19, 32)])
def test_equals_brute_force(spark, monkeypatch, width, tile):
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N, "GROUP_ROWS", 128)
    monkeypatch.setattr(N, "GROUP_ANCHORS", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, width))
    rows = []
    for i in range(600):
        v = centre[i % 6] + rng.normal(scale=0.3, size=width)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(0, 4))))
    rows += [(600 + i, rows[i % 3][1], i % 3) for i in range(60)]  # repeated vectors: ties
    rows += rows[:20] + [(10, rows[5][1], 0)]  # repeated rows and a clashing id
    rows += [(None, rows[0][1], 1), (700, None, 1), (701, rows[0][1], None), (710, [float("nan")] * width, 1), (720, [None] * width, 2), (730, [], 1), (740, [0.5, 0.25], 2), (750, [float("inf")], 2)]
    want = brute(rows)
    assert len(want) > 200
    assert got(spark, rows) == want


def test_few_or_no_rows(spark):
    assert got(spark, []) == set()
    assert got(spark, [(10, [1.0, 0.0], 1)]) == set()
    assert got(spark, [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 1)]) == set()
    assert got(spark, [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [0.9, 0.0], 2)]) == {(10, 11, 1, 12, 65536, 256 * 230)}
    assert got(spark, [(10, [-1.0], 1), (11, [1.0], 1), (12, [-1.0], 2)]) == set()  # a negative ceiling has an empty range
    big = got(spark, [(10, [3e38, 1.0], 1), (11, [3e38, 1.0], 1), (12, [3e38, 0.5], 2)])
    assert big == {(10, 11, 1, 12, N.LARGEST**2 + 65536, N.LARGEST**2 + 256 * 128)}


def test_bounds_hold(spark):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    side = lambda n: N.Side(pa.table({"id": np.arange(n), "label": np.zeros(n, int), "q": pa.array(rng.integers(-300, 300, (n, 37)).tolist(), pa.list_(pa.int32()))}), 37)
    a, b = side(20), side(30)
    exact, before = a.q @ b.q.T, None
    for level in range(len(N.SEGMENTS)):
        lower, upper = N.bounds(a, b, level)
        assert (lower <= exact).all() and (exact <= upper).all()
        assert before is None or (upper - lower).mean() < before
        before = (upper - lower).mean()
