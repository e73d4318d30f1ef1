"""Two-level scans against plain loops, and their plans."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans

SCHEMA = "event_id long, k string, ts_ms long, v double, u double, hit boolean"


def table(n=600, keys=("a", "b", None), days=40, seed=1):
    """Most rows belong to one key; a third of the values are missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = "a" if rng.random() < 0.7 else rng.choice(keys)
        v, u = (rng.choice([None, float(rng.randrange(50)), float(rng.randrange(50))]) for _ in range(2))
        rows.append((i, k, rng.randrange(days * 20) * scans.WIDTH // 20, v, u, rng.random() < 0.1))
    return rows


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out[r[1]].append(r)
    return out


@pytest.mark.parametrize("width", [scans.WIDTH, 1000 * scans.WIDTH, scans.WIDTH // 7])
def test_equal_plain_loops(spark, width):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    near, count, last, since = {}, {}, {}, {}
    for same in by_key(rows).values():
        n, held, kept = 0, [None, None], [None, None]
        for i, r in enumerate(same):
            near[r[0]] = (same[i - 1][3] if i else None, same[i - 1][2] if i else None, same[i + 1][2] if i + 1 < len(same) else None)
            n += r[5]
            held = [x if x is not None else y for x, y in zip(r[3:5], held, strict=True)]
            kept = [x if x is not None else y for x, y in zip(r[3:5], [None, None] if r[5] else kept, strict=True)]
            count[r[0]], last[r[0]], since[r[0]] = n, tuple(held), tuple(kept)
    got = lambda df, *cols: {r[0]: (r[1] if len(cols) == 1 else tuple(r)[1:]) for r in df.select("event_id", *cols).collect()}
    out = scans.neighbours(df, ("k",), before={"pv": "v", "pt": "ts_ms"}, after={"nt": "ts_ms"}, width_ms=width)
    assert set(out.columns) == {*df.columns, "pv", "pt", "nt"}
    assert got(out, "pv", "pt", "nt") == near
    assert got(scans.running_count(df, ("k",), F.col("hit"), "n", width_ms=width), "n") == count
    assert got(scans.last_known(df, ("k",), {"v": "v", "w": "u"}, width_ms=width), "v", "w") == last
    out = scans.last_known(df, ("k",), {"v": "v", "u": "u"}, F.col("hit"), width_ms=width)
    assert out.columns == df.columns and got(out, "v", "u") == since


def test_upper_middle(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.randrange(10), rng.randrange(10**9), None])) for k in ("a", "b", None) for _ in range(rng.randrange(1, 80))]
    want = {}
    for k in ("a", "b", None):
        xs = sorted(x for j, x in rows if j == k and x is not None)
        if xs:
            want[k] = xs[len(xs) // 2]
    df = spark.createDataFrame([*rows, ("none", None)], "k string, x long")
    assert {r.k: r.m for r in scans.upper_middle(df, ("k",), "x", "m").collect()} == want


def test_no_window_over_a_whole_key(spark):
    """Windows by key alone stand on aggregates; a window over rows is cut by the bucket, whose largest has a day of rows."""
    df = spark.createDataFrame(table(), SCHEMA)
    outs = [
        scans.neighbours(df, ("k",), before={"p": "v"}), scans.running_count(df, ("k",), F.col("hit"), "n"),
        scans.last_known(df, ("k",), {"w": "v"}, F.col("hit")),
    ]
    for out in outs:
        plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i, line in enumerate(plan):
            if re.search(r"\bWindow \[", line) and "_b#" not in re.search(r"windowspecdefinition\((.*?)(?: ASC|$)", line)[1].rsplit(",", 1)[0]:
                below = next(x for x in plan[i + 1 :] if not re.search(r"Project|Window", x))
                assert "Aggregate" in below and depth(below) > depth(line)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scans.neighbours(df, ("k",), before={"p": "v"}).count() == scans.running_count(df, ("k",), F.col("hit"), "n").count() == scans.last_known(df, ("k",), {"w": "v"}).count() == 0
