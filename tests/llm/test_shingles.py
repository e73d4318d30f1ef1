"""The near-copy stage against brute-force Jaccard similarity."""

import random

import pytest

from test_dedup import DOCS, corpus


def shingles(text, words=5):
    t = (text or "").encode().lower().split()
    return {tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} if t else set()


def kept_ids(rows):
    """Smallest ids of the groups that pairs of Jaccard 0.8 or more connect; rows without id left out."""
    rows = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, x) in enumerate(rows):
        for j, y in rows[:n]:
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {root(i) for i in up}


def similar_oracle(rows):
    """The rows that stay, as they are."""
    stay = kept_ids(rows)
    return [r for r in rows if r[0] is None or r[0] in stay]


@pytest.mark.parametrize("group", [6, 60])
def test_stage_finds_near_copies(spark, group):
    import corpus_pipeline as cp
    from tidemark.llm.simhash import keep_one

    rnd = random.Random(7)
    rows = [(r[0], r[1], r[2], r[3], 1) for r in corpus(100, 3) if r[0] is not None and r[0] != 3]
    for base in range(8 if group == 6 else 2):
        words = [f"u{rnd.randrange(5000)}" for _ in range(200)]
        for k in range(group):
            t = list(words)
            for _ in range(rnd.randrange(6)):
                t[rnd.randrange(200)] = f"z{rnd.random()}"
            rows.append((1000 + 100 * base + k, " ".join(t), "en", "s", 1))
    rows += [(5000, None, "en", "s", 1), (5001, " ", "en", "s", 1)]
    df = spark.createDataFrame(rows + [(None, "w1", "en", "s", 1)], DOCS)
    want = kept_ids(rows)
    assert {r.doc_id for r in cp.simhash_stage(spark, df, "").collect()} == want | {None}
    assert {r.doc_id for r in keep_one(df).collect()} != want | {None}
    assert cp.simhash_stage(spark, df.limit(0), "").count() == 0


def test_stage_takes_candidates_by_simhash(spark, monkeypatch):
    """Without the completion most near copies still go, by links of SimHash that are close; the completion gets those links."""
    import corpus_pipeline as cp
    from tidemark.llm import shingles as own

    rnd = random.Random(5)
    rows = []
    for base in range(40):
        words = [f"u{rnd.randrange(5000)}" for _ in range(200)]
        for k in range(3):
            t = list(words)
            for _ in range(2 * k):
                t[rnd.randrange(200)] = f"z{rnd.random()}"
            rows.append((10 * base + k, " ".join(t), "en", "s", 1))
    texts = {r[0]: shingles(r[1]) for r in rows}
    far = lambda a, b: 5 * len(texts[a] & texts[b]) < 4 * len(texts[a] | texts[b])
    df = spark.createDataFrame(rows, DOCS)
    seen = []
    monkeypatch.setattr(own, "completed", lambda links, *_: seen.append([tuple(r) for r in links.collect()]) or links)
    some = {r.doc_id for r in cp.simhash_stage(spark, df, "").collect()}
    assert seen and seen[0] and not any(far(a, b) for a, b in seen[0])
    want = kept_ids(rows)
    assert want <= some and len(rows) - len(some) >= 0.8 * (len(rows) - len(want))
    monkeypatch.undo()
    assert {r.doc_id for r in cp.simhash_stage(spark, df, "").collect()} == want


def test_larger_tables_take_fewer_rows_a_fingerprint(spark, monkeypatch):
    """Above FEW fingerprints the candidates meet by the narrower distance, with no more than 15 rows each, and the result is the same."""
    import corpus_pipeline as cp
    from tidemark.llm import shingles as own
    from tidemark.llm import simhash

    rnd = random.Random(11)
    rows = []
    for base in range(12):
        words = [f"u{rnd.randrange(5000)}" for _ in range(150)]
        for k in range(3):
            t = list(words)
            for _ in range(2 * k):
                t[rnd.randrange(150)] = f"z{rnd.random()}"
            rows.append((10 * base + k, " ".join(t), "en", "s", 1))
    masks, real = [], simhash.block_masks
    monkeypatch.setattr(simhash, "block_masks", lambda *a: masks.append(real(*a)) or masks[-1])
    monkeypatch.setattr(own, "FEW", 10, raising=False)
    got = {r.doc_id for r in cp.simhash_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == kept_ids(rows)
    assert masks and all(len(m) <= 15 and min(x.bit_count() if x >= 0 else (x + (1 << 64)).bit_count() for x in m) >= 20 for m in masks)


def test_sketches_never_part_close_sets():
    """Sets differ in as many hashes as their sketches in bits, or more, whatever their sizes are."""
    import numpy as np
    from tidemark.llm.shingles import differing, sketch

    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 31, 33, 250, 4000):
        for m in (0, 1, n // 5, n):
            x = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
            y = np.unique(np.concatenate((x[m // 2 :], rnd.integers(0, 1 << 64, m, dtype=np.uint64))))
            apart = len(np.setxor1d(x, y))
            assert differing(sketch(x), sketch(y)) == differing(sketch(y), sketch(x)) <= apart
            assert n < 250 or not 0 < m < n or differing(sketch(x), sketch(y)) >= 0.7 * apart


def test_sets_that_are_less_than_close_are_not_fetched(spark, monkeypatch):
    """Texts that have two thirds of their shingles in common meet in every pair, but take neither their sets nor their prefixes with them."""
    import corpus_pipeline as cp
    from tidemark.llm import shingles as own

    rnd = random.Random(2)
    words = [f"u{rnd.randrange(5000)}" for _ in range(200)]
    rows = []
    for k in range(45):
        t = list(words)
        for at in rnd.sample(range(10, 190), 4):
            t[at] = f"z{rnd.random()}"
        rows.append((k, " ".join(t), "en", "s", 1))
    rows += [(100 + k, " ".join(f"v{rnd.randrange(9)}" for _ in range(300)), "en", "s", 1) for k in range(5)]
    fetched, real = [], own._sets
    monkeypatch.setattr(own, "_sets", lambda docs, words: fetched.append(docs.count()) or real(docs, words))
    got = {r.doc_id for r in cp.simhash_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == kept_ids(rows) and len(got) >= 45
    assert sum(fetched) <= 10, fetched


@pytest.mark.parametrize("kind", ["long", "int"])
def test_rows_without_id_take_part(spark, kind):
    """A row without an id goes if its text is close to one with an id, or to another such row that stays."""
    import corpus_pipeline as cp

    rnd = random.Random(4)
    new = lambda: [f"u{rnd.randrange(5000)}" for _ in range(120)]
    near = lambda w: " ".join([*w[:60], f"z{rnd.random()}", *w[61:]])
    a, b, c = new(), new(), new()
    rows = [(i, t, "en", "s", 1) for i, t in [(-4, " ".join(a)), (7, near(a)), (2**31 - 1, " ".join(new())), (9, "")]]
    rows += [(None, t, "en", s, 1) for s, t in [("copy", " ".join(a)), ("near", near(a)), ("empty", None), ("first", " ".join(b)), ("first", " ".join(b)), ("alone", " ".join(c))]]
    df = spark.createDataFrame(rows, DOCS)
    df = df.withColumn("doc_id", df.doc_id.cast(kind))
    got = cp.simhash_stage(spark, df, "")
    assert got.schema == df.schema
    assert sorted((str(r.doc_id), r.source) for r in got.collect()) == sorted([("-4", "s"), (str(2**31 - 1), "s"), ("9", "s"), ("None", "first"), ("None", "alone")])
    alone = cp.simhash_stage(spark, spark.createDataFrame([(None, near(b), "en", "s", 1), (None, near(b), "en", "s", 1), (None, None, None, None, None)], DOCS), "").collect()
    assert len(alone) == 2 and sum(r.text is None for r in alone) == 1
