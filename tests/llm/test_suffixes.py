"""Suffix-tree scores against a model of plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import suffixes as P


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


class Tree:
    """The same model, with contexts as tuples."""

    def __init__(self, texts, depth, least, gain):
        self.c = Counter(w for t in texts for w in tokens(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        once, twice = (sum(x == k for x in self.c.values()) for k in (1, 2))
        self.d = min(max(once / max(once + 2 * twice, 1), 0.01), 0.99)
        follow, seen = defaultdict(Counter), Counter()
        for t in texts:
            w = [None, *tokens(t)]
            for i in range(1, len(w)):
                for k in range(1, depth + 1):
                    if i - k >= 0:
                        follow[tuple(w[i - k : i])][w[i]] += 1
                        seen[tuple(w[i - k : i])] += 1
        self.states = {}
        for s in sorted(follow, key=len):
            if seen[s] < least:
                continue
            spare = 0.75 * len(follow[s]) / seen[s]
            total = 0.0
            for w, x in follow[s].items():
                q = math.exp(round(math.log(self.p(s[1:], w)) * P.STEPS) / P.STEPS)
                total += x * math.log((max(x - 1 - 0.75, 0) / max(seen[s] - 1, 1) + min(1, spare) * q) / q)
            if total >= gain:
                self.states[s] = (follow[s], seen[s], spare)

    def p(self, context, w):
        for k in range(len(context) + 1):
            s = context[k:]
            if s in self.states:
                follow, n, spare = self.states[s]
                return max(follow[w] - 0.75, 0) / n + spare * self.p(s[1:], w)
        return (self.c[w] - self.d) / self.n if self.c[w] else (self.d * self.v / self.n if self.n else 1.0)

    def score(self, text, depth):
        w = [None, *tokens(text)]
        return sum(math.log10(self.p(tuple(w[max(0, i - depth) : i]), w[i])) for i in range(1, len(w)))


def corpus(seed=2, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(n):
        text, at = [], rng.randrange(40)
        for _ in range(rng.randrange(0, 60)):
            at = rng.choice([(at * 7 + 3) % 40, (at * 7 + 3) % 40, (at + len(text)) % 40, rng.randrange(40)])
            text.append(words[at].upper() if rng.random() < 0.2 else words[at])
        if rng.random() < 0.3:
            text.append(f"rare{i}é")
        docs.append((i, rng.choice([" ", "\n", "\t  ", "\x0b"]).join(text)))
    return [*docs, (7, docs[3][1]), (7, docs[3][1]), (1000, None), (1001, ""), (1002, " \n "), (None, "w1 w2 nullid"), (1003, "É É \x1f x"), (1004, "w3 " * 5000)]


@pytest.mark.parametrize("chunk,hot,depth", [(10**6, 10**6, 3), (700, 10**6, 2), (700, 50, 2)])
def test_equals_plain_model(spark, monkeypatch, chunk, hot, depth):
    if chunk < 1000:  # many parts
        monkeypatch.setattr(P, "PART_TOKENS", 500)
        monkeypatch.setattr(P, "PART_WORDS", 10)
    docs = corpus()
    part = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else 0
    tree = Tree([t for i, t in docs if part(i) != 2], depth, 8, 3.0)
    assert len(tree.states) > 20 and any(len(s) == 2 for s in tree.states)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as chunk", "'a' as word", "2 as n").repartition(3)
    got = P.suffix_tree_scores(df, tree=P.Tree(depth, 8, 3.0, hot=hot, chunk_tokens=chunk)).collect()
    want = []
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((tree.c[x] + 1) / (tree.n + tree.v + 1)) for x in w)
        want.append((i, part(i) == 2, len(w), sum(tree.c[x] > 0 for x in w), tree.n, base, tree.score(t, depth)))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    for a, b in zip(order(map(tuple, got)), order(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        if hot >= 10**6:  # the test of a split context estimates its discount
            assert a[6] == pytest.approx(b[6], rel=1e-6)
        else:
            assert a[6] == pytest.approx(b[6], rel=0.05, abs=0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up(spark):
    docs = corpus()
    tree = Tree([t for _, t in docs], 2, 8, 3.0)
    for s in [(), *list(tree.states)[:10]]:
        assert sum(tree.p(s, w) for w in tree.c) + tree.p(s, "never") == pytest.approx(1)


def test_nothing(spark):
    assert P.suffix_tree_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = P.suffix_tree_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_short_numbers_come_back():
    rng = np.random.default_rng(3)
    values = np.concatenate([np.arange(300), rng.integers(0, 2**62, 50), [127, 128, 16383, 16384, 2**63 - 1, 0]])
    starts = np.array([0, 0, 5, 5, 200, len(values)])
    got, sizes = P._numbers(P._plain(pa.chunked_array([P._zipped(P._short(values, starts))])))
    assert (got == values).all() and (sizes == np.diff(starts)).all()
    small = rng.integers(-32768, 32767, 40).astype(np.int16)
    assert (P._from_planes(pa.chunked_array([P._planes(small, np.array([0, 7, 7, 40]))])) == small).all()
    assert len(P._numbers(pa.chunked_array([P._short(values[:0], np.array([0, 0]))]))[0]) == 0


@pytest.mark.parametrize("level,exact,most", [(1, True, 3.5), (2, True, 5.0), (2, False, 6.0)])
def test_bytes_of_a_question(level, exact, most):
    """A pair took 10 bytes and its share of 20 for a context; symbols of 32 bits could fall together."""
    rng = np.random.default_rng(5)
    symbol = rng.zipf(1.3, 200_000) % 3_000_000
    key = rng.zipf(1.5, len(symbol)) % 2000
    key = key if level == 1 else key << 32 | key * 7 % 5000 if exact else P._mixed(key, key)
    n, tree = np.full(len(symbol), 100), P.Tree()
    pairs = P.Pairs(key, symbol, n, tree)
    parent = -np.log(symbol + 2.0) if level == 1 else -rng.random(len(symbol)) * 12
    asked = P._questions(level, exact, 1, pairs, np.ones(len(symbol), bool), parent, 7, tree)
    told = sum(asked.column(c).nbytes for c in asked.column_names)
    assert told < most * len(pairs.key)
    assert set(P._got_keys(level, exact, asked.column("keys"))[0]) == set(key)
    answer = P._answers(tree, level, exact, asked)
    assert P._numbers(P._plain(answer.column("counts")))[1].sum() == len(pairs.key)
