"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import spelling as S


def brute_words(docs, slip):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    gap = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            gap[w[:i] + "\0" + w[i + 1 :]].add(w)  # replaced
    near = {w: set() for w in counts}
    for same in gap.values():
        for w in same:
            near[w] |= same - {w}
    for w in counts:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return rows


def edited(word, rng):
    i, c = rng.randrange(len(word) + 1), rng.choice("abzéÿ")
    return rng.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]])


@pytest.mark.parametrize("rows", [8_000, 60])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "SHARD_ROWS", rows)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 12))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababa", "babab", "ababab"]
    docs = []
    for i in range(400):
        text = []
        for _ in range(30):
            w = rng.choice(base[: 1 + int(len(base) * rng.random() ** 2)])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w = edited(w, rng)
            text.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        docs.append((i, rng.choice([" ", ", ", "1", "\n"]).join(text)))
    docs += [(None, "nullid nullid nullid"), (7, None), (8, ""), (9, "x" * 70_000 + " ×÷ÀÀÀ " * 4), *docs[:5]]
    counts = brute_words(docs, 3)
    want = brute(counts)
    assert any(w[2] not in (w[0], w[1]) for w in want) and any(w[1] and len(w[0]) > len(w[1]) for w in want) and any(w[1] and len(w[0]) < len(w[1]) for w in want)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' as word", "1 as n", "'b' as shard")
    assert {tuple(r) for r in S.words(df, slip=3).collect()} == set(counts.items())
    out = S.variants(S.words(df, slip=3))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in out.collect()} == want


def test_index(spark):
    words = sorted({"ab", "aab", "abab", "b", "bb", "éa"})
    index = S.BothWays(words)
    text = "\0" + "\0".join(words) + "\0"
    for pattern in ("a", "ab", "\0ab", "b\0", "bab", "é"):
        want = sum(text.startswith(pattern, i) for i in range(len(text)))
        right = left = index.all(1)
        for c in index.encode(pattern):
            right = index.extend(right, [c], False)
        for c in index.encode(pattern)[::-1]:
            left = index.extend(left, [c], True)
        assert right[2, 0] == want and (right == left).all()  # both intervals, from either end


def test_nothing(spark):
    for rows in ([], [(1, None)], [(1, "a b c")], [(1, "lonely")]):
        assert S.variants(S.words(spark.createDataFrame(rows, "doc_id long, text string"))).count() == 0
    assert [tuple(r) for r in S.variants(S.words(spark.createDataFrame([(1, "words words words")], "doc_id long, text string"))).collect()] == [("words", None, "words", 3, 0, None)]
