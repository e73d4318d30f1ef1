"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut, ship

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A task counts up to so many words before it hands them on, and an index holds about so many rows.
FLUSH, SHARD_ROWS = 400_000, 8_000
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def _counts(slip: int):
    """Words of batches of (id, text), counted until a task's dictionary is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = defaultdict(int)
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():  # bytes lower A-Z alone
                    h = zlib.crc32(word.encode(), seed)
                    if slip and h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    seen[word] += n
                if len(seen) >= FLUSH:
                    yield give()
                    seen.clear()
        yield give()

    return run


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip: int = 0) -> DataFrame:
    """(word, n): lower-cased runs of Latin letters of at least five code points seen at least three times.

    With ``slip``, a run whose crc32 with its document's id is divisible by it
    loses a code point first.  A null text has no words, a null id counts as
    empty.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("a"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("b"))
    return rows.mapInArrow(_counts(slip), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class BothWays:
    """A bidirectional FM-index over the text ``$w1$w2$...$`` of distinct words.

    A pattern is held as (lo, rlo, size): its suffix-rank interval in the text
    and that of its mirror in the mirrored text.  Either end can be extended;
    the other interval follows by the number of smaller symbols.
    """

    def __init__(self, distinct: list[str]):
        joined = "\0" + "\0".join(distinct) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.letters, text = np.unique(codes, return_inverse=True)
        self.n, self.starts = len(text), np.nonzero(text == 0)[0]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))[:-1]])
        self.places, *self.ahead = self._tables(text)
        _, *self.behind = self._tables(text[::-1])

    def _tables(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix ranks by doubling; occurrences of each symbol, and of smaller ones, before each rank."""
        rank, k, at = text.astype(np.int64), 1, np.arange(self.n)
        while True:
            found, rank = np.unique(rank * self.n + rank[(at + k) % self.n], return_inverse=True)
            if len(found) == self.n or k > self.n:
                break
            k *= 2
        places = np.empty(self.n, np.int64)
        places[rank] = at
        before = text[places - 1]
        seen = np.zeros((len(self.letters), self.n + 1), np.int32)
        np.cumsum(before[None, :] == np.arange(len(self.letters))[:, None], axis=1, out=seen[:, 1:])
        smaller = np.zeros_like(seen)
        np.cumsum(seen[:-1], axis=0, out=smaller[1:])
        return places, seen, smaller

    def encode(self, word: str) -> np.ndarray:
        return np.searchsorted(self.letters, np.frombuffer(word.encode("utf-32-le"), np.uint32))

    def all(self, n: int) -> np.ndarray:
        return np.array([[0], [0], [self.n]]).repeat(n, axis=1)

    def extend(self, held: np.ndarray, c: np.ndarray, left: bool) -> np.ndarray:
        """The intervals of patterns with symbols ``c`` added at one end."""
        seen, smaller = self.ahead if left else self.behind
        lo, rlo = (held[0], held[1]) if left else (held[1], held[0])
        hi = lo + held[2]
        a, b = seen[c, lo], seen[c, hi]
        near, far = self.first[c] + a, rlo + smaller[c, hi] - smaller[c, lo]
        return np.stack([near, far, b - a] if left else [far, near, b - a])

    def next(self, held: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (symbol, pattern) of letters that can be added at one end."""
        seen, lo = (self.ahead[0], held[0]) if left else (self.behind[0], held[1])
        c, at = np.nonzero(seen[1:, lo + held[2]] > seen[1:, lo])
        return c + 1, at

    def word(self, lo: np.ndarray) -> np.ndarray:
        """Numbers of the words whose leading delimiter has these ranks."""
        return np.searchsorted(self.starts, self.places[lo])


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows side by side, a delimiter (0) after each."""
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), sizes.max(initial=0) + 1), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, sizes


def search(index: BothWays, asked: list[str], side: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (question, word): words that differ from a question by one replaced or one added letter.

    One half of the question is matched exactly: with ``prefix`` its first
    half after a delimiter, with ``suffix`` its second half before one.  From
    there the pattern is extended over the other half, to the right or to the
    left, and one letter may differ or be added on the way.
    """
    codes = [index.encode(w) for w in asked]
    half = [len(w) // 2 for w in asked]
    left = side == "suffix"
    exact, size = _padded([np.append(c[h:], 0) if left else np.append(0, c[:h]) for c, h in zip(codes, half, strict=True)])
    rest, length = _padded([c[:h][::-1] if left else c[h:] for c, h in zip(codes, half, strict=True)])
    who, held = np.arange(len(asked)), index.all(len(asked))
    for s in range(exact.shape[1] - 1):
        now = size > s
        held[:, now] = index.extend(held[:, now], exact[now, s], False)
    off: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(rest.shape[1]):
        live = (held[2] > 0) & (length[who] >= j)
        who, held = who[live], held[:, live]
        c, at = index.next(held, left)
        branch = index.extend(held[:, at], c, left)
        off.append((who[at], branch, np.full(len(at), j)))  # added
        other = (length[who[at]] > j) & (rest[who[at], j] != c)
        off.append((who[at[other]], branch[:, other], np.full(other.sum(), j + 1)))  # replaced
        go = length[who] > j
        who, held = who[go], index.extend(held[:, go], rest[who[go], j], left)
    who, held, at = np.concatenate([o[0] for o in off]), np.concatenate([o[1] for o in off], axis=1), np.concatenate([o[2] for o in off])
    found = []
    while len(who):
        held = index.extend(held, rest[who, at], left)
        live = held[2] > 0
        ends = live & (at == length[who])
        found.append(np.stack([who[ends], index.word(held[0, ends])]))
        live &= ~ends
        who, held, at = who[live], held[:, live], at[live] + 1
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def _near(table: pa.Table) -> pa.Table:
    """Per word of a shard: its near words found here, and the most frequent one."""
    names, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
    n_of = dict(zip(names, counts, strict=True))
    distinct = sorted(n_of)
    index = BothWays(distinct)
    n = np.array([n_of[w] for w in distinct])
    word, other = [], []
    for side in ("prefix", "suffix"):
        asked = [w for w, s, a in zip(names, table.column("side").to_pylist(), table.column("asks").to_pylist(), strict=True) if a and s == side]
        if not asked:
            continue
        who, b = search(index, asked, side)
        if side == "suffix":  # an added letter that leaves both halves is the prefix side's
            new = np.array([not distinct[y].startswith(asked[x][: len(asked[x]) // 2]) for x, y in zip(who, b, strict=True)], bool)
            who, b = who[new], b[new]
        a = np.searchsorted(np.array(distinct, dtype=object), np.array(asked, dtype=object))[who]
        longer = np.array([len(distinct[y]) > len(distinct[x]) for x, y in zip(a, b, strict=True)], bool)
        word += [a, b[longer]]
        other += [b, a[longer]]
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (word, other))
    order = np.lexsort((y, -n[y], x))
    x, y = x[order], y[order]
    own, start, many = np.unique(x, return_index=True, return_counts=True)
    best = y[start]
    return pa.table({"word": pa.array([distinct[i] for i in own], pa.string()), "n_near": many.astype(np.int64), "best_n": n[best].astype(np.int64) if len(own) else np.empty(0, np.int64), "best": pa.array([distinct[i] for i in best], pa.string())})


def variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """Form and root of each word of a vocabulary (word, n) of distinct words of five code points or more.

    Two words are near if they differ by exactly one inserted, deleted or
    replaced code point.  A word's form is its near word of largest n (ties:
    the smallest in code-point order) if that is at least ``ratio`` times its
    own; its root is the last word that forms lead to.

    One half of a word survives an edit of the other, so each word goes to the
    groups of its length and of the length below, once by the half in front
    and once by that behind; near words meet in one of these groups, and only
    the shorter one (or each of two equally long ones) asks.  Groups are dealt
    by hash into shards of bounded size, each with a bidirectional FM-index of
    its words.  A group holds the words of two lengths that share half of
    their letters, so it grows with the language, not with the corpus.

    Rows (word, form, root, n, n_near, form_n).  An empty vocabulary gives no
    rows.
    """
    spark = vocabulary.sparkSession
    ship(spark)
    base = cut(vocabulary.select("word", "n"))
    shards = max(1, ceil(4 * base.count() / SHARD_ROWS))
    group = lambda side, half, less: F.struct(F.lit(side).alias("side"), F.expr(f"length(word) - {less}").alias("length"), F.expr(half.format(f"(length(word) - {less})")).alias("half"), F.lit(not less).alias("asks"))
    ends = [("prefix", "left(word, int(floor({} / 2)))"), ("suffix", "right(word, int(ceil({} / 2)))")]
    dealt = (
        base.select("word", "n", F.explode(F.array(*[group(*end, less) for end in ends for less in (0, 1)])).alias("g"))
        .select("word", "n", "g.*").where(F.col("length") >= LEAST_LENGTH)
        .select("word", "n", "side", "asks", F.pmod(F.xxhash64("side", "length", "half"), F.lit(shards)).alias("shard"))
    )
    found = dealt.groupBy("shard").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("b")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    has = F.col("b").isNotNull() & (-F.col("b.m") >= F.col("n") * ratio)
    formed = cut(
        base.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("b.best")).alias("form"), F.when(has, -F.col("b.m")).alias("form_n")
        )
    )
    roots = cut(formed.where("form is not null").select("word", F.col("form").alias("root")))
    moved = True
    while moved:  # each round doubles the steps; counts double along a chain, so rounds are few
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        drop_cut(roots)
        roots = new
    out = formed.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
