"""Toxicity by noisy-channel deobfuscation and a classifier over the restored text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fold, labelled_sample, ship

#: Fitting looks at no more than this many labelled documents of each class.
FIT_TOXIC, FIT_CLEAN = 4000, 8000
#: Features that the classifier may hold, and the evidence (G squared) that each must show.
MAX_FEATURES, MIN_EVIDENCE = 2000, 25.0
#: Restored words that a Python worker remembers, and features that it counts before it sends their counts on.
WORD_CACHE, HELD = 100_000, 200_000

#: What a sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
#: Channel costs: a sign for a letter, a dropped digit, a dropped sign of LEET, another dropped sign, a repeated letter, a dropped space.
_SWAP, _DROP_DIGIT, _DROP_LEET, _DROP, _REPEAT, _JOIN = 1.5, 7.0, 4.0, 1.5, 1.0, 1.5
_STATES = 48
#: Neighbouring words of up to these many signs are decoded together, with the spaces between them.
SHORT = 3
#: Words and runs of up to these many signs are remembered; a word of up to WHOLE letters is a feature as a whole.
CACHED, WHOLE = 64, 32
_EDGE = re.compile(r"^(?:([^\w\s])\1+|[^\w\s@$])+|(?:([^\w\s])\2+|[^\w\s@$])+$")
_ODD = re.compile(r"[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]|(.)\1\1", re.S)
_THRICE = re.compile(r"([^\W\d_])\1\1")
#: Signs that say nothing behind a word.
_ENDS = frozenset(".,;:!?)\"'")


def _class_table() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if "a" <= c <= "z":
            out[cp] = cp - 96
        elif c.isalpha():
            out[cp] = 27 + cp % 21
    return out


_CLASS = _class_table()


def _classes(text: str) -> np.ndarray:
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.where(cps < 1 << 16, cps, 0)].astype(np.int64)


def char_model(docs: DataFrame, text: str) -> np.ndarray:
    """Negative log probabilities of a character after two others, from all texts.

    Every task counts the trigrams of all its texts; the counts are summed by
    trigram, of which there are at most 48 cubed whatever the input.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_STATES**3, np.int64)
        for batch in batches:
            for low in range(0, len(batch), 64):
                c = _classes(" " + "\n".join(t or "" for t in batch.text.iloc[low : low + 64]) + " ")
                total += np.bincount((c[:-2] * _STATES + c[1:-1]) * _STATES + c[2:], minlength=_STATES**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    grams = docs.select(F.col(text).alias("text")).mapInPandas(count, "gram long, n long")
    counts = np.zeros(_STATES**3)
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    counts = counts.reshape((_STATES,) * 3)
    low = counts.sum(0) + 0.5
    low = low / low.sum(1, keepdims=True)
    return -np.log((counts + 20 * low) / (counts.sum(2, keepdims=True) + 20))


def decode(run: str, model: np.ndarray) -> str:
    """The likeliest words behind ``run``, by Viterbi over its character lattice.

    Each sign may stay (letters), stand for letters (LEET), be dropped (signs,
    digits, and letters that repeat the one before) or end a word (signs).  A
    space ends a word or is dropped.  A path costs its channel steps and the
    character model; states are the last letter and the classes of the last two
    characters, with 0 between words.  Time and memory grow with the length.
    """
    paths = {("", 0, 0): (0.0, None)}
    for sign in run:
        new: dict = {}

        def put(state, cost, trace, new=new):
            if state not in new or cost < new[state][0]:
                new[state] = (cost, trace)

        letter, space = sign.isalpha(), sign.isspace()
        options = [(sign, 0.0)] if letter else [(c, _SWAP) for c in LEET.get(sign, "")]
        steps = [(c, channel, int(_CLASS[ord(c)]) if ord(c) < 1 << 16 else 0) for c, channel in options]
        drop = None if letter else _JOIN if space else _DROP_DIGIT if sign.isdigit() else _DROP_LEET if sign in LEET else _DROP
        for (last, a, b), (cost, trace) in paths.items():
            for c, channel, k in steps:
                put((c, b, k), cost + channel + model[a, b, k], (c, trace))
            if letter:
                if sign == last:
                    put((last, a, b), cost + _REPEAT, trace)
                continue
            put((last, a, b), cost + (0.0 if space and last == " " else drop), trace)
            if last not in (" ", "") and not sign.isdigit():
                put((" ", b, 0), cost + (0.0 if space else drop) + model[a, b, 0], (" ", trace))
        paths = new
    ends = ((cost + (model[a, b, 0] if last != " " else 0.0), n, trace) for n, ((last, a, b), (cost, trace)) in enumerate(paths.items()))
    trace, out = min(ends, key=lambda e: e[:2])[2], []
    while trace:
        out.append(trace[0])
        trace = trace[1]
    return "".join(reversed(out))


def restore_word(word: str, model: np.ndarray) -> str:
    """What one lower-case word says; clean words come back without the signs around them."""
    core = _EDGE.sub("", word)
    if core.isalpha() and not _ODD.search(core):
        return core
    if not any(c.isalpha() for c in core):
        return core
    return decode(core, model)


def short_runs(words: list[str]) -> Iterator[str]:
    """Runs of two or more neighbouring words of at most SHORT signs, joined by spaces."""
    run: list[str] = []
    for w in words:
        if len(w) <= SHORT:
            run.append(w)
            continue
        if len(run) > 1:
            yield " ".join(run)
        if run:
            run = []
    if len(run) > 1:
        yield " ".join(run)


def restore(text: str | None, model: np.ndarray, cache: dict | None = None) -> set[str]:
    """The restored words of a whole text: of each word, and of each run of short words decoded with its spaces."""
    cache = {} if cache is None else cache
    low = (text or "").lower()
    words = low.split()
    own_words = set(words)
    out: set[str] = set()
    if not _THRICE.search(low):  # letters with one sign behind them, if any, are what restore_word makes of them
        plain = set(filter(str.isalpha, own_words))
        own_words -= plain
        ended = {w for w in own_words if w[-1] in _ENDS and w[:-1].isalpha()}
        own_words -= ended
        out = plain.union([w[:-1] for w in ended])
    for w in [*own_words, *set(short_runs(words))]:
        own = cache.get(w)
        if own is None:
            own = tuple((decode(w, model) if " " in w else restore_word(w, model)).split())
            if len(w) <= CACHED:
                if len(cache) >= WORD_CACHE:
                    cache.clear()
                cache[w] = own
        out.update(own)
    return out


def _features(word: str) -> list[str]:
    """The word, its first letters, and all its runs of five letters, which cover a word of any length."""
    whole = [word] if len(word) <= WHOLE else []
    return whole + [f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n] + [f"~{word[i : i + 5]}" for i in range(1, len(word) - 4)]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, where) -> dict:
    """Character model from all texts, and a classifier from a bounded sample of labelled rows."""
    ship(docs.sparkSession)
    model = char_model(docs, text)
    sample, sizes = labelled_sample(docs, labels, doc_id, text, label, where, {1: FIT_TOXIC, 0: FIT_CLEAN}, 4)
    base = log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5)) if sizes else -3.0

    def said(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            yield pd.DataFrame({"y": batch.y, "said": [" ".join(sorted(restore(t, model, cache))) for t in batch.text]})

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        frame = lambda: pd.DataFrame([(f, p, n) for f, (p, n) in counts.items()], columns=["f", "p", "n"])
        for batch in batches:
            for t, y in zip(batch.said, batch.y, strict=True):
                for f in {f for w in t.split() for f in _features(w)}:
                    counts.setdefault(f, [0, 0])[1 - y] += 1
                if len(counts) >= HELD:
                    yield frame()
                    counts.clear()
        yield frame()

    found = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = found.get(1, 0), found.get(0, 0)
    if not pos or not neg:
        return {"model": model, "weights": {}, "bias": base}
    sample = cut(sample.mapInPandas(said, "y int, said string"))  # each text is restored once
    p, n = F.col("p"), F.col("n")
    rate = pos / (pos + neg)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    evidence = 2 * (part(p, (p + n) * rate) + part(n, (p + n) * (1 - rate)))
    found = (
        sample.mapInPandas(seen, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        .where((p > (p + n) * rate) & (evidence >= MIN_EVIDENCE))
        .orderBy(evidence.desc(), "f").limit(MAX_FEATURES).collect()
    )
    names = [r.f for r in found]
    at = {f: i for i, f in enumerate(names)}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [sorted({at[f] for w in t.split() for f in _features(w) if f in at}) for t in batch.said]
            yield pd.DataFrame({"y": batch.y, "own": own})

    rows = sample.mapInPandas(hits, "y int, own array<int>").collect()  # at most FIT_TOXIC + FIT_CLEAN rows
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, r.own] = 1
    y = np.array([r.y for r in rows], np.float32)
    w, b = np.zeros(len(names), np.float32), float(log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    share_of = np.maximum(1.0, x.sum(0))
    for _ in range(300):
        d = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= 2.0 * (x.T @ d / share_of + 0.01 * w)
        w = np.maximum(w, 0)
        b -= 0.5 * float(d.mean())
    b += log(((sizes[1] + 0.5) / (sizes[0] + 0.5)) / (pos / neg))  # the classes' true shares, where the sample has others
    return {"model": model, "weights": {f: float(v) for f, v in zip(names, w, strict=True) if v > 0.05}, "bias": b}


def scorer(fitted: dict):
    """A column function from whole texts to scores; an empty text has the bias alone."""
    model, weights, bias = fitted["model"], fitted["weights"], fitted["bias"]

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache, useful = {}, {}
        for batch in texts:
            out = []
            for t in batch:
                own: set = set()
                for w in restore(t, model, cache):
                    f = useful.get(w)
                    if f is None:
                        f = tuple(g for g in _features(w) if g in weights)
                        if len(w) <= CACHED:
                            if len(useful) >= WORD_CACHE:
                                useful.clear()
                            useful[w] = f
                    if f:
                        own.update(f)
                out.append(1 / (1 + np.exp(-(bias + sum(weights[g] for g in sorted(own))))))
            yield pd.Series(np.array(out, float))

    return score


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    folds: int = 4, held_out: int = 2, threshold: float = 0.3,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels are learned only from rows outside the held-out fold; null labels
    and ids are not used.  Null and empty texts get the score of no evidence.
    Repeated rows are scored each; of texts that share a labelled id the
    smallest is learned from.  Where labels or the labelled documents lack a
    class, the score is the labels' base rate (without labels, a low constant).
    An empty table gives no rows.
    """
    fitted = fit(docs, labels, doc_id, text, label, fold("doc_id", folds) != held_out)
    scored = docs.select(F.col(doc_id).alias("doc_id"), scorer(fitted)(F.col(text)).alias("score"))
    return scored.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    folds: int = 4, held_out: int = 2, threshold: float = 0.3,
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; learned as in :func:`toxicity`."""
    fitted = fit(docs, labels, doc_id, text, label, fold("doc_id", folds) != held_out)
    return docs.where(scorer(fitted)(F.col(text)) < threshold)
