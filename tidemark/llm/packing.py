"""Best-fit packing of tokenized documents by a configuration linear program."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ship

#: Distinct words that a Python worker remembers with their ids, as written and in lower case; one more, and it begins anew.
WORD_CACHE, CORE_CACHE = 250_000, 300_000
#: Signs after a word that the vocabulary's splitter leaves together; an apostrophe may begin a contraction.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Rounds of multiplicative weights and their step; how close to the best a pattern's worth is; how often the LP of the
#: rest is solved, with half the rounds each time; patterns that leave more of the room free are not rounded to.
ROUNDS, STEP, NEAR, PASSES, WASTE = 30, 0.2, 0.05, 3, 0.002
#: Counts of up to this many (task, length) pairs are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_ODD = "\x1c\x1d\x1e\x1f\x85"
_cores: dict[str, bytes] = {}
_loaded: dict[str, object] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded.clear()
        _words.clear()
        _cores.clear()
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _merge(tokenizer, low: str) -> bytes:
    """Ids of one lower-case run, straight from the vocabulary's merges."""
    spelled = low if low.isascii() else "".join([_LETTER[b] for b in low.encode()])
    ids = _cores[low] = _pack_ids([t.id for t in tokenizer.model.tokenize(spelled)])
    return ids


class _Words(dict):
    """The ids of words between white space, made when one is first looked up:
    letters with signs after them need no more than the merges; all else takes
    the whole way."""

    def __missing__(self, word: str) -> bytes:
        (tokenizer,) = _loaded.values()
        core = word.rstrip(SIGNS)
        low = core.lower()
        if core.isalpha() and low.isalpha() and len(low) == len(core) and (low.isascii() or max(low) < "\u0250"):
            out = _cores.get(low) or _merge(tokenizer, low)
            if len(core) < len(word):
                signs = word[len(core) :]
                out += _cores.get(signs) or _merge(tokenizer, signs)
        else:
            out = _pack_ids(tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = out
        return out


_words = _Words()


def encode_texts(texts: list[str], path: str, by_word: bool = True) -> list[bytes]:
    """Token ids (little-endian unsigned 32-bit) of each whole text, without special tokens.

    ``by_word`` is for lower-case vocabularies that drop white space, where no
    token spans it: each word is encoded once and remembered.  Texts with
    control characters that Python and the tokenizer split differently are
    encoded whole.
    """
    tokenizer = _tokenizer(path)
    if not by_word:
        return [_pack_ids(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    out = []
    for text in texts:
        if any(c in text for c in _ODD):
            out.append(_pack_ids(tokenizer.encode(text, add_special_tokens=False).ids))
            continue
        words = text.split()
        if len(_words) >= WORD_CACHE:
            _words.clear()
        if len(_cores) >= CORE_CACHE:
            _cores.clear()
        out.append(b"".join(map(_words.__getitem__, words)))
    return out


def tokenize(docs: DataFrame, path: str, length: int, end_id: int, doc_id: str, text: str, by_word: bool) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of at most ``length`` tokens.

    ``ids`` are little-endian unsigned 32-bit numbers.  ``part`` and ``rank``
    number the pieces of each length within the task.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            for low in range(0, len(batch), 256):
                some, rows = batch.iloc[low : low + 256], []
                texts = [t or "" for t in some.text]
                for doc, ids in zip(some.doc_id, encode_texts(texts, path, by_word), strict=True):
                    raw = ids + int(end_id).to_bytes(4, "little")
                    for piece in range(-(-len(raw) // (4 * length))):
                        own = raw[4 * length * piece : 4 * length * (piece + 1)]
                        n = len(own) // 4
                        rows.append((doc, piece, piece * length, n, own, part, int(seen[n])))
                        seen[n] += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    pieces = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        run, "doc_id string, piece int, start long, length long, ids binary, part int, rank long"
    )
    return pieces.withColumn("doc_id", F.col("doc_id").cast(kind))


def knapsack(used: np.ndarray, worth: np.ndarray, room: int) -> np.ndarray:
    """The greatest total worth of lengths ``used`` (repeats allowed) that fit each room up to ``room``."""
    best = np.zeros(room + 1)
    ends = np.searchsorted(used, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        e = ends[c]
        best[c] = max(best[c - 1], (worth[:e] + best[c - used[:e]]).max()) if e else best[c - 1]
    return best


def price_pattern(first: int, used: np.ndarray, worth: np.ndarray, best: np.ndarray, want: np.ndarray, slack: float, draws) -> list[int]:
    """A pattern with ``first`` whose worth is within ``slack`` of the best such one.

    It is read off the knapsack's table; of the lengths that keep to the slack
    one is drawn by ``want``, so that equally good patterns share the demand.
    """
    out, space = [first], len(best) - 1 - first
    while space >= used[0]:
        e = int(np.searchsorted(used, space, side="right"))
        loss = best[space] - worth[:e] - best[space - used[:e]]
        open_ = np.cumsum(np.where(loss <= slack + 1e-12, want[:e], 0.0))
        if open_[-1] <= 0:  # the best use leaves a place free
            space -= 1
            continue
        i = int(np.searchsorted(open_, next(draws) * open_[-1], side="right"))
        slack -= max(0.0, float(loss[i]))
        out.append(int(used[i]))
        space -= int(used[i])
    return out


def solve_lp(counts: np.ndarray, room: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[tuple, float], float]:
    """The configuration LP, min sum x_p with every length covered, by multiplicative weights.

    A length's price is its share of the room times its weight.  Each round
    prices the patterns by a knapsack's dynamic program.  Its table gives
    near-best patterns that hold any given length; they get the round's part of
    the volume, dealt by the weighted demand of their lengths.  Lengths that
    this covers better than others lose weight.  Returns the patterns' amounts,
    scaled to the bound, and the lower bound that the prices prove.
    """
    used = np.flatnonzero(counts)
    if not len(used):
        return {}, 0.0
    need, size, weight = counts[used].astype(float), used / room, np.ones(len(used))
    bound = float(need @ size)
    rng = np.random.default_rng(0)
    draws = iter(lambda: rng.random(), None)
    amount: dict[tuple, float] = {}
    covered = np.zeros(len(used))
    for number in range(rounds):
        worth = size * weight
        best = knapsack(used, worth, room)
        bound = max(bound, float(worth @ need / best[room]))
        slack = worth + best[room - used] - (1 - NEAR) * best[room]
        deal = np.where(slack >= 0, need * worth, 0.0)
        deal /= deal.sum()
        gain = np.zeros(len(used))
        want = need * weight
        for i in np.flatnonzero(slack >= 0):
            pattern = price_pattern(int(used[i]), used, worth, best, want, slack[i], draws)
            np.add.at(gain, np.searchsorted(used, pattern), deal[i])
            pattern = tuple(sorted(pattern, reverse=True))
            amount[pattern] = amount.get(pattern, 0.0) + deal[i]
        covered += gain * (need @ size) / need
        ahead = covered / (number + 1) - 1
        weight = np.exp(-step * np.clip(ahead, -1, 4) * (number + 1) ** 0.5)
        weight /= weight.max()
    scale = bound / sum(amount.values())
    return {p: x * scale for p, x in amount.items()}, bound


def plan_sequences(counts: np.ndarray, room: int, rounds: int = ROUNDS) -> tuple[np.ndarray, int, float, int]:
    """Places for all lengths of a histogram: rows (length, first rank, first sequence, offset).

    From its first rank on, the pieces of that length go to successive
    sequences at that offset, until the next row of the length begins.  The
    LP's amounts are rounded along their running sum, fullest patterns first,
    so that the whole times add up to the amounts' sum; a pattern is used as
    often as the counts still allow.  The LP of what is left is solved and
    rounded again, and the rest goes best-fit, pattern by pattern.  Also
    returns the number of sequences, the LP's lower bound, and how many of the
    sequences are whole patterns of an LP.
    """
    left, given = counts.astype(np.int64).copy(), np.zeros(room + 1, np.int64)
    rows, sequences = [], 0

    def use(pattern, times):
        nonlocal sequences
        offset = 0
        for n in pattern:
            rows.append((n, given[n], sequences, offset))
            given[n] += times
            left[n] -= times
            offset += n
        sequences += times

    if left[room]:
        use((room,), int(left[room]))
    bound = None
    for again in range(PASSES):
        amount, own = solve_lp(left, room, max(1, rounds >> again))
        bound = own if bound is None else bound
        sum_, before = 0.0, sequences
        for pattern, x in sorted(amount.items(), key=lambda p: (-sum(p[0]), -p[1], p[0])):
            times = int(sum_ + x) - int(sum_)
            sum_ += x
            if times and sum(pattern) >= (1 - WASTE) * room:
                of, many = np.unique(pattern, return_counts=True)
                times = min(times, int(np.min(left[of] // many)))
                if times:
                    use(pattern, times)
        if sequences == before:
            break
    by_lp = sequences
    while left.any():
        pattern, space = [], room
        spare = left.copy()
        while True:  # the longest piece first, then what fits the rest best
            fits = np.flatnonzero(spare[: space + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            pattern.append(n)
            spare[n] -= 1
            space -= n
        of, many = np.unique(pattern, return_counts=True)
        use(tuple(pattern), int(np.min(left[of] // many)))
    return np.array(rows, np.int64).reshape(-1, 4), sequences, int(counts[room]) + bound, by_lp


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    by_word: bool = True,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Pack whole documents into as few sequences of ``length`` tokens as the LP finds.

    Returns (doc_id, piece, start, length, ids, sequence_id, offset), one row
    per piece; ``ids`` are little-endian unsigned 32-bit.  Every document ends
    with ``end_id``; only longer ones are cut.  A null or empty text is that
    one id.  Repeated rows are packed each; other columns are ignored; an empty
    table gives no rows.

    What the driver holds is the histogram of ``length`` counts and the plan
    made from it, whatever the number of documents.  Ranks within a length are
    a task's own counter plus the counts of the tasks before it, so no length
    is gathered anywhere, however common.
    """
    pieces = cut(tokenize(docs, tokenizer, length, end_id, doc_id, text, by_word))
    sizes = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(length + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``length`` rows
        counts[row.length] = row.n
    plan, *_ = plan_sequences(counts, length, rounds)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    lengths, firsts, sequence, offset = plan[order].T
    starts = (lengths << 48) + firsts  # sorted; every length's first row begins at rank 0
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    base = sizes.select("part", "length", before.alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length_: pd.Series, rank_: pd.Series) -> pd.DataFrame:
        n, rank = length_.to_numpy(), rank_.to_numpy()
        at = np.searchsorted(starts, (n << 48) + rank, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank - firsts[at], "offset": offset[at]})

    few = F.broadcast(base) if sizes.count() <= BROADCAST_ROWS else base
    ranked = pieces.join(few, ["part", "length"])
    placed = ranked.withColumn("_at", place("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "_at.sequence_id", "_at.offset")
