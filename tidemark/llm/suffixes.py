"""Language-model scoring by a probabilistic suffix tree over words."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import cut, drop_cut, fold, release, shared_dir, ship


@dataclass(frozen=True)
class Tree:
    """What shapes the tree, and the sizes of its parts."""

    depth: int = 2  # words of the longest context
    least: int = 64  # occurrences from which a context is a candidate
    gain: float = 10.0  # nats by which a context must predict better than its suffix, each occurrence left out in turn
    discount: float = 0.75  # taken off each count of a state and given to its suffix
    hot: int = 4_000_000  # contexts of more occurrences are split by the symbol that follows
    chunk_tokens: int = 1_000_000  # tokens that a task encodes with one vocabulary

    def sections(self, n: np.ndarray) -> np.ndarray:
        """Into how many sections a context of n occurrences is split."""
        return np.maximum(1, -(-n // self.hot))


#: About so many words of all chunks, and contexts of so many tokens, are counted at once.
PART_WORDS, PART_TOKENS = 250_000, 2_000_000
#: A test takes log probabilities under the suffix in so many steps a nat.
STEPS = 1024
#: Parts of the words that 16 bits of a hash can tell apart.
MOST_PARTS = 1 << 16


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of an array as binary values."""
    ends = pa.py_buffer((starts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each value holds."""
    one = column.combine_chunks()
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    ends = np.frombuffer(one.buffers()[1], np.int32)[one.offset : one.offset + len(one) + 1] if len(one) else np.zeros(1, np.int32)
    data = np.frombuffer(one.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return data.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _short(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of numbers from 0 on as binary values, seven bits a byte; the eighth says that the number goes on."""
    x = values.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, -(-int(x.max(initial=0)).bit_length() // 7)):
        size += x >= np.uint64(1 << 7 * k)
    ends = _starts(size)
    out = np.empty(ends[-1], np.uint8)
    for k in range(size.max(initial=0)):
        mine = np.nonzero(size > k)[0]
        out[ends[mine] + k] = (x[mine] >> np.uint64(7 * k) & np.uint64(127)) | np.where(size[mine] > k + 1, 128, 0).astype(np.uint64)
    return _packed(out, ends[starts])


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of :func:`_short`, and how many each value holds."""
    data, sizes = _flat(column, np.uint8)
    last = data < 128
    ends = np.nonzero(last)[0] + 1
    first = np.append(0, ends[:-1]) if len(ends) else ends
    length = ends - first
    out = (data[first] & 127).astype(np.int64)
    for k in range(1, length.max(initial=0)):
        mine = np.nonzero(length > k)[0]
        out[mine] |= (data[first[mine] + k] & 127).astype(np.int64) << 7 * k
    of = _starts(last)[_starts(sizes)]
    return out, np.diff(of)


def _zipped(column: pa.Array) -> pa.Array:
    """Binary values, each compressed by itself."""
    codec = pa.Codec("zstd", 3)
    return pa.array([None if x is None else len(x).to_bytes(4, "little") + codec.compress(x, asbytes=True) if x else b"" for x in column.to_pylist()], pa.binary())


def _plain(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """What :func:`_zipped` was given."""
    codec = pa.Codec("zstd")
    return pa.chunked_array([pa.array([codec.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True) if x else x for x in column.to_pylist()], pa.binary())])


def _steps(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What each number adds to the one before it; where ``new``, the number itself."""
    out = values.copy()
    out[1:] -= np.where(new[1:], 0, values[:-1])
    return out


def _sums(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers whose :func:`_steps` these are, in runs that start anew."""
    total = np.cumsum(steps)
    sizes = np.diff(starts)
    return total - np.repeat(_starts(steps)[starts[:-1]], sizes)


_ENCODED = "chunk long, doc_id {}, held_out boolean, ids binary, places binary, hashes binary, learned binary"


def _encode(chunk_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of a vocabulary of their chunk, a row each, and two rows of its words: the first 16 bits of their hashes; hashes and training counts."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[pa.Array, np.ndarray]] = []  # ids and folds
    codes: list[np.ndarray] = []
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__

    def give() -> pa.RecordBatch:
        sizes, flat = np.array([len(c) for c in codes]), np.concatenate(codes)
        ids, out = pa.concat_arrays([x for x, _ in held]), np.concatenate([x for _, x in held])
        seen = np.bincount(flat[np.repeat(~out, sizes)], minlength=len(known)).astype(np.int64)
        hashes = np.fromiter(map(xxh64_intdigest, known), np.uint64, len(known))
        n = len(ids)
        whole = np.array([0, len(known)])
        fill = lambda before, value, after: pa.concat_arrays([pa.nulls(before, value.type), value, pa.nulls(after, value.type)])
        places = (hashes >> np.uint64(48)).astype(np.uint16)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 2, (part << 24) + number)), fill(0, ids, 2), fill(0, pa.array(out), 2), fill(0, _short(flat, _starts(sizes)), 2),
                fill(n, _packed(places, whole), 1), fill(n + 1, _packed(hashes, whole), 0), fill(n + 1, _short(seen, whole), 0),
            ],
            names=["chunk", "doc_id", "held_out", "ids", "places", "hashes", "learned"],
        )

    total = 0
    for batch in batches:
        start = 0
        for row, text in enumerate(batch.column(2).to_pylist()):
            words = text.lower().split()  # bytes: A-Z and ASCII blanks alone
            words.append(b"")  # the end; no word is empty
            codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            total += len(words)
            if total >= chunk_tokens or row == batch.num_rows - 1:
                held.append((batch.column(0).slice(start, row + 1 - start), batch.column(1).slice(start, row + 1 - start).to_numpy(zero_copy_only=False)))
                start = row + 1
            if total >= chunk_tokens:
                yield give()
                held.clear()
                codes.clear()
                known.clear()
                number, total = number + 1, 0
    if codes:
        yield give()


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def _word_part(places: np.ndarray, parts: int) -> np.ndarray:
    """Parts of words by the first 16 bits of their hashes."""
    return places.astype(np.int64) * parts // MOST_PARTS


def _by_part(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's vocabulary cut by hash."""
    for batch in batches:
        for row, (chunk, hashes) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            h, n = np.frombuffer(hashes, np.int64), _numbers(pa.chunked_array([batch.column(2).slice(row, 1)]))[0]
            part = _word_part(h.view(np.uint64) >> np.uint64(48), parts)
            order = np.argsort(part, kind="stable")
            sizes = np.bincount(part, minlength=parts)
            starts = _starts(sizes)
            out = pa.RecordBatch.from_arrays([pa.array(np.full(parts, chunk)), pa.array(np.arange(parts)), _packed(h[order], starts), _zipped(_short(n[order], starts))], names=["chunk", "part", "hashes", "learned"])
            yield out.filter(pa.array(sizes > 0))


def _totals(parts: int, rows: pa.Table) -> pa.Table:
    """Training counts over all chunks and numbers of the words, in each chunk's order, and a row of sums of the part.

    Frequent words have small numbers; no two words share one.
    """
    h, sizes = _flat(rows.column("hashes"), np.int64)
    words, at = np.unique(h, return_inverse=True)
    c = np.bincount(at, weights=_numbers(_plain(rows.column("learned")))[0], minlength=len(words)).astype(np.int64)
    n = len(rows)
    number = np.empty(len(words), np.int64)
    number[np.argsort(-c, kind="stable")] = np.arange(len(words)) * parts + rows.column("part")[0].as_py()
    sums = [c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum(), number.max(initial=0)]
    return pa.table({
        "chunk": pa.array([*rows.column("chunk").to_pylist(), None], pa.int64()), "part": pa.array([*rows.column("part").to_pylist(), None], pa.int64()),
        **{k: pa.concat_arrays([_zipped(_short(x[at], _starts(sizes))), pa.nulls(1, pa.binary())]) for k, x in (("totals", c), ("numbers", number))},
        **{k: pa.array([None] * n + [int(v)], pa.int64()) for k, v in zip(("n", "v", "once", "twice", "most"), sums, strict=True)},
    })


def _by_groups(work, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each part, of rows sorted by part; one that a batch may cut in two waits for the next."""
    waiting: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        part = rows.column("part").to_numpy()
        ends = np.nonzero(part[1:] != part[:-1])[0] + 1
        for start, end in zip(np.append(0, ends)[:-1], ends, strict=True):
            yield from work(rows.slice(start, end - start)).to_batches()
        waiting = rows.slice(ends[-1] if len(ends) else 0)
    if waiting is not None and len(waiting):
        yield from work(waiting).to_batches()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of longer contexts from those of a context and of the word before it."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class Pairs:
    """Distinct (context, next symbol) pairs among positions, in groups by context and section."""

    def __init__(self, key: np.ndarray, symbol: np.ndarray, n: np.ndarray, tree: Tree):
        many = tree.sections(n)
        section = np.where(many > 1, symbol % many, 0)
        order = np.lexsort((symbol, section, key))
        k, s, x = key[order], section[order], symbol[order]
        new_key, new_group, new = (np.ones(len(k), bool) for _ in range(3))
        new_key[1:] = k[1:] != k[:-1]
        new_group[1:] = new_key[1:] | (s[1:] != s[:-1])
        new[1:] = new_group[1:] | (x[1:] != x[:-1])
        self.at = np.empty(len(k), np.int64)  # of each position, its pair
        self.at[order] = np.cumsum(new) - 1
        self.first = order[new]  # a position of each pair
        self.key, self.symbol, self.n = k[new], x[new], n[self.first]
        self.section = s[new]
        self.of_key = np.cumsum(new_key[new]) - 1  # of each pair, its context
        self.keys, self.key_n = self.key[new_key[new]], self.n[new_key[new]]
        # groups: each context has all its sections, also those without a pair here
        sections = tree.sections(self.key_n)
        self.group_of = np.append(0, np.cumsum(sections))
        self.starts = np.append(0, np.cumsum(np.bincount(self.group_of[self.of_key] + self.section, minlength=self.group_of[-1])))


_QUESTION = "chunk long, part long, keys binary, sections binary, ns binary, sizes binary, symbols binary, counts binary, parents binary"
_ANSWER = "chunk long, part long, kinds binary, gains binary, counts binary"


class Layout:
    """How a chunk's groups and pairs are dealt to the parts of the contexts; answers come back in the same order."""

    def __init__(self, pairs: Pairs, parts: int):
        self.owner = np.repeat(np.arange(len(pairs.keys)), np.diff(pairs.group_of))
        self.section = np.arange(pairs.group_of[-1]) - pairs.group_of[self.owner]
        self.sizes = np.diff(pairs.starts)
        part = _part(_mixed(pairs.keys[self.owner], self.section), parts)
        self.groups = np.argsort(part, kind="stable")
        self.pairs = _runs(pairs.starts[self.groups], self.sizes[self.groups])
        self.by_part = _starts(np.bincount(part, minlength=parts))


def _sent_keys(level: int, exact: bool, keys: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of contexts in order: of two words as steps of the later one, each followed by the earlier one; hashes as they are."""
    new = np.zeros(len(keys), bool)
    new[starts[:-1][np.diff(starts) > 0]] = True
    if level == 1:
        return _zipped(_short(_steps(keys, new), starts))
    if level == 2 and exact:
        return _zipped(_short(np.stack([_steps(keys >> 32, new), keys & 0xFFFFFFFF], axis=1).reshape(-1), 2 * starts))
    return _packed(keys, starts)


def _got_keys(level: int, exact: bool, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of a column of :func:`_sent_keys`, and how many each value holds."""
    if level == 1:
        steps, many = _numbers(_plain(column))
        return _sums(steps, _starts(many)), many
    if level == 2 and exact:
        both, many = _numbers(_plain(column))
        return _sums(both[::2], _starts(many // 2)) << 32 | both[1::2], many // 2
    return _flat(column, np.int64)


def _questions(level: int, exact: bool, chunk: int, pairs: Pairs, learned: np.ndarray, parent: np.ndarray, parts: int, tree: Tree) -> pa.Table:
    """A row for each part of the contexts: their symbols here, the training counts and the probabilities under the suffix.

    Symbols are in order, so their steps are sent.  On the first level a
    probability belongs to the symbol alone and is sent once a row.  What a
    context has been seen is the sum of its counts; it is sent only of those split.
    """
    at = Layout(pairs, parts)
    owner, by_part = at.owner[at.groups], at.by_part
    of_groups = _starts(at.sizes[at.groups])
    of_pairs = of_groups[by_part]
    counts = np.bincount(pairs.at, weights=learned, minlength=len(pairs.key)).astype(np.int64)[at.pairs]
    steps = np.maximum(np.round(parent[pairs.first] * STEPS), -32768).astype(np.int16)[at.pairs]
    symbols = pairs.symbol[at.pairs]
    new = np.zeros(len(symbols), bool)
    new[of_groups[:-1][at.sizes[at.groups] > 0]] = True
    split = tree.sections(pairs.key_n[owner]) > 1
    if level == 1:
        first, _ = _per_row(symbols, of_pairs)
        steps = steps[first]
        of_steps = np.searchsorted(first_row := np.repeat(np.arange(parts), np.diff(of_pairs))[first], np.arange(parts + 1))
        new_row = np.ones(len(first), bool)
        new_row[1:] = first_row[1:] != first_row[:-1]
        change = _steps(-steps.astype(np.int64), new_row)
        parents = _short(np.where(change < 0, -2 * change - 1, 2 * change), of_steps)
    else:
        parents = _planes(steps, of_pairs)
    out = pa.table({
        "chunk": np.full(parts, chunk), "part": np.arange(parts), "keys": _sent_keys(level, exact, pairs.keys[owner], by_part), "sections": _zipped(_short(at.section[at.groups], by_part)),
        "ns": _zipped(_short(np.where(split, pairs.key_n[owner], 0), by_part)), "sizes": _zipped(_short(at.sizes[at.groups], by_part)), "symbols": _zipped(_short(_steps(symbols, new), of_pairs)),
        "counts": _zipped(_short(counts, of_pairs)), "parents": _zipped(parents),
    })
    return out.filter(pa.array(np.diff(by_part) > 0))


def _per_row(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the different symbols of each row, in order, a place of each; and of each place, which of them it has."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((symbols, row))
    new = np.ones(len(order), bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (row[order][1:] != row[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _planes(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of 16-bit numbers as binary values, all low bytes before the high ones."""
    low, high = (values.view(np.uint8)[i::2] for i in (0, 1))
    sizes = np.diff(starts)
    out = np.empty(2 * len(values), np.uint8)
    at = np.arange(len(values)) + np.repeat(starts[:-1], sizes)
    out[at], out[at + np.repeat(sizes, sizes)] = low, high
    return _packed(out, 2 * starts)


def _from_planes(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column of :func:`_planes`."""
    data, twice = _flat(column, np.uint8)
    sizes = twice // 2
    at = np.arange(sizes.sum()) + np.repeat(_starts(sizes)[:-1], sizes)
    out = np.empty((len(at), 2), np.uint8)
    out[:, 0], out[:, 1] = data[at], data[at + np.repeat(sizes, sizes)]
    return out.reshape(-1).view(np.int16)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    return np.repeat(starts - _starts(sizes)[:-1], sizes) + np.arange(sizes.sum())


def _answers(tree: Tree, level: int, exact: bool, rows: pa.Table) -> pa.Table:
    """Counts over all chunks for the questions of a part, with the sums that decide whether a context is retained.

    The gain of a context is the sum, over its training occurrences, of the
    log of the smoothed probability of the next symbol with that occurrence
    left out, over that under the suffix.  An answer has, in the order of the
    questions, the number of different symbols of each context (0 if it is not
    retained), the gains of the sections of split ones, and the counts of the
    pairs; a count that neither a retained context nor a longer candidate
    needs is 0.
    """
    key, many = _got_keys(level, exact, rows.column("keys"))
    section, n, sizes, counts = (_numbers(_plain(rows.column(c)))[0] for c in ("sections", "ns", "sizes", "counts"))
    by_row = _starts(many)
    pairs_by_row = _starts(sizes)[by_row]
    symbols = _sums(_numbers(_plain(rows.column("symbols")))[0], _starts(sizes))
    if level == 1:
        change, told = _numbers(_plain(rows.column("parents")))
        change = np.where(change & 1, -(change + 1) // 2, change // 2)
        parents = -_sums(change, _starts(told))[_per_row(symbols, pairs_by_row)[1]]
    else:
        parents = _from_planes(_plain(rows.column("parents")))
    same = np.lexsort((section, key))
    new = np.ones(len(key), bool)
    new[1:] = (key[same][1:] != key[same][:-1]) | (section[same][1:] != section[same][:-1])
    group = np.empty(len(key), np.int64)
    group[same] = np.cumsum(new) - 1
    group_n = n[same][new]
    g = group[np.repeat(np.arange(len(key)), sizes)]
    order = np.lexsort((symbols, g))
    first = np.ones(len(order), bool)
    first[1:] = (symbols[order][1:] != symbols[order][:-1]) | (g[order][1:] != g[order][:-1])
    at = np.nonzero(first)[0]
    total = np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    own, q = g[order][at], np.exp(parents[order][at] / STEPS)
    groups = len(group_n)
    group_n = np.where(group_n > 0, group_n, np.bincount(own, weights=total, minlength=groups))
    sections = tree.sections(group_n)
    kinds = np.bincount(own, weights=total > 0, minlength=groups)
    spare = np.minimum(1.0, tree.discount * kinds * sections / group_n)
    p = np.maximum(total - 1 - tree.discount, 0) / np.maximum(group_n[own] - 1, 1) + spare[own] * q
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.bincount(own, weights=np.where(total > 0, total * (np.log(p) - np.log(q)), 0.0), minlength=groups)
    retained = (gain >= tree.gain) | (sections > 1)
    shown = np.where(retained[own] | (total >= tree.least), total, 0)
    back = np.empty(len(order), np.int64)
    back[order] = shown[np.cumsum(first) - 1]
    row_of = np.repeat(np.arange(len(rows)), many)
    split = (sections > 1)[group]
    return pa.table({
        "chunk": rows.column("chunk"), "part": rows.column("part"), "kinds": _zipped(_short(np.where(retained, kinds, 0)[group], by_row)),
        "gains": _packed(gain[group][split], _starts(np.bincount(row_of[split], minlength=len(rows)))), "counts": _zipped(_short(back, pairs_by_row)),
    })


def _levels(chunk: int, documents: pa.Table, words: pa.Table, totals: pa.Table, parts: int, context_parts: int, answers: pa.Table, level_asked: int, exact: bool, tree: Tree, n: int, v: int, discount: float) -> pa.Table:
    """Questions of a level, or, asked for level 0, the documents' scores once every level is answered.

    All positions of a chunk are worked on at once: the log probability of a
    token under the longest retained suffix so far, its context of the level,
    and the number of times that this context was learned from.  A context is
    the number of a word plus 1 (0 before the text), or two of them if they are
    ``exact``, side by side in 64 bits; longer ones are hashes.
    """
    part = _word_part(_flat(words.column("places"), np.uint16)[0], parts)
    totals = totals.sort_by("part")
    learned, number = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    dealt = np.argsort(part, kind="stable")
    learned[dealt], number[dealt] = (_numbers(_plain(totals.column(c)))[0] for c in ("totals", "numbers"))
    ids, sizes = _numbers(documents.column("ids"))
    c, symbol = learned[ids], number[ids]
    starts = _starts(sizes)[:-1]
    train = np.repeat(~documents.column("held_out").to_numpy(zero_copy_only=False).astype(bool), sizes)
    place_in = np.arange(len(ids)) - np.repeat(starts, sizes)
    texts = c[starts[0] + sizes[0] - 1]  # how often the end was learned from: the number of texts
    root = np.where(c > 0, (c - discount) / max(n, 1), discount * v / n if n else 1.0)
    score = np.log(root)
    key, seen = np.zeros(len(ids), np.int64), c
    for level in range(1, (level_asked or tree.depth) + 1):
        far = np.empty(len(ids), np.int64)  # the word ``level`` places before
        far[level:], far[:level] = symbol[: len(ids) - level] + 1, 0
        far[place_in == level - 1] = 0
        count = np.zeros(len(ids), np.int64)
        if level == 1:
            key = far
            count[1:] = c[:-1]
            count[starts] = texts
        else:
            key = key << 32 | far if level == 2 and exact else _mixed(key, far)
            count[1:] = seen[:-1]
            count[place_in < level - 1] = 0
        at = np.nonzero(count >= tree.least)[0]
        pairs = Pairs(key[at], symbol[at], count[at], tree)
        if level == level_asked:
            return _questions(level, exact, chunk, pairs, train[at], score[at], context_parts, tree)
        mine = answers.filter(pa.array(answers.column("level").to_numpy() == level))
        total, kinds, gain = np.zeros(len(pairs.key), np.int64), np.zeros(len(pairs.keys)), np.full(len(pairs.keys), np.inf)
        seen = np.zeros(len(ids), np.int64)
        if len(mine):
            mine, dealt = mine.sort_by("part"), Layout(pairs, context_parts)
            total[dealt.pairs] = _numbers(_plain(mine.column("counts")))[0]
            owner = dealt.owner[dealt.groups]
            np.add.at(kinds, owner, _numbers(_plain(mine.column("kinds")))[0])
            split = tree.sections(pairs.key_n)[owner] > 1
            gain[owner[split]] = 0
            np.add.at(gain, owner[split], _flat(mine.column("gains"), np.float64)[0])
        seen[at] = total[pairs.at]
        spare = tree.discount * kinds / np.maximum(pairs.key_n, 1)
        use = ((gain >= tree.gain) & (kinds > 0))[pairs.of_key][pairs.at]
        own = np.maximum(total - tree.discount, 0)[pairs.at] / count[at] + spare[pairs.of_key][pairs.at] * np.exp(score[at])
        score[at[use]] = np.log(own[use])
    add = lambda x: np.add.reduceat(x, starts)
    return pa.table({
        "doc_id": documents.column("doc_id"), "held_out": documents.column("held_out"), "n_tokens": sizes.astype(np.int64), "n_known": add((c > 0).astype(np.int64)),
        "base_score": add(np.log10((c + 1) / (n + v + 1))), "score": add(score) / np.log(10),
    })


def suffix_tree_scores(docs: DataFrame, folds: int = 7, held: int = 2, doc_id: str = "doc_id", text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """log10 probabilities of whole texts under a probabilistic suffix tree learned from all texts but those of one fold.

    Symbols are the words of the lower-cased text and one end.  The root's
    distribution is that of the words, discounted in favour of words never
    seen.  A context (the words before, back to the beginning of the text) is
    retained if it was seen ``tree.least`` times and predicts what follows it
    better than its suffix by ``tree.gain`` nats, each occurrence left out in turn;
    its distribution is its own, discounted in favour of its suffix's.  A
    token is scored by the longest retained suffix of what stands before it,
    of up to ``tree.depth`` words.

    The model is nowhere whole.  Tasks encode texts by a vocabulary of their
    chunk and ask for the words' counts; then, level by level, a chunk asks
    once for each of its distinct (context, next word) pairs, the tables' side
    sums the counts of a context over all chunks, tests it and answers.  Rows
    are partial counts of a chunk, never tokens, and a context of more than
    ``tree.hot`` occurrences is split by the next word (its test then estimates the
    discount from the section at hand).  Words are told apart by 64-bit hashes,
    then by numbers, as are contexts of up to two words (up to 2^31 numbers); longer
    contexts by 64-bit hashes.

    Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score), one per row of ``docs``.  A null text counts as empty and is
    scored by its end; a null id is learned from.  Without any training text
    all scores are 0.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"tidemark_{uuid.uuid4().hex}", shared_dir(spark)
    columns = _ENCODED.format(kind) + ", part long, totals binary, numbers binary, kinds binary, gains binary, counts binary, level int, asks boolean"

    def put(df: DataFrame) -> DataFrame:
        """Rows added to a table in the shared folder that is dealt by chunk, so that every round reads it without a shuffle; words that ask lie apart."""
        df = df.withColumn("asks", F.col("hashes").isNotNull() if "hashes" in df.columns else F.lit(False))
        rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in columns.split(", "))])
        rows.write.partitionBy("asks").bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").mode("append").saveAsTable(name)
        return spark.table(name)

    texts = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) == held).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    encoded = put(texts.mapInArrow(partial(_encode, tree.chunk_tokens), _ENCODED.format(kind)))
    local = encoded.where("asks").select("chunk", "hashes", "learned")
    parts = min(MOST_PARTS, max(1, (local.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // (8 * PART_WORDS)))
    asked = local.mapInArrow(partial(_by_part, parts), "chunk long, part long, hashes binary, learned binary").repartition(buckets, "part").sortWithinPartitions("part")
    counted = cut(asked.mapInArrow(partial(_by_groups, partial(_totals, parts)), "chunk long, part long, totals binary, numbers binary, n long, v long, once long, twice long, most long"))
    sums = [F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "n"), (F.sum, "v"), (F.sum, "once"), (F.sum, "twice"), (F.max, "most"))]
    del asked
    release(spark)
    n, v, once, twice, most = counted.where("chunk is null").agg(*sums).first()
    discount = min(max(once / max(once + 2 * twice, 1), 0.01), 0.99)
    context_parts, exact = max(1, n // PART_TOKENS), most < (1 << 31) - 1
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(where, "asks=true"), True)
    spark.catalog.refreshTable(name)
    left = put(counted.where("chunk is not null").repartition(buckets, "chunk"))
    drop_cut(counted)
    release(spark)

    def round_(level: int):
        def run(key: tuple[pa.Scalar, ...], mine: pa.Table) -> pa.Table:
            of = lambda c: mine.filter(mine.column(c).is_valid())
            return _levels(key[0].as_py(), of("ids"), of("places"), of("totals"), parts, context_parts, of("level"), level, exact, tree, n, v, discount)

        return run

    for level in range(1, tree.depth + 1):
        asked = left.drop("hashes", "learned", "asks").groupBy("chunk").applyInArrow(round_(level), _QUESTION)
        given = asked.repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(partial(_by_groups, partial(_answers, tree, level, exact)), _ANSWER).withColumn("level", F.lit(level))
        left = put(given.repartition(buckets, "chunk"))
        del asked, given
        release(spark)
    out = left.drop("hashes", "learned", "asks").groupBy("chunk").applyInArrow(round_(0), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = cut(out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"))
    spark.sql(f"DROP TABLE {name}")
    files.delete(where, True)
    return out
