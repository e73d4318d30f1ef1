"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, labelled_sample, ship

#: Fitting uses at most this many labelled documents of each class, and of a longer text a window of FIT_BYTES characters.
FIT_ROWS, FIT_BYTES = 1200, 32_768
#: A filter sees three byte pairs; the next chunk begins one pair later, so chunks overlap by four bytes.
PAIRS, FILTERS, EPOCHS, BATCH = 3, 16, 24, 48


def _kinds() -> np.ndarray:
    """Coarse kinds of bytes, which the filters share besides the bytes themselves."""
    out = np.zeros((256, 8), np.float32)
    for b in range(256):
        c = chr(b)
        out[b, 0] = "a" <= c <= "z"
        out[b, 1] = "A" <= c <= "Z"
        out[b, 2] = c == " "
        out[b, 3] = c == "\n"
        out[b, 4] = "0" <= c <= "9"
        out[b, 5] = b >= 128
        out[b, 6] = 32 < b < 127 and not c.isalnum()
        out[b, 7] = b < 32 and c != "\n"
    return out


_KIND = _kinds()


def pair_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of all texts in a row, and where each text begins; a text is
    padded with spaces to whole chunks, so every byte lies in a chunk."""
    raw, starts, at = [], [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        b += b" " * max(2 * PAIRS - len(b), len(b) % 2)
        raw.append(b)
        starts.append(at)
        at += len(b) // 2
    two = np.frombuffer(b"".join(raw), np.uint8)
    return two[0::2].astype(np.int32) * 256 + two[1::2], np.array(starts, np.int64)


class Net:
    """Filters over chunks of bytes, their maxima over the text, and a logistic unit."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.shared = rng.normal(0, 0.25, (2 * PAIRS, 8, FILTERS)).astype(np.float32)
        self.own = rng.normal(0, 0.02, (2 * PAIRS, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def tables(self) -> np.ndarray:
        byte = np.einsum("bk,jkf->jbf", _KIND, self.shared) + self.own
        return np.stack([(byte[2 * i][:, None] + byte[2 * i + 1][None]).reshape(65536, FILTERS) for i in range(PAIRS)])

    @staticmethod
    def chunks(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - PAIRS + 1
        out = tables[0].take(codes[:n], axis=0)
        for i in range(1, PAIRS):
            out += tables[i].take(codes[i : n + i], axis=0)
        return out

    def pooled(self, tables, texts: list[str], block: int = 1 << 16) -> np.ndarray:
        """The filters' maxima over each whole text, block by block."""
        codes, starts = pair_codes(texts)
        best = np.full((len(texts), FILTERS), -np.inf, np.float32)
        ends = np.append(starts[1:], len(codes)) - PAIRS + 1  # chunks stay within their text
        for low in range(0, len(codes) - PAIRS + 1, block):
            high = min(low + block, len(codes) - PAIRS + 1)
            act = self.chunks(tables, codes[low : high + PAIRS - 1])
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high)
            for d in range(first, last):
                a, b = max(starts[d], low) - low, min(ends[d], high) - low
                if a < b:
                    np.maximum(best[d], act[a:b].max(0), out=best[d])
        return best

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.tanh(pooled + self.bias) @ self.out + self.base[0]).astype(np.float64)))

    def train(self, texts: list[str], y: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        names = ("shared", "own", "bias", "out", "base")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        order = np.arange(len(texts))
        for epoch in range(EPOCHS):
            rng.shuffle(order)
            rate = 0.03 * (1 - epoch / EPOCHS) + 0.001
            for low in range(0, len(order), BATCH):
                some = order[low : low + BATCH]
                codes, starts = pair_codes([texts[i] for i in some])
                act = self.chunks(self.tables(), codes)
                ends = np.append(starts[1:], len(codes)) - PAIRS + 1
                at = np.stack([a + act[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)])
                h = np.tanh(act[at, np.arange(FILTERS)] + self.bias)
                d = (1 / (1 + np.exp(-(h @ self.out + self.base[0]))) - y[some]) / len(some)
                g = {k: np.zeros_like(getattr(self, k)) for k in names}
                g["out"], g["base"] = h.T @ d + 1e-4 * self.out, np.array([d.sum()], np.float32)
                dh = d[:, None] * self.out * (1 - h * h)
                g["bias"] = dh.sum(0)
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                for i in range(PAIRS):
                    code = codes[at + i]
                    for j, byte in ((2 * i, code >> 8), (2 * i + 1, code & 255)):
                        np.add.at(g["own"][j], (byte, f), dh)
                        g["shared"][j] = _KIND.T @ g["own"][j]
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    change = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - change * (0.2 if k == "own" else 1)).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, where) -> Net:
    """A net from a bounded sample of labelled rows, trained on the driver."""
    sample, _ = labelled_sample(docs, labels, doc_id, text, label, where, {1: FIT_ROWS, 0: FIT_ROWS}, 3)
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - FIT_BYTES, F.lit(0)) + 1).cast("int") + 1
    window = F.substring("text", place, F.lit(FIT_BYTES)).alias("text")
    rows = sample.orderBy("doc_id", "y").select(window, "y").collect()  # 2 * FIT_ROWS rows of FIT_BYTES characters at most
    net = Net()
    y = np.array([r.y for r in rows], np.float32)
    if len(rows) and 0 < y.sum() < len(y):
        net.train([r.text for r in rows], y)
    return net


def quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    folds: int = 5, held_out: int = 0, threshold: float = 0.3,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, over whole texts.

    Labels are learned only from rows outside the held-out fold; null labels
    and ids are not used.  A null or empty text is scored as six spaces.
    Repeated rows are scored each.  Without labels of both classes the net
    stays as drawn.  An empty table gives no rows.
    """
    ship(docs.sparkSession)
    net = fit(docs, labels, doc_id, text, label, fold("doc_id", folds) != held_out)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = net.tables()
        for batch in batches:
            for low in range(0, len(batch), 64):
                some = batch.iloc[low : low + 64]
                pooled = net.pooled(tables, [t or "" for t in some.text])
                yield pd.DataFrame({"doc_id": some.doc_id, "score": net.score(pooled)})

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))
    return scored.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
