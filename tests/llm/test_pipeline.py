"""The pipeline against brute force of its stages, on a small corpus."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from test_dedup import DOCS, corpus, key, line_oracle
from test_shingles import similar_oracle


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rnd = random.Random(9)
    rows = [r for r in corpus(160, 11) if r[0] is not None]
    rows = [(r[0], (r[1] or "") + (" moron idiot" if r[0] % 7 == 0 else ""), r[2], r[3] if r[0] % 2 else rnd.choice("abc"), 1) for r in rows]
    labels = [(r[0], 1, int(r[0] % 7 == 0)) for r in rows]
    d = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def mixing_oracle(rows, alpha=0.7, seed=17, rounds=100):
    """Copies of each row by iterative proportional fitting in plain numbers."""

    def cell(r):
        text = r[1] or ""
        legal, table, markup = "icense" in text or "ights reserved" in text, " | " in text, "$$$" in text or "!!" in text
        return (r[3], r[2], "legal" if legal else "table" if table else "markup" if markup else "prose")

    size = Counter()
    for r in rows:
        size[cell(r)] += max(1, -(-len(r[1] or "") // 4))
    total, weight = sum(size.values()), {c: float(n) for c, n in size.items()}
    for _ in range(rounds):
        for k in range(3):
            seen, held = Counter(), Counter()
            for c, n in size.items():
                seen[c[k]] += n
                held[c[k]] += weight[c]
            norm = sum(n**alpha for n in seen.values())
            weight = {c: w * total * seen[c[k]] ** alpha / norm / held[c[k]] for c, w in weight.items()}
    out = []
    for r in rows:
        w = weight[cell(r)] / size[cell(r)]
        draw = int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{seed}".encode()).hexdigest()[:8], 16) / 2**32
        out.append((int(w) + (draw < w - int(w)), min(abs(draw - w + int(w)), 1.0)))
    return out


def test_stages(spark, sf):
    import corpus_pipeline as cp
    import public_tokenizers
    from tidemark.llm.toxicity import toxicity
    from tokenizers import Tokenizer

    d, rows = sf
    read = lambda: spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    verdict = {r.doc_id: r.predicted for r in toxicity(read(), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    docs = cp.toxicity_stage(spark, read(), d)
    now = [tuple(r) for r in docs.collect()]
    assert key(r[0] for r in now) == key(r[0] for r in rows if not verdict[r[0]])
    assert all(r[0] % 7 for r in now) and sum(r[0] % 7 != 0 for r in rows) - len(now) <= 3
    docs = spark.createDataFrame(now, DOCS)
    out = [tuple(r) for r in cp.line_dedup_stage(spark, docs, d).collect()]
    assert key((r[0], r[1]) for r in out) == key((i, t) for i, t, _, _ in line_oracle(now))
    assert all(r[4] == len(r[1]) for r in out)
    docs = spark.createDataFrame(out, DOCS)
    kept = [tuple(r) for r in cp.simhash_stage(spark, docs, d).collect()]
    assert key(kept) == key(similar_oracle(out))
    docs = spark.createDataFrame(kept, DOCS)
    mixed = [tuple(r) for r in cp.mixing_stage(spark, docs, d).collect()]
    want, sure = Counter(), set()
    for r, (copies, apart) in zip(kept, mixing_oracle(kept), strict=True):
        want[r] += copies
        if apart > 0.01:  # fitting may end a thousandth away from its limit
            sure.add(r)
    got = Counter(mixed)
    assert len(sure) > 0.9 * len(set(kept)) and {r: got[r] for r in sure} == {r: want[r] for r in sure}
    packed = cp.packing_stage(spark, spark.createDataFrame(mixed, DOCS), d).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for r in mixed:
        ids = tok.encode(r[1], add_special_tokens=False).ids + [0]
        pieces.update((r[0], k, tuple(ids[2048 * k : 2048 * k + 2048])) for k in range(-(-len(ids) // 2048)))
    assert pieces == Counter((r.doc_id, r.piece, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in packed)
    whole = cp.run(spark, d)
    assert key(r[:4] for r in map(tuple, whole.select("doc_id", "piece", "start", "length").collect())) == key((r.doc_id, r.piece, r.start, r.length) for r in packed)


def test_empty_and_null_tables(spark, tmp_path):
    import corpus_pipeline as cp

    labels = [(1, 1, 0), (2, 1, 1)]
    for name, rows in (("none", []), ("few", [(1, None, None, None, None), (1, None, None, None, None), (2, "x " * 30000, "en", "s", 3), (None, "", None, "s", 0)])):
        d = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = cp.run(spark, d).collect()
        assert len(got) == 0 if not rows else {r.doc_id for r in got} <= {1, 2, None}
