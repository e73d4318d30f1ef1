"""Brute-force and held-out checks of the vector and classifier operators."""

import random

import numpy as np


def test_near_vectors(spark):
    from tidemark.llm import graph

    rng = np.random.default_rng(0)
    base = rng.normal(size=(900, 16))
    vecs = [base, base[:250] + rng.normal(size=(250, 16)) * 0.12, base[:40], np.tile(base[:1], (300, 1)) + rng.normal(size=(300, 16)) * 0.1]
    v = np.concatenate(vecs).astype(np.float32)
    label = [int(x) for x in rng.integers(0, 2, len(v))]
    rows = [(i, [float(x) for x in v[i]], label[i]) for i in range(len(v))]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, rows[0][1], None), (None, rows[0][1], 0)]
    graph_shard, graph.SHARD = graph.SHARD, 300
    try:
        df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
        audits = []
        got = {r.vec_id: r for r in graph.near_vectors(df, report=audits).collect()}
        held, graph.LEAST_RECALL = graph.LEAST_RECALL, 2.0
        wider = []
        some = [(i, rows[i % 350][1] if i < 350 else [x + 0.01 for x in rows[i - 350][1]], 0) for i in range(450)]
        graph.near_vectors(spark.createDataFrame(some, df.schema), report=wider).count()
    finally:
        graph.SHARD, graph.LEAST_RECALL = graph_shard, held
    assert [a[0] for a in wider] == list(graph.OVERLAPS) and audits[-1][1] >= 0.97 * audits[-1][2] > 0
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(hit, False)
    want = hit.sum(1)
    links = np.array([got[i].n_links for i in range(n)])
    assert (links <= want).all()
    assert links.sum() >= 0.97 * want.sum(), (links.sum(), want.sum())
    queries = [i for i in range(0, n, 20)]
    assert links[queries].sum() >= 0.97 * want[queries].sum()
    part = list(range(n))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in zip(*np.nonzero(hit)):
        a, b = root(i), root(j)
        part[max(a, b)] = min(a, b)
    same = sum(got[i].component_id == root(i) for i in range(n))
    assert same >= 0.98 * n
    for i, _, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert graph.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_repeated_vector_ids(spark):
    from tidemark.llm.graph import near_vectors

    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.1]
    rows = [(1, x, 0), (1, y, 0), (2, x, 0), (5, z, 0), (7, [0.0, 0.0, 1.0], 0)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (5, 1, 1, False), (7, 0, 7, True)]


def _texts(n, seed):
    rnd = random.Random(seed)
    syllables = ["an", "er", "tion", "th", "on", "es", "ing", "re"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    return rnd, [" ".join(word() for _ in range(rnd.randint(5, 120))) for _ in range(n)]


def test_toxicity(spark):
    from tidemark.llm.toxicity import toxicity

    rnd, texts = _texts(900, 1)
    rows, labels = [], []
    for i, t in enumerate(texts):
        bad = i % 5 == 0
        if bad:
            words = t.split()
            form = rnd.choice(["idiot", "moron", "Idiot!", "moron."])
            if i >= 600:
                form = rnd.choice(["1d10t", "i d i o t", "m0ron", "idiooot", "m.o.r.o.n", "1d!ot!!"])
            words.insert(rnd.randrange(len(words)), form)
            t = " ".join(words)
        rows.append((i, t, 1))
        if i < 600:
            labels.append((i, 1, int(bad)))
    rows += [(900, None, 1), (901, "", 1), (None, "idiot", 1), (902, "thon " * 20000, 1)]
    got = toxicity(
        spark.createDataFrame(rows, "doc_id long, text string, score int"),
        spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"),
    ).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    hidden = [i for i in range(600, 900) if i % 5 == 0]
    assert sum(by[i].predicted for i in hidden) >= 0.9 * len(hidden)
    assert sum(by[i].predicted for i in range(900) if i % 5) <= 5
    assert by[900].score == by[901].score and by[900].predicted == 0 and by[902].predicted == 0 and by[None].predicted == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def _model(text):
    from tidemark.llm.toxicity import _STATES, _classes

    c = _classes(" " + text + " ")
    counts = np.zeros((_STATES,) * 3)
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    return -np.log((counts + 0.01) / (counts.sum(2, keepdims=True) + 0.5))


def test_decode_prefers_the_language():
    from tidemark.llm.toxicity import decode, restore, restore_word

    model = _model("the idiot and the moron met another idiot here you are an idiot it is a day " * 50)
    assert decode("1d10t", model) == "idiot" and decode("m.0.r.0.n", model) == "moron" and decode("idiiiot", model) == "idiot"
    assert restore_word("worth,", model) == "worth" and restore_word("2024", model) == "2024" and restore_word("", model) == ""
    # whole words of any length, spaces, line feeds, full stops and neighbours of one letter
    assert "idiot" in restore_word("a-" * 40 + "1d10t" + "-a" * 40, model)
    for text in ("id iot", "i\nd\ni\no\nt", "i d i o t.", "a i d i o t", "i d i o t a", "1 d 1 0 t", "x the i.d i.o t here", "y o u a r e a n i d i o t"):
        assert "idiot" in restore(text, model), text
    assert "you are an idiot".split() == decode("you_are_an_idiot", model).split()
    assert restore("it is a day", model) == {"it", "is", "a", "day"}
    long = "1d10t" * 20000
    assert len(restore_word(long, model)) == 5 * 20000


def test_decode_equals_enumeration():
    from itertools import product

    from tidemark.llm import toxicity as tx

    model = _model("the idiot and the moron met another idiot here " * 20)

    def costs(run):
        choices = []
        for s in run:
            own = [("stay", s, 0.0), ("again", "", tx._REPEAT)] if s.isalpha() else [("swap", c, tx._SWAP) for c in tx.LEET.get(s, "")]
            if not s.isalpha():
                drop = tx._JOIN if s == " " else tx._DROP_DIGIT if s.isdigit() else tx._DROP_LEET if s in tx.LEET else tx._DROP
                own += [("drop", "", drop)] + ([("gap", " ", 0.0 if s == " " else drop)] if not s.isdigit() else [])
            choices.append([(s, *o) for o in own])
        best = None
        for path in product(*choices):
            out, cost, ok, c1, c2 = "", 0.0, True, 0, 0
            for s, kind, c, channel in path:
                if kind == "again":
                    ok &= out[-1:] == s
                elif kind == "gap":
                    ok &= out[-1:] not in ("", " ")
                elif kind == "drop" and s == " " and out[-1:] == " ":
                    channel = 0.0
                cost += channel
                if c:
                    k = 0 if c == " " else int(tx._CLASS[ord(c)])
                    cost += model[c1, c2, k]
                    c1, c2, out = c2, k, out + c
            if ok:
                cost += 0.0 if out[-1:] == " " else model[c1, c2, 0]
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, out)
        return best

    for run in ("1d10t", "id iot", "m.0ron", "a $t", "iidd", "t 1 e", "th@.e", ""):
        best = costs(run)
        assert tx.decode(run, model) == best[1], (run, best)


def test_toxicity_without_matching_labels(spark):
    from tidemark.llm.toxicity import drop_toxic, toxicity

    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 6)], "doc_id long, text string, _score int")
    for labels in ([], [(7, 1, 1), (8, 1, 0)], [(1, 1, 1)], [(1, 1, 0), (9, 1, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = toxicity(docs, table).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert drop_toxic(docs, table).columns == docs.columns


def test_quality(spark):
    from tidemark.llm.quality import Net, quality

    rnd, texts = _texts(500, 2)
    rows, labels = [], []
    for i, t in enumerate(texts):
        if i % 3 == 0:
            t = t + " " + rnd.choice(["$$$ %%% ", "BUY!! NOW!! ", "a | b | "]) * rnd.randint(3, 9) + t
        rows.append((i, t))
        labels.append((i, int(i % 3 != 0), 0))
    rows += [(500, None), (501, ""), (502, "é"), (503, "thon " * 30000)]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert len(held) > 50 and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r.score for r in got}
    assert by[500] == by[501]
    net = Net()
    long = "abc DEF!! " * 40000
    a, b = net.pooled(net.tables(), [long, "x"], block=1000), net.pooled(net.tables(), ["x", long])
    assert np.allclose(a[0], b[1]) and np.allclose(a[1], b[0])
    # against a convolution written out
    text = "ab C! é12 x\n"
    raw = text.encode() + b" " * (len(text.encode()) % 2)
    filters = net.own + np.einsum("bk,jkf->jbf", __import__("tidemark.llm.quality", fromlist=["_KIND"])._KIND, net.shared)
    direct = [[sum(filters[j, raw[at + j], f] for j in range(len(filters))) for f in range(filters.shape[2])] for at in range(0, len(raw) - len(filters) + 1, 2)]
    pooled = net.pooled(net.tables(), [text])[0]
    assert np.allclose(pooled, np.max(direct, axis=0), atol=1e-4) or np.allclose(pooled, np.tanh(np.max(direct, axis=0) + net.bias), atol=1e-4)
    again = [(0, texts[0])] * 300 + rows[:20]
    few = quality(spark.createDataFrame(again, "doc_id long, text string"), spark.createDataFrame(labels[:20] * 5, "doc_id long, quality int, toxic int")).collect()
    assert len(few) == 320 and all(0 <= r.score <= 1 for r in few)
    assert quality(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
