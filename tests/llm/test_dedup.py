"""Brute-force checks of the deduplication, archive and licence operators."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "Éa", "a"]
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choices(words, k=rnd.randint(1, 14))) for _ in range(rnd.randint(1, 4))]
        if rows and rnd.random() < 0.5:
            old = rnd.choice(rows)[1] or ""
            part = old.split("\n")
            some = rnd.choice(part).split(" ")
            some[rnd.randrange(len(some))] = "edit"
            lines.append(rnd.choice([" ".join(some), rnd.choice(part)]))
            if rnd.random() < 0.3:
                lines = part
        rows.append((i, "\n".join(lines), "en", "s", 1))
    rows += [(n, None, None, None, None), (n + 1, "", "en", None, 0), (None, "w1 w2 w3", "en", "s", 8), (3, rows[3][1], "en", "s", 1)]
    rows += [(n + 2, "one two three four five\n\none two three four five", "en", "s", 1), (n + 3, "x " * 20000 + "end", "en", "s", 1)]
    return rows


def line_oracle(rows):
    full = {(-1 if r[0] is None else r[0], r[1] or "") for r in rows}
    lines = []
    for doc, text in full:
        for k, line in enumerate(text.split("\n")):
            lines.append((doc, text, k, frozenset(line.lower().split())))
    lines.sort(key=lambda x: (x[0], x[2]))
    gone = set()
    for i, (doc, text, k, s) in enumerate(lines):
        for d2, t2, k2, s2 in lines[:i]:
            if s and (d2, k2) < (doc, k) and 5 * len(s & s2) >= 4 * len(s | s2):
                gone.add((doc, text, k))
                break
    out = []
    for r in rows:
        text = r[1] or ""
        parts = text.split("\n")
        left = [p for k, p in enumerate(parts) if (-1 if r[0] is None else r[0], text, k) not in gone]
        out.append((r[0], "\n".join(left), len(parts), len(parts) - len(left)))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_line_dedup(spark):
    from tidemark.llm.lines import line_dedup

    rows = corpus()
    got = line_dedup(spark.createDataFrame(rows, DOCS)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert key(map(tuple, got)) == key(line_oracle(rows))
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0
    extra = spark.createDataFrame([(1, "a b\na b", "x", 3, 4, "p", 9)], "doc_id long, text string, line string, _n int, _id2 int, _parts string, n_lines int")
    out = line_dedup(extra)
    assert out.columns == ["doc_id", "text", "line", "_n", "_id2", "_parts", "n_lines", "n_removed"]
    assert out.first() == (1, "a b", "x", 3, 4, "p", 2, 1)


def test_line_dedup_long_lines(spark):
    from tidemark.llm.lines import line_dedup

    rnd = random.Random(8)
    rows = []
    for i in range(60):
        size = rnd.choice([30, 47, 49, 60, 110, 113, 130, 300])
        words = [f"u{rnd.randrange(4000)}" for _ in range(size)]
        rows.append((3 * i, " ".join(words), "en", "s", 1))
        for j in (1, 2):
            edit = list(words)
            for _ in range(int(size * rnd.choice([0.02, 0.09, 0.11, 0.12, 0.2]))):
                edit[rnd.randrange(size)] = f"v{rnd.randrange(10**6)}"
            edit += [f"t{k}" for k in range(rnd.choice([0, 0, 2, size // 6]))]
            rows.append((3 * i + j, " ".join(edit), "en", "s", 1))
    got = line_dedup(spark.createDataFrame(rows, DOCS)).select("doc_id", "text", "n_lines", "n_removed").collect()
    want = line_oracle(rows)
    assert key(map(tuple, got)) == key(want) and 30 < sum(r[3] for r in want) < 110


def simhash_oracle(rows, words=4, distance=4):
    fps = []
    for _, text, *_ in rows:
        t = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sh = [" ".join(t[i : i + words]) for i in range(max(1, len(t) - words + 1))] if t else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                part[root(i)] = root(j)
    comp = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            comp[root(i)] = min(comp.get(root(i), r[0]), r[0])
    return [(r[0], f"{fps[i]:016x}", comp.get(root(i))) for i, r in enumerate(rows)]


def test_simhash(spark):
    from pyspark.sql import functions as F
    from tidemark.llm.simhash import keep_one, simhash_components

    rnd = random.Random(1)
    rows = [r for r in corpus(150) if r[0] is not None]
    base = [f"v{rnd.randrange(999)}" for _ in range(300)]
    for i in range(60):
        t = list(base)
        t[rnd.randrange(300)] = f"z{i}"
        rows.append((1000 + i, " ".join(t), "en", "s", 1))
    df = spark.createDataFrame(rows, DOCS)
    got = simhash_components(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    want = simhash_oracle(rows)
    assert key(map(tuple, got)) == key(want)
    assert len({c for _, _, c in want}) < len(rows) - 30
    assert keep_one(df, words=4).select("doc_id").distinct().count() == len({c for _, _, c in want})
    assert simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash_components(spark.createDataFrame([(None, "a")], "doc_id long, text string")).first()["component_id"] is None


def test_close_links_large_bucket(spark):
    from tidemark.llm.components import connected_components
    from tidemark.llm.simhash import close_links

    rnd = random.Random(2)
    fps = {rnd.getrandbits(63) for _ in range(50)}
    chain = rnd.getrandbits(62)
    for i in range(300):
        fps.add(chain ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60)))
    fps = sorted(fps)
    df = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, node long")
    got = connected_components(close_links(df, direct=4, tile=40))
    part = list(range(len(fps)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root(i) != root(j):
                part[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in range(len(fps))}
    seen = {r.node: r.component for r in got.collect()}
    assert {i: seen.get(i, i) for i in want} == want


def test_radix(spark):
    from tidemark.llm.radix import radix_dedup

    rows = corpus() + [(5000, "p" * 70000 + "a", "", "", 1), (5001, "p" * 70000 + "b", "", "", 1), (5002, "p" * 70000 + "a", "", "", 1)]
    got = radix_dedup(spark.createDataFrame(rows, DOCS)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g.text_sha256, []).append(g)
    for text, ids in groups.items():
        mine = by[hashlib.sha256(text.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert {(m.keep_id, m.group_size) for m in mine} == {(best, len(ids))}
        assert [m.doc_id for m in mine if m.kept] == [best]
    assert radix_dedup(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, size int, grp string")
    assert {(r.doc_id, r.kept) for r in radix_dedup(clash).collect()} == {(1, False), (2, True)}


def test_warc_salvage():
    from tidemark.llm.warc import encode_record, salvage

    records = [encode_record(i, f"page {i} ".encode() * 50, hashlib.sha256(f"page {i} ".encode() * 50).hexdigest(), "response", None) for i in range(6)]

    def gz(b):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(b) + z.flush()

    members = [gz(r) for r in records]
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    data = b"junk" + members[0] + members[1] + bytes(broken) + members[3] + records[4] + records[5][:-9]
    rows = list(salvage(data))
    assert [r["page_id"] for r in rows if r["status"] == "ok"] == [0, 1, 3, 4]
    gaps = [(r["position"], r["length"]) for r in rows if r["status"] == "gap"]
    assert gaps[0] == (0, 4) and gaps[1] == (4 + len(members[0]) + len(members[1]), len(broken))
    assert sum(r["length"] for r in rows) == len(data)
    assert list(salvage(b"")) == []
    flipped = bytearray(records[0] + records[1])
    flipped[flipped.index(b"page 0")] ^= 1
    assert [r["page_id"] for r in salvage(bytes(flipped)) if r["status"] == "ok"] == [1]


def test_warc_round_trip(spark):
    from tidemark.llm.warc import warc_round_trip

    rows = [(1, "u", "x" * 200), (2, "u", "x" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "é" * 60), (7, "u", "é" * 60), (2, "u", "WARC/1.1\r\n" * 3000)]
    got = {(r.page_id, r.payload_length, r.payload_digest, r.record_type, r.refers_to) for r in warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = set()
    for p, _, h in rows:
        b = (h or "").encode()
        ids = [q for q, _, g in rows if (g or "").encode() == b and q is not None]
        again = len(b) >= 100 and min(ids) != p
        want.add((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    assert got == want
    assert warc_round_trip(spark.createDataFrame([], "page_id long, html string")).count() == 0


def license_oracle(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    at = {k: [i for i in range(len(w)) if w[i : i + len(p)] == p] for k, p in base.items()}
    every = [i for v in at.values() for i in v]
    return (len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k in at if at[k])))


def test_licenses(spark):
    from tidemark.llm.licenses import TEMPLATES, license_scan

    texts = ["MIT License", "the mit-license, mit license", None, "", "GNU General Public\nLicense and apache LICENSE.", "mit mit license license", "ÉMIT license", "licenſe mit"]
    texts += ["worK mit license", "word " * 5000 + "Released under the MIT License.", "general public", "mit"]
    texts += [f"filler text {t[1].upper()} more" for t in TEMPLATES] + ["This work is licensed under a license, version 3"] + ["filler of the in"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_oracle(t), t
        assert 0 <= r.score <= 1
    for i, t in enumerate(TEMPLATES):
        assert t[0] in got[12 + i].labels.split(","), t
    n = 12 + len(TEMPLATES)
    assert got[n].labels == "" and got[n].score == 0
    # an edited notice without its rarest words, a template that starts before the text, and clashing names
    grant = "Permission is hereby granted, free of charge, to xx xx obtaining a xx"
    more = spark.createDataFrame([(1, grant, 1), (2, "mit license", 2), (3, "released under the mit license " * 300, 3)], "doc_id long, text string, words int")
    own = {r.doc_id: r for r in license_scan(more).collect()}
    assert own[1].labels == "mit-grant" and 0.6 <= own[1].score < 1
    assert own[2].labels == "mit" and own[3].labels == "mit,mit-notice" and own[3].n_base == 300
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("alpha", [0.5, 1.0])
def test_mixing(spark, alpha):
    from tidemark.llm.mixing import mix

    rnd = random.Random(3)
    rows = [(i, "t" * rnd.randint(1, 400), rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", "c"]), 1) for i in range(600)]
    got = mix(spark.createDataFrame(rows, DOCS), alpha=alpha).collect()
    assert len(got) == 600 and all(r.weight > 0 for r in got)
    if alpha == 1.0:
        assert all(abs(r.weight - 1) < 1e-9 and r.copies == 1 for r in got)
    else:
        assert sum(r.copies > 0 for r in got) > 300
        for col in ("source", "lang"):
            mass, seen = {}, {}
            for r in got:
                mass[r[col]] = mass.get(r[col], 0) + r.tokens * r.weight
                seen[r[col]] = seen.get(r[col], 0) + r.tokens
            want = {k: v**alpha for k, v in seen.items()}
            for k in want:
                assert abs(mass[k] / sum(mass.values()) - want[k] / sum(want.values())) < 1e-3
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tidemark.llm.packing import pack
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(4)
    texts = [None, "", "It's Naïve   café <|endoftext|>x\n\t12ab", "a\x1cb\x85c d e　f", "ΑΣ ΟΔΟΣ, İstanbul"]
    texts += [" ".join(f"word{rnd.randrange(300)}," for _ in range(rnd.randint(1, 200))) for _ in range(200)] + ["long text here " * 900]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pack(rows, path, length=512).collect()
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    import numpy as np

    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(docs[i], key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids, t
        assert [r.start for r in mine] == list(range(0, len(ids), 512)) and all(r.length == 512 for r in mine[:-1])
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(seqs) <= 1.02 * sum(r.length for r in got) / 512 + 1
    assert pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_plan_is_near_the_bound():
    import numpy as np
    from tidemark.llm.packing import plan_sequences, solve_lp

    rnd = np.random.default_rng(0)
    sizes = np.minimum(2048, rnd.lognormal(6.3, 0.9, 30000).astype(int) + 1)
    counts = np.bincount(sizes, minlength=2049)
    plan, n, bound, by_lp = plan_sequences(counts, 2048)
    assert bound - 1 <= n <= 1.002 * bound
    assert by_lp - counts[2048] > 0.6 * (n - counts[2048])  # most sequences are whole patterns of an LP
    cover, rest = np.zeros(2049), counts.copy()
    rest[2048] = 0
    amount, own = solve_lp(rest, 2048)
    for pattern, x in amount.items():
        assert sum(pattern) <= 2048
        np.add.at(cover, list(pattern), x)
    assert sum(amount.values()) == pytest.approx(own) and (cover >= 0.8 * rest).all()
    # every piece has its own place, without overlap or gaps
    for count in (counts, np.bincount([5, 5, 7, 2048, 1], minlength=2049), np.zeros(2049, int)):
        plan, n, _, _ = plan_sequences(count, 2048)
        filled = {}
        for length in np.flatnonzero(count):
            own = sorted(map(tuple, plan[plan[:, 0] == length]), key=lambda r: r[1])
            for (_, first, seq, offset), after in zip(own, [r[1] for r in own[1:]] + [count[length]], strict=True):
                for k in range(after - first):
                    filled.setdefault(seq + k, []).append((offset, length))
        assert len(filled) == n
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    heavy = np.bincount(rnd.integers(700, 1100, 5000), minlength=2049)  # only two of these fit a sequence
    assert plan_sequences(heavy, 2048)[1] == 2500


def test_knapsack_by_enumeration():
    import numpy as np
    from tidemark.llm.packing import knapsack, price_pattern

    rnd = np.random.default_rng(1)
    for _ in range(20):
        used = np.sort(rnd.choice(np.arange(1, 15), 4, replace=False))
        worth = rnd.random(4)
        best = knapsack(used, worth, 20)

        def most(space):
            return max([0.0] + [w + most(space - u) for u, w in zip(used.tolist(), worth, strict=True) if u <= space])

        assert best == pytest.approx([most(c) for c in range(21)])
        value = dict(zip(used.tolist(), worth, strict=True))
        for i, first in enumerate(used.tolist()):
            for slack in (0.0, 0.1):
                got = price_pattern(first, used, worth, best, np.ones(4), slack, iter(rnd.random, None))
                assert got[0] == first and sum(got) <= 20
                assert sum(map(value.get, got)) >= worth[i] + best[20 - first] - slack - 1e-9
