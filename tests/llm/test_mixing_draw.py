"""The mixing draw, copies counted, against its targets."""

import random

import pytest

from test_dedup import DOCS


def rows(n=12000, seed=3):
    rnd = random.Random(seed)
    pick = lambda: (rnd.choice(["en"] * 6 + ["de", None]), rnd.choice("aaaaaabc"))
    return [(i, "t" * rnd.randint(1, 400), *pick(), 1) for i in range(n)]


def shares(got, col, by):
    mass = {}
    for r in got:
        mass[r[col]] = mass.get(r[col], 0) + r.tokens * by(r)
    return {k: v / sum(mass.values()) for k, v in mass.items()}


def test_drawn_tokens_meet_the_targets(spark):
    from tidemark.llm.mixing import mix

    got = mix(spark.createDataFrame(rows(), DOCS), alpha=0.5).collect()
    assert all(int(r.weight) <= r.copies <= int(r.weight) + 1 for r in got)
    assert max(r.copies for r in got) > 1
    for col in ("source", "lang"):
        seen = shares(got, col, lambda r: 1)
        norm = sum(v**0.5 for v in seen.values())
        drawn = shares(got, col, lambda r: r.copies)
        assert all(abs(drawn[k] - seen[k] ** 0.5 / norm) < 0.01 for k in seen)


def test_given_targets_and_topics(spark):
    from tidemark.llm.mixing import mix

    docs = spark.createDataFrame([(*r, "xyz"[r[0] % 3]) for r in rows()], DOCS + ", kind string")
    want = {"source": {"a": 0.2, "b": 0.8, "no row has it": 5.0}, "lang": {"en": 1.0, "de": 1.0, None: 2.0}, "topic": {"x": 0.5, "y": 0.3, "z": 0.2}}
    tables = {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in want.items()}
    got = mix(docs, targets=tables, topics="kind").collect()
    assert len(got) == 12000 and all(r.copies == 0 for r in got if r.source == "c")
    for col, table in want.items():
        table = {k: v for k, v in table.items() if k != "no row has it"}
        expected, drawn = shares(got, col, lambda r: r.weight), shares(got, col, lambda r: r.copies)
        for k, v in table.items():
            assert expected[k] == pytest.approx(v / sum(table.values()), abs=1e-3)
            assert drawn[k] == pytest.approx(v / sum(table.values()), abs=0.03)


def test_names_nulls_and_many_cells(spark):
    from tidemark.llm import mixing

    docs = spark.createDataFrame(
        [(1, "a", None, "~", 5, "mine"), (2, "b", "~", None, 6, None), (None, None, None, None, 7, "")],
        "doc_id long, text string, source string, lang string, _w int, topic string",
    )
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "lang", "_w", "topic", "tokens", "weight", "copies"]
    assert sorted(("-" if r.topic is None else r.topic, r._w) for r in got.collect()) == [("", 7), ("-", 6), ("mine", 5)]
    assert {r["_source"] for r in docs.select(mixing._key(docs.source).alias("_source")).collect()} == {"", "=~"}
    some = spark.createDataFrame(rows(400), DOCS)
    plain = {r.doc_id: r.weight for r in mixing.mix(some, rounds=2).collect()}
    held, mixing.BROADCAST_CELLS = mixing.BROADCAST_CELLS, 0
    blocks, mixing.BLOCKS = mixing.BLOCKS, 1
    try:
        joined = {r.doc_id: r.weight for r in mixing.mix(some, rounds=2).collect()}
    finally:
        mixing.BROADCAST_CELLS, mixing.BLOCKS = held, blocks
    assert joined == pytest.approx(plain, rel=1e-2)
    again = mixing.drawn_rows(mixing.mix(some)).collect()
    copies = {r.doc_id: r.copies for r in mixing.mix(some).collect()}
    assert len(again) == sum(copies.values()) and {r.doc_id for r in again} == {i for i, n in copies.items() if n}
