"""Plain words of a text skip the search for disguises, and all others get it."""

import random

import numpy as np


def test_plain_words_are_taken_as_they_are(monkeypatch):
    from tidemark.llm import toxicity as own

    model = np.random.default_rng(3).random((own._STATES,) * 3)

    def slow(text):
        words = text.lower().split()
        parts = [own.restore_word(w, model) for w in set(words)] + [own.decode(r, model) for r in set(own.short_runs(words))]
        return {w for p in parts for w in p.split()}

    rnd = random.Random(4)
    pieces = ["word", "Été", "ß", "İx", "ab", "a", "x1", "id10t", "!", "!!", "...", ",", '"', "'", ")", "@", "$", "_", "7", "ª", "́", "漢字", "soooo", " "]
    texts = ["".join(rnd.choice([*pieces, " ", " ", "\n"]) for _ in range(30)) for _ in range(400)]
    assert [own.restore(t, model) for t in texts] == [slow(t) for t in texts]
    seen = []
    real = own.restore_word
    monkeypatch.setattr(own, "restore_word", lambda w, m: seen.append(w) or real(w, m))
    assert own.restore("Some words, many words; (and) id1ot!", model) >= {"some", "words", "many"}
    assert sorted(seen) == ["(and)", "id1ot!"]
