"""Encoding word by word against the whole tokenizer, with full caches."""

import public_tokenizers
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_once_a_text_when_caches_are_full(monkeypatch):
    from tidemark.llm import packing

    monkeypatch.setattr(packing, "WORD_CACHE", 10)
    packing._tokenizer(PATH)
    seen = []
    real = packing._pack_ids
    monkeypatch.setattr(packing, "_pack_ids", lambda ids: seen.append(1) or real(ids))
    texts = [" ".join(f"w{a}{b}" for a in "abcdef" for b in "uvwxyz"), "later*** latest. " * 500]
    got = packing.encode_texts(texts, PATH)
    assert len(seen) <= 50
    tok = Tokenizer.from_file(PATH)
    assert got == [real(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_with_signs():
    from tidemark.llm import packing

    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    words = [f"{w}{s}{t}" for w in ("Word", "ÀÉß", "Şirket", "", "İx", "K", "don't", "x_y", "a1") for s in signs for t in ("", "'", "s", "***", "_", "1")]
    tok = Tokenizer.from_file(PATH)
    want = [packing._pack_ids(tok.encode(w, add_special_tokens=False).ids) for w in words]
    assert packing.encode_texts(words, PATH) == want
    assert packing.encode_texts([" ".join(words)], PATH) == [b"".join(want)]


def test_known_words_are_only_looked_up(monkeypatch):
    """No set of a text's words is built: words that are known cost one lookup, and only unknown ones are worked on."""
    from tidemark.llm import packing

    packing._tokenizer(PATH)
    first = packing.encode_texts(["known words, known signs."], PATH)
    worked = []
    real = packing._Words.__missing__
    monkeypatch.setattr(packing._Words, "__missing__", lambda self, word: worked.append(word) or real(self, word))
    assert packing.encode_texts(["known words, known signs."], PATH) == first and not worked
    packing.encode_texts(["known zzqx zzqx words, zzqx"], PATH)
    assert worked == ["zzqx"]


def test_odd_blanks_take_the_whole_way():
    from tidemark.llm import packing

    tok = Tokenizer.from_file(PATH)
    texts = [f"one{c}two three" for c in "\x1c\x1d\x1e\x1f\x85\x1b\u2028"]
    assert packing.encode_texts(texts, PATH) == [packing._pack_ids(tok.encode(t, add_special_tokens=False).ids) for t in texts]
