import numpy as np

from clarispark.llm import packing


class Counting:
    """A tokenizer that counts the words it is given."""

    def __init__(self, own):
        self.own, self.seen = own, []

    def encode(self, text, **kw):
        self.seen += text.split()
        return self.own.encode(text, **kw)

    def encode_batch_fast(self, texts, **kw):
        self.seen += " ".join(texts).split()
        return self.own.encode_batch_fast(texts, **kw)


def test_a_word_met_again_is_not_learned_again_when_tables_are_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 60)
    e = packing.Encoder(packing.default_tokenizer())
    plain, e.tokenizer = e.tokenizer, Counting(e.tokenizer)
    texts = [" ".join(["often", "Often,", *(f"w{chr(97 + a)}{chr(97 + b)}x." for b in range(20))]) for a in range(20)]
    got = [e([t])[0] for t in texts]
    assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.tokenizer.seen.count("often") == 1 and len(e.words) + len(e.older) <= 2 * 60 + 2


def test_white_space_of_all_kinds_and_empty_texts():
    e = packing.Encoder(packing.default_tokenizer())
    texts = ["", "  ", "　a b  c\x85", "a\x1cb c", " x\ty\x0bz\n", "boys' it's 12³ab, ², don't!?", "<|endoftext|> 日本", "İstanbul ŉa"]
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e(texts) == want
