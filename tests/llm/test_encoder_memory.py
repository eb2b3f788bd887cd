import tracemalloc

import numpy as np
import pyarrow as pa

from clarispark.llm import packing


def _whole(e, texts):
    return [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def _texts(many, end=""):
    """Texts of 1000 words each that are met once; many of them."""
    letters = "abcdefghijklmnopqrst"
    word = lambda n: "".join(letters[n // 20**k % 20] for k in range(5))
    return [" ".join(word(1000 * t + n) + end for n in range(1000)) for t in range(many)]


def test_full_tables_take_few_bytes_a_word(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 40_000)
    e = packing.Encoder(packing.default_tokenizer())
    texts = _texts(120)
    tracemalloc.start()
    try:
        e.words, e.older = type(e.words)(), type(e.older)()  # inside what is traced
    except TypeError:
        e.words, e.older = packing.Words(40_000), packing.Words(40_000)
    got = [x for at in range(0, 120, 10) for x in e(texts[at : at + 10])]
    held = tracemalloc.get_traced_memory()[0] - sum(map(len, got))
    tracemalloc.stop()
    assert got == _whole(e, texts) and len(e.words) + len(e.older) == 80_000
    assert held < 80_000 * 80


def test_long_words_do_not_fill_the_tables(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 1000)
    e = packing.Encoder(packing.default_tokenizer())
    texts = [*_texts(3), "語" * 3000, *_texts(2, "é" * 700)]
    columns = [pa.array([t]) for t in texts]
    tracemalloc.start()
    got = [e(c)[0] for c in columns]
    held = tracemalloc.get_traced_memory()[0] - sum(map(len, got))
    tracemalloc.stop()
    assert got == _whole(e, texts)
    assert held < 1_000_000


def test_words_of_one_hash_are_told_apart():
    words = ["a", "b", "ab", "ba", "abc", "cab"]
    column, table = packing.Column(words), packing.Words(10)
    column.hashes[:] = 7
    sizes = np.arange(1, 5)
    table.add(column, np.array([0, 2, 3, 5]), np.arange(10, dtype="<u4"), np.cumsum(sizes) - sizes, sizes)
    assert table.find(column, np.arange(6)).tolist() == [0, -1, 1, 2, -1, 3]
    assert [table.ids[s : s + n].tolist() for s, n in zip(*table.place(np.array([1, 3])), strict=True)] == [[1, 2], [6, 7, 8, 9]]
