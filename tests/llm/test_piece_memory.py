"""Bounds on what the piece encoder works out and remembers at once change no result."""

from proofmill.llm import sentencepiece_nbest as nbest
from proofmill.llm.queries import tokenizer_path

TEXTS = ["", "a few words, and a few more", "x" * 300, "日本語の文章" * 20, "a few words again \t  end", "ünï çödé " * 5]


def test_portions_are_bounded_and_whole():
    words = [b"aa", b"b" * 9, b"c", b"d", b"ee", b""]
    assert list(nbest.portions(words, 2, 4)) == [[b"aa"], [b"b" * 9], [b"c", b"d"], [b"ee", b""]]
    assert list(nbest.portions([], 2, 4)) == []


def test_results_do_not_depend_on_the_bounds(monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    wide = nbest.Encoder(path, 4).encode(TEXTS)
    monkeypatch.setattr(nbest, "_BYTES_AT_ONCE", 8)
    monkeypatch.setattr(nbest, "MOST_BYTES", 16)
    narrow = nbest.Encoder(path, 4)
    for text, want in zip(TEXTS, wide, strict=True):
        assert [x for _, x in narrow.encode([text])[0]] == [x for _, x in want]
