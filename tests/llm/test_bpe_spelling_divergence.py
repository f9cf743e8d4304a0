"""Byte-level BPE, spelling variants and source divergence against plain versions, and their results for odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill.llm import byte_bpe, divergence, spelling
from proofmill.llm.queries import queries, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, word string, n int, ids int, term int, c int, b int, value int, rank int"
CLASH = ("clash", *(7,) * 7)
ROWS = [
    (1, None, "aa", "s"), (2, "", "aa", "s"), (3, "  \n\t ", None, None), (4, "Wörter wörter WÖRTER wörtern " * 40, "aa", "s"), (5, "don't 日本語 \U0001f600 \x00 <|endoftext|>  x" * 30, "aa", "t"),
    (6, "repeat receive recieve repeat " * 9, "bb", "s"), (6, "repeat receive recieve repeat " * 9, "bb", "s"), (7, "a" * 30_000 + " " + "ab" * 9_000, "bb", "t"), (None, "no id at all at all", "bb", "u"),
    (9, "wörter repeat ×÷ ÿ " * 200, "cc", None), (10, "wörter repeat", "aa", "t"), (11, "Wörter no " * 6, "aa", "u"), (12, "...", "dd", "only"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(PATH)) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def machine():
    return byte_bpe.Transducer(byte_bpe.read_ranks(PATH))


# ---------------------------------------------------------------- 11


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=40), st.text("aeinrst éß日", min_size=1, max_size=80).map(str.encode)))
def test_transducer_gives_the_library_s_tokens(machine, library, piece):
    assert machine.encode(piece) == library._encode_single_piece(piece)


def test_long_pieces_are_decided_as_they_are_read(machine, library):
    rnd = random.Random(3)
    for piece in (b"a" * 20_000, b"ab" * 9_000, b"=" * 5_000, "".join(rnd.choices("abcdefgh", k=9_000)).encode(), "日本".encode() * 2_000):
        assert machine.encode(piece) == library._encode_single_piece(piece)
    assert machine.lookahead <= 16


def test_transducer_forgets_states_beyond_its_bound(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 50)
    monkeypatch.setattr(byte_bpe, "PAIRS", 50)
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(PATH))
    rnd = random.Random(4)
    for _ in range(60):
        piece = "".join(rnd.choices("abcdeé", k=120)).encode()
        assert machine.encode(piece) == library._encode_single_piece(piece)
        assert len(machine.states) <= 50


def test_rules_without_merges_from_bytes_still_take_whole_tokens():
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abcd", b"ab"]
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    machine = byte_bpe.Transducer(tokens)
    for text in ("abcd", "abcda", "xabcd", "abab", "abc", "bcabcdbc"):
        assert machine.encode(text.encode()) == library.encode_ordinary(text)


def test_texts_below_u0100_are_split_alike():
    any_text, latin_text = byte_bpe.splitters(public_tokenizers.PATTERN)
    assert any_text is not latin_text
    rnd = random.Random(6)
    letters = [chr(c) for c in range(256)] + ["a", " ", "'s", "'ll", "9", "  "] * 20
    for _ in range(1_000):
        text = "".join(rnd.choices(letters, k=40))
        assert any_text(text) == latin_text(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=30), st.integers(1, 5))
def test_streamed_text_is_that_of_all_bytes(data, step):
    tokens = [bytes([b]) for b in range(256)]
    decoder = byte_bpe.Decoder(tokens)
    ids = np.array(data, np.int32)
    text = "".join(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + decoder.close()
    assert text == bytes(data).decode("utf-8", "replace")


def test_byte_bpe_of_documents(odd, none, library):
    decoded = byte_bpe.decode(byte_bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH)
    found = sorted(((r.doc_id or 0, list(r.ids), r.text) for r in decoded.collect()), key=repr)
    assert found == sorted(((i or 0, library.encode_ordinary(t or ""), t or "") for i, t, *_ in ROWS), key=repr)
    assert byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(none, PATH, public_tokenizers.PATTERN), PATH)).collect() == []


def test_byte_bpe_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op11_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# ---------------------------------------------------------------- 12


def near(a: str, b: str) -> bool:
    """Whether one letter put in, left out or replaced makes b of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts: dict[str, int]) -> dict[str, tuple]:
    forms, out = {}, {}
    for w, n in counts.items():
        best = sorted((o for o in counts if near(w, o)), key=lambda o: (-counts[o], o))
        forms[w] = best[0] if best and counts[best[0]] >= 5 * n else None
        out[w] = [forms[w], None, n, len(best), counts[forms[w]] if forms[w] else None]
    for w, row in out.items():
        row[1] = w
        while forms[row[1]]:
            row[1] = forms[row[1]]
    return {w: tuple(row) for w, row in out.items()}


def counted(rows) -> dict[str, int]:
    found = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_spelling_variants_of_odd_documents(odd, none):
    want = grouped(counted(ROWS))
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(odd).collect()}
    assert found == want and len(want) > 4
    assert spelling.spelling_variants(none).collect() == []


@pytest.mark.parametrize("part", [2, 7, 5_000])
def test_near_words_however_parts_are_cut(spark, part):
    rnd = random.Random(part)
    words = {"".join(rnd.choices("abé", k=rnd.randint(6, 9))) for _ in range(300)} | {f"identifier{''.join(rnd.choices('ab', k=4))}" for _ in range(40)} | {"a" * k for k in range(6, 12)}
    rows = spark.createDataFrame([(w, i + 5) for i, w in enumerate(sorted(words))], "word string, n long")
    found = [(r.word, r.other) for r in spelling.near_words(rows, part=part).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in words for b in words if near(a, b)}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", max_size=6), max_size=25))
def test_active_nodes_find_all_pairs(words):
    words = sorted(words)
    found = {(words[i], words[j]) for i, j in spelling.near_pairs(words)}
    assert found == {(a, b) for a in words for b in words if near(a, b)}


def test_roots_follow_forms_to_the_last(spark):
    counts = {"chainaa": 1, "chainab": 5, "chainbb": 25, "chaincb": 125, "chaincc": 625, "equally": 5, "equalla": 25, "equallb": 25}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words, spelling.near_words(words)).collect()}
    assert found == grouped(counts) and found["chainaa"][1] == "chaincc" and found["equally"][0] == "equalla"


# ---------------------------------------------------------------- 13


def diverging(rows, top=200) -> set[tuple]:
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        within, groups = Counter(), {}
        for own, source, terms in docs:
            if own == lang:
                within.update(set(terms))
                groups.setdefault(source, Counter()).update(terms)
        kept = sorted(t for t, n in within.items() if n >= 3)
        v = len(kept)
        ps = {}
        for name, c in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            n = sum(c[t] for t in kept)
            ps[name] = {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + v) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for g in groups:
            pairs = sorted(((-sum(f(ps[g][t], ps[h][t]) for t in kept), h.encode(), h) for h in groups if h != g))
            out |= {(lang, g, "pair", h, -x, i + 1) for i, (x, _, h) in enumerate(pairs)}
            terms = sorted((-f(ps[g][t], ps[None][t]), t.encode(), t) for t in kept if groups[g][t] and ps[g][t] > ps[None][t])
            out |= {(lang, g, "term", t, -x, i + 1) for i, (x, _, t) in enumerate(terms[:top])}
    return out


def rows_of(df) -> list[tuple]:
    return [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]


def test_divergence_of_odd_documents(odd, none):
    found = rows_of(divergence.divergence(odd))
    assert len(found) == len(set(found)) and set(found) == diverging(ROWS)
    assert {r[0] for r in found} == {"aa", "bb"}
    assert divergence.divergence(none).collect() == []


def test_divergence_of_random_counts(spark):
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma", "Ünder", "delta", "eps", "日本"]
    rows = [(i, " ".join(rnd.choices(words, weights=range(1, 8), k=rnd.randint(0, 30))), rnd.choice("xy"), rnd.choice(["p", "q", "r", None])) for i in range(60)]
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], DOCS)
    found = rows_of(divergence.divergence(df, top=2))
    assert set(found) == diverging(rows, top=2) and len(found) == len(set(found))


def test_counts_beyond_64_bits_of_product_are_exact(spark):
    c, n = 40_000_000_000, 90_000_000_001
    got = spark.range(1).select(divergence._p(F.lit(c), F.lit(n), F.lit(7)).alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (c + 1) // (n + 7)
