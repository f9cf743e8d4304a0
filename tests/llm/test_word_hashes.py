"""Hashes of words: long words of two letters whose polynomials agree modulo powers of two have hashes of their own."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from proofmill.llm import decontaminate
from proofmill.llm.common import PRIMES, hashed_words, prime_powers
from proofmill.llm.ngram_join import jaccard_classes


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1_024, 2_048, 4_096])
def test_complements_have_different_hashes(n):
    words = [thue_morse(n, x, y) for x in "abz" for y in "abz" if x != y]
    found = [int(h[0]) for _, h in hashed_words(pa.array(words))]
    assert len(set(found)) == len(words)


def test_hashes_are_those_of_a_plain_sum():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abc\u00e9", k=rnd.randint(1, 40))) for _ in range(200)]
    found = next(hashed_words(pa.array([" ".join(words)])))[1]
    apart = [next(hashed_words(pa.array([w])))[1][0] for w in words]
    assert found.tolist() == apart and len(set(apart)) == len(set(words))
    for (up, down), prime in zip(prime_powers(100), PRIMES, strict=True):
        assert (up[:100] * down[:100] % prime == 1).all() and up.max() < prime


def test_words_longer_than_a_sum_of_terms():
    long = np.random.default_rng(1).integers(97, 123, 9_000_000, np.uint8).tobytes().decode()
    found = [h.tolist() for _, h in hashed_words(pa.array([long, "x " + long, long[:-1] + "!"]))]
    assert found[0][0] == found[1][1] != found[2][0]


def test_documents_of_such_words_are_not_linked(spark):
    x, y = thue_morse(1_024, "a", "b"), thue_morse(1_024, "b", "a")
    docs = spark.createDataFrame([(1, x), (2, y), (3, x), (4, " ".join([x] * 6)), (5, " ".join([y] * 6))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_classes(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    items = spark.createDataFrame([(1, " ".join([x, "b", "c", "d", "e", "f"]))], "item_id long, text string")
    near = spark.createDataFrame([(i, " ".join([w, "b", "c", "d", "e", "f"])) for i, w in enumerate((x, y))], "doc_id long, text string")
    assert {r.doc_id: r.similarity for r in decontaminate.benchmark_matches(near, items, threshold=0.75).collect()} == {0: 1.0}
