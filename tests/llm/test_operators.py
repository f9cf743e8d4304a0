"""The training-data operators against plain versions of them, and their results for odd input."""

from __future__ import annotations

import hashlib
import random
import sys
import textwrap
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from proofmill.llm import chat, decontaminate, langid, licenses, ngram_join, quality, sentencepiece_nbest, suffix_dedup, token_counts, token_output  # noqa: E402
from proofmill.llm.components import components  # noqa: E402
from proofmill.llm.ngram_join import jaccard_classes  # noqa: E402
from proofmill.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, words int, token int, h int, score int, rep int, kind int, window int, spans int, unit int"
CLASH = (7,) * 10


def _texts() -> list[str | None]:
    rnd = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("Lo", "mi", "ta", "ré", "zu", "Kö") for b in ("ra", "n", "s", "dol", "per", "日本")]
    prose = lambda n: " ".join(rnd.choice(vocabulary) + (".\n" if rnd.random() < 0.05 else "") for _ in range(n))
    base = prose(120)
    shared = prose(60)
    near = base.split(" ")
    near[50] = "changed"
    return [
        None, "", "  \n\t ", "one", "two words", "one", "a b c d", "a b c d", base, base, " ".join(near), base + " and a little more", prose(40) + " " + shared + " " + prose(40), prose(30) + " " + shared,
        shared, "x" * 450, "ab" * 300, prose(30_000), "same line\n" * 80, "same line\n" * 80 + "end", "퟿ \U0001f600 ▁mark ▁ \x00 <s> </s>", "#*$%&|<> " * 30, "¿ " * 60 + " 　z", "日本語 テキスト です",
    ]


TEXTS = _texts()
BY_ID = {i + 1: t for i, t in enumerate(TEXTS)}


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, and columns whose names the operators use themselves."""
    langs = ["aa", "bb", None]
    return spark.createDataFrame([(i, t, langs[i % 3], None, None, *CLASH) for i, t in BY_ID.items()], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def with_nulls(spark, odd):
    """odd with a row without doc_id, and with one row repeated."""
    return odd.unionByName(spark.createDataFrame([(None, "no id at all", "aa", None, None, *CLASH)], DOCS)).unionByName(odd.where("doc_id = 9"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# ---------------------------------------------------------------- 1


def test_jaccard_classes(with_nulls, none, sample):
    take = lambda df: {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    want = brute.jaccard(BY_ID)
    found = jaccard_classes(with_nulls).collect()
    assert len(found) == len(want) and {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert jaccard_classes(none).collect() == []
    df, docs = sample
    assert take(jaccard_classes(df)) == brute.jaccard(docs)


def test_jaccard_at_the_threshold(spark):
    words = [f"w{i}" for i in range(400)]
    docs = {1: " ".join(words[:104])}  # 100 shingles
    docs |= {k: " ".join(words[: 104 - k]) for k in range(20, 30)}  # 100 - k of them: linked directly up to 25
    docs |= {100 + k: " ".join(words[200 : 200 + k]) for k in range(3, 9)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df).collect()} == brute.jaccard(docs)
    two = {k: docs[k] for k in (1, 25)}, {k: docs[k] for k in (1, 26)}
    assert [len({r.component_id for r in jaccard_classes(spark.createDataFrame(list(d.items()), "doc_id long, text string")).collect()}) for d in two] == [1, 2]


def test_random_similar_sets_lose_no_link(spark):
    rnd = random.Random(11)
    docs = {}
    for family in range(12):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(rnd.choice((20, 60, 150)))]
        for copy in range(12):
            own = list(base)
            for _ in range(rnd.randrange(5)):
                own[rnd.randrange(len(own))] = f"z{rnd.randrange(9)}"
            docs[family * 100 + copy] = " ".join(own[: len(own) - rnd.randrange(6)])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df).collect()} == brute.jaccard(docs)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, x) for x in range(1001, 1100)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(1000, 1100), 1000)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 12), st.integers(0, 3)), min_size=2, max_size=200), st.sampled_from([50, 75, 90]))
def test_skipped_blocks_hold_no_pairs(entries, pct):
    rows = sorted((n, i, kind, min(place, n - 1)) for i, (n, place, kind) in enumerate(entries))
    n, doc, kind, place = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    fits = lambda p, q: p[2] != q[2] and 100 * max(p[0], q[0]) // pct >= 0 and 100 * min(p[0], q[0]) >= pct * max(p[0], q[0]) and min(p[0] - p[3], q[0] - q[3]) >= ngram_join.need(p[0] + q[0], pct)
    want = {tuple(sorted((p[1], q[1]))) for i, p in enumerate(rows) for q in rows[i + 1 :] if fits(p, q)}
    assert {(int(a), int(b)) for x, y in ngram_join.of_list(doc, kind, n, place, pct) for a, b in zip(x, y, strict=True)} == want


def test_answers_are_derived_from_pivots(spark):
    """Two classes of near copies whose members link crosswise only in part."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(2_000)]
    base = [rnd.choice(words) for _ in range(300)]
    other = base[:262] + [rnd.choice(words) for _ in range(40)]
    docs = {}
    for i in range(60):
        text = list(base if i % 2 else other)
        for _ in range(rnd.randrange(0, 5)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        docs[i + 1] = " ".join(text)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df).collect()} == brute.jaccard(docs)


# ---------------------------------------------------------------- 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.sampled_from([0, 1, 2**59, 2**60 - 1, 2**60, 2**64 - 1]), max_size=700), max_size=4))
def test_simple8b_round_trip(rows):
    sizes = np.array([len(r) for r in rows], np.int64)
    ids = np.array([x for r in rows for x in r], np.uint64)
    starts = token_output.block_starts(sizes)
    words, offsets = token_output.encode(ids, starts)
    assert len(words) <= 2 * len(ids)
    block_sizes = np.diff(np.append(starts, len(ids)))
    assert (token_output.decode(words, offsets, block_sizes) == ids).all()
    for k in range(len(starts)):  # a block by itself
        end = offsets[k + 1] if k + 1 < len(starts) else len(words)
        alone = token_output.decode(words[offsets[k] : end], np.zeros(1, np.int64), block_sizes[k : k + 1])
        assert (alone == ids[starts[k] : starts[k] + block_sizes[k]]).all()


def test_small_ids_pack_into_few_words():
    words, _ = token_output.encode(np.ones(240, np.uint64), np.array([0]))
    assert len(words) == 4


def _digest_wanted(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    at, want = 0, {}
    for d in sorted(docs):
        ids = np.array([*t.encode(docs[d] or "", add_special_tokens=False).ids, 1], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return want


def test_token_digests(odd, with_nulls, none, sample):
    digest = lambda df: token_output.token_digest(token_output.token_table(df, tokenizer_path("word_bpe_49k.json"), 1))
    take = lambda df: {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in digest(df).collect()}
    assert take(odd) == _digest_wanted(BY_ID)
    df, docs = sample
    assert take(df) == _digest_wanted(docs)
    assert digest(with_nulls).count() == len(TEXTS) + 2 and digest(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abZÀéßÿ0 9\n\t'’“…-#<|>.", "'s", "'re", "don't", "'Stone", "\u0301", "İ", "²", "ª", "\xa0", "\x1c", "\x85", "日", "ẞ", "<|endoftext|>", "<|"]), max_size=12).map("".join), max_size=4))
def test_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    if path not in token_output._known:
        token_output._known[path] = token_output.Ids(path)
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, np.uint32).tolist() for x in token_output._known[path].of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizer_files_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(rules))
    other, text = token_output.Ids(str(tmp_path / "other.json")), "A Text that isn't lower case"
    assert not other.by_parts
    assert np.frombuffer(other.of([text])[0], np.uint32).tolist() == Tokenizer.from_file(str(tmp_path / "other.json")).encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- 3


def test_quality_counts_and_ratio(spark, odd, with_nulls, none, sample, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, docs in ((odd, BY_ID), sample):
        for r in quality.quality_verdicts(df, labels).collect():
            assert tuple(r[c] for c in columns) == brute.quality(docs[r.doc_id]), r.doc_id
            assert not (r.base_failed and r.kept) and (r.score is None) == (r.n_words == 0)
    assert quality.quality_verdicts(with_nulls, labels.limit(0)).count() == len(TEXTS) + 2
    assert quality.quality_verdicts(none, labels).count() == 0


def test_ratio_weights_are_those_of_two_multinomials(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words here"), (3, None)], "doc_id long, text string")
    weights = np.array(quality.ratio_weights(docs, spark.createDataFrame([(1,)], "doc_id long")))
    words = spark.createDataFrame([(["good", "words", "here"],), (["bad", "words", "here"],)], "w array<string>")
    good, bad = (np.bincount(r[0], minlength=quality.BUCKETS) for r in words.select(quality.buckets(F.col("w"))).collect())
    smooth = lambda c: np.log((c + 1) / (c.sum() + quality.BUCKETS))
    assert np.allclose(weights, smooth(good) - smooth(good + bad))


def test_verdicts_are_those_of_plain_scores(spark, sample, sf_dir):
    df, docs = sample
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    want = brute.quality_scores(docs, trusted, quality.BUCKETS, quality.SMOOTHING)
    rows = quality.quality_verdicts(df, labels).collect()
    assert len(rows) == len(docs) and {r.kept for r in rows} == {True, False}
    for r in rows:
        assert (r.score is None) == (want[r.doc_id] is None)
        if r.score is not None:
            assert abs(r.score - want[r.doc_id]) < 1e-9
            assert r.kept == (not brute.quality(docs[r.doc_id])[5] and want[r.doc_id] >= quality.THRESHOLD)


# ---------------------------------------------------------------- 4


@pytest.fixture(scope="module")
def pieces():
    found = sentencepiece_nbest.Pieces(tokenizer_path("piece_bpe_32k.model"))
    return found, {found.bytes[i]: float(found.scores[i]) for i in found.numbers}


def test_segmentations_of_words_are_the_best_there_are(pieces):
    model, scores = pieces
    words = [b" " + w for t in ("hello world segmentation", "an ostrich", "Zürich") for w in t.encode().split(b" ")]
    made = sentencepiece_nbest.lattices(model, words)
    for k, word in enumerate(words):
        assert np.allclose([s for s, _ in made.nbest(k, 6)], [s for s, _ in brute.segmentations(word, scores, model.odd, 6)])


def test_segmentations_of_texts_are_the_best_there_are(pieces):
    model, scores = pieces
    own = sentencepiece_nbest.Encoder(tokenizer_path("piece_bpe_32k.model"), 5)
    texts = [
        "the two cats", "(the cat, it's a.b) said:2x", "a  b", "def f():\n    return 1\n        # six", "   ", "x" + " " * 37 + "y", "日本語のテキスト です", "▁ literal▁sign  \u2581\u2581 ", "naïve  \U0001f600 \t tab", "mixed é è  ü",
    ]
    for text, ranked in zip(texts, own.encode(texts), strict=True):
        want = brute.segmentations(b" " + text.encode(), scores, model.odd, 5)
        assert np.allclose([s for s, _ in ranked], [s for s, _ in want], rtol=1e-12, atol=1e-5), text
        assert len({x for _, x in ranked}) == len(ranked) and all(own.decode(x) == text for _, x in ranked)
        if len(want) == 1 or want[0][0] > want[1][0] + 1e-5:
            best = [x for p in want[0][1] for x in ([p] if p in scores else [bytes([y]) for y in p])]
            assert [model.bytes[i] for i in np.frombuffer(ranked[0][1], np.uint32).tolist()] == best


def test_a_long_text_without_spaces():
    own = sentencepiece_nbest.Encoder(tokenizer_path("piece_bpe_32k.model"), 4)
    text = "internationalisé" * 1_500
    ranked = own.encode([text])[0]
    assert len(ranked) == 4 and own.decode(ranked[0][1]) == text


def test_pieces_decode_to_the_text(odd, with_nulls, none):
    path = tokenizer_path("piece_bpe_32k.model")
    coded = sentencepiece_nbest.encode_nbest(odd, path)
    rows = coded.collect()
    assert all(r.restored and r.scores == sorted(r.scores, reverse=True) for r in rows) and len(rows) == len(TEXTS)
    assert {r.doc_id: r.text for r in sentencepiece_nbest.decode_ids(coded, path).collect()} == {d: t or "" for d, t in BY_ID.items()}
    assert next(r for r in rows if r.doc_id == 1).sizes == [0]
    assert sentencepiece_nbest.encode_nbest(with_nulls, path).count() == len(TEXTS) + 2 and sentencepiece_nbest.encode_nbest(none, path).count() == 0


# ---------------------------------------------------------------- 5


def _matches(df, items):
    return {(r.doc_id, r.item_id): r.similarity for r in decontaminate.benchmark_matches(df, items).collect()}


def test_benchmark_matches(spark, odd, with_nulls, none, sample, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    df, docs = sample
    found, want = _matches(df, bench), brute.decontaminated(docs, items)
    assert set(found) == set(want) and np.allclose([found[k] for k in want], list(want.values()))
    some = [(1, None), (2, ""), (3, "too few words"), (4, TEXTS[8]), (5, TEXTS[8]), (6, TEXTS[14])]
    more = spark.createDataFrame(some, "item_id long, text string")
    found, want = _matches(odd, more), brute.decontaminated(BY_ID, dict(some))
    assert set(found) == set(want) and np.allclose([found[k] for k in want], list(want.values()))
    assert decontaminate.benchmark_matches(with_nulls, more).where("doc_id = 9").count() == 4  # both rows, both equal items
    assert _matches(none, more) == {} and _matches(odd, more.limit(0)) == {}


def test_items_in_blocks_weigh_as_all_do(spark, sample, sf_dir, monkeypatch):
    df, docs = sample
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    head = " ".join(f"w{i}" for i in range(12))
    items |= {10**6 + i: f"{head} {' '.join(f'x{i}y{j}' for j in range(6))}" for i in range(7)}
    own = docs | {10**6 + i: f"before {head} {' '.join(f'x{i}y{j}' for j in range(5))} after it" for i in range(7)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    found, want = _matches(spark.createDataFrame(list(own.items()), "doc_id long, text string"), bench), brute.decontaminated(own, items)
    assert set(found) == set(want) and np.allclose([found[k] for k in want], list(want.values()))


def test_hamming_blocks_find_all_within_the_radius():
    draw = np.random.default_rng(5)
    items = draw.integers(0, 1 << 16, (120, decontaminate.BLOCKS), dtype=np.uint16)
    flips = np.zeros((400, decontaminate.BITS), np.uint8)
    for row in flips:
        row[draw.permutation(decontaminate.BITS)[: draw.integers(0, 48)]] = 1
    near = items[draw.integers(0, 120, 400)] ^ np.packbits(flips, axis=1).view(np.uint16)
    apart = np.bitwise_count(near[:, None] ^ items[None]).sum(2, dtype=np.int64)
    index = decontaminate.HammingBlocks(items)
    for first, end in ((0, 120), (30, 31), (50, 50), (100, 120)):
        row, item = index.within(near, first, end)
        want = {(r, i) for r, i in np.argwhere(apart <= decontaminate.RADIUS).tolist() if first <= i < end}
        assert set(zip(row.tolist(), item.tolist(), strict=True)) == want


def test_rolled_fingerprints_are_those_of_each_window_alone():
    draw = np.random.default_rng(6)
    own, weights = draw.integers(0, 1 << 63, 300, dtype=np.uint64), 1 / draw.integers(1, 9, 300)
    for size in (1, 7, 40):
        starts = np.flatnonzero(draw.random(300 - size) < 0.2)
        found = decontaminate.simhashes(own, weights, starts, size)
        alone = [decontaminate.simhashes(own[s : s + size], weights[s : s + size], np.zeros(1, np.int64), size)[0] for s in starts.tolist()]
        assert np.array_equal(found, np.array(alone, np.uint16).reshape(-1, decontaminate.BLOCKS))


def test_random_windows_near_the_threshold(spark):
    """Items with words changed, moved and left out, of several sizes, inside longer texts: what brute force finds is found."""
    draw = np.random.default_rng(7)
    items, docs = {}, {}
    for i in range(150):
        words = [f"w{x}" for x in draw.integers(0, 400, draw.integers(5, 70))]
        items[i] = " ".join(words)
        for j in range(5):
            own = list(words)
            for _ in range(j // 2 + 1 if len(own) > 30 else j // 2):
                own[draw.integers(0, len(own))] = "changed"
            around = [f"v{x}" for x in draw.integers(0, 400, 20)]
            docs[10 * i + j] = " ".join([*around[: draw.integers(0, 20)], *own, *around])
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} long, text string")
    found, want = _matches(frame(docs, "doc_id"), frame(items, "item_id")), brute.decontaminated(docs, items)
    assert set(found) <= set(want) and len(set(want) - set(found)) <= 0.005 * len(want) and len(want) > 150
    assert np.allclose([found[k] for k in found], [want[k] for k in found])


def test_windows_of_a_very_long_text(spark):
    """A passage far inside a text of over half a megabyte, with filler that shares words with the item."""
    item = " ".join(f"i{i}" for i in range(60))
    filler = " ".join(f"i{(7 * i) % 60} f{i % 977}" for i in range(40_000))
    docs = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, filler)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in decontaminate.benchmark_matches(docs, items).collect()] == [(1, 1, 80_000, 1.0)]


def test_short_items_match_their_copies(spark):
    docs = spark.createDataFrame([(1, "Two words."), (2, "before two WORDS after them, two words"), (3, "words two"), (4, "two"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two words"), (2, "two words"), (3, "a b c d"), (4, ""), (5, "words two")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in decontaminate.benchmark_matches(docs, items).collect()}
    assert found == {(1, 1): (0, 2, 1.0), (1, 2): (0, 2, 1.0), (2, 1): (1, 2, 1.0), (2, 2): (1, 2, 1.0), (3, 5): (0, 2, 1.0)}


# ---------------------------------------------------------------- 6


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_never_used(spark, sample):
    df, _ = sample
    lied = df.withColumn("lang", F.when(langid.held_out(), F.lit("lie")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    take = lambda d: {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in langid.predict_languages(d).collect()}
    assert take(df) == take(lied)
    crc = {r.doc_id: r.held_out for r in langid.predict_languages(df).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in crc.items())


def test_odd_texts_have_no_language(odd, with_nulls, none):
    found = {r.doc_id: r for r in langid.predict_languages(odd).collect()}
    for d, t in BY_ID.items():
        assert (found[d].lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))
    assert langid.predict_languages(with_nulls).count() == len(TEXTS) + 2 and langid.predict_languages(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict_languages(unlabelled).collect()} == {"und"}


def test_predictions_are_those_of_plain_kernels(spark, sample):
    """Kernels worked out from sets of n-grams, with each row's landmarks and coefficients; a text counts by the lengths of its pieces."""
    df, docs = sample
    model = langid.fit(df)
    marks = [set(np.flatnonzero(c).tolist()) for c in model.landmarks.T]
    found = {r.doc_id: r for r in langid.predict_languages(df, model).collect()}
    for d in sorted(docs)[:40]:
        raw = (docs[d] or "").encode()
        if found[d].lang_pred == "und" or len(raw) != len(docs[d]):  # pieces are cut between bytes
            continue
        cut = [docs[d][i : i + langid.PIECE] for i in range(0, len(raw), langid.PIECE)]
        kernel = np.array([[brute.spectrum_kernel(brute.spectrum(t, langid.BUCKETS, langid.ORDERS), m) for m in marks] for t in cut])
        values = np.average(kernel @ model.coefficients, axis=0, weights=[len(t) for t in cut])
        assert abs(found[d].score - np.clip((values.max() + 1) / 2, 0, 1)) < 1e-3
        assert values[model.languages.index(found[d].lang_pred)] >= values.max() - 1e-3


def test_sample_of_languages_is_split_but_the_same(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id doc_id", "if(id % 50 = 0, 'few', 'many') lang")
    take = lambda: sorted(map(tuple, langid._first(rows, [F.xxhash64("doc_id"), "doc_id"], 100).select("lang", "r", "doc_id").collect()))
    found = take()
    monkeypatch.setattr(langid, "SALTS", 1)
    assert found == take() and len(found) == 160


def test_repeated_ids_are_sampled_once(spark):
    rows = [(1, f"some text {i}", "bb" if i else "aa") for i in range(4)] + [(3, "another text", "bb"), (4, "the last text", "bb")]
    model = langid.fit(spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], "doc_id long, text string, lang string"))
    assert set(model.languages) <= {"aa", "bb"} and model.landmarks.shape[1] <= 6


# ---------------------------------------------------------------- 7


def _said(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    bits = ["<|end|>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "<|role|>", "<s>", "plain words here", "\n", "ü 日", "<", "|>", ""]
    rows, talks = [], {}
    for conv in range(60):
        turns = ([("system", "be kind")] if conv % 3 == 0 else []) + [(("user", "assistant")[i % 2], "".join(rnd.choice(bits) for _ in range(rnd.randrange(6))) + " w" * rnd.choice((0, 5, 200))) for i in range(rnd.randrange(1, 30))]
        talks[conv] = turns
        rows += [(conv, i, r, t, 5, 5) for i, (r, t) in enumerate(turns)]
    rows += [(99, 0, None, None, 5, 5), (99, None, "assistant", None, 5, 5), (None, 1, "assistant", "lost", 5, 5)]
    talks[99] = [("assistant", ""), ("", "")]
    talks[None] = [("assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int, i int")
    windows = chat.chat_windows(df, budget=64)
    found = {r.conv_id: r for r in chat.chat_digest(windows).collect()}
    assert set(found) == set(talks)
    for conv, turns in talks.items():
        r, learnt = found[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), _said(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    systems = windows.where("conv_id = 0").collect()
    assert len(systems) > 1 and all("<|role|>system<|text|>be kind<|end|>" in w.text for w in systems)
    assert chat.chat_digest(chat.chat_windows(df.limit(0))).count() == 0


def _windows_of(spark, talks, budget):
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    found: dict = {c: [] for c in talks}
    for w in chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget).orderBy("conv_id", "window").collect():
        assert w.window == len(found[w.conv_id])
        found[w.conv_id].append((w.n_repeated, [tuple(x.split("<|text|>")) for x in w.text[3:-4].replace("<|role|>", "").split("<|end|>")[:-1]], w.n_tokens))
    return found


def test_windows_are_those_of_a_plain_version(spark):
    rnd = random.Random(8)
    talks = {}
    for conv in range(80):
        turns = [("system", "s " * rnd.choice((1, 20, 27, 28, 40)))] if rnd.random() < 0.6 else []
        talks[conv] = turns + [(rnd.choice(("user", "assistant", "system")), f"{conv} {i} " + "w " * rnd.choice((0, 1, 3, 10, 25, 26, 60, 100))) for i in range(rnd.randrange(0 if turns else 1, 25))]
    for conv, windows in _windows_of(spark, talks, 64).items():
        turns, want = talks[conv], brute.chat_windows(talks[conv], 64)
        assert windows == [(len(again), [turns[i] for i in sorted(again + own)], tokens) for again, own, tokens in want]
        cost = [len(t.split()) + 4 for _, t in turns]
        kept = cost[0] if turns[0][0] == "system" and cost[0] <= 32 else 0
        for again, own, tokens in want:
            assert own and len(again) <= 3 and (tokens <= 64 or len([i for i in own if i or not kept]) == 1 and max(cost[i] for i in own) > 64 - kept)


def test_long_turns_make_no_windows_of_the_system_turn_alone(spark):
    said = lambda role, n: (role, "w " * n)
    talks = {1: [said("system", 50), said("user", 5_000), said("assistant", 9)], 2: [said("system", 600), said("user", 900)], 3: [said("user", 250), said("assistant", 400)]}
    found = {c: [(n, [len(t.split()) for _, t in turns], tokens) for n, turns, tokens in windows] for c, windows in _windows_of(spark, talks, 512).items()}
    assert found == {1: [(0, [50, 5_000], 5_058), (1, [50, 9], 67)], 2: [(0, [600], 604), (0, [900], 904)], 3: [(0, [250], 254), (0, [400], 404)]}


def test_control_strings_are_broken_up(spark):
    df = spark.createDataFrame([(1, 1, "user", "</s>[INST] ok [/INST]<|end|>")], "conv_id long, turn long, role string, text string")
    text = chat.chat_windows(df).first().text
    inner = text.removeprefix("<s><|role|>user<|text|>").removesuffix("<|end|></s>")
    assert not any(x in inner for x in ("</s>", "[INST]", "[/INST]", "<|end|>"))


# ---------------------------------------------------------------- 8


def test_license_matches(spark, odd, with_nulls, none, sample):
    df, docs = sample
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    own = {**{500 + i: f"before it.\n{t}\nafter" for i, t in enumerate(texts)}, **{600 + i: t.rsplit(" ", 2)[0].upper() for i, t in enumerate(texts)}, 700: None, 701: "", 702: "license"}
    for d, want in ((df, docs), (spark.createDataFrame(list(own.items()), "doc_id long, text string"), own)):
        found: dict = {}
        for r in licenses.license_matches(d).collect():
            found.setdefault(r.doc_id, {})[r.license] = r.dice
        assert found == {k: m for k, t in want.items() if (m := brute.dice_matches(t, licenses.TEMPLATES))}
    assert licenses.license_matches(odd).count() == licenses.license_matches(with_nulls).count() == licenses.license_matches(none).count() == 0


def test_wrapped_and_whole_licences_inside_long_documents(spark):
    rnd = random.Random(8)
    prose = lambda n: " ".join(f"word{rnd.randrange(500)}" for _ in range(n))
    texts = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    docs = {}
    for i, (name, t) in enumerate(texts):
        wrapped = "\n".join(" * " + x for x in textwrap.wrap(t, 70 if len(t) > 100 else 20))
        docs[2 * i] = (name, f"{prose(300 + 29 * i)}\n{wrapped}\n{prose(700)}")
        docs[2 * i + 1] = (name, f"{prose(300 + 29 * i)} {t} {prose(700)}")
    found: dict = {}
    for r in licenses.license_matches(spark.createDataFrame([(d, t) for d, (_, t) in docs.items()], "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, {})[r.license] = r.dice
    assert all(found.get(d, {}).get(name, 0) >= 0.75 for d, (name, _) in docs.items())
    assert found[2 * [t for _, t in texts].index(licenses.TEMPLATES["MIT"][-1])]["MIT"] == 1  # no line nor sentence of it is found


# ---------------------------------------------------------------- 9


def test_token_counts(odd, with_nulls, none, sample):
    pieces = token_counts.vocabulary(tokenizer_path("word_bpe_49k.json"))
    known, cuts = set(pieces), {}
    for df, docs in ((odd, {k: t for k, t in BY_ID.items() if len(t or "") < 50_000}), sample):
        found = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(df, pieces).collect()}
        assert max(map(len, pieces)) <= 32
        for d, text in docs.items():
            words = (text or "").encode().lower().split()
            for w in set(words) - set(cuts):
                cuts[w] = brute.greedy_pieces(w, known, token_counts.END)
            assert found[d] == (len(words), sum(map(cuts.__getitem__, words))), d
    assert token_counts.token_counts(with_nulls, pieces).count() == len(TEXTS) + 2 and token_counts.token_counts(none, pieces).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=5), max_size=8), st.lists(st.text("abc", max_size=12), min_size=1, max_size=8))
def test_automaton_is_greedy(pieces, words):
    symbols = [tuple(p.encode()) for p in sorted(pieces)] + [(97, 98, token_counts.END), (98, token_counts.END)]
    words = [w.encode() for w in words if w]
    if words:
        assert token_counts.Automaton(symbols).counts(words) == [brute.greedy_pieces(w, set(symbols), token_counts.END) for w in words]


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("wide", [1_000, 2])
def test_repeats_are_cut(spark, odd, with_nulls, none, sample, wide):
    take = lambda df: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(df, wide=wide).collect()}
    for df, docs in ((odd, BY_ID), sample):
        assert take(df) == {d: x[:4] for d, x in brute.repeats(docs).items()}
    assert len(suffix_dedup.cut_repeats(with_nulls).collect()) == len(TEXTS) and take(none) == {}
    rest = {r.doc_id: r.kept for r in suffix_dedup.cut_repeats(odd).where("n_removed > 0").collect()}
    assert rest == {d: x[4].decode("utf-8", "ignore") for d, x in brute.repeats(BY_ID).items() if x[1]}


def test_one_document_that_repeats_itself(spark):
    rnd = random.Random(2)
    part = "".join(rnd.choice("abcdef ") for _ in range(230))
    docs = {1: part + "1" + part, 2: part[:199] + "2", 3: "y" * 201, 4: "z" * 200}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(df).collect()} == {d: x[:4] for d, x in brute.repeats(docs).items()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=60), min_size=1, max_size=6), st.integers(2, 9))
def test_run_length_index_finds_all_repeats(texts, length):
    segments = [t.encode() for t in texts]
    seen: dict = {}
    for s in segments:
        for i in range(len(s) - length + 1):
            seen[s[i : i + length]] = seen.get(s[i : i + length], 0) + 1
    for s, flags in zip(segments, suffix_dedup.repeats(segments, length), strict=True):
        assert flags.tolist() == [seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


def test_cut_documents_keep_their_columns(odd):
    out = suffix_dedup.cut_documents(odd)
    assert out.columns == odd.columns
    want = {d: x[4].decode("utf-8", "ignore") if x[1] else BY_ID[d] for d, x in brute.repeats(BY_ID).items()}
    assert {r.doc_id: r.text for r in out.collect()} == {d: t for d, t in want.items() if not (brute.repeats({d: BY_ID[d]})[d][0] and brute.repeats(BY_ID)[d][1] and not t.strip(" \t\n\r"))}


# ---------------------------------------------------------------- very long texts


def test_words_of_very_long_texts_hash_as_alone():
    import pyarrow as pa

    from proofmill.llm.common import CHUNK, hashed_words

    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    words[30_000] = "x" * (CHUNK + 1_000)
    text = "".join(w + rnd.choice((" ", "\n", "  ")) for w in words)
    assert len(text) > 2 * CHUNK
    alone = [h for _, h in hashed_words(pa.array(words))]
    assert (next(hashed_words(pa.array([text])))[1] == np.concatenate(alone)).all()


def test_windows_have_one_owner_also_over_the_edges_of_pieces():
    rnd = np.random.default_rng(6)
    length, edge = 200, suffix_dedup.PIECE
    passage = rnd.integers(97, 123, 900, np.uint8)
    data = rnd.integers(97, 123, 2 * edge + 5_000, np.uint8)
    for at in (1_000, edge - 400, 2 * edge - 150):
        data[at : at + 900] = passage
    next_window, owners = 0, {}
    for gram, _, first, last in suffix_dedup.owned(data, length):
        for g, a, b in zip(gram.tolist(), first.tolist(), last.tolist(), strict=True):
            assert a == next_window
            next_window = b + 1
            owners.update(dict.fromkeys(range(a, b + 1), g))
    assert next_window == len(data) - length + 1
    for i in range(900 - length + 1):
        assert owners[1_000 + i] == owners[edge - 400 + i] == owners[2 * edge - 150 + i]
