"""The corpus pipeline against the stages' plain versions, one after another, and on odd input."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from proofmill.llm import langid, sentencepiece_nbest  # noqa: E402
from proofmill.llm.queries import tokenizer_path  # noqa: E402


def test_rows_are_those_of_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    judged = {r.doc_id: r for r in langid.predict_languages(docs).collect()}
    texts = {d: t for d, t in texts.items() if judged[d].lang_pred != "und" and judged[d].score >= pipeline.LEAST_SCORE}
    texts = {d: t for d, t in texts.items() if brute.jaccard(texts)[d][1] == d} if len(texts) < 5 else _first_of_each(texts)
    cut = brute.repeats(texts)
    texts = {d: (cut[d][4].decode("utf-8", "ignore") if cut[d][1] else t) for d, t in texts.items()}
    texts = {d: t for d, t in texts.items() if not cut[d][1] or t.strip(" \t\n\r")}
    leaks = {d for d, _ in brute.decontaminated(texts, items)}
    texts = {d: t for d, t in texts.items() if d not in leaks}
    own = sentencepiece_nbest.Encoder(tokenizer_path("piece_bpe_32k.model"), 4)
    want = {d: own.encode([t])[0] for d, t in texts.items()}
    found = {r.doc_id: r for r in pipeline.run(spark, sf_dir).collect()}
    assert set(found) == set(want) and leaks and len(want) < len(judged)
    for d, ranked in want.items():
        assert bytes(found[d].ids) == ranked[0][1] and found[d].n_tokens == len(ranked[0][1]) // 4
        assert [round(s, 6) for s in found[d].scores] == [round(s, 6) for s, _ in ranked]


def _first_of_each(texts):
    classes = brute.jaccard(texts)
    return {d: t for d, t in texts.items() if classes[d][1] == d}


def test_stages_keep_columns_and_stand_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "lost words of no id", "aa", None, None), (10**6, None, None, None, None), (10**6 + 1, "", None, None, 0), (10**6 + 2, "12 34", "aa", "s", 5)], docs.schema)
    mixed = docs.unionByName(odd).withColumn("n", F.lit(1)).withColumn("component_id", F.lit("x"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, mixed, sf_dir)
        assert out.columns == mixed.columns, name
        assert stage(spark, mixed.limit(0), sf_dir).count() == 0, name
        assert out.count() > 0
    assert pipeline.language_id(spark, mixed, sf_dir).where("doc_id >= 1000000").count() == 0
    assert pipeline.STAGES[-1][1](spark, mixed.limit(0), sf_dir).count() == 0


def test_each_row_is_a_document(spark, sf_dir):
    words = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 100").first().text
    rows = [(7, words("a")), (7, words("a")), (7, words("b")), (None, words("b") + " more"), (None, words("c")), (None, words("c")), (8, None), (8, None), (3, words("d")), (9, words("d") + " end")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, source int").repartition(3)
    kept = sorted((str(r.doc_id), str(r.text)) for r in pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert kept == sorted([("7", words("a")), ("7", words("b")), ("None", words("c")), ("8", "None"), ("8", "None"), ("3", words("d"))])

    twice = "x" + words("p", 90)
    docs = spark.createDataFrame([(1, "one " + twice), (1, "two " + twice), (None, "three " + twice), (None, "four alone"), (2, "five alone")], "doc_id long, text string")
    cut = brute.repeats(dict(enumerate(r.text for r in docs.collect())))
    want = sorted(zip(("1", "1", "None", "None", "2"), (x[4].decode() for x in cut.values())))
    assert sorted((str(r.doc_id), r.text) for r in pipeline.repeated_passages(spark, docs, sf_dir).collect()) == want

    docs = spark.createDataFrame([(1, item), (1, words("q")), (None, "see " + item), (None, words("r"))], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in pipeline.decontaminated(spark, docs, sf_dir).collect()) == [("1", words("q")), ("None", words("r"))]
