"""A corpus pipeline: language ID, near duplicates, repeated passages, benchmark passages, tokens.

Each stage works on all that its predecessor kept, and its result is written and reread before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import decontaminate, langid, sentencepiece_nbest, suffix_dedup
from proofmill.llm.common import by_row, stored, table, with_ids, without_ids
from proofmill.llm.ngram_join import jaccard_classes
from proofmill.llm.queries import tokenizer_path

#: A document whose language scores less isn't text of any learnt language.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a language that could be learnt."""
    label, score = (F.col(c) for c in langid.ADDED)
    return langid.tag_languages(docs).where((label != "und") & (score >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that is linked by Jaccard similarity. Each row is a document, also one
    whose doc_id is null (these come last) or that of other rows too; of equal ids the least text comes first. Rows without
    words are linked with nothing, so all stay."""

    def firsts(rows: DataFrame) -> DataFrame:
        first = stored(jaccard_classes(rows).where("doc_id = component_id").select("doc_id"))
        return with_ids(rows, first).select(rows.columns)

    return by_row(docs, firsts)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat in strings of 200; those without anything left go."""
    return suffix_dedup.cut_documents(docs, length=200)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is similar to a benchmark item. Each row is judged by its own text, whatever its doc_id."""

    def clean(rows: DataFrame) -> DataFrame:
        matches = decontaminate.benchmark_matches(rows, table(spark, sf_dir, "benchmark"))
        return without_ids(rows, stored(matches.select("doc_id").distinct())).select(rows.columns)

    return by_row(docs, clean)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, score, ids of the best segmentation, and scores of the N best."""
    coded = sentencepiece_nbest.encode_nbest(docs, tokenizer_path("piece_bpe_32k.model"), n=4)
    return coded.select("doc_id", F.get("sizes", F.lit(0)).alias("n_tokens"), F.get("scores", F.lit(0)).alias("score"), "scores", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("tokenized", tokenized),
]

#: SQL can't express the first stage (a fitted classifier) nor the last (a lattice search); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
