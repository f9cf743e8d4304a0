"""Quality rules: counts that expose junk, and the log-likelihood ratio of hashed n-grams between trusted and raw text.

DataFrame functions only. Words and word pairs are hashed to BUCKETS buckets. Two multinomials are counted, over all
documents (raw) and over the trusted ones (target); a document's score is the mean over its n-grams of
ln p_target - ln p_raw, and it is kept if no base rule fails and the score reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, stored

BUCKETS, SMOOTHING = 10_000, 1.0
#: Mean nats an n-gram: a text less than e**-0.3 times as likely, per n-gram, as trusted text than as raw text goes.
THRESHOLD = -0.3
_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != "")


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.select("doc_id", text.alias("text"), words_of(text).alias("words")).withColumn("n", F.size("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({"lines": lines, "h": F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), 1, F.greatest(F.col("n") - 2, F.lit(0)))})
    ordered = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("s", ordered)
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    again = F.filter("s", lambda x, k: same(x, k + 1) | same(x, k - 1))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    count = lambda c: c.cast("long")
    return df.select(
        "doc_id", "words", count(F.col("n")).alias("n_words"), count(F.char_length(F.array_join("words", ""))).alias("word_chars"),
        count(F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), count(F.size(covered)).alias("n_repeat_words"),
    )


def buckets(words: Column) -> Column:
    """Buckets of all words and word pairs, without regard to case."""
    low = lambda w: F.lower(w)
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(low(w)), F.lit(BUCKETS)).cast("int"))
    double = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(low(w), low(F.get(words, i + 1))), F.lit(BUCKETS)).cast("int"))
    return F.concat(single, double)


def ratio_weights(documents: DataFrame, trusted: DataFrame) -> list[float]:
    """ln p_target - ln p_raw of each bucket, over all documents; as many numbers as buckets."""
    marks = stored(trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(1)))
    marked = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks, "doc_id", "left")
    split = marked.select("trusted", words_of(F.col("text").cast("string")).alias("words"))  # a column, so that it is split once and not for each word
    seen = split.select("trusted", F.explode_outer(buckets(F.col("words"))).alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    spread = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(seen, "b", "left").na.fill(0)
    total = spread.agg(F.sum("raw").alias("r"), F.sum("target").alias("t"))
    w = F.log((F.col("target") + SMOOTHING) / (F.col("t") + SMOOTHING * BUCKETS)) - F.log((F.col("raw") + SMOOTHING) / (F.col("r") + SMOOTHING * BUCKETS))
    return [x.w for x in spread.join(F.broadcast(total), F.lit(True)).select("b", w.alias("w")).orderBy("b").collect()]


def quality_verdicts(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of documents: doc_id, base counts, base_failed, kept, score.

    labels: (doc_id, quality, toxic); documents of quality 1 that aren't toxic are trusted; without any, all scores are
    about 0 and only the base rules decide. Null and blank texts have no words, fail the base rules and have score null.
    Repeated rows are judged alike. Other columns are ignored.
    """
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    weights = F.split(F.lit(",".join(map(repr, ratio_weights(documents, trusted)))), ",").cast("array<double>")
    df = base_counts(documents)
    found = buckets(F.col("words"))
    total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    df = df.withColumn("score", F.when(F.col("n_words") > 0, total / (F.lit(2) * F.col("n_words") - 1)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.coalesce(F.col("score"), F.lit(-1e9)) >= threshold)).alias("kept"), "score")
