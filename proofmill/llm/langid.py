"""Language ID by string kernels.

A piece of text is the set of its byte n-grams of one to three bytes (a blended spectrum, presence only), hashed to
BUCKETS. The kernel of two pieces is the size of their common set over the root of the product of their sizes. A few
sampled pieces are Nystroem landmarks; kernel ridge regression, one language against the rest, is solved on them.
Prediction is a product of a batch's presence matrix with the landmarks' and of that with the coefficients; the values
of a text's pieces are averaged by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bounded_batches, stored, text_buffer, tidy, with_ids

BUCKETS, ORDERS, PIECE, ROWS = 8192, (1, 2, 3), 4096, 128
#: The model is fitted on at most so many labelled documents of each language; so many of their pieces are landmarks.
SAMPLE, LANDMARKS, RIDGE, SALTS = 400, 160, 1e-3, 32
_FOLD = LOWER.copy()
_FOLD[:65] = 32
_FOLD[91:97] = _FOLD[123:128] = 32


def held_out() -> Column:
    """Documents that are never learnt from: crc32 of doc_id as text is 2 modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def presence(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, its bytes, its 0/1 row of n-gram buckets), a batch of pieces at a time."""
    data, at = text_buffer(column)
    size = np.diff(at)
    many = -(-size // PIECE)
    row = np.repeat(np.arange(len(size)), many)
    begin = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * PIECE
    end = np.minimum(begin + PIECE, at[row + 1])
    for a in range(0, len(row), ROWS):
        b = min(a + ROWS, len(row))
        part = _FOLD[data[begin[a] : end[b - 1]]].astype(np.uint32)
        owner = np.repeat(np.arange(b - a), end[a:b] - begin[a:b])  # pieces lie end to end
        out = np.zeros((b - a) * BUCKETS, np.float32)
        gram = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :] if len(part) >= n else gram[:0]
            if n in ORDERS and len(gram):
                inside = owner[: len(gram)]
                bucket = ((gram + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(19)
                ok = inside == owner[n - 1 :]
                out[inside[ok] * BUCKETS + bucket[ok]] = 1
        yield row[a:b], end[a:b] - begin[a:b], out.reshape(-1, BUCKETS)


@dataclass
class Model:
    """Languages, scaled landmark rows (BUCKETS x landmarks) and coefficients (landmarks x languages)."""

    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def values(self, rows: np.ndarray) -> np.ndarray:
        kernel = rows @ self.landmarks
        kernel /= np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
        return kernel @ self.coefficients


#: What is learnt from nothing.
NONE = Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        for row, _, bits in presence(batch.column("text")):
            packed = [x.tobytes() for x in np.packbits(bits.astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array([langs[r] for r in row]), pa.array([ids[r] for r in row], pa.int64()), pa.array(np.arange(len(row))), pa.array(packed, pa.binary())], ["lang", "doc_id", "k", "bits"])


def _first(rows: DataFrame, order: list[Column | str], sample: int) -> DataFrame:
    """The first `sample` rows of each lang in this order, with their rank r; ranked within SALTS parts of a language before,
    so that no task gets more than SALTS * sample rows of one or a part of its rows."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    few = rows.withColumn("salt", salt).withColumn("r", F.row_number().over(part)).where(F.col("r") <= sample).drop("salt")
    return few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= sample)


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from text and non-null lang of documents that aren't held out; None if there are none. A doc_id that comes
    several times is sampled once, with the least of its languages, and all its texts."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    labelled = bounded_batches(rows).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    once = labelled.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = stored(_first(once, [F.xxhash64("doc_id"), "doc_id"], sample).select("doc_id", "lang"))
    texts = with_ids(rows.where("text is not null and lang is not null").select("doc_id", "text"), chosen.select("doc_id"))
    pieces = texts.join(chosen, "doc_id").select("doc_id", "lang", "text").mapInArrow(_packed, "lang string, doc_id long, k long, bits binary")
    rows = _first(pieces, [F.xxhash64("doc_id", "k"), "doc_id", "k", "bits"], sample).orderBy("lang", "r").select("lang", "r", "bits").collect()
    if not rows:
        return None
    x = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in rows]), axis=1).astype(np.float32)
    size = np.sqrt(np.maximum(x.sum(1), 1))
    languages = sorted({r.lang for r in rows})
    each = max(1, LANDMARKS // len(languages))
    marks = np.array([i for i, r in enumerate(rows) if r.r <= each])
    scaled = (x[marks] / size[marks][:, None]).T.copy()
    kernel = (x @ scaled) / size[:, None]
    value, vector = np.linalg.eigh(kernel[marks].astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = kernel.astype(np.float64) @ root
    label = np.array([languages.index(r.lang) for r in rows])
    weight = 1 / np.bincount(label, minlength=len(languages))[label]  # languages count alike
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
    return Model(languages, scaled, (root @ solved).astype(np.float32))


def _predicted(model):
    """Batches with two more columns, the language and its score."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            n, text = batch.num_rows, batch.column("text")
            total, size = np.zeros((n, len(m.languages)), np.float64), np.zeros(n)
            for row, length, bits in presence(text):
                np.add.at(total, row, m.values(bits) * length[:, None])
                np.add.at(size, row, length)
            total /= np.maximum(size, 1)[:, None]
            best = total.argmax(1)
            score = np.clip((total[np.arange(n), best] + 1) / 2, 0, 1)
            known = [t is not None and any(map(str.isalpha, t)) for t in text.to_pylist()]
            pick = [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pick, pa.string()), pa.array(np.where(known, score, 0.0))], [*batch.schema.names, *ADDED])

    return run


#: Names of the columns that tag_languages adds.
ADDED = ("__lang_pred", "__lang_score")


def tag_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows and columns of documents, and the columns ADDED: a learnt language, or `und` with score 0 where the text
    is null or has no letter, or where nothing could be learnt; and the score from 0 to 1. Texts are read whole."""
    documents = bounded_batches(documents)
    model = model or fit(documents) or NONE
    if not model.languages:
        return documents.select("*", F.lit("und").alias(ADDED[0]), F.lit(0.0).alias(ADDED[1]))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema.fields, T.StructField(ADDED[0], T.StringType()), T.StructField(ADDED[1], T.DoubleType())])
    return documents.mapInArrow(_predicted(shared), schema)


def predict_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of documents: doc_id, held_out, lang_pred, score. held_out is null where doc_id is. Other columns
    than doc_id, text and lang are ignored."""
    model = model or fit(documents) or NONE
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return tag_languages(rows, model).select("doc_id", held_out().alias("held_out"), F.col(ADDED[0]).alias("lang_pred"), F.col(ADDED[1]).alias("score"))
