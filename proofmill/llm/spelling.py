"""Spelling variants: a trie self-join with active-node sets over a partitioned vocabulary.

Words at distance one agree in all but one place. Cut a word of b letters at b // 2: the shorter word of a pair (b letters)
and the longer one (b or b + 1) share all before the cut or all from it on. So the vocabulary is parted by length and by
what is shared at both ends, each word four times, and every near pair meets in some part. A part is cut again in the
same way, at the middle of what its words don't share, while it holds too many words; where only one letter is left
open, a part can't be larger than the alphabet allows. In a part, the rest of its words makes a trie, in which each
node's active nodes (those within distance one) come from its parent's; words that end in active nodes at distance one
are pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, tidy

#: Words of a part that are joined in one trie; larger parts are cut again.
PART = 5_000
#: Different words that a task counts before it hands the counts on.
HELD = 300_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def _changed(word: str, seed: int, every: int) -> str:
    """word, without one letter if `every` divides its checksum; seed: the checksum of what stands before it."""
    h = zlib.crc32(word.encode(), seed)
    if h % every:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def _counted(every: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                own = Counter(_RUN.findall((text.as_py() or "").encode().lower().decode()))
                for word, n in own.items():
                    held[_changed(word, seed, every)] += n
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def vocabulary(documents: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, that have `shortest` letters and occur `least` times.

    A run in a document whose checksum of `<doc_id>:<run>` is divisible by `every` has lost a letter before it is counted,
    as a test of what the grouping finds. Null and empty texts have no runs; a null doc_id is written as nothing; repeated
    rows count as often as they are there.
    """
    rows = bounded_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = rows.mapInArrow(_counted(every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.length("word") >= shortest) & (F.col("n") >= least))


# ---------------------------------------------------------------- a part's trie


class _Node:
    __slots__ = ("ends", "next")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.ends: list[int] = []


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, j), i before j by trie order or not, of all words at distance one, both ways round."""
    root = _Node()
    for i, word in enumerate(words):
        node = root
        for c in word:
            node = node.next.setdefault(c, _Node())
        node.ends.append(i)
    walk = [(root, {root: 0} | {child: 1 for child in root.next.values()})]
    while walk:
        node, active = walk.pop()
        for i in node.ends:
            for other, d in active.items():
                if d:
                    for j in other.ends:
                        yield i, j
        for c, child in node.next.items():
            own: dict[_Node, int] = {}
            for other, d in active.items():
                if not d:
                    own.setdefault(other, 1)  # c is one letter too many
                    if (same := other.next.get(c)) is not None:
                        own[same] = 0
                        for more in same.next.values():  # the other has one letter more
                            own.setdefault(more, 1)
                    for s, replaced in other.next.items():
                        if s != c:
                            own.setdefault(replaced, 1)
                elif (same := other.next.get(c)) is not None:
                    own.setdefault(same, 1)
            walk.append((child, own))


_SCHEMA = "word string, n long, other string, m long"


@tidy
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each part. Parts come end to end."""

    def emit(part: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        b, at, to = part[:3]
        words, n = [r[0] for r in rows], [r[1] for r in rows]
        pairs = [(i, j) for i, j in near_pairs([w[at : len(w) - to] for w in words]) if min(len(words[i]), len(words[j])) == b]
        if pairs:
            columns = [[x[k] for k in side] for side in zip(*pairs, strict=True) for x in (words, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "other", "m"])

    held, rows = None, []
    for batch in batches:
        *keys, words, counts = (batch.column(c).to_pylist() for c in ("b", "at", "to", "head", "tail", "word", "n"))
        for part, word, n in zip(zip(*keys, strict=True), words, counts, strict=True):
            if part != held and rows:
                yield from emit(held, rows)
                rows = []
            held = part
            rows.append((word, n))
    if rows:
        yield from emit(held, rows)


_KEY = ["b", "at", "to", "head", "tail"]


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (b, at, to, word, n): the words of b and b + 1 letters whose first `at` and last `to` letters count as shared,
    with those ends as head and tail, once for each half of what was open between them."""
    half = F.expr("(b - at - to) div 2")
    ends = F.array(F.struct((F.col("at") + half).alias("at"), F.col("to").alias("to")), F.struct("at", (F.col("b") - F.col("at") - half).alias("to")))
    rows = rows.select("word", "n", "b", F.explode(ends).alias("e")).select("word", "n", "b", "e.at", "e.to")
    return rows.withColumns({"head": F.expr("left(word, at)"), "tail": F.expr("right(word, to)")})


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n, other, m) for each ordered pair of different words of `words` (word, n) at distance one: one letter put in,
    left out or replaced. Words must be distinct and of two letters at least."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("b"))
    parted = stored(_cut(rows.select("word", "n", "b", F.lit(0).alias("at"), F.lit(0).alias("to"))))
    found = None
    while True:
        sizes = stored(parted.groupBy(*_KEY).agg(F.count("*").alias("size"), F.min(F.length("word")).alias("short")).where((F.col("size") > 1) & (F.col("short") == F.col("b"))))
        whole = (F.col("size") <= part) | (F.col("b") - F.col("at") - F.col("to") <= 1)
        ready = parted.join(sizes.where(whole), _KEY, "left_semi").repartition(*_KEY).sortWithinPartitions(*_KEY, "word")
        ready = ready.select(*_KEY, "word", "n").mapInArrow(_joined, _SCHEMA)
        found = ready if found is None else found.unionByName(ready)
        if not sizes.where(~whole).take(1):
            return found.distinct()
        parted = stored(_cut(parted.join(sizes.where(~whole), _KEY, "left_semi").select("word", "n", "b", "at", "to")))


def variants(words: DataFrame, near: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of words (word, n).

    A word's form is its most frequent near word (of equal ones the least by code points), if that occurs `times` as often;
    its root is where its forms' forms end. A word without a form is its own root; without near words n_near is 0.
    """
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("b"))
    found = words.join(best, "word", "left").withColumn("m", -F.col("b.less"))
    has = F.col("m") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("b.other")).alias("form"), F.when(has, F.col("m")).alias("form_n"))
    found = stored(found)
    # each round doubles the steps from a word to its root; counts grow by `times` a step, so there are few
    roots = stored(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        to = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(roots.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = longer.drop("moved")
        if not longer.where("moved").take(1):
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of documents, as `vocabulary`, `near_words` and `variants` say.
    No rows, or no words, give no rows. Other columns are ignored."""
    words = stored(vocabulary(documents))
    return variants(words, stored(near_words(words)))
