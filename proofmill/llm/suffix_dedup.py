"""Suffix-array dedup: remove every byte that lies in a long string found elsewhere too.

Each window of `length` bytes is owned by the k-gram of least hash in it (the leftmost such), so equal windows are owned
by equal k-grams and meet under one key. A long k-gram keeps short common phrases from being keys. Neighbouring windows
with one owner make a segment. Every segment whose owner occurs again goes into a run-length index: once if it occurs
once, twice if more often. The index's Burrows-Wheeler transform is compressed to runs, text positions and longest
common prefixes are kept for the run ends only, and matching statistics against all other places of the index are
streamed from them in text order (between run ends they fall by one at each step). What the index finds in a segment
holds for each of its occurrences.

An owner with very many segments is parted. A window has its owner somewhere inside, so either half of what is left lies
before the owner or more than half behind it; those bytes make the owner longer, and the windows of a segment fall into
two shorter segments under longer owners. That goes on until an owner has few segments, at the latest when it is a whole
window. Longer owners are part of their windows too, so equal windows stay together.

No window spans two documents or is owned twice, so a match of `length` bytes in an index is a repeat in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_array, bounded_batches, by_row, one_per_id, powers, rolling, signed, span, stored, text_buffer, tidy, with_ids, without_ids

#: Bytes of a k-gram; bytes of text hashed at once; bytes of an index; segments of one owner above which it is parted.
GRAM, PIECE, BLOCK, WIDE = 96, 1 << 18, 1 << 18, 1_000
_POS = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by running minima from both ends of blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def owned(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(owner's hash, segment's hash, first window, last window) of each owner in one text's bytes."""
    for a in range(0, len(data) - length + 1, PIECE):
        piece = data[a : a + PIECE + length - 1]
        powers(PIECE + length)
        sums = rolling(piece)
        at = np.arange(len(piece) - GRAM + 1)
        grams = span(sums, at, at + GRAM)
        least = sliding_min((grams & ~_POS) | at.astype(np.uint64), length - GRAM + 1)
        owner = (least & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.concatenate((first[1:], [len(owner)])) - 1
        yield grams[owner[first]], span(sums, first, last + length), first + a, last + a


def _owners(length: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for k in np.flatnonzero(np.diff(at) >= length):
                for gram, seg, first, last in owned(data[at[k] : at[k + 1]], length):
                    for col, x in zip(cols, (signed(gram), signed(seg), np.full(len(gram), ids[k], np.int64), first, last), strict=True):
                        col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["gram", "seg", "doc_id", "first", "last"])

    return run


_PIECE = pa.schema([("gram", pa.int64()), ("seg", pa.int64()), ("bytes", pa.binary())])


def _segments(length: int):
    """The bytes of segments, from the texts that they are parts of."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            for k, parts in enumerate(batch.column("parts").to_pylist()):
                text = data[at[k] : at[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["gram"] for p in parts]), pa.array([p["seg"] for p in parts]), binary_array([text[p["first"] : p["last"] + length].tobytes() for p in parts])], schema=_PIECE
                )

    return run


def halves(first: int, last: int, owner: int, size: int, length: int) -> list[tuple[int, int, int, int]]:
    """(first window, last window, longer owner, its size): the windows first to last, which all hold the `size` bytes at
    `owner`, by where more of what is left of a window lies: before the owner, or behind it."""
    left = (length - size + 1) // 2
    right = length - size - left + 1
    found = [(first, min(last, owner - left), owner - left, size + left), (max(first, owner - left + 1), last, owner, size + right)]
    return [x for x in found if x[0] <= x[1]]


_HALF = pa.schema([("gram", pa.int64()), ("seg", pa.int64()), ("of_gram", pa.int64()), ("of_seg", pa.int64()), ("c", pa.int64()), ("at", pa.int64()), ("owner", pa.int64()), ("size", pa.int64()), ("bytes", pa.binary())])


def _parted(length: int):
    """Segments in two parts under longer owners. owner, size: where a segment's owner lies; null at first, as its hash tells."""

    def halved(batch: pa.RecordBatch) -> Iterator[tuple]:
        for gram, seg, c, owner, size, part in zip(*(batch.column(x).to_pylist() for x in ("gram", "seg", "c", "owner", "size", "bytes")), strict=True):
            sums = rolling(np.frombuffer(part, np.uint8))
            if owner is None:
                at = np.arange(length - GRAM + 1)
                owner, size = int(np.argmin(span(sums, at, at + GRAM) & ~_POS)), GRAM
            for first, last, longer, wide in halves(0, len(part) - length, owner, size, length):
                key, own = signed(span(sums, np.array([longer, first]), np.array([longer + wide, last + length]))).tolist()
                yield key, own, gram, seg, c, first, longer - first, wide, part[first : last + length]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(halved(batch))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_HALF)], schema=_HALF)

    return run


class RunIndex:
    """A run-length index of a few texts: Burrows-Wheeler runs, and for both ends of each run its text position and the
    longest common prefix with the row beyond that end."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        m = len(texts)
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + m
        symbols[self.ends] = np.arange(m)  # each text's end is a symbol of its own, below all bytes
        self.size = len(symbols)
        order, levels = self._suffix_order(symbols, m + 256)
        before = symbols[order - 1]
        edge = before[1:] != before[:-1]
        head, tail = np.concatenate(([True], edge)), np.concatenate((edge, [True]))
        self.runs = int(head.sum())
        above, below = np.concatenate(([-1], order[:-1])), np.concatenate((order[1:], [-1]))
        self.samples = [self._sampled(order[head], above[head], levels), self._sampled(order[tail], below[tail], levels)]

    @staticmethod
    def _suffix_order(symbols: np.ndarray, base: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix array by doubling; the ranks by each power of two of leading symbols."""
        n = len(symbols)
        padded = np.concatenate((symbols, np.zeros(4, np.int64)))
        levels = [(1, symbols.astype(np.int32))]
        two = padded[:-4] * base + padded[1:-3]
        key, h = two * (base * base) + padded[2:-2] * base + padded[3:-1], 4
        levels.append((2, np.unique(two, return_inverse=True)[1].astype(np.int32)))
        while True:
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate(([False], key[1:] != key[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            levels.append((h, rank.astype(np.int32)))
            if rank[order[-1]] == n - 1:
                return order, levels
            beyond = np.zeros(n, np.int64)
            beyond[:-h] = rank[h:] + 1 if h < n else 0
            key, h = rank * (n + 1) + beyond, 2 * h

    @staticmethod
    def _sampled(place: np.ndarray, other: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(place)
        place, other = place[by], other[by]
        p, q, common = place.copy(), other.copy(), np.zeros(len(place), np.int64)
        n = len(levels[0][1])
        q[other < 0] = n
        for h, rank in reversed(levels):
            same = np.flatnonzero((p < n) & (q < n))
            same = same[rank[p[same]] == rank[q[same]]]
            p[same] += h
            q[same] += h
            common[same] += h
        return place, common

    def statistics(self) -> np.ndarray:
        """For each text position the length of its longest match that starts anywhere else in the index."""
        at = np.arange(self.size)
        found = np.zeros(self.size, np.int64)
        for place, common in self.samples:
            s = np.searchsorted(place, at, "right") - 1
            np.maximum(found, common[s] - (at - place[s]), out=found)
        return found


def repeats(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur at another place in these segments."""
    index = RunIndex(segments)
    long = index.statistics() >= length
    return [long[a : max(a, b - length + 1)] for a, b in zip(index.starts, index.ends, strict=True)]


def spans_of(flags: np.ndarray, at: int, length: int) -> list[tuple[int, int]]:
    """Byte spans under the flagged windows."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return [(at + int(a), at + int(b) - 1 + length) for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)]


_SPANS = pa.schema([("gram", pa.int64()), ("seg", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _indexed(length: int):
    """Spans of repeated windows within segments. Rows come by owner and segment, end to end; an index takes whole owners."""

    def flush(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        out, before = [], None
        for (gram, seg, _), flags in zip(rows, repeats([r[2] for r in rows], length), strict=True):
            if (gram, seg) != before:
                out += [(gram, seg, a, b) for a, b in spans_of(flags, 0, length)]
            before = gram, seg
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], schema=_SPANS)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for gram, seg, part in zip(*(batch.column(c).to_pylist() for c in ("gram", "seg", "bytes")), strict=True):
                if gram != last and size >= BLOCK:
                    yield flush(held)
                    held, size = [], 0
                held.append((gram, seg, part))
                size, last = size + len(part), gram
        if held:
            yield flush(held)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text without its spans; the rest is decoded leniently, as a cut may fall inside of a character."""
    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        removed, count, digest, kept = [], [], [], []
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            text, runs = data[at[k] : at[k + 1]].tobytes(), merged([(s["a"], s["b"]) for s in spans])
            edges = [0, *(x for r in runs for x in r), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(len(text) - len(rest))
            count.append(len(runs))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(kept)], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])


def _of_owners(segments: DataFrame, wide: int) -> tuple[DataFrame, DataFrame]:
    """Stored segments (gram, seg, c, ...) whose owner occurs again: those of owners with up to `wide` places in an index, and of wider ones."""
    sizes = stored(segments.groupBy("gram").agg(F.sum(F.least("c", F.lit(2))).alias("n")).where(f"n = 1 or n > {max(2, wide)}"))
    return segments.join(sizes, "gram", "left_anti"), segments.join(sizes.where("n > 1").select("gram"), "gram", "left_semi")


def _found(pieces: DataFrame, length: int) -> DataFrame:
    """(gram, seg, a, b): spans that repeat, of pieces (gram, seg, bytes)."""
    return pieces.repartition("gram").sortWithinPartitions("gram", "seg").mapInArrow(_indexed(length), "gram long, seg long, a long, b long")


def _parts_found(many: DataFrame, length: int, wide: int) -> DataFrame:
    """As _found, of segments (gram, seg, c, owner, size, bytes) of wide owners, which are parted until none is wide."""
    levels = []
    while True:
        parts = stored(many.mapInArrow(_parted(length), "gram long, seg long, of_gram long, of_seg long, c long, at long, owner long, size long, bytes binary"))
        segments = parts.groupBy("gram", "seg").agg(F.sum("c").alias("c"), *[F.first(x).alias(x) for x in ("owner", "size", "bytes")])
        few, many = _of_owners(stored(segments), wide)
        twice = few.select("gram", "seg", F.explode(F.array_repeat("bytes", F.least("c", F.lit(2)).cast("int"))).alias("bytes"))
        levels.append((parts, stored(_found(twice, length))))
        if not many.take(1):
            break
    below = None
    for parts, found in reversed(levels):
        found = found if below is None else found.unionByName(below)
        whole = parts.select("gram", "seg", "of_gram", "of_seg", "at").join(found, ["gram", "seg"])
        below = stored(whole.select(F.col("of_gram").alias("gram"), F.col("of_seg").alias("seg"), (F.col("a") + F.col("at")).alias("a"), (F.col("b") + F.col("at")).alias("b")))
    return below


def repeated_spans(documents: DataFrame, length: int = 200, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """(spans, copies): byte spans (doc_id, a, b) to remove, over one document of each group of equal texts, and
    (doc_id, rep, copies) of all documents. A text with a copy is a repeat as a whole if it has `length` bytes."""
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("x"), F.xxhash64("text", F.lit(1)).alias("y"))
    keyed = stored(keyed)
    key = ["n_bytes", "x", "y"]
    copies = stored(keyed.join(keyed.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), key).select("doc_id", "rep", "copies", "n_bytes"))
    others = stored(copies.where("doc_id <> rep").select("doc_id"))

    occurring = stored(without_ids(texts, others).mapInArrow(_owners(length), "gram long, seg long, doc_id long, first long, last long"))
    again = stored(occurring.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"))
    places = stored(occurring.join(again, "gram", "left_semi"))
    place = F.struct("doc_id", "first", "last")
    segments = stored(places.groupBy("gram", "seg").agg(F.count("*").alias("c"), F.min(place).alias("lo"), F.max(place).alias("hi")))
    few, many = _of_owners(segments, wide)

    def pieces(at: DataFrame) -> DataFrame:
        """The bytes of segments (gram, seg, at)."""
        parts = stored(at.groupBy("at.doc_id").agg(F.collect_list(F.struct("gram", "seg", "at.first", "at.last")).alias("parts")))
        return with_ids(texts, parts.select("doc_id")).join(parts, "doc_id").select("text", "parts").mapInArrow(_segments(length), "gram long, seg long, bytes binary")

    twice = F.when(F.col("c") > 1, F.array("lo", "hi")).otherwise(F.array("lo"))
    found = _found(pieces(few.select("gram", "seg", F.explode(twice).alias("at"))), length)
    if many.take(1):
        unknown = F.lit(None).cast("long")
        hot = pieces(many.select("gram", "seg", F.col("lo").alias("at"))).join(many.select("gram", "seg", "c"), ["gram", "seg"])
        found = found.unionByName(_parts_found(hot.withColumns({"owner": unknown, "size": unknown}), length, wide))
    spans = places.select("gram", "seg", "doc_id", "first").join(stored(found), ["gram", "seg"])
    return spans.select("doc_id", (F.col("a") + F.col("first")).alias("a"), (F.col("b") + F.col("first")).alias("b")), copies


def cut_repeats(documents: DataFrame, length: int = 200, wide: int = WIDE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are taken as UTF-8 bytes, null as empty; texts shorter than `length` are kept. All copies of a repeated text
    go, as strings are judged on the input. `kept` is what is left, decoded without broken characters; it is null where
    nothing was removed. Rows with a null doc_id are left out; of rows with one doc_id the least text counts, once. No rows
    give no rows. Extra columns are ignored.
    """
    documents = bounded_batches(one_per_id(documents))
    spans, copies = repeated_spans(documents, length, wide)
    spans = stored(spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    texts = documents.select("doc_id", "text")
    cut = with_ids(texts, spans.select("doc_id")).join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept string")
    known = copies.select("doc_id", "n_bytes", ((F.col("copies") > 1) & (F.col("n_bytes") >= length)).alias("gone"))
    intact = texts.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    rows = intact.join(known, "doc_id").join(cut, "doc_id", "left")
    pick = lambda gone, name, other: F.when(F.col("gone"), gone).otherwise(F.coalesce(F.col(name), other)).alias(name)
    return rows.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0).cast("long")), pick(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")),
        pick(F.sha2(F.lit(""), 256), "kept_sha256", F.col("sha")), F.when(F.col("gone"), "").otherwise(F.col("kept")).alias("kept"),
    )


def cut_documents(documents: DataFrame, length: int = 200) -> DataFrame:
    """documents with their repeats cut out of text and n_chars set anew; those of which only white space is left go. Each row
    is a document, also one whose doc_id is null or that of other rows too."""
    return by_row(documents, lambda rows: _cut_rows(rows, length))


def _cut_rows(documents: DataFrame, length: int) -> DataFrame:
    cut = stored(cut_repeats(documents, length).where("n_removed > 0").select("doc_id", "kept"))
    kept = with_ids(documents.drop("text"), cut.select("doc_id")).join(cut.where("kept rlike '[^ \\\\t\\\\n\\\\r]'"), "doc_id")
    kept = kept.select(*[F.col("kept").alias("text") if c == "text" else F.char_length("kept").cast("long").alias(c) if c == "n_chars" else c for c in documents.columns])
    return without_ids(documents, cut.select("doc_id")).select(documents.columns).unionByName(kept)
