"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks, verified exactly.

Every window of an item's size gets a SimHash of BITS bits over its weighted shingles, rolled along the document, unless
the shingles that it shares with all items of that size together weigh too little for any of them to be similar. The
fingerprint is cut into BLOCKS blocks of 16 bits, each with an index of its own: two fingerprints within RADIUS bits differ
by at most RADIUS // BLOCKS bits in some block, and an item is listed under all values that near to its block's value, so
that one look-up in each index finds every item of the window's size within the radius. Found items are verified by the weighted Jaccard
similarity of the two bags of shingles. A shingle's weight is counted over all items, whatever pass they are compared in.
A text of fewer words than a shingle's is one shingle, its whole sequence of words, so an item that short is similar to
the windows that equal it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, distinct, hashed_words, mixed, shingle_hashes, signed, tidy

#: At a similarity of 0.75 the expected distance is 22 of 128 bits, with a deviation of 4.3: the radius is four deviations above.
BITS, BLOCKS, RADIUS = 128, 8, 39
#: Items are compared so many at a time; a task holds one such set, of which the indexes take 80 KB an item.
ITEMS = 1_000
#: Weights in fingerprints are whole numbers of this part of one, so that sums are exact in any order.
UNIT = 1 << 20
_FOLD = LOWER.copy()
_FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_COUNT = np.unpackbits(np.arange(1 << 16, dtype=np.uint16).view(np.uint8).reshape(-1, 2), axis=1).sum(1).astype(np.uint8)
_NEAR = np.flatnonzero(_COUNT <= RADIUS // BLOCKS).astype(np.uint16)


def simhashes(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints, as BLOCKS numbers of 16 bits, of the windows of `size` shingles at sorted `starts`; shingles that no
    window covers are left out of the sums."""
    out = np.zeros((len(starts), BITS // 8), np.uint8)
    for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > size) + 1):
        if not len(part):
            continue
        at = starts[part] - starts[part[0]]
        own = shingles[starts[part[0]] : starts[part[-1]] + size]
        heavy = np.round(weights[starts[part[0]] : starts[part[-1]] + size] * UNIT).astype(np.int64)[:, None]
        raw = np.concatenate([own[:, None], mixed(own ^ np.uint64(0xD6E8FEB86659FD93))[:, None]], axis=1).view(np.uint8)
        for b in range(BITS // 8):  # eight bits at a time: sums take 64 bytes a shingle
            sums = np.zeros((len(own) + 1, 8), np.int64)
            np.cumsum(np.where(np.unpackbits(raw[:, b : b + 1], axis=1), heavy, -heavy), axis=0, out=sums[1:])
            out[part, b] = np.packbits(sums[at + size] - sums[at] > 0, axis=1)[:, 0]
    return out.view(np.uint16)


class HammingBlocks:
    """Indexes of fingerprints by each of their blocks; items are in the order of their size."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        item = np.arange(len(prints), dtype=np.uint32)[:, None]
        self.lists = [np.sort(((prints[:, b, None] ^ _NEAR).astype(np.uint32) << 16 | item).ravel()) for b in range(BLOCKS)]

    def looked_up(self, prints: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of prints, item), each once, of the items from `first` to before `end` that are near in some block."""
        pairs = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            value = prints[:, b].astype(np.uint32) << 16
            lo, hi = np.searchsorted(self.lists[b], value | np.uint32(first)), np.searchsorted(self.lists[b], value | np.uint32(end))
            many = hi - lo
            row = np.repeat(np.arange(len(prints)), many)
            place = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(row))
            pairs.append(row << 16 | (self.lists[b][place] & 0xFFFF).astype(np.int64))
        found = distinct(np.concatenate(pairs))
        return found >> 16, found & 0xFFFF

    def within(self, prints: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of prints, item) of these items within RADIUS bits."""
        row, item = self.looked_up(prints, first, end)
        near = _COUNT[prints[row] ^ self.prints[item]].sum(1, dtype=np.int64) <= RADIUS
        return row[near], item[near]


class Items:
    """Benchmark items, their shingles, fingerprints and Hamming blocks."""

    def __init__(self, ids: list[int], texts: list[str], k: int, threshold: float, common: np.ndarray, spread: np.ndarray):
        """common: sorted shingles of several items, among all there are; spread: of how many."""
        self.k, self.threshold = k, threshold
        words = [w for _, w in hashed_words(pa.array(texts, pa.string()), _FOLD)]
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(words):
            if 0 < len(w) < k:
                self.short.setdefault(len(w), {}).setdefault(int(shingle_hashes(w, k)[0]), []).append(ids[i])
        keep = sorted((i for i, w in enumerate(words) if len(w) >= k), key=lambda i: len(words[i]))
        self.ids, self.sizes = [ids[i] for i in keep], np.array([len(words[i]) for i in keep], np.int64)
        bags = [shingle_hashes(words[i], k) for i in keep]
        self.common, self.spread = common, spread
        self.bags = [self._bag(b) for b in bags]
        self.total = np.array([sum(b.values()) for b in self.bags])
        first = np.zeros(1, np.int64)
        self.index = HammingBlocks(np.concatenate([np.zeros((0, BLOCKS), np.uint16), *(simhashes(b, self.weights(b), first, len(b)) for b in bags)]))
        # (shingle, size) once each, sorted: the shingles that items of a size have
        pairs = sorted({(h, size) for b, size in zip(bags, self.sizes.tolist(), strict=True) for h in b.tolist()})
        self.shingle, self.size_of = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """One over the number of items that a shingle is in; 1 if it is in none."""
        if not len(self.common):
            return np.ones(len(shingles))
        i = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        return np.where(self.common[i] == shingles, 1 / self.spread[i], 1.0)

    def _bag(self, shingles: np.ndarray) -> dict[int, float]:
        bag: dict[int, float] = Counter()
        for h, w in zip(shingles.tolist(), self.weights(shingles).tolist(), strict=True):
            bag[h] += w
        return bag

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int]]:
        """item -> (similarity, first word) of its best window in a document's words; of equal ones the first."""
        best: dict[int, tuple[float, int]] = {}
        if len(words) < self.k or not len(self.shingle):
            return best
        own = shingle_hashes(words, self.k)
        lo, hi = np.searchsorted(self.shingle, own), np.searchsorted(self.shingle, own, "right")
        hits = np.flatnonzero(hi > lo)
        if not len(hits):
            return best
        weights = self.weights(own)
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        many = (hi - lo)[hits]
        place = np.repeat(hits, many)
        sizes = self.size_of[np.repeat(lo[hits] - (np.cumsum(many) - many), many) + np.arange(len(place))]
        for size in np.unique(sizes).tolist():
            at = place[sizes == size]
            span = min(size, len(words)) - self.k + 1
            begun, total, shared = self._promising(at, weights, sums, span)
            if not len(begun):
                continue
            first, end = np.searchsorted(self.sizes, [size, size + 1])
            row, item = self.index.within(simhashes(own, weights, begun, span), int(first), int(end))
            most = shared[row] / np.maximum(total[row] + self.total[item] - shared[row], 1e-9)
            bags: dict[int, dict[int, float]] = {}
            for j in np.lexsort((row, -most)).tolist():  # the likeliest first; those that can't be better are skipped
                r, i = int(row[j]), int(item[j])
                if most[j] + 1e-9 < max(self.threshold, best.get(i, (0.0, 0))[0]):
                    continue
                start = int(begun[r])
                bag = bags[r] if r in bags else bags.setdefault(r, self._bag(own[start : start + span]))
                both = sum(min(w, bag[h]) for h, w in self.bags[i].items() if h in bag)
                similarity = both / (sum(bag.values()) + self.total[i] - both)
                if similarity >= self.threshold and (i not in best or (similarity, -start) > (best[i][0], -best[i][1])):
                    best[i] = (float(similarity), start)
        return best

    def _promising(self, at: np.ndarray, weights: np.ndarray, sums: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first shingle, weight, weight of the shingles at the sorted places `at`) of each window of `span` shingles whose part
        at those places is no less than the threshold allows: what two bags share is at least that part of either."""
        last = len(weights) - span
        shared = np.concatenate([[0.0], np.cumsum(weights[at])])
        # windows that begin from `low` on and hold a place: runs of starts, each once
        low, high = np.maximum(at - span + 1, 0), np.minimum(at, last)
        low[1:] = np.maximum(low[1:], high[:-1] + 1)
        many = np.maximum(high - low + 1, 0)
        begun = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        total = sums[begun + span] - sums[begun]
        part = shared[np.searchsorted(at, begun + span)] - shared[np.searchsorted(at, begun)]
        good = part >= self.threshold * total - 1e-6
        return begun[good], total[good], part[good]

    def short_matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item's id, first word, words) of the first window that equals an item of fewer than k words."""
        for size, items in self.short.items():
            own = shingle_hashes(words, size) if len(words) >= size else words[:0]
            first = dict(zip(own[::-1].tolist(), range(len(own) - 1, -1, -1), strict=True)) if len(own) else {}
            for h, ids in items.items():
                if h in first:
                    yield from ((i, first[h], size) for i in ids)


def _spread(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different shingles of each item."""
        for batch in batches:
            own = [distinct(shingle_hashes(words, k)) for _, words in hashed_words(batch.column("text"), _FOLD) if len(words) >= k]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *own])))], ["h"])

    return run


def _matched(items):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Items = items.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for row, words in hashed_words(batch.column("text"), _FOLD):
                rows += [(ids[row], held.ids[i], start, int(held.sizes[i]), similarity) for i, (similarity, start) in held.matches(words).items()]
                rows += [(ids[row], i, start, size, 1.0) for i, start, size in held.short_matches(words)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["doc_id", "item_id", "start", "n_words", "similarity"])

    return run


def benchmark_matches(documents: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.75) -> DataFrame:
    """Rows (doc_id, item_id, start, n_words, similarity): the best window of each document for each item it is similar to.

    Words are lower-cased (A-Z) and parted by ASCII white space and punctuation. Items with fewer than k words match where
    all their words follow one another in a document, with similarity 1; null and empty items or documents match nothing. Items
    come in blocks of ITEMS, each compared with all documents in a pass of its own; weights are those of all items, of which
    the driver and each task hold the shingles that several items have. Repeated documents and items are all reported; null doc_ids too.
    Other columns are ignored.
    """
    documents = bounded_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    block: list = []
    found = None
    texts = bounded_batches(benchmark).select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    often = texts.mapInArrow(_spread(k), "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").toPandas()
    common, spread = often["h"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.int64)
    order = np.argsort(common)

    def compared(rows: list) -> DataFrame:
        items = Items([r[0] for r in rows], [r[1] for r in rows], k, threshold, common[order], spread[order])
        shared = documents.sparkSession.sparkContext.broadcast(items)
        return documents.mapInArrow(_matched(shared), "doc_id long, item_id long, start long, n_words long, similarity double")

    for row in texts.orderBy("item_id").toLocalIterator():
        block.append(row)
        if len(block) == ITEMS:
            found = compared(block) if found is None else found.unionByName(compared(block))
            block = []
    if block or found is None:
        found = compared(block) if found is None else found.unionByName(compared(block))
    return found
