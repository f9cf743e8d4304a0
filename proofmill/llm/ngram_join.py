"""N-gram Jaccard join: exact set similarity join over word shingles by skipping along set relations.

Index lists are ordered by set size and carry positions. What a set's own size and position rule out is the end of a
list; of the rest, blocks in which no entry's position allows a set of that size are skipped as a whole. A set that is
highly similar to another (its pivot) takes over that set's answers.

1. Equal sets fall into one class by a 128-bit signature; their least doc_id stands for them in all that follows.
2. Each set is compared with the pivots it shares most min-hash slots with; verified links give classes (components).
3. Every set lists its prefix (rarest shingles first). A list whose entries all are of one class is skipped whole, as
   its answers follow from the class; of the others only pairs between classes that pass the bounds are kept.
4. Such a pair's answer is derived from its pivots': the overlap of two pivots differs from that of two sets by no more
   than what the sets and their pivots don't share. Where that doesn't decide, the two sets are compared.
5. Components over all links.

Every link at or above the threshold joins two documents of one component; none is lost: a pair of sets that isn't
found in step 3 either is in one class already or can't reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, distinct, hashed_words, mixed, one_per_id, shingle_hashes, signed, stored, tidy, with_ids, without_ids
from .components import components

#: Min-hash slots of a set; so many pivots at most are compared with it; slots that must agree before that.
SLOTS, PIVOTS, AGREE = 8, 2, 3
#: The prefix order puts at most so many of the most frequent shingles last (2 MB for each task); any choice gives the same links.
FREQUENT, OFTEN = 1 << 18, 8
_RANGES = 256
#: Entries of a list that are skipped together.
ENTRIES = 64
#: Groups of shingles by hash; what two sets' counts by group have in common bounds their overlap from above.
GROUPS = 256


def need(total, pct: int):
    """Least overlap of two sets of `total` elements together at which 100 * overlap >= pct * union."""
    return -((-pct * total) // (100 + pct))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, words in hashed_words(batch.column("text")):
        yield row, distinct(shingle_hashes(words, k))


def _sketches(k: int):
    """A row for each document: set size, signature, the least hash of each min-hash slot, and how its elements spread over
    GROUPS groups by hash."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, s1, s2, slots, spread = [], [], [], [], []
            for _, s in _sets(batch, k):
                x = mixed(s + np.uint64(len(s)))
                slot = s & np.uint64(SLOTS - 1)
                firsts = [i for j in range(SLOTS) for i in np.flatnonzero(slot == j)[:1]]
                size.append(len(s))
                s1.append(x.sum(dtype=np.uint64))
                s2.append(np.bitwise_xor.reduce(mixed(x ^ np.uint64(0x5BD1E995))) if len(s) else np.uint64(0))
                slots.append(signed(s[firsts]))
                spread.append(np.minimum(np.bincount((s >> np.uint64(8)) & np.uint64(GROUPS - 1), minlength=GROUPS), 0xFFFF).astype(np.uint16).tobytes())
            halves = [pa.array(signed(np.array(x, np.uint64))) for x in (s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), *halves, pa.array(slots, pa.list_(pa.int64())), pa.array(spread, pa.binary())], ["doc_id", "n", "s1", "s2", "slots", "spread"])

    return run


_BLOB = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def _halves(k: int):
    """The sorted high halves of all shingles' hashes, for counting, as a blob for each of some ranges."""

    def blobs(bag: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(bag))
        cut = np.searchsorted(x, np.arange(_RANGES + 1, dtype=np.uint64) << np.uint64(24))
        parts = [i for i in range(_RANGES) if cut[i + 1] > cut[i]]
        return pa.RecordBatch.from_pydict({"part": parts, "blob": [x[cut[i] : cut[i + 1]].tobytes() for i in parts]}, _BLOB)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag: list[np.ndarray] = []
        for batch in batches:
            for _, s in _sets(batch, k):
                bag.append((s >> np.uint64(32)).astype(np.uint32))
            if sum(map(len, bag)) > 4_000_000:
                yield blobs(bag)
                bag = []
        if bag:
            yield blobs(bag)

    return run


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of one range, end to end in part order, to frequent half hashes and their counts."""

    def flush(bag: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(bag), return_counts=True)
        h, c = h[c >= OFTEN], c[c >= OFTEN]
        return pa.RecordBatch.from_pydict({"h": h.astype(np.int64), "c": c.astype(np.int64)}, pa.schema([("h", pa.int64()), ("c", pa.int64())]))

    part, bag = None, []
    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
            if p != part and bag:
                yield flush(bag)
                bag = []
            part = p
            bag.append(np.frombuffer(blob.as_buffer(), np.uint32).copy())
    if bag:
        yield flush(bag)


def _prefixes(k: int, pct: int, often):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, counts = often.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            token, doc, size, place = [], [], [], []
            for row, s in _sets(batch, k):
                n = len(s)
                if not n:
                    continue
                half = (s >> np.uint64(32)).astype(np.uint32)
                i = np.minimum(np.searchsorted(halves, half), max(0, len(halves) - 1))
                c = np.where(halves[i] == half, counts[i], 0) if len(halves) else np.zeros(n, np.int64)
                m = n + (-pct * n // 100) + 1
                first = np.argsort(c, kind="stable")[:m]  # s is sorted: ties go by hash
                token.append(signed(s[first]))
                doc.append(np.full(m, ids[row], np.int64))
                size.append(np.full(m, n, np.int32))
                place.append(np.arange(m, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, doc, size, place)], ["token", "doc_id", "n", "place"])

    return run


def of_list(doc: np.ndarray, kind: np.ndarray, n: np.ndarray, place: np.ndarray, pct: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different classes in a list, by rising size, that pass the size and position bounds."""
    far = (n - place) * (100 + pct) // pct - n  # the largest partner that an entry's position allows
    end = np.searchsorted(n, np.minimum(100 * n // pct, far), "right")
    blocks = np.arange(0, len(n), ENTRIES)
    farthest, lo, hi = np.maximum.reduceat(far, blocks), np.minimum.reduceat(kind, blocks), np.maximum.reduceat(kind, blocks)
    for i in range(len(n) - 1):
        if end[i] <= i + 1:
            continue
        first, last = (i + 1) // ENTRIES, (int(end[i]) - 1) // ENTRIES + 1
        open_ = np.flatnonzero((farthest[first:last] >= n[i]) & ((lo[first:last] != kind[i]) | (hi[first:last] != kind[i]))) + first
        j = (open_[:, None] * ENTRIES + np.arange(ENTRIES)).reshape(-1)
        j = j[(j > i) & (j < end[i])]
        other = doc[j[(far[j] >= n[i]) & (kind[j] != kind[i])]]
        if len(other):
            yield np.minimum(other, doc[i]), np.maximum(other, doc[i])


def _crossing(pct: int):
    """Pairs of each list (of_list). Lists come end to end, by rising size."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ("token", "doc_id", "kind", "n", "place")

        def emit(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.diff(columns[0])) + 1
            pairs = [p for a, b in zip([0, *edges], [*edges, len(columns[0])], strict=True) for p in of_list(*(c[a:b] for c in columns[1:]), pct)]
            if pairs:
                both = np.unique(np.stack([np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            now = [batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on
            yield from emit([c[:last] for c in now]) if last else ()
            held = [c[last:] for c in now]
        if held:
            yield from emit(held)

    return run


def _set_rows(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for _, s in _sets(batch, k)], pa.binary())], ["doc_id", "elements"])

    return run


@tidy
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            i = np.searchsorted(q, p)
            i[i == len(q)] = 0
            found.append(((q[i] == p).sum() if len(q) else 0, len(p) + len(q)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([int(o) for o, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], ["a", "b", "o", "total"])


def _within(pct: int):
    """Pairs whose overlap, as their counts by group bound it, may reach the threshold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, GROUPS).astype(np.int64) for c in ("x", "y"))
            total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            full = (x == 0xFFFF).any(1) | (y == 0xFFFF).any(1)  # such counts may be higher
            ok = pa.array(full | (np.minimum(x, y).sum(1) >= need(total, pct)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    return run


def overlaps(documents: DataFrame, docs: DataFrame, pairs: DataFrame, k: int, pct: int) -> DataFrame:
    """(a, b, o, total): overlap and sum of the sizes of those pairs (a, b), a stored table, that may reach the threshold,
    from their whole sets. docs: the sketches."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    spread = with_ids(docs.select("doc_id", "n", "spread"), ids)
    near = pairs.join(spread.toDF("a", "n", "x"), "a").join(spread.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    near = stored(near.mapInArrow(_within(pct), "a long, b long"))
    ids = stored(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = stored(with_ids(documents, ids).mapInArrow(_set_rows(k), "doc_id long, elements binary"))
    both = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_overlaps, "a long, b long, o long, total long")


def _linked(o: Column, total: Column, pct: int) -> Column:
    return F.lit(100) * o >= F.lit(pct) * (total - o)


def derived(cross: DataFrame, found: DataFrame, near: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """(links, open) of the pairs (a, b) in cross, from the overlaps found (a, b, o) between their pivots and near (doc_id,
    pivot, n, lost, more): what a set lacks of its pivot and has beyond it. A pair without overlap found stays open."""
    of = lambda x: near.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("pivot", "n", "lost", "more")])
    pairs = cross.join(of("a"), "a").join(of("b"), "b").withColumns({"p": F.least("pivot_a", "pivot_b"), "q": F.greatest("pivot_a", "pivot_b")})
    pairs = pairs.join(found.select(F.col("a").alias("p"), F.col("b").alias("q"), "o"), ["p", "q"], "left")
    total = F.col("n_a") + F.col("n_b")
    least, most = F.col("o") - F.col("lost_a") - F.col("lost_b"), F.col("o") + F.col("more_a") + F.col("more_b")
    sure, never = F.coalesce(_linked(least, total, pct), F.lit(False)), F.coalesce(~_linked(most, total, pct), F.lit(False))
    pairs = stored(pairs.select("a", "b", sure.alias("sure"), never.alias("never")))
    return pairs.where("sure").select("a", "b"), pairs.where("not sure and not never").select("a", "b")


def jaccard_classes(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; a set is its distinct k-word shingles, or the
    whole sequence if there are fewer words. Null or blank texts have the empty set, link with nothing and are a
    component of their own. Rows with a null doc_id are left out; of rows with one doc_id the least text counts, once. No
    rows give no rows. Other columns are ignored. Sets are compared by 64-bit hashes of shingles.
    """
    documents = bounded_batches(one_per_id(documents))
    spark = documents.sparkSession
    docs = stored(documents.mapInArrow(_sketches(k), "doc_id long, n long, s1 long, s2 long, slots array<long>, spread binary"))

    # 1. equal sets
    key = ["n", "s1", "s2"]
    full = docs.where("n > 0")
    reps = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("slots", "doc_id").alias("slots"))
    member = stored(full.select("doc_id", *key).join(reps.drop("slots"), key).select("doc_id", "n", "rep").distinct())

    # 2. pivots
    reps = stored(reps.select("rep", F.posexplode(F.transform("slots", lambda h: h)).alias("i", "h")))
    pivots = reps.groupBy("h").agg(F.min("rep").alias("p"), F.min_by("rep", F.xxhash64("rep")).alias("q"), F.count("*").alias("c")).where("c > 1")
    near = reps.join(pivots, "h").select("rep", F.explode(F.array_distinct(F.array("p", "q"))).alias("pivot")).where("rep <> pivot")
    near = near.groupBy("rep", "pivot").agg(F.count("*").alias("c")).where(F.col("c") >= AGREE)
    best = Window.partitionBy("rep").orderBy(F.desc("c"), "pivot")
    near = near.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PIVOTS)
    near = stored(near.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct())
    found = stored(overlaps(documents, docs, near, k, percent))
    linked = _linked(F.col("o"), F.col("total"), percent)
    links = found.where(linked).select("a", "b")
    kinds = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    # 3. lists
    documents = without_ids(documents, stored(member.where("doc_id <> rep").select("doc_id")))
    counts = documents.mapInArrow(_halves(k), "part int, blob binary").repartition("part").sortWithinPartitions("part").mapInArrow(_counted, "h long, c long")
    often = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas().sort_values("h")
    often = spark.sparkContext.broadcast((often["h"].to_numpy().astype(np.uint32), often["c"].to_numpy().astype(np.int64)))
    lists = documents.mapInArrow(_prefixes(k, percent, often), "token long, doc_id long, n int, place int")
    in_list = Window.partitionBy("token")
    shared = lists.withColumn("m", F.count("*").over(in_list)).where("m > 1").drop("m")
    shared = shared.join(kinds, shared.doc_id == kinds.node, "left").withColumn("kind", F.coalesce("component", "doc_id"))
    shared = shared.withColumns({"lo": F.min("kind").over(in_list), "hi": F.max("kind").over(in_list)}).where("lo <> hi")
    cross = shared.select("token", "doc_id", "kind", "n", "place").repartition("token").sortWithinPartitions("token", "n", "doc_id")
    cross = stored(cross.mapInArrow(_crossing(percent), "a long, b long").distinct())

    # 4. answers from pivots: of a set's links the one with the least doc_id is its pivot's; a set without one is its own
    sizes = docs.select("doc_id", "n")
    ends = stored(cross.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    pivot = found.where(linked).groupBy(F.col("b").alias("doc_id")).agg(F.min_by(F.struct(F.col("a").alias("pivot"), "o", "total"), "a").alias("p"))
    near = with_ids(sizes, ends).join(pivot, "doc_id", "left").select("doc_id", "n", F.coalesce("p.pivot", "doc_id").alias("pivot"), F.coalesce(F.col("p.total") - F.col("n") - F.col("p.o"), F.lit(0)).alias("lost"), F.coalesce(F.col("n") - F.col("p.o"), F.lit(0)).alias("more"))
    near = stored(near)
    of = lambda x: near.select(F.col("doc_id").alias(x), F.col("pivot").alias(f"p{x}"))
    heads = cross.join(of("a"), "a").join(of("b"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    found = stored(overlaps(documents, docs, stored(heads), k, percent))
    sure, rest = derived(cross, found, near, percent)
    rest = rest.join(found.select("a", "b"), ["a", "b"], "left_anti")
    more = found.where(linked).select("a", "b").unionByName(sure).unionByName(overlaps(documents, docs, stored(rest), k, percent).where(linked).select("a", "b"))

    # 5. components of both
    joined = kinds.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    whole = components(joined)
    found = member.join(whole, member.rep == whole.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return found.unionByName(docs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")).distinct())
