"""Token ids as binary tables: Simple-8b word-aligned coding.

A 64-bit word holds a selector in its upper four bits and as many ids as fit at that selector's width in the other 60.
Ids of 60 bits or more are an escape: a word with selector 15, then the id as a word of its own. Ids are coded in blocks
of BLOCK that start on a word; the first word of every block is kept, so that blocks decode at once and on their own.

The table has a row per document, ordered by doc_id within and across its shards: shard, doc_id, n_tokens, words, offsets.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_array, bounded_batches, stored, tidy
from .token_counts import byte_letters
from .words import WordMemory

BLOCK = 256
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 64])
ESCAPE = 15
_ORDER = [*range(14), ESCAPE]


def encode(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of ids (uint64), whose blocks of up to BLOCK ids begin at starts."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    sizes = np.diff(np.append(starts, n))
    across = BLOCK + int(COUNTS[0])  # a row for each block, with zeros behind: they fit any selector and aren't read back
    grid = np.zeros((len(starts), across), np.uint64)
    grid[:, :BLOCK][np.arange(BLOCK) < sizes[:, None]] = ids
    if int(ids.max()) < 1 << 53:  # a float's exponent is the width
        width = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)
    else:
        width = np.zeros(grid.shape, np.uint8)
        for w in range(60):
            width += grid >> np.uint64(w) > 0
        width[grid >> np.uint64(60) > 0] = 64
    spread = {1: width}  # greatest width of so many ids from here on
    while max(spread) * 2 <= COUNTS[0]:
        h = max(spread)
        wider = spread[h].copy()
        np.maximum(wider[:, :-h], spread[h][:, h:], out=wider[:, :-h])
        spread[2 * h] = wider
    choice = np.full(grid.shape, ESCAPE, np.uint8)
    for s in _ORDER[-2::-1]:
        k = int(COUNTS[s])
        h = max(x for x in spread if x <= k)
        fits = np.maximum(spread[h][:, :BLOCK], spread[h][:, k - h : k - h + BLOCK]) <= WIDTHS[s]
        choice[:, :BLOCK][fits] = s
    choice, flat = choice.reshape(-1), grid.reshape(-1)
    found = []
    pos = np.flatnonzero(sizes) * across
    end = pos + sizes[sizes > 0]
    while len(pos):  # one word of every block that goes on
        found.append(pos)
        pos = pos + COUNTS[choice[pos]]
        on = pos < end
        pos, end = pos[on], end[on]
    first = np.sort(np.concatenate(found))
    pick = choice[first].astype(np.int64)
    room = 1 + (pick == ESCAPE)
    slot = np.cumsum(room) - room
    words = np.zeros(int(room.sum()), np.uint64)
    for s in _ORDER[:-1]:
        if len(mine := np.flatnonzero(pick == s)):
            word = np.full(len(mine), s << 60, np.uint64)
            for j in range(COUNTS[s]):
                word |= flat[first[mine] + j] << np.uint64(j * WIDTHS[s])
            words[slot[mine]] = word
    if len(mine := np.flatnonzero(pick == ESCAPE)):
        words[slot[mine]] = np.uint64(ESCAPE << 60)
        words[slot[mine] + 1] = flat[first[mine]]
    return words, np.append(slot, len(words))[np.searchsorted(first, np.arange(len(starts)) * across)]


def decode(words: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of blocks of these sizes, whose first words are at offsets."""
    out = np.zeros(int(sizes.sum()), np.uint64)
    if not len(words):
        return out
    pick = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (pick == ESCAPE).any():  # an escaped id may look like any selector: go from word to word
        i = 0
        for m in np.flatnonzero(pick == ESCAPE):
            if m >= i:
                raw[m + 1] = True
                i = m + 2
    head = np.flatnonzero(~raw)
    pick = pick[head]
    count = COUNTS[pick]
    total = np.cumsum(count) - count
    begin = np.cumsum(sizes) - sizes
    owners = np.flatnonzero(sizes > 0)
    block = owners[np.searchsorted(offsets[owners], head, "right") - 1]
    lead = total[np.searchsorted(head, offsets[owners])]
    shift = np.zeros(len(sizes), np.int64)
    shift[owners] = begin[owners] - lead
    place, limit = total + shift[block], (begin + sizes)[block]
    for s in _ORDER[:-1]:
        if len(mine := np.flatnonzero(pick == s)):
            j = np.arange(COUNTS[s])
            where = place[mine][:, None] + j
            part = (words[head[mine]][:, None] >> (j * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[s])) - 1)
            ok = where < limit[mine][:, None]
            out[where[ok]] = part[ok]
    if len(mine := np.flatnonzero(pick == ESCAPE)):
        out[place[mine]] = words[head[mine] + 1]
    return out


def block_starts(sizes: np.ndarray) -> np.ndarray:
    """Where blocks begin in rows of these sizes, end to end; an empty row has none."""
    begin = np.cumsum(sizes) - sizes
    many = -(-sizes // BLOCK)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(begin, many) + within * BLOCK


#: Characters of plain text: white space, ASCII, Latin letters and general punctuation, none of which normalising joins with another.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ‐-‧]*")
#: The rules of a tokenizer file under which plain text is parted as `_PARTS` parts it, in lower case.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Parts that are remembered, at about 200 bytes each.
PARTS = 700_000


def _plain(text: str) -> bool:
    """Whether text is parted by `_PARTS`; signs of added tokens aren't looked for in it."""
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


class Ids:
    """A tokenizer file's ids of texts, as little-endian 32-bit integers. Under the rules above parts of words are looked up in
    a memory, filled by the model's merges for plain ones and by the whole tokenizer for others; other files encode whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_parts = rules["normalizer"] == _NORMAL and rules["pre_tokenizer"] == _SPLIT and not rules["post_processor"]
        self.by_parts = self.by_parts and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.memory = WordMemory(lambda parts: map(self._part, parts), PARTS)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if _plain(part):
            return array("I", [t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return self.whole(part)

    @staticmethod
    def parts(text: str) -> list[str]:
        """Parts of a text; words with other than plain characters are whole, as nothing is joined over ASCII white space."""
        if _plain(text):
            return _PARTS.findall(text.lower())
        words = (w.decode() for w in text.encode().split())
        return [p for w in words for p in (_PARTS.findall(w.lower()) if _plain(w) else (w,))]

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            return [self.whole(t) for t in texts]
        split = [self.parts(t) for t in texts]
        self.memory.know(p for parts in split for p in parts)
        return [b"".join(map(self.memory.__getitem__, parts)) for parts in split]


_known: dict[str, Ids] = {}


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` together, at least a row each."""
    a = 0
    while a < len(sizes):
        b, total = a + 1, sizes[a]
        while b < len(sizes) and total + sizes[b] <= limit:
            total += sizes[b]
            b += 1
        yield a, b
        a = b


def _encoded(path: str, end_id: int):
    end = np.array([end_id], np.uint32).tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _known:
            _known[path] = Ids(path)
        for batch in batches:
            texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id")
            for a, b in _runs([len(t) for t in texts], 2_000_000):
                flat = [x + end for x in _known[path].of(texts[a:b])]
                sizes = np.array([len(x) // 4 for x in flat])
                starts = block_starts(sizes)
                words, offsets = encode(np.frombuffer(b"".join(flat), np.uint32).astype(np.uint64), starts)
                cut = np.searchsorted(starts, np.cumsum(sizes) - sizes)
                edge = np.append(offsets, len(words))
                parts, tables = [], []
                for i, j in zip(cut, [*cut[1:], len(starts)], strict=True):
                    parts.append(words[edge[i] : edge[j]].tobytes())
                    tables.append((offsets[i:j] - edge[i]).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes, pa.int64()), binary_array(parts), binary_array(tables)], ["doc_id", "n_tokens", "words", "offsets"])

    return run


def read_rows(sizes: np.ndarray, words: list[bytes], offsets: list[bytes]) -> np.ndarray:
    """The ids of rows of the table, end to end, as unsigned 32-bit integers."""
    starts = block_starts(sizes)
    ends = np.append(starts[1:], sizes.sum())
    first = np.concatenate(([0], np.cumsum([len(w) // 8 for w in words])[:-1]))
    base = np.repeat(first, [len(x) // 4 for x in offsets])
    return decode(np.frombuffer(b"".join(words), np.uint64), np.frombuffer(b"".join(offsets), np.uint32) + base, ends - starts).astype(np.uint32)


@tidy
def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
        words, offsets = (batch.column(c).to_pylist() for c in ("words", "offsets"))
        size, crc = [], []
        for a, b in _runs(sizes.tolist(), 500_000):
            ids = read_rows(sizes[a:b], words[a:b], offsets[a:b])
            ends = np.cumsum(sizes[a:b])
            for i, j in zip(ends - sizes[a:b], ends, strict=True):
                size.append(int(j - i))
                crc.append(zlib.crc32(ids[i:j]))
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "n_tokens", "ids_crc32"])


def token_table(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The coded table, in ascending doc_id order. Null texts are empty and have the end id alone; rows keep repeats of
    a doc_id; null doc_ids come first. Other columns are ignored."""
    ordered = bounded_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    coded = ordered.mapInArrow(_encoded(tokenizer, end_id), "doc_id long, n_tokens long, words binary, offsets binary")
    return coded.select(F.spark_partition_id().alias("shard"), "*")


def token_digest(coded: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a coded table, from its decoded words."""
    rows = stored(coded.mapInArrow(_decoded, "shard int, doc_id long, n_tokens long, ids_crc32 long"))
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per file
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("shard").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.withColumn("before", before).join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
