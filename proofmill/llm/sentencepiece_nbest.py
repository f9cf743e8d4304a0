"""SentencePiece encoding and decoding: the N best segmentations over the piece lattice.

Text gets a space in front, and pieces are spelled with spaces where the model writes U+2581. The lattice falls apart
before each space, and likewise between any two ASCII characters, unless some piece has both side by side (as the pieces
of several spaces have): a text's segmentation is one of each of its words, as these parts are called here.
Within a word, forward Viterbi scores are worked out for all positions; searching backward from the word's end
by A-star they are the exact value of what is left, so segmentations come out in order of their scores. Over a text,
the same search runs on words: the exact loss of each word's second best path (from forward and backward scores) says
which few words can differ in the N best.

Characters without a piece are written as byte pieces at a score below all others. Decoding joins pieces' bytes.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, bounded_batches, tidy
from .trie import Trie, laid_out
from .words import WordMemory

SPACE = "▁"
_LOW = -1e300
#: Words are worked out so many, or so many bytes of them, at once; so many are remembered, with so many bytes of words and ids.
_AT_ONCE, _BYTES_AT_ONCE, MOST, MOST_BYTES = 2_000, 1 << 16, 250_000, 1 << 25
#: Texts are encoded so many, or so many bytes of them, at once.
_ROWS, _ROW_BYTES = 256, 1 << 20


class Pieces:
    """The model's pieces as bytes with their scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [b""] * n
        self.scores = np.zeros(n)
        self.of_byte = [0] * 256
        normal = []
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.of_byte[int(text[3:5], 16)] = i
                self.bytes[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
                self.bytes[i] = text.replace(SPACE, " ").encode()
                self.scores[i] = model.get_score(i)
        self.numbers = np.array(normal, np.int64)
        usable = self.scores[self.numbers]
        self.odd = float(usable[usable > -1e8].min()) - 10.0  # for each byte of a character without a piece
        self.trie = Trie([tuple(self.bytes[i]) for i in normal])
        self.trie.children = []  # the arrays are enough
        self.apart = np.zeros((256, 256), bool)  # whether two bytes are parted
        self.apart[:128, :128] = True
        self.apart[:, 32] = True
        for i in normal:
            plain = np.frombuffer(self.bytes[i], np.uint8)
            self.apart[plain[:-1], plain[1:]] = False
        self.apart = self.apart.reshape(-1)

    def split(self, text: str) -> list[bytes]:
        """A text's words, with a space in front of the text."""
        data = np.frombuffer(b" " + text.encode(), np.uint8)
        to = np.arange(len(data))
        to[1:] += np.cumsum(self.apart[data[:-1].astype(np.int32) * 256 + data[1:]])
        out = np.full(to[-1] + 1, 255, np.uint8)  # no byte of UTF-8
        out[to] = data
        return out.tobytes().split(b"\xff")


class Lattices:
    """The lattices of many words: edges by (end, start), forward and backward scores of all positions."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.pieces = pieces
        symbols, self.start = laid_out(words)
        self.size = np.array([len(w) for w in words], np.int64)
        lead = (symbols < 256) & ((symbols & 0xC0) != 0x80)
        at = np.flatnonzero(lead)
        width = np.where(symbols[at] < 0x80, 1, np.where(symbols[at] < 0xE0, 2, np.where(symbols[at] < 0xF0, 3, 4)))
        single = np.zeros(len(at), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live, node, to = np.arange(len(at)), np.zeros(len(at), np.int64), at.copy()
        while len(live):
            node = pieces.trie.step(node, symbols[to])
            on = node >= 0
            live, node, to = live[on], node[on], to[on] + 1
            number = pieces.trie.numbers[node]
            hit = number >= 0
            found.append((at[live[hit]], to[hit], pieces.numbers[number[hit]]))
            single[live[hit & (to - at[live] == width[live])]] = True
        lone = np.flatnonzero(~single)
        found.append((at[lone], at[lone] + width[lone], np.full(len(lone), -1)))
        self.a, self.b, self.piece = (np.concatenate(x) for x in zip(*found, strict=True))
        self.score = np.where(self.piece >= 0, pieces.scores[self.piece], pieces.odd * (self.b - self.a))
        self.owner = np.searchsorted(self.start, self.a, "right") - 1
        self.forward = self._swept(len(symbols), self.a, self.b, self.b - self.start[self.owner], self.start)
        self.backward = self._swept(len(symbols), self.b, self.a, (self.start + self.size)[self.owner] - self.a, self.start + self.size)
        self.into = np.argsort(self.b, kind="stable")
        self.into_at = np.searchsorted(self.b[self.into], np.arange(len(symbols) + 1))

    def _swept(self, n: int, source: np.ndarray, target: np.ndarray, depth: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Best scores from zero to all positions, all words' positions of one depth at a time."""
        value = np.full(n, _LOW)
        value[zero] = 0.0
        by = np.lexsort((target, depth))
        source, target, depth, score = source[by], target[by], depth[by], self.score[by]
        cut = np.flatnonzero(np.diff(depth)) + 1
        for x, y in zip([0, *cut], [*cut, len(depth)], strict=True):
            if y > x:
                reach = value[source[x:y]] + score[x:y]
                heads = np.flatnonzero(np.concatenate(([True], np.diff(target[x:y]) != 0)))
                value[target[x + heads]] = np.maximum.reduceat(reach, heads)
        return value

    def nbest(self, k: int, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, edges) of word k: A-star from its end backward, with the forward scores as what is left."""
        first, last = int(self.start[k]), int(self.start[k] + self.size[k])
        heap: list = [(-float(self.forward[last]), 0, last, 0.0, None)]  # what is done has a score, and links from edge to edge
        out, tick = [], 0
        while heap and len(out) < n:
            _, _, at, done, link = heapq.heappop(heap)
            if at == first:
                edges = []
                while link:
                    edge, link = link
                    edges.append(edge)
                out.append((done, edges))
                continue
            for e in self.into[self.into_at[at] : self.into_at[at + 1]].tolist():
                tick += 1
                now = done + float(self.score[e])
                heapq.heappush(heap, (-(float(self.forward[self.a[e]]) + now), tick, int(self.a[e]), now, (e, link)))
        return out

    def best(self) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """(edges, score, loss of the second best path) of each word, its losses infinite where there is but one path."""
        through = self.forward[self.a] + self.score + self.backward[self.b]
        top = self.forward[self.start + self.size]
        lead = np.full(len(self.forward), -1)  # for each position the edge of its best path: of ties the longest
        reach = self.forward[self.a] + self.score
        good = np.flatnonzero(reach >= self.forward[self.b])
        good = good[np.argsort(-self.a[good], kind="stable")]
        lead[self.b[good]] = good
        on = np.zeros(len(self.a), bool)
        at = self.start + self.size
        paths: list[list[int]] = [[] for _ in self.start]
        live = np.flatnonzero(self.size > 0)
        while len(live):
            e = lead[at[live]]
            on[e] = True
            for k, x in zip(live.tolist(), e.tolist(), strict=True):
                paths[k].append(x)
            at[live] = self.a[e]
            live = live[at[live] > self.start[live]]
        loss = np.full(len(self.start), np.inf)
        np.minimum.at(loss, self.owner[~on], np.maximum(0.0, (top[self.owner] - through)[~on]))
        return [p[::-1] for p in paths], top, loss

    def ids(self, edges: list[int]) -> list[int]:
        out: list[int] = []
        for e in edges:
            piece = int(self.piece[e])
            if piece >= 0:
                out.append(piece)
            else:
                k = int(self.owner[e])
                out += [self.pieces.of_byte[b] for b in self.words[k][self.a[e] - self.start[k] : self.b[e] - self.start[k]]]
        return out


def lattices(pieces: Pieces, words: list[bytes]) -> Lattices:
    made = Lattices(pieces, words)
    made.words = words
    return made


def portions(words: list, most: int, most_bytes: int) -> Iterator[list]:
    """words in order, in runs of at most so many and so many bytes; one that is longer stands alone."""
    part: list = []
    held = 0
    for w in words:
        if part and (len(part) == most or held + len(w) > most_bytes):
            yield part
            part, held = [], 0
        part.append(w)
        held += len(w)
    if part:
        yield part


def combined(choices: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of one loss from each ascending list, with the choices made."""
    heap, out, seen = [(sum(c[0] for c in choices), (0,) * len(choices))], [], {(0,) * len(choices)}
    while heap and len(out) < n:
        total, pick = heapq.heappop(heap)
        out.append((total, pick))
        for i, c in enumerate(choices):
            if pick[i] + 1 < len(c):
                new = (*pick[:i], pick[i] + 1, *pick[i + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (total - c[pick[i]] + c[pick[i] + 1], new))
    return out


class Encoder:
    """What has been worked out for words lies in a few arrays: where a word is in them, its ids' end, score and loss of the
    second best path. Beyond MOST words or MOST_BYTES it starts afresh, which costs time only."""

    def __init__(self, path: str, n: int):
        self.pieces, self.n = Pieces(path), n
        self.more = WordMemory(self._ranked, 20_000)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.end, self.score, self.loss = array("I"), array("q"), array("d"), array("d")
        self.more.clear()

    def _know(self, words: set[bytes]) -> None:
        new = list(words.difference(self.place))
        if self.place and (len(self.place) + len(new) > MOST or self.held > MOST_BYTES):
            self.forget()
            new = list(words)
        for part in portions(new, _AT_ONCE, _BYTES_AT_ONCE):
            made = lattices(self.pieces, part)
            paths, top, loss = made.best()
            plain = made.piece.tolist()
            for word, path in zip(part, paths, strict=True):
                ids = [plain[e] for e in path]
                self.place[word] = len(self.place)
                self.ids.extend(made.ids(path) if -1 in ids else ids)
                self.held += len(word) + 4 * len(ids)
                self.end.append(len(self.ids))
            self.score.extend(top.tolist())
            self.loss.extend(loss.tolist())

    def _ranked(self, words: list[bytes]) -> list[list[tuple[float, bytes]]]:
        return [r for part in portions(words, _AT_ONCE, _BYTES_AT_ONCE) for r in self._ranked_at_once(part)]

    def _ranked_at_once(self, words: list[bytes]) -> list[list[tuple[float, bytes]]]:
        made = lattices(self.pieces, words)
        out = []
        for k, path in enumerate(made.best()[0]):
            others = [x for x in made.nbest(k, self.n) if x[1] != path]
            ranked = [(float(made.score[path].sum()), path), *others][: self.n]
            out.append([(score, np.array(made.ids(edges), np.uint32).tobytes()) for score, edges in ranked])
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """For each text its N best (score, ids), best first; of an empty text one, without ids."""
        split = [self.pieces.split(t) if t else [] for t in texts]
        self._know({w for words in split for w in words})
        pool, end, score, loss = map(np.asarray, (self.ids, self.end, self.score, self.loss))  # views, which end with this call
        size = np.diff(end, prepend=0)
        places = [np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)) for words in split]
        some: list[list[int]] = []
        for at in places:
            few = np.lexsort((np.arange(len(at)), loss[at]))[: self.n - 1]
            some.append([i for i in sorted(few.tolist()) if np.isfinite(loss[at[i]])])
        self.more.know(words[i] for words, few in zip(split, some, strict=True) for i in few)
        out = []
        for words, at, few in zip(split, places, some, strict=True):
            upto = np.cumsum(size[at])
            from_pool = np.repeat(end[at] - upto, size[at]) + np.arange(upto[-1] if len(at) else 0)
            spans = [(int(upto[i] - size[at[i]]), int(upto[i])) for i in few]
            out.append(self._combined(pool[from_pool].tobytes(), float(score[at].sum()), spans, [self.more[words[i]] for i in few]))
        return out

    def _combined(self, best: bytes, score: float, spans: list[tuple[int, int]], ranked: list[list[tuple[float, bytes]]]) -> list[tuple[float, bytes]]:
        """The n best of a text, from its best ids and the ranked ways to write the words at some spans of them."""
        out = [(score, best)]
        for total, pick in combined([[r[0][0] - s for s, _ in r] for r in ranked], self.n)[1:]:
            parts, at = [], 0
            for (a, b), r, p in zip(spans, ranked, pick, strict=True):
                parts += [best[4 * at : 4 * a], r[p][1]]
                at = b
            out.append((score - total, b"".join([*parts, best[4 * at :]])))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join([*map(self.pieces.bytes.__getitem__, np.frombuffer(ids, np.uint32).tolist())])[1:].decode("utf-8", "replace")


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, n: int) -> Encoder:
    if (path, n) not in _encoders:
        _encoders[path, n] = Encoder(path, n)
    return _encoders[path, n]


def _encoded(path: str, n: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, n)
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for texts in portions([t or "" for t in batch.column("text").to_pylist()], _ROWS, _ROW_BYTES):
                ranked = own.encode(texts)
                a, at = at, at + len(texts)
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(texts)), pa.array([[s for s, _ in r] for r in ranked], pa.list_(pa.float64())), pa.array([[len(x) // 4 for _, x in r] for r in ranked], pa.list_(pa.int64())), binary_array([r[0][1] for r in ranked]), pa.array([[zlib.crc32(x) for _, x in r] for r in ranked], pa.list_(pa.int64())), pa.array([own.decode(r[0][1]) == t for r, t in zip(ranked, texts, strict=True)])], ["doc_id", "scores", "sizes", "ids", "crcs", "restored"])
        own.forget()

    return run


def encode_nbest(documents: DataFrame, model: str, n: int = 4) -> DataFrame:
    """One row per row of documents: doc_id, scores, sizes, ids, crcs, restored.

    scores, sizes and crcs (of the ids) have an entry for each of the n best segmentations there are, best first; ids are
    the best one's, as little-endian unsigned 32-bit integers; restored says whether decoding them gives the text. Null
    texts are empty: one segmentation of no pieces. Other columns are ignored.
    """
    return bounded_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoded(model, n), "doc_id long, scores array<double>, sizes array<long>, ids binary, crcs array<long>, restored boolean")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from the ids of encode_nbest."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model, 1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
