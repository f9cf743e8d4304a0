"""Byte-level BPE: merges compiled into a transducer that is determinised as texts need it; streaming decoding.

A cut of a string into tokens is its encoding exactly if every token encodes as itself and the merges leave each pair of
neighbours apart. So the machine reads bytes and keeps a hypothesis for each place where a token may just have ended: the
encoding up to there, and the bytes since, which must begin some token. One hypothesis has no bytes left over: it is the
encoding of all that was read. What the hypotheses' encodings have in common is decided and leaves the machine at once;
what they don't have in common is a bounded number of tokens. A set of hypotheses after what was decided is a state;
states and steps are made when a text first needs them. A bounded number is kept; beyond that, states are made and forgotten.

Decoding feeds the bytes of ids through a state machine over UTF-8, whose steps over whole tokens are made once a token.
"""

from __future__ import annotations

import base64
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: States that a worker's machine keeps; beyond those it goes on with states that it forgets. Pairs and tokens it remembers.
STATES, PAIRS = 100_000, 300_000
#: Longer matches of the pattern aren't remembered as a whole; of others two generations of so many are.
REMEMBERED, MATCHES = 64, 250_000
#: Ids that the decoder takes at once.
CHUNK = 4096


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank. Every byte must be a token."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    tokens = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"{path} has no token for {len(missing)} of the bytes")
    return tokens


class Merges:
    """What the ranks say of strings and of pairs of tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self._apart: dict[int, bool] = {}
        self._spines: dict[tuple[int, int], list[tuple[bytes, int]] | None] = {}

    def merged(self, parts: list[bytes], below: int | None = None) -> list[bytes]:
        """Parts, after the neighbours of least rank (of those below a rank), leftmost first, are merged until none are left."""
        parts, rank = list(parts), self.rank
        below = len(self.tokens) if below is None else below
        ranks = [rank.get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < below:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ranks.pop(i)
            for j in (i - 1, i):
                if 0 <= j < len(ranks):
                    ranks[j] = rank.get(parts[j] + parts[j + 1], below)
        return parts

    def whole(self, token: int) -> bool:
        """Whether the merges make the token of its own bytes."""
        t = self.tokens[token]
        return len(t) == 1 or len(self.merged([t[i : i + 1] for i in range(len(t))])) == 1

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """The tokens at one end of a token (0: left, 1: right) as its merges make them, the whole token first, each with its
        rank; None if some part has a greater rank than what is made of it."""
        if (token, side) not in self._spines:
            out, t, at = [], self.tokens[token], token
            while len(t) > 1:
                out.append((t, at))
                parts = self.merged([t[i : i + 1] for i in range(len(t))], at)
                if len(parts) != 2 or max((self.rank[p] for p in parts if len(p) > 1), default=-1) > at:
                    out = None
                    break
                t = parts[side]
                at = self.rank[t]
            self._spines[token, side] = None if out is None else [*out, (t, -1)]
        return self._spines[token, side]

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b side by side."""
        key = a * len(self.tokens) + b
        if (known := self._apart.get(key)) is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._left_apart(a, b)
        return known

    def _left_apart(self, a: int, b: int) -> bool:
        """By the spines that meet: whatever stands on both sides of the seam stays until one of them is merged into more.
        Meanwhile a merge of both comes first if its rank is less; of equal ranks the left one comes first."""
        right, left = self.spine(a, 1), self.spine(b, 0)
        if right is None or left is None:  # ranks that don't follow the order of merges
            x, y = self.tokens[a], self.tokens[b]
            return self.merged([bytes([c]) for c in x + y]) == [x, y]
        rank, i, j, end = self.rank, len(right) - 1, len(left) - 1, len(self.tokens)
        while True:
            more_a, more_b = right[i - 1][1] if i else end, left[j - 1][1] if j else end
            across = rank.get(right[i][0] + left[j][0], end)
            if across < more_a and across <= more_b and across < end:
                return False
            if not i and not j:
                return True
            if more_a <= more_b:
                i -= 1
            else:
                j -= 1


class _State:
    """Hypotheses of (last token, or -1; node of the bytes since; tokens that aren't decided), and steps from here.
    Without steps it isn't kept."""

    __slots__ = ("held", "steps")

    def __init__(self, held: tuple, steps: dict | None):
        self.held, self.steps = held, steps

    @property
    def rest(self) -> tuple[int, ...]:
        return self.held[-1][2]  # the hypothesis without bytes left over is the last


class Transducer:
    """encode(piece): the ids of one match of the pattern."""

    def __init__(self, tokens: list[bytes]):
        self.merges = Merges(tokens)
        self.whole: dict[int, bool] = {}
        # a trie of the tokens: node * 256 + byte to node, the token at a node, whether a node has more below it
        self.next: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for i, t in enumerate(tokens):
            node = 0
            for c in t:
                self.inner[node] = True
                to = self.next.get(node * 256 + c)
                if to is None:
                    to = self.next[node * 256 + c] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            if t:
                self.token[node] = i
        self.states: dict[tuple, _State] = {}
        self.lookahead = 0  # the most tokens that weren't decided at once
        self.start = self._state(((-1, 0, ()),))

    def _state(self, held: tuple) -> _State:
        if (known := self.states.get(held)) is None:
            if len(self.states) >= STATES:
                return _State(held, None)
            known = self.states[held] = _State(held, {})
            if len(known.rest) > self.lookahead:
                self.lookahead = len(known.rest)
        return known

    def _ends(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merges.whole(token)
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The state after one more byte, and what that byte decides."""
        now, done, follow, token_at, inner, apart = [], None, self.next, self.token, self.inner, self.merges.apart
        for last, node, tokens in state.held:
            to = follow.get(node * 256 + byte)
            if to is None:
                continue
            if inner[to]:
                now.append((last, to, tokens))
            if done is None:
                token = token_at[to]
                if token >= 0 and (last < 0 or apart(last, token)) and self._ends(token):
                    done = (token, 0, (*tokens, token))
        now.append(done)
        out = now[0][2]
        if out:
            for h in now:
                while h[2][: len(out)] != out:
                    out = out[:-1]
                if not out:
                    break
        if out:
            shared = len(out)
            to = self._state(tuple([(last, node, tokens[shared:]) for last, node, tokens in now]))
        else:
            to = self._state(tuple(now))
        if state.steps is not None and to.steps is not None:
            state.steps[byte] = to, out
        return to, out

    def encode(self, piece: bytes) -> list[int]:
        if (token := self.merges.rank.get(piece)) is not None:
            return [token]
        state, ids = self.start, []
        for byte in piece:
            state, out = (state.steps and state.steps.get(byte)) or self._step(state, byte)
            if out:
                ids += out
        return [*ids, *state.rest]


_kept: dict[str, tuple] = {}


def _of_worker(key: str, make):
    """What a worker makes once for the broadcast of that key."""
    if key not in _kept:
        while len(_kept) > 1:  # a worker may take turns at encoding and decoding
            _kept.pop(next(iter(_kept)))
        _kept[key] = make()
    return _kept[key]


def _latin(name: str) -> str:
    """The characters below U+0100 that a class of the pattern has, as ranges."""
    has = [regex.fullmatch(name, chr(c)) is not None for c in range(256)]
    begins = [c for c in range(256) if has[c] and not (c and has[c - 1])]
    ends = [c for c in range(256) if has[c] and not (c < 255 and has[c + 1])]
    return "".join(f"\\x{a:02x}-\\x{b:02x}" for a, b in zip(begins, ends, strict=True))


def splitters(pattern: str) -> tuple:
    """(of any text, of texts below U+0100): functions from a text to the pattern's matches. Below U+0100 letters, digits and
    spaces are written out, which the plainer of the two libraries takes."""
    classes = {name: _latin(name) for name in (r"\p{L}", r"\p{N}", r"\s")}

    def written(text: str, alone: bool) -> str:
        for name, ranges in classes.items():
            text = text.replace(name, f"[{ranges}]" if alone else ranges)
        return text.replace(r"\S", f"[^{classes[r'\s']}]") if alone else text

    plain = "".join(written(part, alone=i % 2 == 0) for i, part in enumerate(re.split(r"(?<!\\)(\[[^\]]*\])", pattern)))
    any_text = regex.compile(pattern).findall
    return any_text, any_text if re.search(r"\\[pPswdSWDbB]", plain) else re.compile(plain).findall


def split_by(any_text, latin_text, text: str) -> list[str]:
    if text.isascii():
        return latin_text(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return any_text(text)
    return latin_text(text)


class _Matches(dict):
    """A match of the pattern to the bytes of its ids, of four bytes each. Long ones aren't kept. When there are MATCHES, they
    become the old ones, of which those that come again are taken over; the old ones before them go."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = array("i", self.machine.encode(piece.encode())).tobytes()
            if len(piece) > REMEMBERED:
                return ids
        if len(self) >= MATCHES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _encoded(shared, pattern: str):
    key = uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, *split = _of_worker(key, lambda: (_Matches(Transducer(shared.value)), *splitters(pattern)))
        for batch in batches:
            ids = []
            for value in batch.column("text"):
                ids.append(b"".join(map(matches.__getitem__, split_by(*split, value.as_py() or ""))))
            ends = np.cumsum([0, *map(len, ids)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of documents: doc_id, and ids by the ranks in the file at path, each match of pattern separately.

    A match that is a token is that token; others are encoded by merges. Special tokens' strings are ordinary text. Null
    and empty texts have no ids; a null doc_id stays null and repeated rows are rows. Other columns are ignored. What no
    match of the pattern covers (nothing, by the public patterns) has no ids.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = bounded_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encoded(shared, pattern), "doc_id long, ids array<int>")


# ---------------------------------------------------------------- decoding

_ACCEPT, _REJECT = 0, 8
#: State after a lead byte: the bytes it stands for, how many more follow, and the least and the greatest second byte.
_LEADS = ((range(0xC2, 0xE0), 1, 0x80, 0xBF), ((0xE0,), 4, 0xA0, 0xBF), ((0xED,), 5, 0x80, 0x9F), ((*range(0xE1, 0xED), 0xEE, 0xEF), 2, 0x80, 0xBF), ((0xF0,), 6, 0x90, 0xBF), ((0xF4,), 7, 0x80, 0x8F), ((0xF1, 0xF2, 0xF3), 3, 0x80, 0xBF))
_AFTER = {1: _ACCEPT, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 2}


def _utf8_table() -> list[list[int]]:
    """State and byte to state: 0 between characters, 1 to 3 so many bytes to come, 4 to 7 as 2 or 3 with a narrower second byte."""
    table = [[_REJECT] * 256 for _ in range(9)]
    table[_ACCEPT][:128] = [_ACCEPT] * 128
    for leads, state, least, greatest in _LEADS:
        for b in leads:
            table[_ACCEPT][b] = state
        for b in range(least, greatest + 1):
            table[state][b] = _AFTER[state]
    return table


_UTF8 = _utf8_table()


class Decoder:
    """feed(ids) gives the text that is complete so far, close() the rest. Bytes that are no UTF-8 become U+FFFD, one for
    each longest beginning of a character."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.moves = tokens, {}
        self.clean = np.array([self._moved(t)[_ACCEPT] == _ACCEPT for t in tokens], bool)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array(list(map(len, tokens)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.state, self.open = _ACCEPT, b""

    def _moved(self, token: bytes) -> tuple[int, ...]:
        out = []
        for state in range(9):
            for b in token:
                state = _UTF8[state][b]
            out.append(state)
        return tuple(out)

    def _joined(self, ids: np.ndarray) -> str:
        """The text of tokens that begin and end between characters."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes().decode()

    def feed(self, ids: np.ndarray) -> str:
        text = []
        for a in range(0, len(ids), CHUNK):
            part = ids[a : a + CHUNK]
            if self.state == _ACCEPT and self.clean[part].all():
                text.append(self._joined(part))
                continue
            tokens, moves, state, held = self.tokens, self.moves, self.state, [self.open]
            for t in part.tolist():
                held.append(tokens[t])
                move = moves.get(t)
                if move is None:
                    move = moves[t] = self._moved(tokens[t])
                state = move[state]
                if state == _REJECT:
                    text.append(self._mended(b"".join(held)))
                    state, held = self.state, [self.open]
            data = b"".join(held)
            cut = len(data) - self._left_over(data) if state != _ACCEPT else len(data)
            text.append(data[:cut].decode())
            self.state, self.open = state, data[cut:]
        return "".join(text)

    @staticmethod
    def _left_over(data: bytes) -> int:
        """Bytes at the end that begin a character: its lead byte is the last that doesn't continue one."""
        return next(k for k in (1, 2, 3) if data[-k] >= 0xC0)

    def _mended(self, data: bytes) -> str:
        """The text of bytes that aren't UTF-8, byte by byte; a beginning of a character at their end stays open."""
        text, state, start = [], _ACCEPT, 0
        for i, b in enumerate(data):
            to = _UTF8[state][b]
            if to == _REJECT and state != _ACCEPT:  # a character that breaks off; this byte begins anew
                text.append("�")
                start, to = i, _UTF8[_ACCEPT][b]
            if to == _REJECT:
                text.append("�")
                start, to = i + 1, _ACCEPT
            elif to == _ACCEPT:
                text.append(data[start : i + 1].decode())
                start = i + 1
            state = to
        self.state, self.open = state, data[start:]
        return "".join(text)

    def close(self) -> str:
        rest = "�" if self.open else ""
        self.state, self.open = _ACCEPT, b""
        return rest


def _decoded(shared):
    key = uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _of_worker(key, lambda: Decoder(shared.value))
        for batch in batches:
            lists = batch.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [decoder.feed(flat[a:b]) + decoder.close() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (null: empty) and text, for each row of coded. The file at path as in `encode`; an id that it hasn't fails."""
    shared = coded.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = bounded_batches(coded).select(F.col("doc_id").cast("long"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoded(shared), "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and hex SHA-256 of the decimal ids, joined by one space, and of the text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
