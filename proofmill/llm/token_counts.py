"""Token counts: greedy longest-match word pieces by a linear automaton, without building pieces.

The vocabulary's trie gets failure links: where no step leads on from a node, the longest pieces that begin its string
are popped, and the link leads to the node of what remains. How many pieces are popped is worked out beforehand, so a
word's number of pieces is a sum along one walk over its bytes.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy
from .trie import END, Trie, laid_out
from .words import WordMemory


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest are shifted beyond."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level tokenizer file with word ends, as symbols, by rising id."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    letters, out = byte_letters(), []
    for token in sorted(tokens, key=tokens.get):
        body, end = (token[:-4], (END,)) if token.endswith("</w>") else (token, ())
        if all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *end))
    return out


class Automaton:
    """Failure links and popped counts beside the trie. Single bytes are pieces in any case, so that every word has pieces."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.trie = Trie([*pieces, *((b,) for b in range(256))])
        n = len(self.trie.children)
        fail, pops = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in self.trie.children[u].items():
                queue.append(v)
                if self.trie.piece[v] >= 0:
                    fail[v], pops[v] = 0, 1
                    continue
                z, popped = fail[u], pops[u]
                while z >= 0 and s not in self.trie.children[z]:
                    popped += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = self.trie.children[z][s], popped
        self.fail, self.pops = np.array(fail), np.array(pops)

    def counts(self, words: list[bytes]) -> list[int]:
        """Number of pieces of each word."""
        symbols, at = laid_out(words)
        count = np.zeros(len(words), np.int64)
        live, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        while len(live):
            end = symbols[at[live]] == END
            to = self.trie.step(node, symbols[at[live]])
            on, stuck = to >= 0, (to < 0) & (node > 0)
            count[live[stuck]] += self.pops[node[stuck]]
            count[live[on & end]] += 1
            at[live[on]] += 1
            node = np.where(on, to, np.where(stuck, self.fail[node], 0))
            going = ~end | stuck
            live, node = live[going], node[going]
        return count.tolist()


_memory: dict[str, WordMemory] = {}


def _counted(shared):
    key = uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _memory:
            _memory.clear()
            _memory[key] = WordMemory(shared.value.counts)
        memory = _memory[key]
        for batch in batches:
            n_words, n_tokens = [], []
            for a in range(0, batch.num_rows, 256):
                split = [(text or "").encode().lower().split() for text in batch.column("text").slice(a, 256).to_pylist()]
                memory.know(w for words in split for w in words)
                n_words += map(len, split)
                n_tokens += [sum(map(memory.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(documents: DataFrame, pieces: list[tuple[int, ...]]) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_tokens.

    Words are lower-cased (A-Z) runs of anything but ASCII white space, cut greedily into the longest pieces; a piece
    with END matches only at a word's end. Null and blank texts have no words and no tokens. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Automaton(pieces))
    return bounded_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted(shared), "doc_id long, n_words long, n_tokens long")
