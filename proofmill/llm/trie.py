"""Vocabulary tries as arrays, walked by many words at once."""

from __future__ import annotations

import numpy as np

END = 256  # the symbol after a word's last byte


class Trie:
    """Nodes are numbers, 0 the root. Steps are looked up in sorted keys node * 257 + symbol."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        self.piece = [-1]
        for number, symbols in enumerate(pieces):
            node = 0
            for s in symbols:
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    self.piece.append(-1)
                node = children[node][s]
            if node and self.piece[node] < 0:
                self.piece[node] = number
        self.children = children
        pairs = sorted((n * 257 + s, c) for n, kids in enumerate(children) for s, c in kids.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.targets = np.array([c for _, c in pairs], np.int64)
        self.numbers = np.array(self.piece, np.int64)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The node reached, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(node), -1)
        key = node * 257 + symbol
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.targets[i], -1)


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words with END after each, where each word begins)."""
    size = np.array([len(w) + 1 for w in words])
    start = np.cumsum(size) - size
    symbols = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    symbols[start + size - 1] = END
    return symbols, start
