"""A bounded memory of what has been worked out for words, kept by each Python worker from task to task."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class WordMemory(dict):
    """Word to value. `fill` works out many words at once; beyond `most` words it starts afresh, which costs time only."""

    def __init__(self, fill: Callable[[list], Iterable], most: int = 500_000):
        super().__init__()
        self.work, self.most = fill, most

    def know(self, words: Iterable) -> None:
        """Afterwards all of these words are in the memory."""
        words = set(words)
        new = list(words.difference(self))
        if len(self) + len(new) > self.most and self:
            self.clear()
            new = list(words)
        for a in range(0, len(new), 20_000):
            self.update(zip(new[a : a + 20_000], self.work(new[a : a + 20_000]), strict=True))
