"""The operators' results worked out in the plainest way, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log, sqrt

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(docs: dict[int, str | None], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}


def repeats(docs: dict[int, str | None], length: int = 200) -> dict[int, tuple[int, int, int, str, bytes]]:
    """doc_id -> (bytes, removed, spans, digest of the rest, the rest)."""
    raw = {d: (t or "").encode() for d, t in docs.items()}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        rest = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = len(re.findall(b"\1+", bytes(covered)))
        out[d] = (len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest)
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def _buckets(text: str | None, buckets: int) -> list[int]:
    words = [w.lower().encode() for w in WORD.findall(text or "")]
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, words[1:], strict=False)]
    return [(h - (1 << 64) * (h >> 63)) % buckets for h in one + two]


def quality_scores(docs: dict[int, str | None], trusted: set[int], buckets: int, smooth: float) -> dict[int, float | None]:
    """doc -> mean of ln p_target - ln p_raw over its words and word pairs."""
    found = {d: _buckets(t, buckets) for d, t in docs.items()}
    raw = Counter(b for x in found.values() for b in x)
    target = Counter(b for d in trusted & set(docs) for b in found[d])
    p = lambda c, b: log((c[b] + smooth) / (c.total() + smooth * buckets))
    return {d: sum(p(target, b) - p(raw, b) for b in x) / len(x) if x else None for d, x in found.items()}


def spectrum(text: str, buckets: int, orders: tuple[int, ...]) -> set[int]:
    """Buckets of the byte n-grams of a text: upper case folded, other ASCII than letters a space."""
    raw = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in text.encode())
    shift = 32 - (buckets - 1).bit_length()
    grams = [(n, int.from_bytes(raw[i : i + n])) for n in orders for i in range(len(raw) - n + 1)]
    return {((g + (n << 24)) * 0x9E3779B1 % (1 << 32)) >> shift for n, g in grams}


def spectrum_kernel(a: set[int], b: set[int]) -> float:
    return len(a & b) / sqrt(max(1, len(a)) * max(1, len(b)))


_SIGNS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def bench_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER).translate(str.maketrans(_SIGNS, " " * len(_SIGNS))))


def decontaminated(docs: dict[int, str | None], items: dict[int, str | None], k: int = 5, threshold: float = 0.75) -> dict[tuple[int, int], float]:
    """(doc, item) -> greatest weighted Jaccard similarity of any window of the item's size, at the threshold or above."""
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    bags = {i: grams(w) for i, t in items.items() if len(w := bench_words(t)) >= k}
    sizes = {i: len(bench_words(items[i])) for i in bags}
    spread = Counter(g for b in bags.values() for g in set(b))
    weigh = lambda gs: Counter({g: n / spread.get(g, 1) for g, n in Counter(gs).items()})
    out: dict[tuple[int, int], float] = {}
    for d, text in docs.items():
        words = bench_words(text)
        if len(words) < k:
            continue
        own = set(grams(words))
        for i, bag in bags.items():
            if own.isdisjoint(bag):
                continue
            want, size = weigh(bag), min(sizes[i], len(words))
            for start in range(len(words) - size + 1):
                have = weigh(grams(words[start : start + size]))
                both = sum((want & have).values())
                similarity = both / (sum(want.values()) + sum(have.values()) - both)
                if similarity >= threshold:
                    out[d, i] = max(out.get((d, i), 0.0), similarity)
    return out


def greedy_pieces(word: bytes, pieces: set[tuple[int, ...]], end: int, longest: int = 32) -> int:
    """How many longest-match pieces a word is cut into; single bytes always are pieces."""
    symbols, at, n = (*word, end), 0, 0
    while at < len(word):
        for size in range(min(longest, len(symbols) - at), 0, -1):
            part = symbols[at : at + size]
            if part in pieces or len(part) == 1:
                at, n = at + size, n + 1
                break
    return n


def dice_matches(text: str | None, templates: dict[str, list[str]], threshold: float = 0.75) -> dict[str, float]:
    """licence -> greatest Dice coefficient of a unit (text, line or sentence) with a template."""
    text = text or ""
    lines = text.split("\n")
    units = {text, *lines, *(s for x in lines for s in re.split("(?<=[.!?]) +", x))}
    pairs = lambda t: (w := re.findall("[a-z0-9]+", t.lower())) and set(zip(w, w[1:], strict=False)) or set()
    out: dict[str, float] = {}
    for unit in units:
        own = pairs(unit)
        for name, texts in templates.items():
            for t in texts:
                other = pairs(t)
                dice = 2 * len(own & other) / (len(own) + len(other)) if own else 0
                if dice >= threshold:
                    out[name] = max(out.get(name, 0), round(dice, 6))
    return out


def segmentations(text: bytes, scores: dict[bytes, float], odd: float, n: int) -> list[tuple[float, tuple[bytes, ...]]]:
    """The n best ways to cut a text into pieces, best first; a character without a piece costs `odd` for each byte."""
    edges = [*(i for i, x in enumerate(text) if x & 0xC0 != 0x80), len(text)]
    chars = dict(zip(edges, edges[1:], strict=False))
    longest = max(map(len, scores))
    ways: list[list[tuple[float, tuple[bytes, ...]]]] = [[] for _ in range(len(text) + 1)]
    ways[0] = [(0.0, ())]
    for a, end in chars.items():
        ways[a] = sorted(ways[a], key=lambda w: -w[0])[:n]
        for b in range(a + 1, min(len(text), a + longest) + 1):
            part = text[a:b]
            cost = scores.get(part, odd * len(part) if b == end else None)
            if cost is not None:
                ways[b] += [(s + cost, (*p, part)) for s, p in ways[a]]
    return sorted(ways[-1], key=lambda w: -w[0])[:n]


def chat_windows(turns: list[tuple[str, str]], budget: int) -> list[tuple[list[int], list[int], int]]:
    """(repeated turns, own turns, tokens) of each window over the turns (role, text) of a conversation, in order."""
    cost = [len(re.findall("[^ \t\n\r]+", t)) + 4 for _, t in turns]
    system = bool(turns) and turns[0][0] == "system" and cost[0] <= budget // 2
    room, windows, spent, last = budget - cost[0] * system, [], 0, None
    for i in range(system, len(turns)):
        stripe, long = 2 * spent // room, 2 * cost[i] > room
        if last is None or long or last != stripe:
            windows.append([])
        windows[-1].append(i)
        spent, last = spent + cost[i], None if long else stripe
    out = []
    for own in windows or [[]]:
        again, total = [], sum(cost[i] for i in own)
        for i in range(own[0] - 1, max(own[0] - 3, system - 1), -1) if own else []:
            if sum(cost[i : own[0]]) + total > room:
                break
            again.insert(0, i)
        first = not out
        kept = [0] * system
        out.append(((again if first else kept + again), (kept + own if first else own), sum(cost[i] for i in kept + again + own)))
    return out
