"""Words, shingles and their hashes, computed over whole Arrow batches with numpy.

Words are the maximal runs of Unicode letters and numbers of the lower-cased text. A word's hash is a polynomial over its code points modulo 2**64, taken from prefix sums, so no Python code runs per word.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """For each code point, whether it is a letter or a number."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


#: Code points taken at once; bounds the memory that a very long text needs.
STRETCH = 1 << 20


def _stretches(whole: str):
    """Ranges of about STRETCH characters that end behind a character outside words."""
    at = 0
    while at < len(whole):
        end = min(at + STRETCH, len(whole))
        while end < len(whole) and word_chars()[ord(whole[end - 1])]:
            end += 1
        yield at, end
        at = end


def _runs(whole: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer(whole[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word_chars()[points], [False])).view(np.int8)))
    first, past = edges[0::2], edges[1::2]
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points.astype(np.uint64) * up[: len(points)], dtype=np.uint64, out=sums[1:])
    return first + a, past + a, mix((sums[past] - sums[first]) * down[first])


def slices(texts: list[str | None], limit: int = STRETCH // 2):
    """Ranges of rows whose texts have about `limit` characters together, one text at least."""
    at, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= limit:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def in_original(text: str, first: int, past: int) -> tuple[int, int]:
    """The range of a text that became the range (first, past) of the lower-cased text, which may be longer."""
    if len(text.lower()) == len(text):
        return first, past
    ends = np.cumsum(np.fromiter((len(c.lower()) for c in text), np.int64, len(text)))
    return int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(ends, past - 1, side="right")) + 1


class Words:
    """The words of a batch of texts: hash, index of the text, and, in the lower-cased text, first and past-the-end position."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        sizes = np.fromiter((len(t) for t in low), np.int64, len(low))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        whole = "\n".join([*low, ""])
        parts = [_runs(whole, a, b) for a, b in _stretches(whole)]
        first, past, self.hash = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.text = np.searchsorted(starts, first, side="right") - 1
        self.first, self.past = first - starts[self.text], past - starts[self.text]
        self.count = np.bincount(self.text, minlength=len(low)) if len(low) else np.zeros(0, np.int64)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every run of n words, in order, repeats included."""
        h, t = self.hash, self.text
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = len(h) - n + 1
        out = np.zeros(size, np.uint64)
        for k in range(n):
            out = out * np.uint64(_BASE) + h[k : k + size]
        inside = t[:size] == t[n - 1 :]
        return mix(out[inside]), t[:size][inside]


def distinct(values: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values without repeats within a text, sorted within each text; texts must be in order."""
    order = np.lexsort((values, texts))
    v, t = values[order], texts[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return v[keep], t[keep]


def set_digest(values: np.ndarray, texts: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on each text's set of values only. Values must be distinct within a text."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(n_texts, np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1]))) if len(texts) else np.zeros(0, np.int64)
        if len(starts):
            total[texts[starts]] = np.add.reduceat(mix(values ^ np.uint64(salt)), starts)
        out.append(total.view(np.int64))
    return out[0], out[1]
