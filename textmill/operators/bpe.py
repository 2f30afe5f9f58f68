"""Byte-pair merges from a corpus's word histogram, and the vocabulary that they make."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import adjacent
from ..functions.text import PATTERN, utf8_bytes, words
from ..runtime import cut, release

#: The special tokens, in the order of their numbers.
SPECIALS = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>")


def word_histogram(docs: DataFrame, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """word, n: how often each pre-token occurs. Null texts have none. One scan, one partial and one final aggregation."""
    return docs.select(F.explode(words(F.col(text_col), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(histogram: DataFrame) -> DataFrame:
    """a, b, c: neighbouring bytes and how often they occur, words weighted by n; overlaps count ('aaa' has two)."""
    pairs = histogram.select("n", F.explode(adjacent(utf8_bytes(F.col("word")))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("c"))


def top_pair(counts: DataFrame) -> DataFrame:
    """One row: the most frequent pair, the smallest (a, b) of equals."""
    best = F.max_by(F.struct("a", "b", "c"), F.struct(F.col("c"), -F.col("a"), -F.col("b"))).alias("p")
    return counts.agg(best).select("p.a", "p.b", "p.c")


def merges(histogram: list[tuple[str, int]], n: int) -> list[tuple[int, int]]:
    """The first n merges of the words with their counts; fewer if no pair is left.

    The smallest (a, b) of equally frequent pairs is taken, so the result doesn't depend on the order of the words.
    """
    words = [w.encode() for w, c in histogram if c]
    starts = np.cumsum([0, *map(len, words)])
    return _Merging([(np.frombuffer(b"".join(words), np.uint8), starts, np.array([c for _, c in histogram if c], np.int64))]).run(n)


class _Merging:
    """Words as one array of places, and an index of the most frequent pairs of tokens.

    A token stands at its first place, as _LAST - token at its last one, and leaves _INSIDE between; words are parted by _APART. So both neighbours of a token are found from
    its ends. Pairs are kept by rank, the count first and then the smallest (a, b). Those ranked behind `bar` are not in the index: counts only fall once a merge is
    done, so they can't come before the bar by themselves, and when all before it are taken the places are looked through again. `held` bounds the index.
    """

    _INSIDE, _APART, _LAST = -1, -2, -3

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], held: int = 100_000, step: int = 1 << 22):
        """parts: the bytes of words one behind the other, where each begins and the last ends, and how often each occurs."""
        size = sum(len(data) + len(weight) for data, _, weight in parts) + 1
        self.place = np.int32 if size < 2**31 else np.int64
        self.at = np.full(size, self._APART, np.int32)
        self.begins, self.weight = np.empty(sum(len(w) for _, _, w in parts), self.place), np.empty(sum(len(w) for _, _, w in parts), np.int64)
        end, k = 0, 0
        for data, starts, weight in parts:
            own = self.at[end : end + len(data) + len(weight)]
            letters = np.ones(len(own), bool)
            letters[starts[:-1] - starts[0] + np.arange(len(weight))] = False
            own[letters] = data
            self.begins[k : k + len(weight)] = end + (starts[:-1] - starts[0]) + np.arange(len(weight))
            self.weight[k : k + len(weight)] = weight
            end, k = end + len(own), k + len(weight)
        self.length = np.ones(256, np.int64)
        self.held, self.step = held, step
        self.count: dict[int, int] = {}
        self.where: dict[int, np.ndarray] = {}
        self.heap: list[int] = []
        self.bar: int | None = None

    @staticmethod
    def _rank(c: int, key: int) -> int:
        return (-c << 64) + key

    def _weights(self, places: np.ndarray) -> np.ndarray:
        return self.weight[np.searchsorted(self.begins, places, "right") - 1]

    def _scan(self):
        """Keys and places of all pairs, in blocks."""
        for low in range(0, len(self.at), self.step):
            a_at = (low + np.flatnonzero(self.at[low : low + self.step] >= 0)).astype(self.place)
            a = self.at[a_at]
            b = self.at[a_at + self.length[a]]
            pair = b >= 0
            yield (a[pair].astype(np.int64) << 32) | b[pair], a_at[pair]

    def _look(self) -> None:
        """The index made anew, of the first `held` pairs by rank."""
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for key, at in self._scan():
            own, sums, _, _ = _summed(key, self._weights(at))
            keys, counts, _, _ = _summed(np.concatenate([keys, own]), np.concatenate([counts, sums]))
        first = np.lexsort((keys, -counts))[: self.held]
        self.bar = self._rank(int(counts[first[-1]]), int(keys[first[-1]])) if len(first) < len(keys) else None
        first = np.sort(first)
        keys, counts = keys[first], counts[first]
        self.count = dict(zip(keys.tolist(), counts.tolist()))
        self.heap = [self._rank(c, key) for key, c in self.count.items()]
        heapq.heapify(self.heap)
        which, places = [np.empty(0, np.int32)], [np.empty(0, self.place)]
        for key, at in self._scan() if len(keys) else ():
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1).astype(np.int32)
            in_it = keys[k] == key
            which.append(k[in_it])
            places.append(at[in_it])
        k = np.concatenate(which)
        places = np.concatenate(places)[np.argsort(k, kind="stable")]
        ends = np.cumsum(np.bincount(k, minlength=len(keys))).tolist()
        self.where = {key: places[low:high].copy() for key, low, high in zip(keys.tolist(), [0, *ends], ends)}

    def _trim(self) -> None:
        """The index without all but its first `held` pairs."""
        ranks = sorted(self._rank(c, key) for key, c in self.count.items() if c > 0)
        self.heap, self.bar = ranks[: self.held], ranks[self.held - 1] if len(ranks) > self.held else self.bar
        kept = {r & (2**64 - 1) for r in self.heap}
        self.count = {key: c for key, c in self.count.items() if key in kept}
        self.where = {key: at for key, at in self.where.items() if key in kept}

    def _next(self) -> int | None:
        """The key of the first pair by rank."""
        while True:
            while self.heap:
                rank = heapq.heappop(self.heap)
                key = rank & (2**64 - 1)
                now = self._rank(self.count[key], key)
                if now == rank:
                    return key
                if self.count[key] > 0 and (self.bar is None or now <= self.bar):
                    heapq.heappush(self.heap, now)
                else:
                    del self.count[key], self.where[key]
            if self.bar is None:
                return None
            self._look()

    def run(self, n: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        self._look()
        self.length = np.concatenate([self.length, np.zeros(max(n, 0), np.int64)])
        while len(out) < n and (key := self._next()) is not None:
            a, b = key >> 32, key & (2**32 - 1)
            self._merge(key, a, b, 256 + len(out))
            out.append((a, b))
            if len(self.count) > 2 * self.held:
                self._trim()
        return out

    def _merge(self, key: int, a: int, b: int, new: int) -> None:
        at, la, lb = self.at, int(self.length[a]), int(self.length[b])
        self.length[new] = la + lb
        first = self.where.pop(key)
        del self.count[key]
        first = first[(at[first] == a) & (at[first + la] == b)]
        if a == b and len(first) > 1:  # of overlapping ones, every other from the left
            begins = np.concatenate([[True], np.diff(first) != la])
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            first = first[(np.arange(len(first)) - run) % 2 == 0]
        last = first + (la + lb - 1)
        alone = np.concatenate([first[1:] != last[:-1] + 1, [True]])  # no further one behind it
        weight = self._weights(first)

        def sides(x: int, y: int):
            """Pairs before and behind: keys with x and y as the neighbour's partner, places and weights."""
            left, right = at[first - 1], at[last + 1]
            left = np.where(left <= self._LAST, self._LAST - left, left)
            before, behind = left >= 0, alone & (right >= 0)
            keys = np.concatenate([(left[before].astype(np.int64) << 32) | x, (y << 32) | right[behind].astype(np.int64)])
            return keys, left[before], before, behind, np.concatenate([weight[before], weight[behind]])

        keys, _, _, _, w = sides(a, b)
        gone, sums, _, _ = _summed(keys, w)
        for k, c in zip(gone.tolist(), sums.tolist()):
            if k in self.count:
                self.count[k] -= c
        if la > 1:
            at[first + (la - 1)] = self._INSIDE
        if lb > 1:
            at[first + la] = self._INSIDE
        at[last] = self._LAST - new
        at[first] = new
        keys, left, before, behind, w = sides(new, new)
        come, sums, order, ends = _summed(keys, w)
        places = np.concatenate([first[before] - self.length[left], first[behind]]).astype(self.place)[order]
        for k, c, low, high in zip(come.tolist(), sums.tolist(), [0, *ends], ends):
            rank = self._rank(c, k)
            if self.bar is None or rank <= self.bar:
                self.count[k], self.where[k] = c, places[low:high].copy()
                heapq.heappush(self.heap, rank)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys in order and the sums of their weights; the order of the rows by key, and where each key ends in it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sums = np.add.reduceat(weights[order], begins) if len(keys) else np.empty(0, np.int64)
    return keys[begins], sums, order, [*begins[1:].tolist(), len(keys)]


def learn(docs: DataFrame, vocab_size: int, text_col: str = "text", pattern: str = PATTERN, max_words: int = 20_000_000) -> DataFrame:
    """token_id, bytes: the vocabulary of 256 bytes and vocab_size - 256 merges (fewer if the corpus has no more).

    The corpus is read once, in Spark; what comes to the driver is its distinct words, `max_words` at most (more raise ValueError).
    """
    if vocab_size < 256:
        raise ValueError("learn(): vocab_size must be 256 or more")
    histogram = cut(word_histogram(docs, text_col, pattern).select(F.col("word").cast("binary"), "n"))
    if histogram.count() > max_words:
        raise ValueError(f"learn(): distinct words: more than {max_words} rows, too many for the driver")
    parts = []
    for batch in histogram.toArrow().to_batches():
        words = batch.column(0).cast(pa.large_binary())
        starts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        parts.append((data, starts, batch.column(1).to_numpy()))
    release(histogram)
    return vocabulary(docs.sparkSession, _Merging(parts).run(vocab_size - 256))


def vocabulary(spark: SparkSession, found: list[tuple[int, int]]) -> DataFrame:
    table = [bytes([k]) for k in range(256)]
    for a, b in found:
        table.append(table[a] + table[b])
    return spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(table)], "token_id int, bytes binary")


def special_ids(vocab: DataFrame, names: tuple[str, ...] = SPECIALS) -> DataFrame:
    """token, token_id: numbers behind the vocabulary's, in the order of the names."""
    top = vocab.agg(F.max("token_id").alias("top"))
    return top.select(F.posexplode(F.array(*map(F.lit, names))).alias("k", "token"), "top").select("token", (F.col("top") + 1 + F.col("k")).alias("token_id"))


def token_bytes(vocab: DataFrame, specials: DataFrame | None = None) -> DataFrame:
    """token_id, n_bytes: the byte length of each token, 0 for special ones."""
    out = vocab.select("token_id", F.octet_length("bytes").alias("n_bytes"))
    return out if specials is None else out.unionByName(specials.select("token_id", F.lit(0).alias("n_bytes")))
