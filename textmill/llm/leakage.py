"""Problem 6: passages of evaluation texts inside corpus documents, by an FM-index per training shard.

The evaluation texts are small and fixed: their words are the alphabet, and every run of `words` consecutive words of an item is a
phrase. Each task takes its documents in shards of bounded size, turns them into word numbers, builds the FM-index of a shard
(suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions), searches all phrases backwards at once,
locates their occurrences and merges those of one item and document into spans. Nothing is shuffled.

Words that no item has cannot be part of an occurrence; they all are the number 1, the gaps between documents are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .words import Words, in_original, slices


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The start positions of the suffixes of text in lexicographic order, by prefix doubling; settled suffixes are left alone."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], np.diff(text[order]) != 0)))
    sizes = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, sizes)
    open_at = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order that are not settled
    step = 1
    while len(open_at):
        at = order[open_at]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[open_at] = at = at[by]
        key = key[by]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(head, len(key)))
        rank[at] = np.repeat(open_at[head], sizes)
        open_at = open_at[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class WaveletMatrix:
    """Rank and access over a sequence of small numbers, for whole arrays of questions at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(values) - int(count[-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, value: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each value occurs before the place."""
        lo = np.zeros_like(upto)
        for k in range(self.levels):
            bit = ((value >> (self.levels - 1 - k)) & 1).astype(bool)
            lo1, up1 = self.ones[k][lo], self.ones[k][upto]
            lo, upto = np.where(bit, self.zeros[k] + lo1, lo - lo1), np.where(bit, self.zeros[k] + up1, upto - up1)
        return upto - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for k in range(self.levels):
            ones = self.ones[k][at]
            bit = self.ones[k][at + 1] > ones
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            value = value * 2 + bit
        return value


class FMIndex:
    """Backward search and locating in a sequence of numbers; `sample` is the distance of stored positions."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        # The closing mark is the smallest symbol, so all others move up by one.
        text = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_order(text)
        last = text[order - 1]
        self.size, top = len(text), int(text.max())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.bwt = WaveletMatrix(last, top)
        kept = order % sample == 0
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]
        self.top = top

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of phrases the range of its suffixes in the order; empty where there is none."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k].astype(np.int64) + 1
            known = symbol <= self.top
            hi[alive[~known]] = lo[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            lo[alive] = self.before[symbol] + self.bwt.rank(symbol, lo[alive])
            hi[alive] = self.before[symbol] + self.bwt.rank(symbol, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text positions of places in the order, by steps back to a stored position."""
        out, steps, open_ = np.empty(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.copy()
        while len(open_):
            here = at[open_]
            stored = self.kept[here + 1] > self.kept[here]
            done = open_[stored]
            out[done] = self.positions[self.kept[at[done]]] + steps[done]
            open_ = open_[~stored]
            symbol = self.bwt.access(at[open_])
            at[open_] = self.before[symbol] + self.bwt.rank(symbol, at[open_])
            steps[open_] += 1
        return out


class Phrases:
    """All runs of `words` words of the items, as numbers of the items' alphabet, and the items that have each run."""

    def __init__(self, items: list[tuple[int, str | None]], words: int):
        w = Words([t for _, t in items])
        self.words, self.alphabet = words, np.unique(w.hash)
        numbers = self.encode(w.hash)
        size = max(0, len(numbers) - words + 1)
        inside = np.flatnonzero(w.text[:size] == w.text[words - 1 :]) if size else np.zeros(0, np.int64)
        runs = numbers[inside[:, None] + np.arange(words)] if len(inside) else np.zeros((0, words), np.int64)
        owner = np.array([i for i, _ in items], np.int64)[w.text[inside]] if len(inside) else np.zeros(0, np.int64)
        self.runs, which = np.unique(runs, axis=0, return_inverse=True) if len(runs) else (runs, np.zeros(0, np.int64))
        self.runs = self.runs.astype(np.int32)
        both = np.unique(np.stack((which.ravel(), owner)), axis=1) if len(runs) else np.zeros((2, 0), np.int64)
        self.starts, self.owners = np.searchsorted(both[0], np.arange(len(self.runs) + 1)), both[1]

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, at + 2, 1).astype(np.int64)


def spans_of_shard(phrases: Phrases, words: Words, n_texts: int, sample: int = 8) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(text, item, merged word ranges) for the texts of one shard."""
    numbers = phrases.encode(words.hash)
    # A run of known words shorter than a phrase holds none; such runs and all unknown words shrink to one gap each.
    gap = np.concatenate((numbers == 1, [True]))
    gap_at = np.flatnonzero(gap)
    breaks = np.union1d(gap_at, np.flatnonzero(np.diff(words.text)) + 1) if len(words.text) else gap_at
    ends = np.append(breaks, len(numbers))
    begins = np.append(0, breaks)
    begins = begins + ((begins < len(numbers)) & gap[np.minimum(begins, len(numbers))])
    long_ = ends - begins >= phrases.words
    begins, ends = begins[long_], ends[long_]
    if not len(begins) or not len(phrases.runs):
        return []
    sizes = ends - begins + 1  # with a gap behind each
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    source = np.arange(sizes.sum()) - np.repeat(starts - begins, sizes)
    text = numbers[np.minimum(source, len(numbers) - 1)]
    text[starts + sizes - 1] = 0
    index = FMIndex(text, sample)
    lo, hi = index.search(phrases.runs)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return []
    count = (hi - lo)[found]
    places = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)
    at = source[index.locate(places)]
    phrase = np.repeat(found, count)
    n_owners = np.diff(phrases.starts)[phrase]
    item = phrases.owners[np.arange(n_owners.sum()) - np.repeat(np.cumsum(n_owners) - n_owners, n_owners) + np.repeat(phrases.starts[phrase], n_owners)]
    at = np.repeat(at, n_owners)
    order = np.lexsort((at, item, words.text[at]))
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for t, i, a in zip(words.text[at[order]].tolist(), item[order].tolist(), at[order].tolist()):
        if not out or out[-1][0] != t or out[-1][1] != i:
            out.append((t, i, []))
        spans = out[-1][2]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], a + phrases.words)
        else:
            spans.append((a, a + phrases.words))
    return out


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "query", words: int = 12, block_chars: int = 8_000_000, shard_chars: int = 1 << 21
) -> DataFrame:
    """item_id, doc_id, spans: each item and document that have `words` consecutive words in common.

    spans: array of (first, past), the merged character ranges of the item's passages in the document as it is. Items are searched in blocks of about block_chars characters, with one scan
    of the documents for each block (and one block at least); what is broadcast for a block, its phrases, takes about 12 bytes a character.
    Null, empty or shorter texts are in no row. Rows that repeat an item's id are parts of one item. Document ids must be unique.
    """
    texts = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null and i is not null")
    chars = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    found = None
    for k in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()  # about block_chars characters
        part = _search(docs, Phrases([(r[0], r[1]) for r in rows], words), id_col, text_col, shard_chars)
        found = part if found is None else found.unionByName(part)
    return found


def _search(docs: DataFrame, block: Phrases, id_col: str, text_col: str, shard_chars: int) -> DataFrame:
    phrases, words = docs.sparkSession.sparkContext.broadcast(block), block.words

    def run(batches):
        p, ids, texts, total = phrases.value, [], [], 0
        for batch in batches:
            names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(values, shard_chars):
                ids += names[a:b]
                texts += values[a:b]
                total += sum(len(t) for t in values[a:b])
                if total >= shard_chars:
                    yield shard(p, ids, texts)
                    ids, texts, total = [], [], 0
        if texts:
            yield shard(p, ids, texts)

    def shard(p, ids, texts):
        w = Words(texts)
        found = spans_of_shard(p, w, len(texts))
        spans = [[dict(zip(("first", "past"), in_original(texts[t], int(w.first[a]), int(w.past[b - 1])))) for a, b in s] for t, _, s in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for _, i, _ in found], pa.int64()), pa.array([ids[t] for t, _, _ in found], pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])))],
            names=["item_id", "doc_id", "spans"],
        )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(texts.where((F.length("text") >= 2 * words - 1) & F.col("doc_id").isNotNull())).mapInArrow(run, "item_id long, doc_id long, spans array<struct<first: long, past: long>>")


def removal_spans(found: DataFrame) -> DataFrame:
    """doc_id, first, past: the character ranges of each document that any item covers, merged over items. found: as leaks() returns it."""
    from pyspark.sql import Window

    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.first").alias("first"), F.col("s.past").alias("past"))
    w = Window.partitionBy("doc_id").orderBy("first", "past")
    reach = F.max("past").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("first") <= reach, 0).otherwise(1)).over(w)
    return each.withColumn("part", part).groupBy("doc_id", "part").agg(F.min("first").alias("first"), F.max("past").alias("past")).drop("part")
