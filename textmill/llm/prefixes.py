"""Prefix filtering of n-gram sets: sets that are alike share an n-gram among the first ones of either, in any common order.

The order puts n-grams that are not frequent first, by hash, then the frequent ones, the most frequent last, so that few sets meet. Which n-grams are frequent is
judged from a sample; a wrong judgement costs time only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, distinct, mix, set_digest, slices

#: What rounding may add to a product with the threshold.
ROUNDING = 1e-6


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many n-grams of a set of n, in any order, hold one of each set with a likeness of the threshold or more."""
    return n - np.maximum(np.ceil(threshold * n - ROUNDING).astype(np.int64), 1) + 1


def ordered_grams(texts: list[str | None], salt: np.ndarray, words: int, min_words: int, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text with min_words words or more: distinct n-grams and their texts, in the common order, and a digest of the set by text.

    hot: the frequent n-grams, sorted, and the place of each, from 1 on.
    """
    w = Words(texts)
    g, t = w.shingles(words)
    big = (w.count >= min_words)[t]
    g, t = distinct(mix(g[big] ^ salt[t[big]]), t[big])
    digest = mix(set_digest(g, t, len(texts))[0].view(np.uint64) ^ salt)
    keys, place = hot
    rank = np.zeros(len(g), np.uint64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        rank = np.where(keys[at] == g, place[at], 0).astype(np.uint64)
    # Equal values stay in the order of their hashes.
    order = np.lexsort((rank << np.uint64(40) | g >> np.uint64(24), t))
    return g[order], t[order], digest


def salts(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    return batch.column("salt").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def frequent(records: DataFrame, words: int, min_words: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that are in two records or more of about `sample` of them, sorted, with their places; `most` at most. records: id, text, salt (records of different salts have no n-gram in common)."""
    part = min(1.0, sample / max(records.count(), 1))
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(ordered_grams(texts[a:b], salts(batch, a, b), words, min_words, none)[0].view(np.int64))], names=["key"])

    chosen = records.where(F.pmod(F.xxhash64("salt", "id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    counts = chosen.select("salt", "text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    rows = counts.orderBy(F.desc("c"), "key").limit(most).collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.arange(len(keys), 0, -1).astype(np.uint64)[order]
