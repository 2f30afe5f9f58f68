"""Fixed-length rows of token sequences: one conversation a row, next fit with padding, best fit with cropping.

The two fits are sequential by definition. Only lengths go through them, one stream per rank in constant memory; the tokens are joined to the places afterwards. More ranks
make more streams.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import masked_targets, padded
from .ordered import numbered_within


def sft_rows(rendered: DataFrame, batch: int, length: int, pad: int, idx: str = "idx", world: int = 1) -> DataFrame:
    """rank, batch, idx, inputs, targets: a row per conversation of at most `length` tokens, `batch` of them padded to their longest; all but the assistant's tokens are ignored in targets (-1).

    rendered: idx (dense numbers), ids, mask and, if known without rendering, n (length of ids). Null and too long conversations are skipped; a last incomplete batch is kept.
    """
    size = F.col("n") if "n" in rendered.columns else F.size("ids")
    # Numbers, batches and widths come from the lengths alone; the tokens move once, to their row.
    rows = rendered.select(F.col(idx).cast("long").alias("idx"), size.cast("int").alias("_n"), F.pmod(F.col(idx), F.lit(world)).cast("int").alias("rank")).where(F.col("_n").between(1, length))
    rows = numbered_within(rows, "rank", "idx", "_k").withColumn("batch", F.floor(F.col("_k") / batch))
    rows = rows.withColumn("_w", F.max("_n").over(Window.partitionBy("rank", "batch"))).select("rank", "batch", "idx", "_w")
    tokens = rendered.where(size.between(1, length)).select(F.col(idx).cast("long").alias("idx"), "ids", "mask")
    return rows.join(tokens, "idx").select("rank", "batch", "idx", padded(F.col("ids"), F.col("_w"), pad).alias("inputs"), padded(masked_targets(F.col("ids"), F.col("mask")), F.col("_w"), -1).alias("targets"))


def next_fit(lengths: Iterator[tuple[int, int]], capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, row, offset, length) in order: a sequence that doesn't fit behind the last one begins a new row; longer ones than a row are skipped."""
    row = used = 0
    for number, n in lengths:
        if n > capacity:
            continue
        if used + n > capacity:
            row, used = row + 1, 0
        yield number, row, used, n
        used += n


def best_fit(lengths: Iterator[tuple[int, int]], capacity: int, buffer: int = 1000, batch: int = 128) -> Iterator[tuple[int, int, int, int]]:
    """(number, row, offset, taken): into each row goes the longest sequence of the buffer that fits, the first of equals; where none fits, the shortest is cropped to fill the row.

    The buffer is filled up by whole batches before every pick. Rows are full; the last one is left out if it isn't.
    """
    held: list[tuple[int, int]] = []  # (length, -number of arrival), sorted
    names: dict[int, int] = {}
    arrived, more = 0, True
    row, used, placed = 0, 0, []
    while True:
        while more and len(held) < buffer:
            for _ in range(batch):
                nxt = next(lengths, None)
                if nxt is None:
                    more = False
                    break
                names[arrived] = nxt[0]
                bisect.insort(held, (nxt[1], -arrived))
                arrived += 1
        if not held:
            return
        room = capacity - used
        at = bisect.bisect_right(held, (room, 0)) - 1
        if at < 0 or not held[at][0]:  # nothing that fits takes up room
            at = bisect.bisect_right(held, (held[0][0], 0)) - 1
        n, seq = held.pop(at)
        placed.append((names.pop(-seq), row, used, min(n, room)))
        used += min(n, room)
        if used == capacity:
            yield from placed
            row, used, placed = row + 1, 0, []


def _places(lengths: DataFrame, fit, world: int) -> DataFrame:
    """rank, idx, row, offset, taken from rank, idx, n: the fit of each rank's lengths in order of idx."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b.column("rank").to_pylist(), b.column("idx").to_pylist(), b.column("n").to_pylist())

        source, head = rows(), None
        head = next(source, None)
        while head is not None:
            rank, buffer = head[0], []

            def mine():
                nonlocal head
                while head is not None and head[0] == rank:
                    item = head
                    head = next(source, None)
                    yield item[1], item[2]

            stream = mine()
            for number, row, offset, taken in fit(stream):
                buffer.append((rank, number, row, offset, taken))
                if len(buffer) == 10_000:
                    yield _batch(buffer)
                    buffer = []
            for _ in stream:
                pass
            yield _batch(buffer)

    ordered = lengths.select("rank", "idx", "n").repartition(world, "rank").sortWithinPartitions("rank", "idx")
    return ordered.mapInArrow(run, "rank int, idx long, row long, offset int, taken int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["rank", "idx", "row", "offset", "taken"])


def places(sequences: DataFrame, capacity: int, how: str, idx: str = "idx", world: int = 1, buffer: int = 1000, batch: int = 128) -> DataFrame:
    """rank, idx, row, offset, taken: where each sequence goes. sequences: idx (dense numbers) and either ids or n (length). how: 'next' or 'best'."""
    if how not in ("next", "best"):
        raise ValueError("places(): how must be 'next' or 'best'")
    n = F.col("n") if "n" in sequences.columns else F.size("ids")
    lengths = sequences.select(F.col(idx).cast("long").alias("idx"), n.cast("int").alias("n")).where("n > 0").withColumn("rank", F.pmod("idx", F.lit(world)).cast("int"))
    fit = (lambda s: next_fit(s, capacity)) if how == "next" else (lambda s: best_fit(s, capacity, buffer, batch))
    return _places(lengths, fit, world)


def rows(sequences: DataFrame, length: int, how: str, pad: int, idx: str = "idx", world: int = 1, buffer: int = 1000, batch: int = 128) -> DataFrame:
    """rank, row, inputs, targets: rows of `length` + 1 tokens, as inputs (all but the last) and targets (all but the first).

    'next' pads with `pad` and ignores the padding in targets (-1); 'best' has no padding. sequences: idx and ids.
    """
    at = places(sequences.select(idx, *(["n"] if "n" in sequences.columns else ["ids"])), length + 1, how, idx, world, buffer, batch)
    parts = at.join(sequences.select(F.col(idx).cast("long").alias("idx"), "ids"), "idx").select("rank", "row", F.struct("offset", F.slice("ids", F.lit(1), F.col("taken")).alias("ids")).alias("part"))
    whole = parts.groupBy("rank", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
    full = padded(F.col("ids"), F.lit(length + 1), pad)
    targets = F.transform(F.slice(full, 2, length), lambda t, i: F.when(i < F.size("ids") - 1, t).otherwise(F.lit(-1)))
    return whole.select("rank", "row", F.slice(full, 1, length).alias("inputs"), targets.alias("targets"))
