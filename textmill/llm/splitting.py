"""Problem 2: cutting oversized values into overlapping pieces at natural boundaries, by pointer doubling.

Every place behind white space is a boundary: a word end, and a sentence or paragraph end where the text says so. From each
boundary one table leads to its farthest legal successor (the next piece begins `overlap` before the cut and holds `max_size`
at most). Squaring that table gives the 2nd, 4th, 8th ... successors; starting with the text's begin, the set of greedy cuts doubles with each square, so the cuts
are found in logarithmically many array steps and not one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, WORD, FORCED, END = "paragraph", "sentence", "word", "forced", "end"
KINDS = (PARAGRAPH, SENTENCE, WORD, FORCED, END)
#: Marks that end a sentence, and marks that may stand between them and the white space.
ENDS, CLOSERS = ".!?…。！？", "\"'”’»)]}“"


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x3001)])


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places behind white space (all; those that end a sentence; those that end a paragraph), and the longest stretch without white space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _spaces()
    space = np.zeros(len(points), bool)
    low = points < len(table)
    space[low] = table[points[low]]
    at = np.flatnonzero(space) + 1
    edges = np.concatenate(([0], at, [len(points) + 1]))
    unbroken = int(np.max(np.diff(edges)) - 1)
    if not len(at):
        return at, at, at, unbroken
    # Of each place: the last character before the white space, without closing marks, and the line ends in the white space.
    n = len(points)
    closer = np.isin(points, [ord(c) for c in CLOSERS])
    solid = np.maximum.accumulate(np.where(space, -1, np.arange(n)))
    core = np.maximum.accumulate(np.where(space | closer, -1, np.arange(n)))
    last, bare = solid[at - 1], core[at - 1]
    # Only closing marks may lie between the sentence's mark and the last visible character.
    solids = np.concatenate(([0], np.cumsum(~space & ~closer)))
    ends = (bare >= 0) & np.isin(points[np.maximum(bare, 0)], [ord(c) for c in ENDS]) & (solids[at] - solids[np.maximum(bare, 0)] == 1)
    spaces_before = np.concatenate(([0], np.cumsum(space)))
    ends &= spaces_before[np.maximum(last, 0)] == spaces_before[np.maximum(bare, 0)]
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    paragraphs = (last >= 0) & (lines[at] - lines[np.maximum(last, 0)] >= 2)
    return at, at[ends | paragraphs], at[paragraphs], unbroken


def cuts(text: str, max_size: int, overlap: int, unit: str = "chars") -> tuple[list[int], list[str], int]:
    """The piece ends of a text, the kind of each, and the longest stretch without white space.

    Piece k runs from `overlap` before the end of piece k - 1 to its own end. An end is the farthest paragraph end in the second half of the
    room, else the farthest sentence end there, else word end; else the farthest of these in the first half; else the room's end (forced).
    """
    n = len(text)
    words, sentences, paragraphs, unbroken = boundaries(text)
    if unit == "chars":
        size = None
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))
    total = n if size is None else int(size[-1])
    if total <= max_size:
        return [n], [END], unbroken

    def begin(e):
        if size is None:
            return np.maximum(e - overlap, 0)
        return np.where(e == 0, 0, np.searchsorted(size, size[e] - overlap))

    def room(s, part=1.0):
        most = int(max_size * part)
        return np.minimum(s + most, n) if size is None else np.searchsorted(size, size[s] + most, side="right") - 1

    def successors(e):
        s = begin(e)
        limit, half = room(s), np.maximum(room(s, 0.5), e)
        out, kind = np.full(len(e), -1, np.int64), np.full(len(e), 3, np.int64)
        for least in (half, e):
            for k, places in enumerate((paragraphs, sentences, words)):
                if len(places):
                    best = places[np.maximum(np.searchsorted(places, limit, side="right") - 1, 0)]
                    take = (out < 0) & (best > least) & (best <= limit)
                    out[take], kind[take] = best[take], k
        forced = out < 0
        out[forced] = np.maximum(limit, e + 1)[forced]
        done = limit >= n
        out[done], kind[done] = n, 4
        return out, kind

    def forced_behind(f):
        """Where cuts forced one after the other may lie, from f to the next boundary: f + k * step in characters; in bytes any place."""
        k = np.searchsorted(words, f, side="right")
        stop = int(words[k]) if k < len(words) else n
        return np.arange(f, min(stop, n), max_size - overlap if size is None else 1)

    nodes = np.unique(np.append(words[words < n], 0))
    to, kind = successors(nodes)
    known = [(nodes, to, kind)]
    while len(fresh := np.setdiff1d(to[(kind == 3) & (to < n)], nodes)):
        fresh = np.setdiff1d(np.concatenate([forced_behind(f) for f in fresh]), nodes)
        to, kind = successors(fresh)
        known.append((fresh, to, kind))
        nodes = np.union1d(nodes, fresh)
    nodes, to, kind = (np.concatenate(x) for x in zip(*known))
    order = np.unique(nodes, return_index=True)[1]
    nodes, to, kind = nodes[order], to[order], kind[order]
    # Table of successors by index; the text's end leads to itself.
    table = np.append(np.searchsorted(nodes, to), len(nodes))
    table[:-1][to == n] = len(nodes)
    reached = np.zeros(len(nodes) + 1, bool)
    reached[0] = True
    while True:
        more = reached.copy()
        more[table[reached]] = True
        if (more == reached).all():
            break
        reached, table = more, table[table]
    path = np.flatnonzero(reached[:-1])
    return to[path].tolist(), [KINDS[k] for k in kind[path]], unbroken


def split(values: DataFrame, text_col: str, max_size: int, overlap: int, unit: str = "chars") -> DataFrame:
    """Oversized rows of `values`, without the text: all other columns, and n_size, unbroken, pieces.

    pieces: array of (no, first, past, kind) in characters; unbroken: longest stretch without white space. Values of max_size or less, null and
    empty ones give no row. unit: 'chars' (code points) or 'utf8_bytes'; in bytes an overlap may be up to three bytes shorter, so that no character is cut.
    max_size must be above overlap (by four at least in bytes). Columns named n_size, unbroken or pieces must not be among the others.
    """
    if unit not in ("chars", "utf8_bytes") or overlap < 0 or max_size <= overlap + (3 if unit == "utf8_bytes" else 0):
        raise ValueError("split(): unit must be chars or utf8_bytes, and 0 <= overlap < max_size")
    keys = [c for c in values.columns if c != text_col]
    clash = {"n_size", "unbroken", "pieces"} & set(keys)
    if clash:
        raise ValueError(f"split(): columns {sorted(clash)} would be overwritten")
    piece = pa.list_(pa.struct([("no", pa.int32()), ("first", pa.int64()), ("past", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            rows, unbroken = [], []
            for text in batch.column(text_col).to_pylist():
                ends, kinds, longest = cuts(text, max_size, overlap, unit)
                firsts = [0, *(_back(text, e, overlap, unit) for e in ends[:-1])]
                rows.append([{"no": k, "first": f, "past": e, "kind": kind} for k, (f, e, kind) in enumerate(zip(firsts, ends, kinds))])
                unbroken.append(longest)
            arrays = [batch.column(c) for c in keys]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("n_size"), pa.array(unbroken, pa.int64()), pa.array(rows, piece)], names=[*keys, "n_size", "unbroken", "pieces"])

    sized = values.withColumn("n_size", size_of(F.col(text_col), unit).cast("long")).where(F.col("n_size") > max_size)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema if f.name != text_col), "n_size long, unbroken long, pieces array<struct<no: int, first: long, past: long, kind: string>>"])
    return sized.mapInArrow(run, schema)


def _back(text: str, end: int, overlap: int, unit: str) -> int:
    """Where the piece behind the cut at `end` begins."""
    if unit == "chars":
        return max(end - overlap, 0)
    at, left = end, overlap
    while at > 0 and (step := len(text[at - 1].encode("utf-8", "surrogatepass"))) <= left:
        at, left = at - 1, left - step
    return at


def size_of(text: Column, unit: str) -> Column:
    return F.length(text) if unit == "chars" else F.octet_length(text)


def piece_texts(values: DataFrame, keys: list[str], text_col: str, found: DataFrame) -> DataFrame:
    """keys, no, first, past, kind, text: the pieces themselves. found: what split() gave for `values`; keys must be unique in both."""
    each = found.select(*keys, F.explode("pieces").alias("p"))
    both = each.join(values.select(*keys, F.col(text_col).alias("_whole")), keys)
    return both.select(*keys, "p.no", "p.first", "p.past", "p.kind", F.substring(F.col("_whole"), (F.col("p.first") + 1).cast("int"), (F.col("p.past") - F.col("p.first")).cast("int")).alias("text"))
