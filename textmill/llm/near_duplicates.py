"""Problem 1: groups and pairs of near-duplicate texts by MinHash banding.

Each text becomes the set of its word n-grams. Texts with equal sets are one class with one representative; copies are
never compared. Every representative gets MinHash values; representatives that agree on all rows of a band meet in a shuffle on the band's hash.

What meets in a band is bounded: where more than `hot` representatives have one band hash, as those of a common template do, they are met by prefix filtering
on their n-grams instead, rare n-grams first, which loses no pair and lets texts that share a template only not meet at all. Of the pairs that met, those go whose compact signatures (a few
bits of each MinHash value) are too unlike for the threshold; the others are verified on the two full n-gram sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, release, spread
from .bitmaps import marked
from .prefixes import ROUNDING, frequent, ordered_grams, prefix_length, salts
from .words import Words, distinct, mix, set_digest, slices


def choose_bands(threshold: float, recall: float, rows: int | None = None) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold is met with probability `recall` at least.

    Without `rows`, the largest row count is taken that needs at most 32 bands: more rows let fewer unlike pairs meet, more bands cost shuffle.
    """
    need = lambda r: math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
    if rows is None:
        rows = max((r for r in range(1, 33) if need(r) <= 32), default=1)
    return need(rows), rows


#: MinHash values in the signature and bits of each; SIGNATURE * BITS / 64 longs.
SIGNATURE, BITS = 128, 4


def least_alike(threshold: float, sigmas: float = 4.0) -> int:
    """How many of the SIGNATURE values two texts at the threshold have in common at least, but for a chance of 3 in 100,000 (sigmas = 4)."""
    p = threshold + (1 - threshold) / (1 << BITS)
    return math.floor(SIGNATURE * p - sigmas * math.sqrt(SIGNATURE * p * (1 - p)))


def differing_values(a: str, b: str):
    """In how many signature values the columns of two signatures (array<long>) differ."""
    ones = F.lit(int("1" * 16, 16))
    total = F.lit(0)
    for k in range(SIGNATURE * BITS // 64):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(ones))
    return total


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (values[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (values[n:] >> np.uint64(32)).astype(np.uint32)


def min_hashes(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (rows) of each text (columns); values[starts[i]:starts[i + 1]] are those of text i."""
    base = (values >> np.uint64(32)).astype(np.uint32)
    by, add = _multipliers(n)
    out = np.empty((n, len(starts)), np.uint32)
    scratch = np.empty_like(base)
    for k in range(n):
        np.bitwise_xor(base, add[k], out=scratch)
        np.multiply(scratch, by[k], out=scratch)
        np.minimum.reduceat(scratch, starts, out=out[k])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, min_words: int, bands: int, rows: int) -> DataFrame:
    """One row for each text with min_words words or more: id, h1 and h2 (digest of its n-gram set), n (its size), bands (array of hashes), sig (SIGNATURE values of BITS bits)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                w = Words(texts[a:b])
                h, t = distinct(*w.shingles(words))
                h, t = (x[(w.count >= min_words)[t]] for x in (h, t))
                h1, h2 = set_digest(h, t, b - a)
                starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
                have = t[starts]
                if not len(have):
                    continue
                low = min_hashes(h, starts, max(bands * rows, SIGNATURE)).astype(np.uint64)
                few = mix(low[:SIGNATURE]) & np.uint64((1 << BITS) - 1)
                in_long = 64 // BITS
                sig = np.zeros((len(have), SIGNATURE // in_long), np.uint64)
                for k in range(SIGNATURE):
                    sig[:, k // in_long] |= few[k] << np.uint64(BITS * (k % in_long))
                keys = np.empty((len(have), bands), np.int64)
                for k in range(bands):
                    key = np.full(len(have), k + 1, np.uint64)
                    for r in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[k * rows + r])
                    keys[:, k] = key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).take(pa.array(have)).cast(pa.int64()),
                        pa.array(h1[have]),
                        pa.array(h2[have]),
                        pa.array(np.diff(np.append(starts, len(t))).astype(np.int32)),
                        *(pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (keys, sig.view(np.int64))),
                    ],
                    names=["id", "h1", "h2", "n", "bands", "sig"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # A text of m words has 2 * m - 1 characters at least.
    return spread(texts.where((F.length("text") >= max(2 * min_words - 1, 2 * words - 1)) & F.col("id").isNotNull())).mapInArrow(run, "id long, h1 long, h2 long, n int, bands array<long>, sig array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and grams: the distinct n-grams of each text, as 64-bit hashes."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                h, t = distinct(*Words(texts[a:b]).shingles(words))
                ends = np.searchsorted(t, np.arange(b - a + 1), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["id", "grams"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, grams array<long>")


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full n-gram sets have a Jaccard similarity of the threshold or more, with `likeness`.

    Only texts that are in a pair are read into sets; the counting runs in the JVM. `pairs` is read three times: cut it first.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = shingle_sets(marked(texts, ["id"], wanted), "id", "text", words).dropDuplicates(["id"])
    both = (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("a"), F.col("grams").alias("_ga")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("_gb")), "b")
    )
    shared = F.size(F.array_intersect("_ga", "_gb"))
    likeness = F.col("_s") / (F.size("_ga") + F.size("_gb") - F.col("_s"))
    return both.withColumn("_s", shared).select("a", "b", likeness.alias("likeness")).where(F.col("likeness") >= threshold)


def prefix_pairs(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, min_words: int, sample: int, most: int) -> DataFrame:
    """Pairs (a, b), a < b, of texts that share an n-gram of both prefixes, at places that leave enough behind them, and whose sizes allow the threshold."""
    records = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("salt"))
    hot = docs.sparkSession.sparkContext.broadcast(frequent(records, words, min_words, sample, most))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                g, t, _ = ordered_grams(texts[a:b], salts(batch, a, b), words, min_words, hot.value)
                n = np.bincount(t, minlength=b - a)
                place = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
                keep = place < prefix_length(n, threshold)[t]
                ids = batch.column("id").slice(a, b - a).take(pa.array(t[keep]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[t[keep]].astype(np.int32)), pa.array(g[keep].view(np.int64)), pa.array(place[keep].astype(np.int32))], names=["id", "n", "gram", "place"])

    rows = records.mapInArrow(run, "id long, n int, gram long, place int").repartition("gram")  # both sides of the join use it
    left, right = (rows.select("gram", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}")) for x in "ab")
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - F.lit(ROUNDING)
    return left.join(right, "gram").where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()


def candidates(sigs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, min_words: int, hot: int = 100, sample: int = 10_000, most: int = 200_000) -> DataFrame:
    """Pairs (a, b), a < b, of representatives that met and whose signatures allow the threshold. sigs: as signatures() gives it; reps: id.

    A band hash that up to `hot` representatives have lets all of them meet, so a representative meets hot * bands others at most; the representatives of hotter band hashes
    are met by prefix_pairs(). sample, most: see frequent().
    """
    rows = sigs.join(reps, "id", "left_semi").select(F.col("id").alias("rep"), "n", F.explode("bands").alias("band"))
    # One shuffle: most band hashes occur once and go no further.
    counted = cut(rows.withColumn("c", F.count("*").over(Window.partitionBy("band"))).where("c > 1"))
    # Hashes that are shared are few, or the result is large.
    cool = counted.where(F.col("c") <= hot).repartition("band")
    left, right = cool.select("band", F.col("rep").alias("a"), F.col("n").alias("na")), cool.select("band", F.col("rep").alias("b"), F.col("n").alias("nb"))
    sizes = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")
    met = left.join(right, "band").where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()
    hotter = counted.where(F.col("c") > hot).select(F.col("rep").alias("_rep")).distinct()
    if not hotter.isEmpty():
        texts = docs.select(F.col(id_col).cast("long").alias("_rep"), F.col(text_col).alias("_text"))
        texts = marked(texts, ["_rep"], hotter).join(hotter, "_rep", "left_semi").dropDuplicates(["_rep"]).select(F.col("_rep").alias(id_col), F.col("_text").alias(text_col))
        met = met.unionByName(prefix_pairs(texts, id_col, text_col, words, threshold, min_words, sample, most)).distinct()
    left, right = sigs.select(F.col("id").alias("a"), F.col("sig").alias("_sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("_sb"))
    return met.join(left, "a").join(right, "b").where(differing_values("_sa", "_sb") <= SIGNATURE - least_alike(threshold)).select("a", "b").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, min_words: int = 0, recall: float = 0.999, hot: int = 100, sample: int = 10_000, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(members, pairs).

    members: `id`, `rep` – each text with enough words and the representative (lowest id) of the texts with the same n-gram set.
    pairs: `a`, `b`, `likeness` – verified pairs of representatives, a < b.
    Null, empty and short texts (under max(min_words, words) words) are in neither, nor are rows with a null id. Rows that repeat an id count once; they should have one text.
    """
    bands, rows = choose_bands(threshold, recall)
    sigs = cut(signatures(docs, id_col, text_col, words, max(min_words, words), bands, rows))
    # Digests alone are shuffled; a representative's row is then the one with its id.
    reps = sigs.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = cut(sigs.select("id", "h1", "h2").join(reps, ["h1", "h2"]).groupBy("id").agg(F.min("rep").alias("rep")))
    met = candidates(sigs, members.where("id = rep").select("id"), docs, id_col, text_col, words, threshold, max(min_words, words), hot, sample, most)
    pairs = verify(cut(met), docs, id_col, text_col, words, threshold)
    return members, pairs


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every pair of near-duplicate texts, copies included: <id>_a < <id>_b. Parameters as in links().

    A class of k copies gives k * (k - 1) / 2 rows; use groups() where one row per text will do.
    """
    members, found = links(docs, id_col, text_col, **how)
    members = cut(members)
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = found.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))
    copies = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias(f"{id_col}_a"), F.col("y").alias(f"{id_col}_b"))
    return across.unionByName(copies)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root: the lowest node of the connected component of every node in edges (a, b).

    Alternates the large-star and small-star steps (Kiveris et al., 2014): each round is two shuffles, and the rounds grow with
    the logarithm of a component's size. No component is gathered anywhere. Each round is cut from its lineage, and the one before removed.
    """
    now = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))  # node a, neighbour b
        else:
            near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = near.join(low, "a")
        out = moved.where("b > a").select(F.col("b").alias("x"), "m") if large else moved.select(F.col("b").alias("x"), "m").unionByName(low.select(F.col("a").alias("x"), "m"))
        return out.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()

    def sign(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    last = sign(now)
    for _ in range(max_rounds):
        before, now = now, cut(star(star(now, True), False))
        release(before)
        seen = sign(now)
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError("components() did not settle; raise max_rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: <id>, `group_id` (lowest id among all texts reached over links; a text of its own, null, empty or short has its own id), `n_links` (verified links of its representative to other representatives)."""
    members, found = links(docs, id_col, text_col, **how)
    found, members = cut(found), cut(members)
    roots = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of = members.join(roots, F.col("rep") == F.col("node"), "left").drop("node").join(degree, F.col("rep") == F.col("node"), "left")
    of = of.select(F.col("id").alias("_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    every = docs.select(F.col(id_col).cast("long").alias(id_col))
    return every.join(of, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("group_id", id_col).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
