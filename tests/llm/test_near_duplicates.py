import random
import re

import pytest

from textmill.llm import near_duplicates as nd

WORD = re.compile(r"[^\W_]+")


def grams(t, n, least):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= max(least, n) else set()


def brute(rows, n, threshold, least):
    sets = {i: grams(t, n, least) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(rng, n):
    vocabulary = [f"w{k}" for k in range(500)] + ["é", "漢字", "Ⅳ"]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = rng.choice([" ", "  ", ", "]).join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(35, 80)))
        out.append((i, text.upper() if rng.random() < 0.1 else text))
    return out


def test_pairs_equal_brute_force(spark):
    rows = corpus(random.Random(1), 150) + [(900, None), (901, ""), (902, "too short"), (903, "x " * 50), (904, "X, " * 50)]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, id int, rep string")
    got = [tuple(r) for r in nd.pairs(df, words=3, threshold=0.6, min_words=30).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6, 30)


def test_groups_give_a_row_each(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (2, base), (3, base + " more"), (4, base + " more words"), (5, None), (6, ""), (7, "alone in the world of words"), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.group_id, r.n_links) for r in nd.groups(df).collect()}
    assert len(got) == 8 and {got[k][0] for k in (1, 2, 3, 4)} == {1} and got[5] == (5, 0) and got[7] == (7, 0)
    assert got[1][1] == 2
    assert nd.groups(df.limit(0)).count() == 0


def test_a_hot_group_of_copies_and_repeated_rows(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(i, base) for i in range(40)] + [(5, base)] + corpus(random.Random(2), 20)[:0]
    got = [tuple(r) for r in nd.pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_bands_reach_the_recall():
    for threshold in (0.6, 0.8):
        bands, rows = nd.choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


@pytest.mark.parametrize("size", [3_000_000])
def test_a_very_long_text(spark, size):
    text = "word " * (size // 10) + " ".join(f"v{k % 9000}" for k in range(size // 12))
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    assert [tuple(r) for r in nd.pairs(df).collect()] == [(1, 2)]


def templates(n, rng):
    """Texts that share a template of 100 words and have 100 words of their own: no two are alike."""
    shared = " ".join(f"t{k}" for k in range(100))
    return [(i, shared + " " + " ".join(f"x{rng.randrange(10**9)}" for _ in range(100))) for i in range(n)]


def test_a_common_template_does_not_make_candidates_quadratic(spark):
    found = []
    for n in (500, 1000, 2000, 4000):
        df = spark.createDataFrame(templates(n, random.Random(n)), "doc_id long, text string")
        bands, rows = nd.choose_bands(0.6, 0.999)
        sigs = nd.signatures(df, "doc_id", "text", 3, 30, bands, rows)
        found.append(nd.candidates(sigs, sigs.select("id"), df, "doc_id", "text", 3, 0.6, 30).count())
    assert found[-1] <= max(8 * found[0], 400), found


def test_hot_bands_lose_no_pair(spark):
    rng = random.Random(7)
    rows = corpus(rng, 120)
    want = brute(rows, 3, 0.6, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2, 100):  # 2: nearly all pairs by prefix filtering
        assert {tuple(r) for r in nd.pairs(df, words=3, threshold=0.6, min_words=30, hot=hot).collect()} == want


def test_signatures_tell_unlike_texts_apart(spark):
    from pyspark.sql import functions as F

    rows = corpus(random.Random(9), 200)
    sets = {i: grams(t, 3, 30) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = nd.signatures(df, "doc_id", "text", 3, 30, *nd.choose_bands(0.6, 0.999)).select("id", "sig")
    both = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")).join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), F.col("a") < F.col("b"))
    got = {(r.a, r.b): 1 - r.d / nd.SIGNATURE for r in both.select("a", "b", nd.differing_values("sa", "sb").alias("d")).collect()}
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in got}
    assert all(abs(got[p] - (likeness[p] + (1 - likeness[p]) / 16)) < 0.23 for p in got)
    least = nd.least_alike(0.6) / nd.SIGNATURE
    assert not [p for p in got if likeness[p] >= 0.6 and got[p] < least] and len([p for p in got if likeness[p] < 0.2 and got[p] >= least]) < 0.01 * len(got)
