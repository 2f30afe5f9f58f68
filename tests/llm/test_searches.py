import random
import re

import numpy as np

from textmill.llm import cross_split, leakage

WORD = re.compile(r"[^\W_]+")


def test_suffixes_search_and_locate():
    rng = np.random.default_rng(0)
    for _ in range(100):
        text = rng.integers(0, 4, rng.integers(1, 60))
        assert leakage.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: tuple(text[i:]))
        index = leakage.FMIndex(text, 3)
        phrases = rng.integers(0, 4, (5, 2))
        lo, hi = index.search(phrases)
        for k in range(5):
            want = [i for i in range(len(text) - 1) if (text[i : i + 2] == phrases[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)] + ["É"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for i in range(20)] + [(98, None), (99, "")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for k in range(0, 60, 3):
        q = items[rng.randrange(20)][1].split()
        a = rng.randrange(max(1, len(q) - 4))
        docs[k] = (k, docs[k][1] + " — " + ", ".join(q[a : a + 8]).upper() + " x " + docs[k][1])
    docs += [(100, None), (101, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    ev = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, query string, doc_id string")
    want = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i, q in items:
            v = WORD.findall((q or "").lower())
            if any(tuple(v[k : k + 5]) in have for k in range(len(v) - 4)):
                want.add((i, d))
    found = leakage.leaks(df, ev, words=5, shard_chars=300)
    rows = found.collect()
    assert {(r.item_id, r.doc_id) for r in rows} == want and len(rows) == len(want) and want
    texts = dict(docs)
    for r in rows:
        for s in r.spans:
            w = WORD.findall(texts[r.doc_id].lower()[s.first : s.past])
            assert len(w) >= 5
    for r in leakage.removal_spans(found).collect():
        assert r.first < r.past
    assert leakage.leaks(df.limit(0), ev, words=5).count() == 0 and leakage.leaks(df, ev.limit(0), words=5).count() == 0


def likeness(a, b):
    a, b = WORD.findall(a.lower()), WORD.findall(b.lower())
    if min(len(a), len(b)) < 30:
        return 0
    a, b = ({tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_overlaps_find_every_pair_above_a_likely_edit_distance(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        tab = "a" if k % 2 else "b"
        words = ["please", "do", "this", "task", "for", "me"] + [rng.choice(vocabulary) for _ in range(rng.randint(30, 140))]
        rows.append((tab, k, True, " ".join(words)))
        if k % 3 == 0:
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((tab, 1000 + k, False, "  ".join(words).title()))
        else:
            rows.append((tab, 1000 + k, False, " ".join(rng.choice(vocabulary) for _ in range(60))))
    rows += [rows[0], ("a", 5000, None, rows[1][3]), ("a", 5001, False, None), ("a", 5002, False, ""), ("a", 5003, True, "short")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "tab string, id long, train boolean, text string, overlap double")
    got = [tuple(r) for r in cross_split.overlaps(df, words=3, threshold=0.6, min_words=30).select("tab", "train_id", "held_id").collect()]
    train, held = [r for r in set(rows) if r[2]], [r for r in rows if r[2] is False and r[3]]
    want = {(t[0], t[1], h[1]) for t in train for h in held if t[0] == h[0] and likeness(t[3], h[3]) >= 0.6}
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 40
    assert cross_split.overlaps(df.limit(0)).count() == 0


def test_report_and_classes_count_copies_without_making_pairs(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [("documents_a", 10, False, "test", "s", text), ("documents_a", 10, False, "test", "s", text), ("documents_a", 1, True, "train", "s", text), ("documents_a", 2, True, "train", "s", text.upper()), ("documents_b", 3, True, "train", "s", text), ("documents_b", 4, None, None, None, text), ("documents_b", 5, False, "test", None, None)]
    records = spark.createDataFrame(rows, "tab string, id long, train boolean, split string, source string, text string")
    how = {"words": 3, "threshold": 0.6, "min_words": 30}
    # Tables whose names begin alike are told apart.
    assert [tuple(r) for r in cross_split.report(records, **how).collect()] == [("documents_a", "test", "s", 2, 1)]
    assert {tuple(r) for r in cross_split.classes(records, **how).distinct().collect()} == {("documents_a", i, 1, 1, 1.0) for i in (1, 2, 10)}
    assert {(r.tab, r.train_id, r.held_id) for r in cross_split.overlaps(records, **how).collect()} == {("documents_a", 1, 10), ("documents_a", 2, 10)}


def overlapping(spark, pairs):
    """Which of the pairs (training text, held-out text) are found, and how many have a likeness of 0.60 or more."""
    rows = [("a", k + 10_000 * (not side), bool(side), p[1 - side]) for k, p in enumerate(pairs) for side in (0, 1)]
    df = spark.createDataFrame(rows, "tab string, id long, train boolean, text string")
    got = {(r.train_id, r.held_id - 10_000) for r in cross_split.overlaps(df, words=3, threshold=0.6, min_words=30).collect()}
    return got, {(k, k) for k, (a, b) in enumerate(pairs) if likeness(a, b) >= 0.6}


def just_above(rng, words, fresh):
    """The words with random substitutions, as many as leave a likeness just above 0.60."""
    best, now = list(words), list(words)
    for at in rng.sample(range(len(words)), len(words)):
        now[at] = fresh()
        if likeness(" ".join(words), " ".join(now)) < 0.6:
            return best
        best = list(now)
    return best


def test_overlaps_meet_every_pair_just_above_the_threshold(spark):
    rng = random.Random(6)
    pairs = []
    for k in range(160):
        words = [f"v{rng.randrange(10**6)}" for _ in range((32, 40, 50, 120, 200)[k % 5])]
        pairs.append((" ".join(words), " ".join(just_above(rng, words, lambda: f"u{rng.randrange(10**6)}"))))
    got, want = overlapping(spark, pairs)
    assert got == want and len(want) == 160


def test_overlaps_meet_long_records_with_evenly_spaced_edits(spark):
    rng = random.Random(7)
    pairs = []
    for k in range(40):
        words = [f"v{rng.randrange(10**6)}" for _ in range((120, 200, 400, 1000)[k % 4])]
        edited = [f"u{rng.randrange(10**6)}" if i % 13 == 6 else w for i, w in enumerate(words)]
        pairs.append((" ".join(words), " ".join(edited)))
    got, want = overlapping(spark, pairs)
    assert got == want and len(want) == 40


def test_overlaps_meet_records_that_repeat_their_content(spark):
    rng = random.Random(8)
    pairs = []
    for k in range(30):
        once = " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))
        pairs.append((once, " ".join([once] * (2 + k % 3))) if k % 2 else (" ".join([once] * (2 + k % 3)), once))
    got, want = overlapping(spark, pairs)
    assert got == want and len(want) == 30


def test_spans_lie_in_the_text_as_it_is(spark):
    passage = "the quick brown fox jumps over the lazy dog and the old grey goose behind the barn"
    text = "İ" * 20 + " " + passage.upper() + " and then ΑΣ something else"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, "nothing of this kind stands in any of the documents that are searched here today")], "item_id long, query string")
    for chars in (8_000_000, 60):  # one block, several blocks
        (row,) = leakage.removal_spans(leakage.leaks(docs, items, block_chars=chars)).collect()
        assert text[row.first : row.past] == passage.upper()
