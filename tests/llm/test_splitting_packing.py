import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.llm import packing, splitting


def walk(text, size, overlap):
    """The greedy cuts one by one, by the rule of splitting.cuts()."""
    words, sentences, paragraphs, _ = (list(x) if not isinstance(x, int) else x for x in splitting.boundaries(text))
    ends, e = [], 0
    while True:
        s = max(e - overlap, 0)
        limit = min(s + size, len(text))
        if limit >= len(text):
            return [*ends, len(text)]
        half = max(min(s + int(size * 0.5), len(text)), e)
        pick = None
        for least in (half, e):
            for places in (paragraphs, sentences, words):
                fit = [p for p in places if least < p <= limit]
                if fit and pick is None:
                    pick = max(fit)
        e = pick if pick is not None else max(limit, e + 1)
        ends.append(e)


def test_cuts_equal_the_walk_and_keep_the_rules():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab é.\n  !x\"") if rng.random() < 0.9 else "y" * 30 for _ in range(rng.randint(0, 200)))
        size = rng.randint(8, 60)
        overlap = rng.randint(0, size - 5)
        ends, kinds, unbroken = splitting.cuts(text, size, overlap)
        assert ends == (walk(text, size, overlap) if len(text) > size else [len(text)])
        assert len(kinds) == len(ends) and unbroken == max(map(len, re.split(r"\s", text)))
        firsts = [0, *(max(e - overlap, 0) for e in ends[:-1])]
        assert all(b - a <= size for a, b in zip(firsts, ends))


def test_bytes_never_cut_a_character():
    text = "漢字é😀 " * 40
    ends, _, _ = splitting.cuts(text, 50, 11, "utf8_bytes")
    firsts = [0, *(splitting._back(text, e, 11, "utf8_bytes") for e in ends[:-1])]
    assert all(len(text[a:b].encode()) <= 50 for a, b in zip(firsts, ends)) and ends[-1] == len(text)


def test_split_keeps_other_columns_and_skips_what_fits(spark):
    df = spark.createDataFrame([(1, "a", "x" * 25), (2, "b", "short"), (3, None, None), (4, "d", ""), (1, "a", "x" * 25)], "id long, no string, text string")
    rows = splitting.split(df, "text", 10, 2).collect()
    assert len(rows) == 2 and rows[0].no == "a" and rows[0].unbroken == 25
    assert [(p.first, p.past, p.kind) for p in rows[0].pieces] == [(0, 10, "forced"), (8, 18, "forced"), (16, 25, "end")]
    pieces = splitting.piece_texts(df.dropDuplicates(["id"]), ["id"], "text", splitting.split(df.dropDuplicates(["id"]), "text", 10, 2)).collect()
    assert all(len(p.text) <= 10 for p in pieces) and len(pieces) == 3
    assert splitting.split(df.limit(0), "text", 10, 2).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, "text", 10, 10)
    with pytest.raises(ValueError):
        splitting.split(df.withColumnRenamed("no", "pieces"), "text", 10, 2)


def test_a_very_long_text_without_blanks():
    ends, kinds, unbroken = splitting.cuts("z" * 400_000, 4000, 200)
    assert ends[0] == 4000 and ends[-1] == 400_000 and set(kinds) == {"forced", "end"} and unbroken == 400_000


def test_assign_balances_and_never_overfills():
    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 300))), reverse=True)
        where = packing.assign(sizes, 100)
        used = {}
        for s, k in zip(sizes, where):
            used[k] = used.get(k, 0) + s
        assert all(u <= 100 for u in used.values())
        if sum(sizes) > 3000:
            assert len(used) <= -(-sum(sizes) // 100) * 1.1 + 1


def test_pack_places_every_item_once(spark):
    rng = random.Random(3)
    rows = [(i, "wörd " * rng.randint(1, 30)) for i in range(300)] + [(900, "w" * 1000), (901, None), (902, ""), (5, "ignored")][:3] + [(None, "x")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "id long, text string, size int")
    placed = packing.pack(df, "id", "text", 200, shard_items=100)
    got = placed.collect()
    texts = dict(rows)
    parts = {}
    for r in got:
        assert r.size == len(texts[r.id][r.first : r.past].encode())
        parts.setdefault(r.id, []).append((r.first, r.past))
    assert set(parts) == {i for i, t in rows if i is not None and t}
    for i, p in parts.items():
        p.sort()
        assert p[0][0] == 0 and p[-1][1] == len(texts[i]) and all(a[1] == b[0] for a, b in zip(p, p[1:]))
        assert len(p) == 1 or len(texts[i].encode()) > 200
    report = packing.fill_report(placed, 200).first()
    assert report.most_used <= 200 and report.mean_fill > 0.9
    assert packing.pack(df.limit(0), "id", "text", 200).count() == 0
    assert placed.groupBy("id", "piece").count().where(F.col("count") > 1).count() == 0


@pytest.mark.parametrize("unit", ["chars", "utf8_bytes"])
def test_forced_cuts_are_those_of_one_step_after_the_other(unit):
    rng = random.Random(11)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abé漢") for _ in range(rng.choice((3, 9, 40, 300)))) for _ in range(rng.randint(1, 12)))
        most, overlap = rng.choice(((40, 10), (25, 0), (64, 33)))
        ends, kinds, _ = splitting.cuts(text, most, overlap, unit)
        size = (lambda t: len(t)) if unit == "chars" else (lambda t: len(t.encode()))
        at = 0
        for k, end in enumerate(ends):
            begin = splitting._back(text, at, overlap, unit) if k else 0
            assert end > at and size(text[begin:end]) <= most
            if kinds[k] == splitting.FORCED:  # no boundary lies in the room, which is used up
                assert not any(text[i - 1].isspace() for i in range(at + 1, end + 1)) and size(text[begin : end + 1]) > most
            at = end
        assert at == len(text)
