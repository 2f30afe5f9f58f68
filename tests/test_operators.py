import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions import text
from textmill.operators import bpe, chat, evaluation, ordered, packing, schedules, tasks
from textmill.operators.tokenizer import Tokenizer


def brute_merges(words, n):
    ids = [(list(w.encode()), c) for w, c in words]
    out = []
    for k in range(n):
        counts = Counter()
        for w, c in ids:
            for p in zip(w, w[1:]):
                counts[p] += c
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        out.append(best)
        new = []
        for w, c in ids:
            j, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and (w[i], w[i + 1]) == best:
                    j.append(256 + k)
                    i += 2
                else:
                    j.append(w[i])
                    i += 1
            new.append((j, c))
        ids = new
    return out


def test_merges_equal_a_full_recount():
    rng = random.Random(3)
    for _ in range(20):
        words = [("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))), rng.randint(1, 5)) for _ in range(30)]
        assert bpe.merges(words, 40) == brute_merges(words, 40)
    assert bpe.merges([("a", 3)], 5) == []


def test_merges_with_a_small_index_equal_a_full_recount():
    rng = random.Random(5)
    for held in (1, 3, 12):
        words = [("".join(rng.choice("abé") for _ in range(rng.randint(1, 14))), rng.randint(1, 4)) for _ in range(25)] + [("a" * 9, 2), ("", 1)]
        parts = []
        for some in (words[:10], words[10:]):
            data = [w.encode() for w, _ in some]
            parts.append((np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), np.array([c for _, c in some])))
        assert bpe._Merging(parts, held=held, step=7).run(60) == brute_merges(words, 60)


def test_long_words_take_little_memory():
    rng = random.Random(6)
    words = [("".join(rng.choice("abcdefgh") for _ in range(2000)), 1) for _ in range(5)]
    tracemalloc.start()
    try:
        assert len(bpe.merges(words, 1500)) == 1500
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


def test_vocabulary_and_specials(spark):
    docs = spark.createDataFrame([("low lower lowest low",), (None,), ("",)], "text string")
    vocab = bpe.learn(docs, 260)
    assert vocab.count() == 260
    assert [r.token_id for r in bpe.special_ids(vocab).orderBy("token_id").collect()] == [260, 261, 262, 263, 264]
    assert bpe.token_bytes(vocab, bpe.special_ids(vocab)).where("n_bytes = 0").count() == 5
    assert bpe.learn(docs.limit(0), 300).count() == 256


def test_encoding_round_trip_keeps_special_names_as_text(spark):
    docs = spark.createDataFrame([("low <|bos|> lower",), (None,), ("",), ("été 😀",)], "text string")
    tok = Tokenizer.of(bpe.learn(docs, 270))
    ids = tok.encode(docs, "text", prepend="<|bos|>")
    rows = tok.decode(ids, "ids", "back").collect()
    for r in rows:
        assert r.back is None if r.text is None else r.back == "<|bos|>" + r.text
        assert r.ids is None or (r.ids[0] == tok.bos and tok.bos not in r.ids[1:])
    bad = tok.decode(spark.createDataFrame([([255, 65],)], "ids array<int>"), "ids").first()
    assert bad.text == "�A"
    with pytest.raises(KeyError):
        tok.special("<|no|>")


def m(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


def test_rendering(spark):
    rows = [m(("system", "S"), ("user", "u"), ("assistant", "a")), m(("user", "u"), ("user", "v")), m(("System ", "S")), m(("user", None), ("assistant", "")), [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, messages array<struct<role string, content string>>")
    got = {r.i: r for r in chat.render(df).collect()}
    assert got[0].ids == [256, 257, 83, 117, 258, 259, 97, 260] and got[0].mask == [0, 0, 0, 0, 0, 0, 1, 1]
    assert got[3].ids == [256, 257, 258, 259, 260] and got[3].mask == [0, 0, 0, 0, 1]
    assert all(got[i].ids is None for i in (1, 2, 4, 5))
    assert {r.i: r.ids for r in chat.render(df, tokenizer=Tokenizer.bytes_only()).collect()} == {i: r.ids for i, r in got.items()}


def brute_best_fit(sizes, capacity, buffer, batch):
    source, held, rows, row = iter(enumerate(sizes)), [], [], []
    used, more = 0, True
    while True:
        while more and len(held) < buffer:
            part = list(itertools.islice(source, batch))
            more = len(part) == batch
            held += part
        if not held:
            return rows
        fits = [x for x in held if x[1] <= capacity - used]
        pick = max(fits, key=lambda x: x[1]) if fits else min(held, key=lambda x: x[1])
        held.remove(pick)
        taken = min(pick[1], capacity - used)
        row.append((pick[0], len(rows), used, taken))
        used += taken
        if used == capacity:
            rows.append(row)
            row, used = [], 0


def test_best_fit_equals_a_scan_of_the_buffer():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 80))]
        want = [p for r in brute_best_fit(sizes, 25, 7, 3) for p in r]
        assert list(packing.best_fit(iter(enumerate(sizes)), 25, 7, 3)) == want


def test_next_fit_carries_over_and_skips(spark):
    assert list(packing.next_fit(iter([(0, 3), (1, 4), (2, 9), (3, 2), (4, 5)]), 6)) == [(0, 0, 0, 3), (1, 1, 0, 4), (3, 1, 4, 2), (4, 2, 0, 5)]
    ids = spark.createDataFrame([(0, [1, 1, 1]), (1, [2, 2, 2, 2]), (2, [3] * 9)], "idx long, ids array<int>")
    got = packing.rows(ids, 5, "next", pad=0).orderBy("row").collect()
    assert [r.inputs for r in got] == [[1, 1, 1, 0, 0], [2, 2, 2, 2, 0]] and [r.targets for r in got] == [[1, 1, -1, -1, -1], [2, 2, 2, -1, -1]]
    assert packing.rows(ids.limit(0), 5, "best", pad=0).count() == 0


def test_sft_rows_pad_to_the_batch(spark):
    df = spark.createDataFrame([(0, [9, 1, 2], [0, 0, 1]), (1, [9, 1, 2, 3, 4], [0, 1, 1, 0, 1]), (2, None, None), (3, [9] * 50, [0] * 50), (4, [9, 5], [0, 1])], "idx long, ids array<int>, mask array<int>")
    got = {r.idx: r for r in packing.sft_rows(df, 2, 10, pad=0).collect()}
    assert sorted(got) == [0, 1, 4] and got[4].batch == 1
    assert got[0].inputs == [9, 1, 2, 0, 0] and got[0].targets == [-1, 2, -1, -1, -1]
    assert got[1].targets == [1, 2, -1, 4, -1]


def test_running_and_numbers(spark):
    rng = random.Random(7)
    values = [(i, rng.choice([None, 1, 5, 9])) for i in range(200)]
    df = spark.createDataFrame(values, "k long, v long").repartition(7)
    total, want = 0, {}
    for k, v in values:
        want[k] = total
        total += v or 0
    assert {r.k: r.s for r in ordered.running(df, ["k"], F.col("v"), "s", per_partition=30).collect()} == want
    assert sorted(r.idx for r in ordered.seeded(df, ["k"]).collect()) == list(range(200))
    assert ordered.numbered(df.limit(0), ["k"]).count() == 0
    order = list(range(200))
    random.Random(2026).shuffle(order)
    got = {r.k: r.idx for r in ordered.python_shuffle(ordered.numbered(df, ["k"]), 200).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == order


def test_schedule_equals_the_walk(spark):
    for sizes, world in (([3, 5, 4], 2), ([4], 1), ([3, 3], 3)):
        want = []
        for rank in range(world):
            task, idx, epoch = 0, rank, 0
            for step in range(12):
                if idx >= sizes[task]:
                    idx -= sizes[task]
                    task += 1
                    if task >= len(sizes):
                        task, epoch = 0, epoch + 1
                want.append((rank, step, task, idx, epoch))
                idx += world
        got = ordered.schedule(sizes, world, 12, spark).orderBy("rank", "step").collect()
        assert [(r.rank, r.step, r.task_idx, r.idx, r.epoch) for r in got] == want
    with pytest.raises(ValueError):
        ordered.schedule([1, 5], 2, 3, spark)


def test_letters_are_drawn_as_python_draws(spark):
    words = spark.createDataFrame([(0, "apple"), (1, "sand"), (2, None), (3, "")], "idx long, word string")
    for r in tasks.letter_questions(words).collect():
        if not r.word:
            assert r.letter is None
            continue
        rng = random.Random(2026 + r.idx)
        letter = rng.choice(r.word)
        assert (r.letter, r.template) == (letter, rng.choice(tasks.TEMPLATES))
        assert r.messages[1].content == f"There are in total {r.word.count(letter)} {letter} in word {r.word}. #### {r.word.count(letter)}"


def test_mixture_keeps_repeats_and_limits(spark):
    t = spark.createDataFrame([(0, m(("user", "a"))), (1, m(("user", "b")))], "idx long, messages array<struct<role string, content string>>")
    assert [(r.task_idx, r.idx) for r in tasks.mixture([t, t, t], [-1, 1, 0]).orderBy("task_idx", "idx").collect()] == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)]


def test_shots_are_drawn_as_python_draws(spark):
    items = spark.range(9).withColumnRenamed("id", "idx")
    for r in evaluation.fewshot_indices(items, 9, 3).collect():
        assert r.shots_idx == random.Random(2026 + r.idx).sample([i for i in range(9) if i != r.idx], 3)
    for r in evaluation.fewshot_indices(items, 9, 8, exact=False).collect():
        assert sorted([*r.shots_idx, r.idx]) == list(range(9))
    with pytest.raises(ValueError):
        evaluation.fewshot_indices(items, 9, 9)


def test_spans_and_crop(spark):
    df = spark.createDataFrame([(0, [[1, 2, 3], [1, 2, 4, 5]])], "i int, tokens array<array<int>>")
    r = evaluation.cropped(evaluation.spans(df, "choice"), 3).first()
    assert (r.starts, r.ends, r.tokens) == ([2, 1], [3, 3], [[1, 2, 3], [2, 4, 5]])
    r = evaluation.spans(spark.createDataFrame([(0, [[1, 9, 9], [2, 2, 9, 9]])], df.schema), "schema").first()
    assert (r.starts, r.ends) == ([1, 2], [3, 4])
    r = evaluation.spans(spark.createDataFrame([(0, [[1, 2], [1, 2, 3]]), (1, [[1, 3], [1, 2, 3]])], df.schema), "language").orderBy("i").collect()
    assert (r[0].starts, r[0].ends, r[0].tokens) == ([2], [3], [[1, 2, 3]]) and r[1].starts is None


def test_schema_and_language_prompts(spark):
    df = spark.createDataFrame([(["A", "B"], "c", 1, ["s"])], "context_options array<string>, continuation string, gold int, shots array<string>")
    assert evaluation.schema_prompts(df, "|").first().prompts == ["s\n\nA|c", "s\n\nB|c"]
    df = spark.createDataFrame([("  x \n", "c", [])], "context string, continuation string, shots array<string>")
    assert evaluation.language_prompts(df, " ").first().prompts == ["x", "x c"]


def test_metrics(spark):
    lengths = spark.createDataFrame([(0, 2), (1, 0)], "token_id int, n_bytes int")
    losses = spark.createDataFrame([(0, 1.0), (1, 5.0), (-1, 7.0)], "target int, loss double")
    assert abs(evaluation.bits_per_byte(losses, lengths).first().bpb - 1 / 0.6931471805599453 / 2) < 1e-12
    assert evaluation.bits_per_byte(losses.where("target = 1"), lengths).first().bpb == float("inf")
    ties = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 1, 2.0), (1, 0, 1, 3.0), (1, 1, 1, 1.0)], "item int, choice int, gold int, loss double")
    assert {r.item: (r.predicted, r.correct) for r in evaluation.choice_correct(ties).collect()} == {0: (0, False), 1: (1, True)}
    acc = spark.createDataFrame([("t", 0.5)], "label string, accuracy double")
    assert abs(evaluation.core(acc, spark.createDataFrame([("t", 25.0)], "label string, percent double")).first().core - 1 / 3) < 1e-12
    with pytest.raises(Exception, match="no baseline"):
        evaluation.core(acc, spark.createDataFrame([("u", 25.0)], "label string, percent double")).collect()
    answers = spark.createDataFrame([("1", [None, "1"]), ("2", ["3", "2"]), ("2", [None])], "gold string, attempts array<string>")
    assert abs(evaluation.generative_accuracy(answers).first().accuracy - 1 / 3) < 1e-12
    top = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 4.0), (1, 4.0), (1, 1.0)], "g int, v double")
    assert evaluation.top_k(top, ["g"], "v", 3).count() == 4


def test_schedules(spark):
    log = spark.createDataFrame([("a", k, float(k % 5)) for k in range(50)] + [("b", 0, 2.0)], "run string, step long, x double")
    got = {(r.run, r.step): r.ema for r in schedules.smoothed(log, ["run"], ["step"], "x").collect()}
    mean = 0.0
    for k in range(50):
        mean = 0.9 * mean + 0.1 * (k % 5)
        assert abs(got["a", k] - mean / (1 - 0.9 ** (k + 1))) < 1e-9
    assert abs(got["b", 0] - 2.0) < 1e-12
    assert schedules.horizon(10, iterations=3) == 3 and schedules.horizon(10, ratio=8, params=100) == 80
    assert schedules.accumulation(64, 2, 4, 2) == 4
    with pytest.raises(ValueError):
        schedules.accumulation(65, 2, 4, 2)
    assert schedules.flops_per_token(100, 40, 2, 3, 4, 5) == 6 * 60 + 12 * 2 * 3 * 4 * 5
    assert text.PATTERN.startswith("'(?i:")


def test_smoothing_of_long_series_with_nulls_is_the_recurrence(spark):
    import random

    from textmill.operators import schedules

    rng = random.Random(5)
    rows = [(s, k, None if rng.random() < 0.1 else rng.uniform(-5, 5), "x") for s, n in (("a", 1500), ("b", 3), (None, 900)) for k in range(n)]
    got = {(r.s, r.k): r.ema for r in schedules.smoothed(spark.createDataFrame(rows, "s string, k int, v double, _note string"), ["s"], ["k"], "v").collect()}
    mean = {}
    for s, k, v, _ in rows:
        mean[s] = mean.get(s, 0.0) * 0.9 + (v or 0.0) * 0.1
        assert abs(got[s, k] - mean[s] / (1 - 0.9 ** (k + 1))) < 1e-9
    assert len(got) == len(rows)
