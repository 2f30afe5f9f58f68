import random

import pytest

from textmill.llm import defects, garbled, mixing, sampling

GOOD = [
    "The old mill stands beside the river. It was built in 1850 by a farmer.",
    "A copper bell hangs above the door, and the children ring it every morning.",
    "First the water turns the wheel; then the stones grind the grain.",
    "People in the valley say that the bridge is older than the church.",
    "When the wind blows from the north, the harbour is calm and the boats stay out.",
]


def talk():
    rng = random.Random(1)
    rows = []
    for k in range(300):
        q = f"Can you explain why the mill number {k} stands beside the river and what it does for the people of the valley?"
        rows.append((k, [("user", q), ("assistant", " ".join(rng.sample(GOOD, 3)))]))
    def add(i, q, a):
        rows.append((i, [("user", q), ("Assistant ", a)]))
    q = "Please tell me about the bridge of the northern town and how it carries the heavy carts in winter."
    add(1000, q, None)
    add(1001, q, "(no answer)")
    add(1002, q, " …​")
    add(1003, q, "I'm sorry, but I cannot help with that request. Please ask me something else.")
    add(1004, q, "I cannot see the bridge from here, but the answer is simple. " + GOOD[0])
    add(1005, q, q.upper())
    add(1006, "Repeat after me, word for word: " + GOOD[0], GOOD[0])
    add(1007, q, "Die Brücke trägt die Wagen und der Fluss ist im Winter nicht tief, das wissen die Leute auch.")
    add(1008, "Translate into German: " + GOOD[0], "Die alte Mühle steht am Fluss und der Bauer hat sie gebaut, das ist nicht neu.")
    add(1009, q, GOOD[0] + " When the wind blows from the")
    add(1010, q, "It does three things:\n- the old mill\n- the copper bell")
    add(1011, q, "```\nfor x in river:\n    print(x)")
    rows += [(1003, rows[-9][1]), (2000, None), (2001, []), (2002, [("user", "x")]), (None, [("user", "x"), ("assistant", None)])]
    return rows


def test_defects(spark):
    df = spark.createDataFrame([(i, m, "x") for i, m in talk()], "conv_id long, messages array<struct<role string, content string>>, turn string")
    got = {r.conv_id: list(r.labels) for r in defects.detect(df.select("conv_id", "messages"), sample=500).collect()}
    want = {1000: "empty", 1001: "empty", 1002: "empty", 1003: "refusal", 1005: "copy", 1007: "language", 1009: "truncated", 1011: "truncated"}
    assert {k: v[0] for k, v in got.items()} == want
    assert defects.detect(df.limit(0)).count() == 0


def test_defects_are_learnt_from_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(defects, "seeded_sample", None)
    df = spark.createDataFrame([(i, m) for i, m in talk()], "conv_id long, messages array<struct<role string, content string>>")
    tables = [sorted(map(tuple, defects.detect(df.repartition(n)).select("conv_id", "labels", "posteriors").collect())) for n in (1, 5)]
    assert tables[0] == tables[1]  # in whatever tasks the rows lie
    got = {i: labels[0] for i, labels, _ in tables[0]}
    assert got == {1000: "empty", 1001: "empty", 1002: "empty", 1003: "refusal", 1005: "copy", 1007: "language", 1009: "truncated", 1011: "truncated"}


def test_lore_of_all_pairs_equals_one_tally(spark):
    pairs = [(f"What does mill number {k} do?", f"The mill turns word{k % 7} slowly. It is, of course, old and of the village. I cannot help with that." * (1 + k % 3)) for k in range(400)]
    pairs.append(("x " * 15_000 + "longer", "y " * 15_000 + "longest"))  # long texts count too
    lore = defects.learn(spark.createDataFrame(pairs, "user string, answer string").repartition(7))
    one = defects.Lore.learn(pairs)
    assert {"word6", "x", "y"} <= lore.vocabulary and "399" not in lore.vocabulary
    for name in ("vocabulary", "prefixes", "trigrams", "word_ends", "endings", "refusing"):
        assert getattr(lore, name) == getattr(one, name), name


ODD = ["", " ", "\x01", "a\x01b. \x01", "snake_case and CamelCase__x.", "İstanbul'da ΣΑΣ ΌΣΟΣ. One two three four.", "five\u00a0six\u2028seven ²³ ½ ٣ x\u0301y z.", "𝔘𝔫𝔦 😀 𠀀𠀁 word\x01word_word. And so it, is here! Yes", "“It is the old mill.” And the river is, of course, of the village", "Ends on a beginn", "lone \ud800 surrogate is not a word."]


def test_tallies_are_those_of_counting_one_by_one():
    rng = random.Random(4)
    words = "the of and is mill river der und nicht ist la les que el los y не на и o a cannot pass".split()
    said = [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".", "!\n", ".” "]) for _ in range(rng.randrange(120))) for _ in range(1500)]
    pairs = [(rng.choice(ODD + said), x) for x in ODD + said]
    want = {}

    def count(kind, keys, bad=0, times=1):
        for key in keys:
            want.setdefault((kind, key), [0, 0])[1 - bad] += times

    for p in pairs:
        for text in p:
            low, spoken = text.lower(), {}
            met = defects.WORD.findall(low)
            count("word", met[:-1] if text[-1:].isalnum() else met)
            marks = [w for w in met if w in defects._MARKS]
            for w in marks:
                for k in defects._MARKS[w]:
                    spoken[k] = spoken.get(k, 0) + 60 // len(defects._MARKS[w])
            top = sorted(spoken.items(), key=lambda x: -x[1])
            tongue = top[0][0] if top and top[0][1] >= 240 and (len(top) == 1 or 10 * top[1][1] <= 7 * top[0][1]) else None
            assert defects.language(met, 4) == tongue == defects.languages([low], 4)[0]
            if tongue:
                count(f"spoken {tongue}", set(met))
            for s in defects.SENTENCE_END.split(low):
                w = defects.WORD.findall(s)
                if s.rstrip("\"”’»)").endswith((".", "!", "?")) and len(w) >= 4:
                    count("n", ["sentence"])
                    count("end", defects._fragment_features(w, s.count(",")))
                    k = 2 + defects.crc32(s.encode("utf-8", "replace")) % (len(w) - 2)
                    count("end", defects._fragment_features(w[:k], min(s.count(","), 1)), 1)
        if met:
            count("declined", set(met), len(met) < 60 and bool(defects.REFUSALS.search(p[1])) and not defects.GOES_ON.search(p[1]))
        count("n", ["pair"])
    seen = defects.Tally()
    seen.add(pairs[:700])
    seen.add(pairs[700:])
    got = {(kind, key): [bad, good] for kind, key, bad, good in seen.rows()}
    assert got == want
    assert list(defects.Tally().rows()) == []


def test_looks_of_many_texts_are_those_of_each():
    pairs = [(u, a) for u in ODD for a in ODD + GOOD]
    lore = defects.Lore.learn(pairs + [(g, " ".join(GOOD)) for g in GOOD for _ in range(3)])
    for p, (u, a) in zip(defects.Pair.of(pairs, lore), pairs, strict=True):
        asked, said = (defects.WORD.findall(t.lower()) for t in (u, a))
        assert (p.asked, p.said, p.letters, p.user, p.answer) == (asked, said, sum(map(len, said)), u, a)
        assert (p.said_look.distinct, p.said_look.common, p.said_look.again) == (len(set(said)), len({*said} & {*asked}), sum(w in asked for w in said))
        assert p.said_look.marking == defects.language(said) and (p.said_look.bits & defects.FIGURE > 0) == any(w.isdigit() for w in said)
    assert list(defects.all_votes(pairs, lore)) == [defects.votes(u, a, lore) for u, a in pairs]
    assert list(defects.all_votes([(None, None)], lore)) == [defects.votes("", "", lore)]


def test_costly_steps_are_done_once(monkeypatch):
    """Sentences don't become strings one by one; equal spoilt answers are judged once."""
    pairs = [(f"What does the mill number {k} do for the people?", " ".join(GOOD)) for k in range(1500)]
    judged = []
    monkeypatch.setattr(defects, "_fragment_features", None)
    lore = defects.Lore.learn(pairs)
    assert any(k.startswith("f the ") for k in lore.endings)
    monkeypatch.undo()
    monkeypatch.setitem(defects.FUNCTIONS, "refusal", (lambda p: judged.append(p.answer) or 1, *defects.FUNCTIONS["refusal"][1:]))
    codes = defects.spoilt_codes(pairs, lore, random.Random(1))["refusal"]
    assert sum(codes.values()) == len(pairs) and len(judged) == len(set(judged)) <= 100


def test_label_model_learns_which_votes_to_trust():
    rng = random.Random(2)
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.05
        v = tuple((1 if (rng.random() < right) == y else -1) if rng.random() < 0.9 else 0 for right in (0.95, 0.9, 0.6))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    model = defects.LabelModel.fit(counts)
    assert abs(model.prior - 0.05) < 0.03
    wrong = sum(min(sum(t), len(t) - sum(t)) if (model.posterior(v) >= 0.5) == (2 * sum(t) >= len(t)) else max(sum(t), len(t) - sum(t)) for v, t in truth.items())
    best = sum(min(sum(t), len(t) - sum(t)) for t in truth.values())
    assert wrong <= 1.3 * best + 20
    assert model.posterior((1, 0, 0)) > model.posterior((0, 0, 1))
    assert all(defects.decode(defects.encode(v), 3) == v for v in counts)


def readings(pattern):
    """Texts that a pattern without lookarounds matches, one for each way through its alternatives."""
    from re import _parser as parser

    def walk(items):
        out = [""]
        for op, x in items:
            op = str(op)
            if op == "AT":
                some = [""]
            elif op == "LITERAL":
                some = [chr(x)]
            elif op == "BRANCH":
                some = [t for part in x[1] for t in walk(part)]
            elif op == "SUBPATTERN":
                some = walk(x[3])
            elif op == "MAX_REPEAT":
                some = ([""] if x[0] == 0 else []) + walk(x[2])
            elif op == "IN":
                some = [chr(v) for kind, v in x if str(kind) == "LITERAL"] or ["x"]
            else:
                raise ValueError(op)
            out = [a + b for a in out for b in some]
        return out

    return walk(parser.parse(pattern))


def test_every_pattern_has_its_cue():
    for pattern, bit in ((defects.REFUSALS, defects.DENIAL), (defects.ASKS_COPY, defects.ASKING_COPY), (defects.ASKS_LANGUAGE, defects.ASKING_LANGUAGE)):
        texts = [t.strip() for t in readings(pattern.pattern)]
        assert len(texts) > 15 and all(pattern.search(t) for t in texts)
        assert [t for t in texts if not any(defects._flags(w) & bit for w in defects.WORD.findall(t.lower()))] == []


def test_refusals_of_every_language_length_and_wording_are_voted_for():
    lore, ask = defects.Lore(), "Please tell me about the bridge."
    for answer in ("Je ne suis pas autorisé à répondre à cette question.", "No estoy en condiciones de responder.", "I'm sorry. " + "I cannot help with that request, nor with any other of its kind. " * 15):
        v = defects.votes(ask, answer, lore)["refusal"]
        assert v[:2] == (1, 1) and v[2] >= 0
    for answer in defects.DECLINING:  # no list has these
        assert sum(defects.votes(ask, answer, lore)["refusal"]) > 0, answer
    long = " ".join(GOOD * 4) + " I cannot help with that."
    assert defects.votes(ask, long, lore)["refusal"][1] == -1


def test_each_function_votes_by_itself():
    lore = defects.Lore()
    v = defects.votes("How tall is the old bridge near the mill?", "(no answer)", lore)
    assert v["empty"].count(1) >= 2 and len(set(v["copy"])) > 1
    spoken = {d: set() for d in defects.DEFECTS}
    asks = ["How tall is the old bridge near the mill?", "Repeat after me: the mill is old and near the tall bridge.", "Translate into German: the old mill.", "Wie hoch ist die Brücke bei der Mühle und wer hat sie im Frühling für das Dorf gebaut?", "Хорошо ли видно мост из окна старой мельницы?"]
    answers = asks + GOOD + list(defects.DECLINING) + ["", None, "...", "N/A", "the old bridge near the mill", "1. One thing.\n2. Another.\n3.", "So 3 + 4 = 3+4=77 and then", "She said (and so did", "The old bridge near the mill is tall and the"]
    for u in asks:
        for a in answers:
            for d, x in defects.votes(u, a, lore).items():
                spoken[d].add(x)
    assert all(len(p) >= 5 for p in spoken.values()), {d: len(p) for d, p in spoken.items()}


def test_a_numbered_list_that_ends_on_a_bare_number_is_broken_off():
    lore, ask = defects.Lore(), "What does the mill do?"
    whole = "It does three things.\n1. It grinds the grain.\n2. It pumps the water.\n3. It saws the wood."
    assert sum(defects.votes(ask, whole[: whole.rindex(" It saws")], lore)["truncated"]) >= 2
    assert sum(defects.votes(ask, whole, lore)["truncated"]) < 0


def test_the_second_language_function_can_contradict_the_first():
    words = "casa perro libro mesa cachorro livro janela menino".split()
    trigrams = {g: tuple(9.0 * ((k == "es") == (w in words[:4])) * (k in ("es", "pt")) for k in defects.MARKERS) for w in words for g in defects._trigrams(w)}
    lore = defects.Lore(trigrams=trigrams, rare=(0.0,) * 6)
    # Markers of both take the same side; the trigrams tell the languages apart.
    user, answer = "como para se casa perro libro mesa muy con por pero", "por con muy cachorro livro janela menino pero según desde"
    assert defects.language(user.split()) == defects.language(answer.split()) == "es"
    assert defects.votes(user, answer, lore)["language"][:2] == (-1, 1)


CLEAN = ["La bergère conserve bientôt les pièces dès le matin.", "Der Bäcker verkürzt die Säge für die Schüler über Nacht.", "¿Quién diría que la montaña cruzó el desagüe también?", "Лесник осторожно чинит лодку до позднего вечера.", "A condição produz a razão e o coração não atrai a mãe.", "“The café of Télö sold 125 loaves,” he wrote — and left."]


def sentences():
    rng = random.Random(3)
    words = [w for s in CLEAN for w in s.split()]
    return CLEAN * 10 + [" ".join([w for w in rng.choice(CLEAN).split()[:4]] + [x for x in rng.sample(rng.choice(CLEAN).split(), 4)]) for _ in range(400) if words]


def test_chains_are_found_and_inverted_exactly():
    model = garbled.train(sentences())
    tried = fixed = 0
    for text in CLEAN:
        assert garbled.repair(text, model, 4.0, 25.0)[0] == []
        for chain in ((("utf-8", "cp1252"),), (("utf-8", "mac_roman"),), (("utf-8", "cp1251"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))):
            bad = garbled.garble(text, chain)
            if bad and bad != text:
                tried += 1
                _, got, whole = garbled.repair("Plain words. " + bad, model, 4.0, 25.0)
                fixed += whole and got == "Plain words. " + text
    assert fixed >= 0.9 * tried
    assert all(garbled.invert(garbled.garble(t, c), c) == t for t in CLEAN for c in garbled.CHAINS if garbled.garble(t, c) not in (None, t))
    assert garbled.repair("caf�", model, 4.0, 25.0)[0] == ["lost"]
    for fine in ("The letters Ã, Â and Å head three columns.", "┌──────┬──────┐", "∑x≤∞", "a\xa0b\xa0c", "😀 αβγ"):
        assert garbled.repair(fine, model, 4.0, 25.0)[0] == [], fine


def test_garbled_rows(spark):
    rows = [(k, s) for k, s in enumerate(sentences())] + [(9000, "Chaque année. La bergÃ¨re conserve bientÃ´t les piÃ¨ces."), (9001, None), (9002, ""), (9003, "plain & simple"), (None, "bergÃ¨re")]
    df = spark.createDataFrame([(i, t, "u") for i, t in rows], "doc_id long, text string, restored string")
    got = {r.doc_id: r.restored for r in garbled.detect(df).collect()}
    assert got[9000] == "Chaque année. La bergère conserve bientôt les pièces." and None in got
    assert not any(k in got for k in range(400)) and 9003 not in got
    assert garbled.detect(df.limit(0)).count() == 0


def test_flow_is_cheapest_and_respects_caps():
    flow = mixing.route({("a",): 100, ("b",): 50, ("a", "b"): 30}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 3, "c": 2})
    assert flow[("a",), "a"] == 100 and sum(f for (p, _), f in flow.items() if p == ("b",)) <= 150
    a, b = (sum(f for (_, s), f in flow.items() if s == x) for x in "ab")
    assert abs(a / (a + b) - 5 / 9) < 0.02
    assert mixing.route({}, {"a": 1.0}, {"a": 1}) == {}
    once = mixing.route({("a",): 100}, {"a": 1.0}, {"a": 3}, total=150)
    assert once == {(("a",), "a"): 150}


def test_mixture_reaches_its_shares(spark):
    import os

    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(ranks):
        pytest.skip("no vocabulary file")
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(5, 60), ["a"] if i < 400 else ["b"] if i < 500 else ["a", "b"]) for i in range(520)] + [(900, None, ["a"]), (901, "", ["a"]), (902, "x", None), (903, "x", ["z"]), (904, "x", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    goals = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("c", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, goals, ranks_file=ranks, bucket_docs=50)
    uses = mixed.collect()
    assert all(r.uses <= {"a": 1, "b": 3}[r.source] for r in uses) and not {r.doc_id for r in uses} & {900, 901, 902, 903, 904}
    got = {r.source: r for r in mixing.shares(mixed, goals).collect()}
    assert abs(got["a"].actual_share - 2 / 3) < 0.02 and abs(got["b"].actual_share - 1 / 3) < 0.02 and got["c"].actual_share == 0
    assert sorted(map(tuple, uses)) == sorted(map(tuple, mixing.mix(docs, goals, ranks_file=ranks, bucket_docs=10_000).collect()))
    assert mixing.mix(docs.limit(0), goals, ranks_file=ranks).count() == 0


def test_sample_is_the_same_whatever_the_first_part(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000)
    want = [r.id for r in sampling.seeded_sample(df, F.xxhash64("id"), 50, 1)]
    assert want == [r.id for r in sampling.seeded_sample(df, F.xxhash64("id"), 50, 10**9)] and len(want) == 50
