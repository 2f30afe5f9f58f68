import random

import regex
from pyspark.sql import functions as F

from textmill.functions import arrays, text

HARD = ["a  b", "trail  ", "x\r\n\r\ny", "a\xa0\xa0b", "a\x85b", "em  space", "\x1cz", "ⅣX ½", "I'LL don't it's", "😀🌱 hi", "", " ", "\n", "aaa", "12345", "…,;!\n\n", "été Über"]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_words_equal_the_pattern_in_python_and_tile_the_text(spark):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab é.,'\n\r\t \xa0 12Zß漢") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = column(spark, texts).select("v", text.words(F.col("v")).alias("w")).collect()
    for r in rows:
        assert r.w == regex.findall(text.PATTERN, r.v)
        assert "".join(r.w) == r.v


def test_bytes_and_pairs(spark):
    values = ["hé", "aaa", "", None, "x\x00y", "漢字😀"]
    rows = column(spark, values).select("v", text.utf8_bytes(F.col("v")).alias("b"), arrays.adjacent(text.utf8_bytes(F.col("v"))).alias("p")).collect()
    for r in rows:
        if r.v is None:
            assert r.b is None
            continue
        b = list(r.v.encode())
        assert r.b == b
        assert [(p.a, p.b) for p in r.p] == list(zip(b, b[1:]))


def test_merge_is_left_to_right_and_without_overlaps(spark):
    got = column(spark, [[1, 1, 1], [1, 1, 1, 1], [2, 1], []], "array<int>").select(arrays.merged(F.col("v"), 1, 1, 9).alias("m")).collect()
    assert [r.m for r in got] == [[9, 1], [9, 9], [2, 1], []]


def test_answers(spark):
    values = ["so #### 1,234.", "#### -5 #### 6", "none", "#### B", None]
    rows = column(spark, values).select(text.extract_answer(F.col("v")).alias("n"), text.extract_label(F.col("v")).alias("l")).collect()
    assert [r.n for r in rows] == ["1234.", "-5", None, None, None]
    assert [r.l for r in rows] == ["1234.", "-5", None, "B", None]


def test_small_ones(spark):
    r = column(spark, ["apple"]).select(text.spelled(F.col("v")), text.occurrences(F.col("v"), F.lit("p")), text.strip(F.lit(" \n a b\t ")), text.without_markers(F.lit("1<<2=3>>4")), text.escaped(F.lit("a\nb"))).first()
    assert list(r) == ["a,p,p,l,e", 2, "a b", "12=34", "a\\u000ab"]


def test_common_ends(spark):
    rows = [[[1, 2, 3], [1, 2, 4]], [[5], [5, 6]], [[1], [2]], [[7, 8], [7, 8]], [[], [1]]]
    got = column(spark, rows, "array<array<int>>").select(arrays.common_prefix(F.col("v")).alias("p"), arrays.common_suffix(F.col("v")).alias("s")).collect()
    assert [(r.p, r.s) for r in got] == [(2, 0), (1, 0), (0, 0), (2, 2), (0, 0)]


def test_targets(spark):
    r = spark.range(1).select(arrays.masked_targets(F.expr("array(1,2,3,4)"), F.expr("array(0,0,1,1)")), arrays.rolled(F.expr("array(1,2,3)")), arrays.upto(F.expr("array(4,9,5)"), [9, 8]), arrays.upto(F.expr("array(4,5)"), [9, 8]), arrays.first_lowest(F.expr("array(3,1,1)"))).first()
    assert list(r) == [[-1, 3, 4], [2, 3, 1], [4], [4, 5], 1]
