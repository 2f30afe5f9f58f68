"""Task datasets as chat messages, their splits and their mixture."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lettered, occurrences, spelled, without_markers
from .ordered import numbered, python_shuffle, seeded

#: Questions for the number of a letter in a word.
TEMPLATES = (
    "How many {letter} are in the word {word}",
    "How many {letter} are in {word}",
    "Count the number of {letter} in {word}",
    "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}",
    "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}",
    "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}",
    "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}",
    "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}",
    "How many times is {letter} in {word}",
    "Number of {letter} in {word}",
    "Total count of {letter} in {word}",
    "How many {letter} does {word} have",
    "How many {letter} does {word} contain",
    "What's the number of {letter} in {word}",
    "{word} has how many {letter}",
    "In {word}, count the {letter}",
    "How many {letter} appear in {word}",
    "Count the {letter} in {word}",
    "Give me the count of {letter} in {word}",
    "How many instances of {letter} in {word}",
    "Show me how many {letter} are in {word}",
    "Calculate the number of {letter} in {word}",
)


def dialogue(question: Column, answer: Column) -> Column:
    """Two messages, of the user and of the assistant."""
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def word_problems(df: DataFrame) -> DataFrame:
    """messages from question and answer: calculator signs are removed, the question gets a line end. Null questions or answers give null contents."""
    return df.withColumn("messages", dialogue(F.concat(without_markers(F.col("question")), F.lit("\n")), without_markers(F.col("answer"))))


#: The wordings of choice prompts and answers, of spelling and of letter answers.
QUESTION, CHOICES, RIGHT, FINAL, SPELL, TOTAL, IN_WORD = "Question: ", "\nChoices: ", "The correct answer is ", " #### ", "Please spell word ", "There are in total ", " in word "


def _choice_prompt(labels: Column, choices: Column) -> Column:
    return F.concat(F.lit(QUESTION), F.col("question"), F.lit(CHOICES), lettered(labels, choices), F.lit("\n"))


def _choice_answer(label: Column) -> Column:
    return F.concat(F.lit(RIGHT), label, F.lit(FINAL), label)


def four_choices(df: DataFrame) -> DataFrame:
    """messages from question, choices (four) and answer (0 to 3). Rows without exactly four choices or with another answer have null contents."""
    letters = F.array(*map(F.lit, "ABCD"))
    sound = (F.size("choices") == 4) & F.col("answer").between(0, 3)
    return df.withColumn("messages", dialogue(F.when(sound, _choice_prompt(letters, F.col("choices"))), F.when(sound, _choice_answer(F.get(letters, F.col("answer"))))))


def labelled_choices(df: DataFrame, key: str = "answerkey") -> DataFrame:
    """messages from question, choices (text and label) and the key of the right one."""
    return df.withColumn("messages", dialogue(_choice_prompt(F.col("choices.label"), F.col("choices.text")), _choice_answer(F.col(key))))


def spelling(words: DataFrame, word: str = "word") -> DataFrame:
    return words.withColumn("messages", dialogue(F.concat(F.lit(SPELL), F.col(word), F.lit("\n")), spelled(F.col(word))))


def letter_questions(words: DataFrame, word: str = "word", idx: str = "idx", seed: int = 2026) -> DataFrame:
    """letter, template and messages for each word; letter and template are drawn as Python's random.Random(seed + idx) draws them. Null and empty words have nulls."""

    @F.pandas_udf("struct<letter: string, template: string>")
    def draw(w: pd.Series, i: pd.Series) -> pd.DataFrame:
        out = []
        for x, k in zip(w, i):
            rng = random.Random(seed + int(k))
            out.append((rng.choice(x), rng.choice(TEMPLATES)) if x else (None, None))
        return pd.DataFrame(out, columns=["letter", "template"])

    df = words.withColumn("_d", draw(F.col(word), F.col(idx))).withColumn("letter", F.col("_d.letter")).withColumn("template", F.col("_d.template")).drop("_d")
    question = F.concat(F.replace(F.replace(F.col("template"), F.lit("{word}"), F.col(word)), F.lit("{letter}"), F.col("letter")), F.lit("\n"))
    return df.withColumn("messages", dialogue(question, letter_answer(F.col(word), F.col("letter"))))


def letter_answer(word: Column, letter: Column) -> Column:
    n = occurrences(word, letter).cast("string")
    return F.concat(F.lit(TOTAL), n, F.lit(" "), letter, F.lit(IN_WORD), word, F.lit(". #### "), n)


def split_ratio(df: DataFrame, n: int, split: str, ratio: float = 0.9, idx: str = "idx") -> DataFrame:
    """The first int(n * ratio) rows by the dense number idx, or the rest."""
    if split not in ("train", "test"):
        raise ValueError("split must be train or test")
    cut_at = int(n * ratio)
    return df.where(F.col(idx) < cut_at if split == "train" else F.col(idx) >= cut_at)


def shuffled(df: DataFrame, key: list[str], seed: int = 2026, exact: bool = False, idx: str = "idx") -> DataFrame:
    """df with a dense number in shuffled order: Python's own permutation (exact; bounded) or one by hashes."""
    if not exact:
        return seeded(df, key, seed, idx)
    rows = numbered(df, key, idx)
    return python_shuffle(rows, rows.count(), idx, seed)


def mixture(tasks: list[DataFrame], size: list[int] | None = None) -> DataFrame:
    """task_idx, idx, messages: the tasks one after the other, repeats kept; a task given twice counts twice. tasks: idx (dense), messages. size: the most rows of each, below 1 for all."""
    out = None
    for k, t in enumerate(tasks):
        t = t.select(F.lit(k).alias("task_idx"), F.col("idx").cast("long").alias("idx"), "messages")
        if size and size[k] > 0:
            t = t.where(F.col("idx") < size[k])
        out = t if out is None else out.unionByName(t)
    if out is None:
        raise ValueError("mixture(): no tasks")
    return out
