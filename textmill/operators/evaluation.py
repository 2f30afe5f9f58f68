"""Evaluation prompts, their spans, and metrics over tables of per-token losses and predictions."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import common_prefix, common_suffix, last, padded, upto
from ..functions.text import strip


def fewshot_indices(items: DataFrame, n: int, shots: int, idx: str = "idx", seed: int = 2026, exact: bool = True) -> DataFrame:
    """items with `shots_idx`: the numbers of `shots` other items each.

    exact: as Python's random.Random(seed + idx).sample() draws them from all others. Otherwise the ones that follow, from a start that the md5 of the number gives; SQL can say that too.
    """
    if shots > n - 1:
        raise ValueError("fewshot_indices(): too few items")
    if not shots:
        return items.withColumn("shots_idx", F.array().cast("array<long>"))
    if not exact:
        start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(idx).cast("string"))), 1, 8), 16, 10).cast("long")
        steps = F.transform(F.sequence(F.lit(0), F.lit(shots - 1)), lambda k: F.pmod(F.col(idx) + 1 + F.pmod(start + k, F.lit(n - 1)), F.lit(n)))
        return items.withColumn("shots_idx", steps)

    @F.pandas_udf("array<long>")
    def draw(i: pd.Series) -> pd.Series:
        return i.map(lambda k: [j + (j >= k) for j in random.Random(seed + int(k)).sample(range(n - 1), shots)])

    return items.withColumn("shots_idx", draw(F.col(idx)))


def with_shots(items: DataFrame, shot: Column, idx: str = "idx") -> DataFrame:
    """items with `shots`: the text `shot` of each item that shots_idx names, in its order. An equi-join; nothing is crossed."""
    wanted = items.select(F.col(idx).alias("_i"), F.posexplode("shots_idx").alias("_k", "_j"))
    texts = items.select(F.col(idx).alias("_j"), shot.alias("_t"))
    got = wanted.join(texts, "_j").groupBy("_i").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_t", F.lit("")).alias("_t")))), lambda x: x["_t"]).alias("shots"))
    out = items.join(got, F.col(idx) == F.col("_i"), "left").drop("_i")
    return out.withColumn("shots", F.coalesce("shots", F.array().cast("array<string>")))


def _examples(shots: Column) -> Column:
    return F.array_join(F.transform(shots, lambda s: F.concat(s, F.lit("\n\n"))), "")


def choice_shot(delimiter: str) -> Column:
    return F.concat(F.col("query"), F.lit(delimiter), F.coalesce(F.get("choices", F.col("gold")), F.lit("")))


def choice_prompts(items: DataFrame, delimiter: str = " ") -> DataFrame:
    """items with `prompts`, one per choice: the shots, the query, the delimiter and the choice."""
    head = F.concat(_examples(F.col("shots")), F.col("query"), F.lit(delimiter))
    return items.withColumn("prompts", F.transform("choices", lambda c: F.concat(head, F.coalesce(c, F.lit("")))))


def schema_shot(delimiter: str) -> Column:
    return F.concat(F.get("context_options", F.col("gold")), F.lit(delimiter), F.col("continuation"))


def schema_prompts(items: DataFrame, delimiter: str = " ") -> DataFrame:
    """items with `prompts`, one per context option, all with the same continuation."""
    return items.withColumn("prompts", F.transform("context_options", lambda c: F.concat(_examples(F.col("shots")), c, F.lit(delimiter), F.col("continuation"))))


def language_shot(delimiter: str) -> Column:
    return F.concat(strip(F.col("context")), F.lit(delimiter), F.col("continuation"))


def language_prompts(items: DataFrame, delimiter: str = " ") -> DataFrame:
    """items with `prompts`: without (stripped) and with the continuation."""
    head = F.concat(_examples(F.col("shots")), strip(F.col("context")), F.lit(delimiter))
    return items.withColumn("prompts", F.array(strip(head), F.concat(head, F.col("continuation"))))


def spans(items: DataFrame, kind: str, ids: str = "tokens") -> DataFrame:
    """items with `starts` and `ends` (0-based, past the end) of the scored part of each of the token arrays in `ids`.

    choice: behind the common beginning. schema: the common ending. language: behind the first array; only the second is kept, and null where the first isn't its beginning.
    """
    seqs = F.col(ids)
    sizes = F.transform(seqs, lambda s: F.size(s))
    if kind == "choice":
        return items.withColumn("ends", sizes).withColumn("starts", F.array_repeat(common_prefix(seqs), F.size(seqs)))
    if kind == "schema":
        return items.withColumn("ends", sizes).withColumn("starts", F.transform("ends", lambda e: e - common_suffix(seqs)))
    if kind == "language":
        short, whole = F.get(seqs, F.lit(0)), F.get(seqs, F.lit(1))
        sound = (F.size(short) < F.size(whole)) & (common_prefix(seqs) == F.size(short))
        return items.withColumn("starts", F.when(sound, F.array(F.size(short)))).withColumn("ends", F.when(sound, F.array(F.size(whole)))).withColumn(ids, F.when(sound, F.array(whole)))
    raise ValueError("spans(): kind must be choice, schema or language")


def cropped(items: DataFrame, most: int, ids: str = "tokens") -> DataFrame:
    """Token arrays cut to their last `most` tokens, starts and ends moved along."""
    over = lambda s: F.greatest(F.lit(0), F.size(s) - most)
    out = items.withColumn("starts", F.zip_with("starts", ids, lambda a, s: a - over(s))).withColumn("ends", F.zip_with("ends", ids, lambda a, s: a - over(s)))
    return out.withColumn(ids, F.transform(ids, lambda s: last(s, most)))


def stacked(sequences: Column, pad: int) -> Column:
    """All arrays padded at the right to the longest."""
    width = F.array_max(F.transform(sequences, lambda s: F.size(s)))
    return F.transform(sequences, lambda s: padded(s, width, pad))


def bits_per_byte(losses: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: bpb from losses (target, loss) and lengths (token_id, n_bytes). Tokens of no bytes and targets below 0 count for nothing; infinite without bytes. The vocabulary is broadcast."""
    both = losses.where("target >= 0").join(F.broadcast(lengths), F.col("target") == F.col("token_id")).where("n_bytes > 0")
    sums = both.agg(F.sum("loss").alias("nats"), F.sum("n_bytes").alias("bytes"))
    return sums.select(F.when(F.coalesce("bytes", F.lit(0)) > 0, F.col("nats") / F.lit(math.log(2)) / F.col("bytes")).otherwise(F.lit(float("inf"))).alias("bpb"))


def choice_correct(losses: DataFrame) -> DataFrame:
    """item, predicted, correct from rows of item, choice, gold, loss (one per scored token): the choice of the lowest mean loss, the first of equals."""
    means = losses.groupBy("item", "choice").agg(F.avg("loss").alias("mean"), F.first("gold").alias("gold"))
    best = means.groupBy("item").agg(F.min_by("choice", F.struct("mean", "choice")).alias("predicted"), F.first("gold").alias("gold"))
    return best.select("item", "predicted", (F.col("predicted") == F.col("gold")).alias("correct"))


def exact_correct(predictions: DataFrame) -> DataFrame:
    """item, correct from rows of item, predicted, actual (one per scored token): whether all are right."""
    return predictions.groupBy("item").agg(F.every(F.col("predicted") == F.col("actual")).alias("correct"))


def core(accuracies: DataFrame, baselines: DataFrame) -> DataFrame:
    """label, accuracy, centered, core from accuracies (label, accuracy) and baselines (label, percent). A label without a baseline raises an error; of repeated baselines the last by percent counts."""
    base = baselines.groupBy("label").agg(F.max("percent").alias("percent"))
    both = accuracies.join(F.broadcast(base), "label", "left")
    chance = F.lit(0.01) * F.coalesce("percent", F.raise_error(F.concat(F.lit("no baseline for "), F.col("label"))).cast("double"))
    out = both.select("label", "accuracy", ((F.col("accuracy") - chance) / (F.lit(1.0) - chance)).alias("centered"))
    return out.withColumn("core", F.avg("centered").over(Window.partitionBy(F.lit(0))))  # a row per task


def generative_accuracy(answers: DataFrame) -> DataFrame:
    """One row: n, accuracy from answers (gold, attempts: array of parsed answers, null where nothing could be parsed): the first parsed attempt counts."""
    first = F.get(F.filter("attempts", lambda a: a.isNotNull()), F.lit(0))
    return answers.agg(F.count("*").alias("n"), F.avg(F.coalesce((first == F.col("gold")).cast("double"), F.lit(0.0))).alias("accuracy"))


def top_k(df: DataFrame, group: list[str], by: str, k: int) -> DataFrame:
    """The rows of each group whose value is among its k highest; all that equal the k-th stay."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*group).orderBy(F.desc(by)))).where(F.col("_r") <= k).drop("_r")


def draw(logits: DataFrame, row: str = "row", token: str = "token", logit: str = "logit", temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """One token of each row, with the probability its logit gives it: the first arrival of exponential clocks. Temperature 0 takes the highest, the lowest token of equals."""
    if temperature == 0:
        return logits.groupBy(row).agg(F.max_by(token, F.struct(F.col(logit), -F.col(token))).alias(token))
    uniform = (F.pmod(F.xxhash64(row, token, F.lit(seed)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    clock = F.log(-F.log(uniform)) - F.col(logit) / temperature
    return logits.groupBy(row).agg(F.min_by(token, F.struct(clock, F.col(token))).alias(token))


def scored(items: DataFrame, ids: str = "tokens") -> DataFrame:
    """item, label, kind, choice, gold, pos, token, before: a row for each token to be scored, `before` the token that stands in front of it. items: item, label, kind, gold, token arrays, starts and ends."""
    each = items.select("item", "label", "kind", "gold", F.posexplode(F.arrays_zip(F.col(ids).alias("t"), F.col("starts").alias("s"), F.col("ends").alias("e"))).alias("choice", "z"))
    places = F.when(F.col("z.e") > F.col("z.s"), F.sequence(F.col("z.s"), F.col("z.e") - 1)).otherwise(F.array().cast("array<int>"))
    each = each.withColumn("pos", F.explode(places))
    return each.select("item", "label", "kind", "choice", "gold", "pos", F.get("z.t", F.col("pos")).alias("token"), F.get("z.t", F.col("pos") - 1).alias("before"))


def prepared(items: DataFrame, config: DataFrame, encode, seed: int = 2026, most: int | None = None) -> DataFrame:
    """item, label, kind, gold, tokens, starts, ends of all tasks at once: examples, prompts, tokens, spans and cropping.

    config: label, icl_task_type (multiple_choice, schema or language_modeling), num_fewshot, continuation_delimiter. items: item (dense numbers within its label), label, and what its kind needs (query and choices; context_options and continuation; context and
    continuation; gold). encode: prompt column to array<int>. Examples are the items behind one that its number's md5 picks. Labels without a config have no row; a task with too few items for its examples raises.
    """
    counts = items.groupBy("label").agg(F.count("*").alias("_n"))
    rows = items.join(F.broadcast(config.join(counts, "label")), "label")  # a row per task
    few = F.raise_error(F.concat(F.lit("too few items in "), F.col("label"))).cast("int")
    rows = rows.withColumn("_shots", F.when(F.col("num_fewshot") > F.col("_n") - 1, few).otherwise(F.col("num_fewshot")))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("item").cast("string"))), 1, 8), 16, 10).cast("long")
    wanted = rows.where("_shots > 0").select("label", F.col("item").alias("_i"), "_n", start.alias("_h"), F.explode(F.sequence(F.lit(0), F.col("_shots") - 1)).alias("_k"))
    wanted = wanted.withColumn("_j", F.pmod(F.col("_i") + 1 + F.pmod(F.col("_h") + F.col("_k"), F.col("_n") - 1), F.col("_n")))
    kind, d = F.col("icl_task_type"), F.col("continuation_delimiter")
    choice = F.concat(F.col("query"), d, F.coalesce(F.get("choices", F.col("gold")), F.lit("")))
    schema = F.concat(F.get("context_options", F.col("gold")), d, F.col("continuation"))
    plain = F.concat(strip(F.col("context")), d, F.col("continuation"))
    shot = F.when(kind == "multiple_choice", choice).when(kind == "schema", schema).otherwise(plain)
    texts = rows.select("label", F.col("item").alias("_j"), F.coalesce(shot, F.lit("")).alias("_t"))
    got = wanted.join(texts, ["label", "_j"]).groupBy("label", F.col("_i").alias("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_t"))), lambda x: x["_t"]).alias("shots"))
    rows = rows.join(got, ["label", "item"], "left").withColumn("shots", F.coalesce("shots", F.array().cast("array<string>")))
    head = _examples(F.col("shots"))
    ask = F.concat(head, strip(F.col("context")), d)
    prompts = (
        F.when(kind == "multiple_choice", F.transform("choices", lambda c: F.concat(head, F.col("query"), d, F.coalesce(c, F.lit("")))))
        .when(kind == "schema", F.transform("context_options", lambda c: F.concat(head, c, d, F.col("continuation"))))
        .otherwise(F.array(strip(ask), F.concat(ask, F.col("continuation"))))
    )
    rows = rows.withColumn("tokens", F.transform(prompts, encode)).select("item", "label", kind.alias("kind"), "gold", "tokens")
    parts = None
    for name, how in (("multiple_choice", "choice"), ("schema", "schema"), ("language_modeling", "language")):
        part = spans(rows.where(F.col("kind") == name), how)
        parts = part if parts is None else parts.unionByName(part)
    return cropped(parts, most) if most else parts


def evaluate_model(items: DataFrame, config: DataFrame, baselines: DataFrame, encode, score, seed: int = 2026, most: int | None = None) -> DataFrame:
    """label, accuracy, centered, core: from configured tasks and their items to the mean of accuracies above chance.

    score: from scored() to the same rows with `loss` and `predicted`; the network behind it is not part of this library. Choices and schemas are right where the right option has the lowest mean
    loss, continuations where every token was predicted. All tasks go through one plan.
    """
    rows = score(scored(prepared(items, config, encode, seed, most)))
    key = F.struct("label", "item").alias("item")
    options = choice_correct(rows.where("kind <> 'language_modeling'").select(key, "choice", "gold", "loss")).select("item", "correct")
    exact = exact_correct(rows.where("kind = 'language_modeling'").select(key, "predicted", F.col("token").alias("actual")))
    accuracy = options.unionByName(exact).groupBy(F.col("item.label").alias("label")).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return core(accuracy, baselines)


def response(generated: DataFrame, stops: list[int], ids: str = "ids", longest: int = 128) -> DataFrame:
    """generated with the tokens before the first stop token, `longest` at most."""
    return generated.withColumn(ids, upto(F.slice(ids, 1, longest), stops))


def attempts(generated: DataFrame, item: str, attempt: str, answer: Column, most: int) -> DataFrame:
    """item, attempts: the parsed answers of each item's first `most` attempts, in order; null where nothing could be parsed."""
    first = generated.where(F.col(attempt) < most).select(item, F.struct(F.col(attempt).alias("k"), answer.alias("a")).alias("x"))
    return first.groupBy(item).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["a"]).alias("attempts"))


def validation_loss(batches: DataFrame) -> DataFrame:
    """One row: loss, n_batches. batches: rank, batch, loss (one row per scored token; targets below 0 count for nothing, as does a batch without scored tokens). The mean over all ranks of the batches' means."""
    means = batches.where("target >= 0").groupBy("rank", "batch").agg(F.avg("loss").alias("mean"))
    return means.agg(F.avg("mean").alias("loss"), F.count("*").alias("n_batches"))
