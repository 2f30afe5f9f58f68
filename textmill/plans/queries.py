"""Named queries over the test tables, one or more for each operator of the core."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import bpe, chat, evaluation, ordered, packing, schedules, tasks
from ..operators.tokenizer import Tokenizer
from ..runtime import cut, scratch_folder
from ..sources import corpus, runs
from ..streaming import corpus as streams

#: The vocabulary of the queries that encode; the driver reads the file.
RANKS = os.environ.get("TEXTMILL_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
ROW, LONG_ROW, BATCH, WORLD = 2048, 8192, 8, 4
VOCABULARY = 32_768
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark, folder) -> DataFrame:
    return _t(spark, folder, "documents").select("doc_id", "text")


def _talk(spark, folder) -> DataFrame:
    """Each conversation once."""
    return _t(spark, folder, "smoltalk").select("conv_id", "messages").dropDuplicates(["conv_id"])


def _check(ids: Column) -> Column:
    """A number that depends on every element and its place."""
    return F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * (F.pmod(i, F.lit(1009)) + 1)), F.lit(0).cast("long"), lambda a, x: a + x)


def _total(ids: Column) -> Column:
    return F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)


@query
def word_histogram(spark, folder):
    return bpe.word_histogram(_documents(spark, folder))


@query
def char_budget_prefix(spark, folder):
    return ordered.char_budget(_documents(spark, folder), "doc_id", "text", 500_000).select("doc_id", "chars_before")


@query
def byte_pair_counts(spark, folder):
    return bpe.pair_counts(bpe.word_histogram(_documents(spark, folder)))


@query
def top_pair(spark, folder):
    return bpe.top_pair(bpe.pair_counts(bpe.word_histogram(_documents(spark, folder))))


@query
def bpe_vocabulary(spark, folder):
    """The default vocabulary size; the bytes of each token in hex, special tokens behind them."""
    vocab = bpe.learn(_documents(spark, folder), VOCABULARY)
    specials = bpe.special_ids(vocab)
    names = vocab.select("token_id", F.hex("bytes").alias("token")).unionByName(specials.select("token_id", "token"))
    return names.join(bpe.token_bytes(vocab, specials), "token_id")


@query
def encode_decode(spark, folder):
    """Each document as tokens behind the mark of its begin, and decoded: its bytes, and whether the text came back."""
    tok = Tokenizer.from_ranks(RANKS)
    ids = tok.encode(_documents(spark, folder).where("text is not null"), "text", prepend=tok.names[0])
    back = tok.decode(ids, "ids", "back")
    return back.select("doc_id", (F.size("ids") > 0).alias("encoded"), (F.octet_length("back") - F.octet_length(F.lit(tok.names[0]))).alias("n_bytes"), (F.col("back") == F.concat(F.lit(tok.names[0]), F.col("text"))).alias("same"))


def _folded(spark, folder) -> DataFrame:
    rows = _talk(spark, folder).withColumn("m", chat.folded(chat.tidy_roles(F.col("messages"))))
    return rows.where(chat.alternates(F.col("m")))


@query
def conversation_fold_system(spark, folder):
    m = F.col("m")
    return _folded(spark, folder).select("conv_id", F.size(m).alias("n_messages"), F.get(m, F.lit(0))["content"].alias("first_user"), F.get(m, F.size(m) - 1)["role"].alias("last_role"))


def _sound(spark, folder) -> DataFrame:
    # Unsound conversations go before they are rendered: a filter on the result would make it twice.
    return _talk(spark, folder).where(chat.alternates(chat.folded(chat.tidy_roles(F.col("messages")))))


@query
def conversation_render_bytes(spark, folder):
    ids, mask = F.col("ids"), F.col("mask")
    return chat.render(_sound(spark, folder)).select("conv_id", F.size(ids).alias("n_ids"), _total(mask).alias("n_masked"), _check(ids).alias("ids_check"), _check(mask).alias("mask_check"))


def _sequences(spark, folder) -> DataFrame:
    """Rendered conversations with dense numbers and, from the contents alone, their lengths: rendering is left to the step that reads the tokens."""
    rows = cut(_sound(spark, folder).select("conv_id", "messages"))  # each once: several steps read them
    m = chat.folded(chat.tidy_roles(F.col("messages")))
    n = F.aggregate(m, F.lit(1), lambda a, x: a + F.octet_length(x["content"]) + 2)
    return chat.render(rows.join(ordered.numbered(rows.select("conv_id"), ["conv_id"]), "conv_id").withColumn("n", n))


@query
def sft_targets(spark, folder):
    rows = packing.sft_rows(_sequences(spark, folder), BATCH, LONG_ROW, pad=256, world=WORLD)
    return rows.select("rank", F.col("batch").cast("long").alias("batch"), "idx", F.size("inputs").alias("width"), _check(F.col("inputs")).alias("inputs_check"), _check(F.col("targets")).alias("targets_check"))


@query
def pack_nextfit(spark, folder):
    rows = packing.rows(_sequences(spark, folder), LONG_ROW, "next", pad=256, world=WORLD)
    return rows.select("rank", "row", _check(F.col("inputs")).alias("inputs_check"), F.size(F.filter("targets", lambda t: t == -1)).alias("n_ignored"))


@query
def pack_bestfit(spark, folder):
    """Documents as bytes behind a begin mark, in full rows."""
    ids = ordered.numbered(_documents(spark, folder).where("length(text) > 0"), ["doc_id"]).withColumn("ids", F.concat(F.array(F.lit(256)), text.utf8_bytes(F.col("text"))))
    rows = packing.rows(ids, ROW, "best", pad=256, world=WORLD)
    return rows.select("rank", "row", F.size("inputs").alias("width"), _check(F.col("inputs")).alias("inputs_check"), F.array_min("targets").alias("least_target"))


@query
def task_mixture_schedule(spark, folder):
    sizes = [_t(spark, folder, n).count() for n in ("gsm8k", "arc", "mmlu")]
    return ordered.schedule(sizes, WORLD, 2 * sum(sizes) // WORLD, spark).withColumn("progress", F.round("progress", 6))


@query
def task_mixture(spark, folder):
    """Word problems twice and choice questions once, one after the other."""
    gsm = ordered.numbered(tasks.word_problems(_t(spark, folder, "gsm8k").dropDuplicates(["item_id"])), ["item_id"])
    arc = ordered.numbered(tasks.labelled_choices(_t(spark, folder, "arc").dropDuplicates(["item_id"])), ["item_id"])
    mixed = tasks.mixture([gsm, arc, gsm], [-1, 50, -1])
    return mixed.select("task_idx", "idx", F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


@query
def split_train_val(spark, folder):
    """The corpus in 16 shards by id; the last is for validation."""
    shard = F.pmod("doc_id", F.lit(16))
    return _documents(spark, folder).select("doc_id", shard.cast("int").alias("shard"), F.when(shard == 15, "val").otherwise("train").alias("split"))


@query
def shard_assignment(spark, folder):
    return ordered.shards(ordered.numbered(_documents(spark, folder).select("doc_id"), ["doc_id"]), "idx", WORLD)


@query
def file_split(spark, folder):
    """The documents table as shards: rows by file and split."""
    both = [corpus.read(spark, f"{folder}/documents.parquet", s).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return both[0].unionByName(both[1]).groupBy("split", "pf_idx").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _qa(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


@query
def gsm8k_messages(spark, folder):
    return _qa(tasks.word_problems(_t(spark, folder, "gsm8k")), "item_id")


@query
def mmlu_messages(spark, folder):
    return _qa(tasks.four_choices(_t(spark, folder, "mmlu")), "item_id")


@query
def arc_messages(spark, folder):
    return _qa(tasks.labelled_choices(_t(spark, folder, "arc")), "item_id")


def _words(spark, folder) -> DataFrame:
    return _t(spark, folder, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word <> ''").distinct()


@query
def spelling_messages(spark, folder):
    return _qa(tasks.spelling(_words(spark, folder)), "word")


@query
def letter_questions(spark, folder):
    """Letters and templates as Python's generator draws them."""
    return _qa(tasks.letter_questions(ordered.numbered(_words(spark, folder), ["word"])), "word")


@query
def letter_count(spark, folder):
    return _t(spark, folder, "part").select("p_partkey", *(text.occurrences(F.lower("p_name"), F.lit(c)).alias(f"n_{c}") for c in "aeinrs"))


@query
def extract_answer(spark, folder):
    return _t(spark, folder, "gsm8k").select("item_id", text.extract_answer(F.col("answer")).alias("number"), F.coalesce(text.extract_answer(F.col("answer")), F.lit("[invalid]")).alias("shown"))


@query
def seeded_split(spark, folder):
    """Words in the order that Python's own shuffle gives them, 90 % for training."""
    words = tasks.shuffled(_words(spark, folder), ["word"], exact=True)
    n = words.count()
    return tasks.split_ratio(words, n, "train").withColumn("split", F.lit("train")).unionByName(tasks.split_ratio(words, n, "test").withColumn("split", F.lit("test")))


def _items(spark, folder) -> tuple[DataFrame, int]:
    items = ordered.numbered(_t(spark, folder, "eval_items").where("query is not null and gold is not null and size(choices) > 0"), ["item_id"])
    return items, items.count()


def _prompts(spark, folder, exact: bool) -> DataFrame:
    items, n = _items(spark, folder)
    items = evaluation.fewshot_indices(items, n, 3, exact=exact)
    return evaluation.choice_prompts(evaluation.with_shots(items, evaluation.choice_shot(" ")))


@query
def fewshot_prompts(spark, folder):
    return _prompts(spark, folder, exact=False).select("item_id", F.posexplode("prompts").alias("choice", "prompt"))


@query
def fewshot_exact(spark, folder):
    """Shots as Python's generator draws them."""
    return _prompts(spark, folder, exact=True).select("item_id", F.array_join("shots_idx", ",").alias("shots_idx"), F.md5(F.array_join("prompts", "|")).alias("prompts_md5"))


def _bytes_of_prompts(spark, folder) -> DataFrame:
    items = _t(spark, folder, "eval_items").where("query is not null and size(choices) > 0")
    prompts = evaluation.choice_prompts(items.withColumn("shots", F.array().cast("array<string>")))
    return prompts.withColumn("tokens", F.transform("prompts", lambda p: F.concat(F.array(F.lit(256)), text.utf8_bytes(p))))


@query
def common_prefix_suffix(spark, folder):
    return _bytes_of_prompts(spark, folder).select("item_id", arrays.common_prefix(F.col("tokens")).alias("prefix"), arrays.common_suffix(F.col("tokens")).alias("suffix"))


@query
def crop_stack(spark, folder):
    """Prompts cut to their last 160 bytes and padded to the longest, with the span of the choice."""
    items = evaluation.cropped(evaluation.spans(_bytes_of_prompts(spark, folder), "choice"), 160).withColumn("stack", evaluation.stacked(F.col("tokens"), 256))
    each = items.select("item_id", F.posexplode(F.arrays_zip("stack", "starts", "ends")).alias("choice", "z"))
    return each.select("item_id", "choice", F.size("z.stack").alias("width"), "z.starts", "z.ends", _check(F.col("z.stack")).alias("ids_check"))


@query
def language_spans(spark, folder):
    """Word problems as contexts and answers as continuations: where the scored part begins and ends."""
    rows = _t(spark, folder, "gsm8k").select("item_id", F.col("question").alias("context"), F.col("answer").alias("continuation")).where("context is not null and length(continuation) > 0").dropDuplicates(["item_id"])
    rows = evaluation.language_prompts(rows.withColumn("shots", F.array().cast("array<string>")))
    rows = evaluation.spans(rows.withColumn("tokens", F.transform("prompts", text.utf8_bytes)), "language")
    return rows.select("item_id", F.col("starts")[0].alias("start"), F.col("ends")[0].alias("end"))


@query
def bits_per_byte(spark, folder):
    """Losses made from the word problems; every tenth token has no bytes."""
    losses = _t(spark, folder, "gsm8k").where("question is not null").select((F.length("question") % 260 - 2).alias("target"), ((F.coalesce(F.length("answer"), F.lit(0)) % 17) / 10).alias("loss"))
    lengths = spark.range(260).select(F.col("id").cast("int").alias("token_id"), F.when(F.col("id") % 10 == 0, 0).otherwise(1 + F.col("id") % 4).cast("int").alias("n_bytes"))
    return evaluation.bits_per_byte(losses, lengths).select(F.round("bpb", 6).alias("bpb"))


def _choice_losses(spark, folder) -> DataFrame:
    """A made-up loss of each choice."""
    rows = _t(spark, folder, "eval_items").where("gold is not null").select(F.col("item_id").alias("item"), "task_label", "gold", F.posexplode("choices").alias("choice", "c"))
    loss = ((F.coalesce(F.length("c"), F.lit(0)) * 7 + F.col("item") * 3 + F.col("choice") * 5) % 101) / 10
    return rows.select("item", "task_label", "gold", "choice", loss.alias("loss"))


@query
def choice_argmin(spark, folder):
    return evaluation.choice_correct(_choice_losses(spark, folder))


@query
def core_metric(spark, folder):
    losses = _choice_losses(spark, folder)
    right = evaluation.choice_correct(losses).join(losses.select("item", F.coalesce("task_label", F.lit("")).alias("label")).distinct(), "item")
    accuracy = right.groupBy("label").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    base = accuracy.select("label", F.lit(25.0).alias("percent"))
    return evaluation.core(accuracy, base).select("label", *(F.round(c, 6).alias(c) for c in ("accuracy", "centered", "core")))


def _suite(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choice items as tasks by label, word problems as continuations, labelled questions as schemas: items, config and chances that differ."""
    empty = lambda t: F.lit(None).cast(t)
    def shaped(df, label, **given):
        types = {"query": "string", "choices": "array<string>", "context_options": "array<string>", "context": "string", "continuation": "string", "gold": "int"}
        df = df.select(label.alias("label"), "key", *(given.get(c, empty(t)).cast(t).alias(c) for c, t in types.items()))
        return df.withColumn("item", F.row_number().over(Window.partitionBy("label").orderBy("key")) - 1)  # evaluation items are few

    choice = _t(spark, folder, "eval_items").where("query is not null and gold is not null and size(choices) > 0").withColumn("key", F.col("item_id"))
    label = F.concat(F.lit("choice_"), F.coalesce("task_label", F.lit("")))
    language = _t(spark, folder, "gsm8k").where("question is not null and length(answer) > 0").dropDuplicates(["item_id"]).withColumn("key", F.col("item_id"))
    right = F.array_position("choices.label", F.upper("answerkey")) - 1
    schema = _t(spark, folder, "arc").where("question is not null and answerkey is not null").dropDuplicates(["item_id"]).withColumn("key", F.col("item_id")).withColumn("right", right).where("right >= 0")
    items = shaped(choice, label, query=F.col("query"), choices=F.col("choices"), gold=F.col("gold"))
    items = items.unionByName(shaped(language, F.lit("word_problems"), context=F.col("question"), continuation=F.col("answer")))
    items = items.unionByName(shaped(schema, F.lit("questions"), context_options=F.transform("choices.text", lambda c: F.coalesce(c, F.lit(""))), continuation=F.col("question"), gold=F.col("right")))
    labels = items.select("label").distinct()
    kind = F.when(F.col("label") == "word_problems", "language_modeling").when(F.col("label") == "questions", "schema").otherwise("multiple_choice")
    config = labels.select("label", kind.alias("icl_task_type"), F.when(kind == "multiple_choice", 2).otherwise(0).alias("num_fewshot"), F.lit(" ").alias("continuation_delimiter"))
    chances = labels.select("label", F.when(F.col("label") == "word_problems", 0.0).when(F.col("label") == "questions", 20.0).otherwise(25.0).alias("percent"))
    return items, config, chances


def _made_up(rows: DataFrame) -> DataFrame:
    """A loss and a prediction for each token, in place of a network's."""
    return rows.withColumn("loss", F.pmod(F.col("token") * 7 + F.col("before") * 3 + F.col("pos"), F.lit(101)) / 10).withColumn("predicted", F.when(F.pmod(F.col("token") + F.col("pos"), F.lit(997)) == 0, -1).otherwise(F.col("token")))


@query
def evaluate_model(spark, folder):
    items, config, chances = _suite(spark, folder)
    out = evaluation.evaluate_model(items, config, chances, lambda p: F.concat(F.array(F.lit(256)), text.utf8_bytes(p)), _made_up)
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("accuracy", "centered", "core")))


@query
def exact_match(spark, folder):
    rows = _t(spark, folder, "gsm8k").where("length(answer) > 0").dropDuplicates(["item_id"]).select("item_id", F.posexplode(text.utf8_bytes(F.col("answer"))).alias("pos", "token"))
    guess = F.when(F.pmod(F.col("token") + F.col("pos"), F.lit(331)) == 0, -1).otherwise(F.col("token"))
    return evaluation.exact_correct(rows.select(F.col("item_id").alias("item"), guess.alias("predicted"), F.col("token").alias("actual")))


@query
def schema_spans(spark, folder):
    """Choices as contexts and the question as the common ending: where it begins and ends in each prompt."""
    rows = _t(spark, folder, "arc").where("question is not null and size(choices.text) > 1").dropDuplicates(["item_id"])
    rows = rows.select("item_id", F.transform("choices.text", lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit("|"))).alias("context_options"), F.col("question").alias("continuation"), F.array().cast("array<string>").alias("shots"))
    rows = evaluation.schema_prompts(rows)
    rows = evaluation.spans(rows.withColumn("tokens", F.transform("prompts", text.utf8_bytes)), "schema")
    return rows.select("item_id", F.posexplode(F.arrays_zip("starts", "ends")).alias("option", "z")).select("item_id", "option", "z.starts", "z.ends")


@query
def sft_validation_loss(spark, folder):
    """Losses made from the targets of each row."""
    rows = packing.sft_rows(_sequences(spark, folder), BATCH, LONG_ROW, pad=256, world=WORLD)
    each = rows.select("rank", "batch", F.explode("targets").alias("target"))
    out = evaluation.validation_loss(each.withColumn("loss", F.pmod(F.col("target"), F.lit(17)) / 4))
    return out.select(F.round("loss", 6).alias("loss"), "n_batches")


@query
def generated_answers(spark, folder):
    """Three made-up attempts for each word problem, cut at a stop token, of which the first that can be parsed counts."""
    gold = _t(spark, folder, "gsm8k").where("length(answer) > 0").dropDuplicates(["item_id"]).select("item_id", text.extract_answer(F.col("answer")).alias("gold"), "answer").where("gold is not null")
    tried = gold.select("item_id", "answer", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    # Attempt 0 is stopped before the answer, 1 has another one, 2 is right; which of them an item has depends on its number.
    said = F.when(F.pmod(F.col("item_id"), F.lit(3)) > F.col("k"), F.lit("I do not know")).when(F.pmod(F.col("item_id"), F.lit(5)) == 0, F.lit("#### 0.5")).otherwise(F.substring("answer", -100, 100))
    ids = tried.select("item_id", "k", F.concat(text.utf8_bytes(said), F.array(F.lit(260)), text.utf8_bytes(F.lit("#### 7"))).alias("ids"))
    cut_off = evaluation.response(ids, [260, 256])
    back = cut_off.withColumn("said", F.array_join(F.transform("ids", lambda b: F.char(b)), ""))
    both = gold.join(evaluation.attempts(back, "item_id", "k", text.extract_answer(F.col("said")), 3), "item_id")
    return evaluation.generative_accuracy(both).withColumn("accuracy", F.round("accuracy", 6))


@query
def merged_ids(spark, folder):
    """The bytes 't', 'h' of each question as one token, and the array moved round by one."""
    ids = arrays.merged(text.utf8_bytes(F.col("question")), 116, 104, 256)
    rows = _t(spark, folder, "gsm8k").where("question is not null").dropDuplicates(["item_id"]).select("item_id", ids.alias("ids"))
    return rows.select("item_id", F.size("ids").alias("n"), _check(F.col("ids")).alias("ids_check"), _check(arrays.rolled(F.col("ids"))).alias("rolled_check"))


@query
def split_on_specials(spark, folder):
    """Each question and answer between special tokens, cut at them again."""
    whole = F.concat(F.lit("<|user_start|>"), F.col("question"), F.lit("<|user_end|>"), F.col("answer"))
    rows = _t(spark, folder, "gsm8k").where("length(question) > 0 and length(answer) > 0").dropDuplicates(["item_id"])
    return rows.select("item_id", F.posexplode(text.on_specials(whole, bpe.SPECIALS)).alias("no", "piece"))


@query
def without_last_message(spark, folder):
    m = chat.without_last(chat.tidy_roles(F.col("messages")))
    return _talk(spark, folder).where("size(messages) > 0").select("conv_id", F.size(m).alias("n"), F.get(m, F.size(m) - 1)["role"].alias("last_role"))


@query
def escaped_text(spark, folder):
    """Documents with control characters shown as escapes."""
    return _documents(spark, folder).where(F.col("text").rlike("[\\x00-\\x1f\\x7f]")).select("doc_id", F.md5(text.escaped(F.col("text"))).alias("escaped_md5"))


@query
def event_windows(spark, folder):
    """Events per hour and kind."""
    return streams.event_counts(_t(spark, folder, "events").select("ts", "event_type").where("ts is not null")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query
def training_plan(spark, folder):
    """Steps and accumulation for the corpus's bytes at several batch sizes."""
    total = _documents(spark, folder).agg(F.sum(F.octet_length("text"))).first()[0]
    rows = [(b, schedules.accumulation(b * 2048 * 4 * 2, b, 2048, 4), schedules.horizon(b * 2048 * 4, ratio=20, params=total), schedules.horizon(b * 2048 * 4, flops=6.0e15, per_token=6_000_000)) for b in (1, 2, 4, 8)]
    return spark.createDataFrame(rows, "batch int, accumulation int, by_ratio long, by_flops long")


@query
def files_round_trip(spark, folder):
    """Items as JSON lines, conversations as JSON arrays, chances as CSV and words as lines: written, and read again by the library's readers."""
    base = scratch_folder(spark)
    _t(spark, folder, "eval_items").select("query", "choices", "gold").write.json(f"{base}/items")
    _talk(spark, folder).where("messages is not null").select(F.to_json("messages").alias("value")).write.text(f"{base}/talk")
    _t(spark, folder, "mix_targets").select(F.col("source").alias("Eval Task"), (F.col("target_share") * 100).alias("Random baseline")).write.option("header", True).csv(f"{base}/chances")
    _words(spark, folder).select(F.concat(F.lit(" "), "word").alias("value")).write.text(f"{base}/words")
    out = corpus.items(spark, f"{base}/items").agg(F.count("*").alias("n"), F.sum(F.size("choices")).cast("double").alias("x")).withColumn("what", F.lit("items"))
    out = out.unionByName(corpus.conversations(spark, f"{base}/talk").agg(F.count("*").alias("n"), F.sum(F.size("messages")).cast("double").alias("x")).withColumn("what", F.lit("talk")))
    out = out.unionByName(corpus.baselines(spark, f"{base}/chances").agg(F.count("*").alias("n"), F.round(F.sum("percent"), 6).alias("x")).withColumn("what", F.lit("chances")))
    out = out.unionByName(corpus.word_list(spark, f"{base}/words").agg(F.count("*").alias("n"), F.sum(F.length("word")).cast("double").alias("x")).withColumn("what", F.lit("words")))
    return out.select("what", "n", "x")


@query
def generative_accuracy(spark, folder):
    """Choice answers against attempts of which the first can't be parsed."""
    rows = tasks.labelled_choices(_t(spark, folder, "arc").where("answerkey is not null and question is not null"))
    gold = text.extract_label(F.col("messages")[1]["content"])
    guess = F.get("choices.label", (F.col("item_id") % 4).cast("int"))
    return evaluation.generative_accuracy(rows.select(gold.alias("gold"), F.array(F.lit(None).cast("string"), guess).alias("attempts"))).withColumn("accuracy", F.round("accuracy", 6))


@query
def lr_schedule(spark, folder):
    step = F.col("id")
    out = spark.range(1000).select(F.col("id").alias("step"), schedules.learning_rate(step, 1000, 0.05, 0.4, 0.1).alias("lr"), schedules.plateau(step / 1000.0).alias("sft_lr"))
    return out.select("step", F.round("lr", 6).alias("lr"), F.round("sft_lr", 6).alias("sft_lr"))


@query
def momentum_schedule(spark, folder):
    step = F.col("id")
    return spark.range(1000).select(F.col("id").alias("step"), F.round(schedules.momentum(step), 6).alias("momentum"), F.round(schedules.weight_decay(step, 1000, 0.2, 6), 6).alias("decay"))


def _log(spark, folder) -> DataFrame:
    return _t(spark, folder, "events").select("user_id", "ts", "event_id", "value")


@query
def ema_loss(spark, folder):
    """Each user's events as a loss curve."""
    return schedules.smoothed(_log(spark, folder), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("ema", 6).alias("ema"))


@query
def running_best(spark, folder):
    return schedules.running_best(_log(spark, folder), ["user_id"], ["ts", "event_id"], "value").select("event_id", "best")


@query
def training_progress(spark, folder):
    """Throughput and time left, on a log of 500 steps made up here."""
    log = spark.range(500).select(F.lit("run").alias("run"), F.col("id").alias("step"), (0.5 + (F.col("id") % 8) / 8).alias("seconds"))
    out = schedules.progress(log, ["run"], 1000, 524_288)
    return out.select("step", "tokens_per_second", F.round("trained", 6).alias("trained"), "percent", F.round("eta", 3).alias("eta"))


@query
def topk_with_ties(spark, folder):
    items = _t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_suppkey")
    return evaluation.top_k(items, ["l_suppkey"], "l_quantity", 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query
def sampled_tokens(spark, folder):
    """One event kind per user, drawn with the weight of its value."""
    rows = _t(spark, folder, "events").where("value is not null").groupBy("user_id", "event_type").agg(F.log(F.sum("value") + 1).alias("logit"))
    return evaluation.draw(rows, "user_id", "event_type", "logit")


@query
def greedy_tokens(spark, folder):
    rows = _t(spark, folder, "events").groupBy("user_id", F.length("event_type").alias("token")).agg(F.count("*").alias("logit"))
    return evaluation.draw(rows, "user_id", "token", "logit", temperature=0)


@query
def latest_checkpoint(spark, folder):
    names = spark.range(1, 21).select(F.format_string("model_%06d.pt", F.col("id") * 250).alias("name"))
    return runs.latest_step(names)


@query
def metrics_pivot(spark, folder):
    rows = spark.range(60).select(F.element_at(F.array(F.lit("loss"), F.lit("bpb"), F.lit("lr")), (F.col("id") % 3 + 1).cast("int")).alias("tag"), F.floor(F.col("id") / 3).alias("step"), (F.col("id") * 0.5).alias("value"))
    return runs.by_step(rows, ["loss", "bpb", "lr"])


@query
def streamed_histogram(spark, folder):
    """The word histogram by a stream over the shards, batch by batch."""
    base = scratch_folder(spark)
    q = streams.keep_histogram(streams.arriving(spark, f"{folder}/documents.parquet"), f"{base}/out", f"{base}/at")
    q.awaitTermination()
    return streams.summed_histogram(spark, f"{base}/out")


@query
def row_group_scan(spark, folder):
    """The documents by row group, those of both ranks."""
    source = f"{folder}/documents.parquet"
    both = corpus.row_groups(spark, source, rank=0, world=2).unionByName(corpus.row_groups(spark, source, rank=1, world=2))
    return both.groupBy("pf_idx", "rg_idx").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
