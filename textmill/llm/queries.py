"""The pN_ queries: each operator over its whole intended tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, small

from . import cross_split, defects, garbled, leakage, mixing, near_duplicates, oracle, packing, splitting

WORDS, LIKENESS, MIN_WORDS = 3, 0.60, 30


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.pairs(_table(spark, folder, "documents"), words=WORDS, threshold=LIKENESS, min_words=MIN_WORDS)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(_table(spark, folder, "documents"))


def _limit(spark: SparkSession, folder: str, field: str, purpose: str) -> dict:
    rows = small(_table(spark, folder, "size_limits").where((F.col("field_name") == field) & (F.col("purpose") == purpose)), 1, "size_limits")
    return {"max_size": rows[0]["max_size"], "overlap": rows[0]["overlap_size"], "unit": rows[0]["unit"]}


def _values(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, folder, "documents").select(F.lit("documents.text").alias("field_name"), F.col("doc_id").alias("row_id"), F.lit(-1).cast("long").alias("turn"), "text")
    talk = _table(spark, folder, "smoltalk").select("conv_id", F.posexplode("messages").alias("turn", "m"))
    return docs, talk.select(F.lit("messages.content").alias("field_name"), F.col("conv_id").alias("row_id"), F.col("turn").cast("long").alias("turn"), F.col("m.content").alias("text"))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    found = []
    for values, field in zip(_values(spark, folder), ("documents.text", "messages.content")):
        limit = _limit(spark, folder, field, "split")
        forced = F.exists("pieces", lambda p: p["kind"] == splitting.FORCED) & (F.col("unbroken") > limit["max_size"])
        found.append(splitting.split(values, "text", **limit).where(F.size("pieces") > 1).withColumn("forced", forced.cast("long")))
    return found[0].unionByName(found[1]).dropDuplicates(["field_name", "row_id", "turn"])


def p2_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the pieces of each value are right: none above the limit, each with exactly the overlap, from the begin to the end, and cut where their kind says."""
    found = []
    for values, field in zip(_values(spark, folder), ("documents.text", "messages.content")):
        limit = _limit(spark, folder, field, "split")
        keys = ["field_name", "row_id", "turn"]
        whole = values.dropDuplicates(keys)
        cuts = splitting.split(whole, "text", **limit)
        p, n = F.col("pieces"), F.col("n_size")
        behind = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: b["first"] == F.greatest(F.lit(0), a["past"] - limit["overlap"]))
        both = cuts.join(whole.where(F.length("text") > limit["max_size"]), keys)
        # A piece that isn't forced ends behind white space, or at the end.
        kinds = F.forall(p, lambda x: x["kind"].isin(splitting.FORCED, splitting.END) | F.substring(F.col("text"), x["past"].cast("int"), F.lit(1)).rlike(r"(?U)[\s\x1c-\x1f]"))
        found.append(both.select(*keys, F.forall(p, lambda x: x["past"] - x["first"] <= limit["max_size"]).alias("within"), F.forall(behind, lambda x: x).alias("overlaps"), ((p[0]["first"] == 0) & (F.element_at(p, -1)["past"] == n)).alias("covers"), kinds.alias("kinds")))
    return found[0].unionByName(found[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).select("field_name", "row_id", "turn", "forced")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).select("field_name", "row_id", "turn", F.explode("pieces").alias("p")).select("field_name", "row_id", "turn", "p.no", "p.first", "p.past", "p.kind")


def _pack(spark: SparkSession, folder: str, field: str) -> tuple[DataFrame, int]:
    limit = _limit(spark, folder, field, "pack")
    if field == "documents.text":
        items, key = _table(spark, folder, "documents"), "doc_id"
    else:
        items, key = _table(spark, folder, "smoltalk").select("conv_id", F.array_join(F.transform("messages", lambda m: m["content"]), "").alias("text")), "conv_id"
    return packing.pack(items, key, "text", limit["max_size"], limit["unit"]), limit["max_size"]


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return _pack(spark, folder, "messages.content")[0]


def p3_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _pack(spark, folder, "documents.text")[0]


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    out = [packing.fill_report(*_pack(spark, folder, field)).withColumn("field_name", F.lit(field)) for field in ("documents.text", "messages.content")]
    return out[0].unionByName(out[1])


def p3_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of each field: items and their total size, whether no container is above its capacity, whether only larger items are split, and whether 95 % of the room is used, but for one container."""
    out = []
    for field in ("documents.text", "messages.content"):
        placed, capacity = _pack(spark, folder, field)
        placed = cut(placed.toDF("id", *placed.columns[1:]))
        used = placed.groupBy("container").agg(F.sum("size").alias("used")).agg(F.max("used").alias("most"), F.sum("used").alias("used"), F.count("*").alias("n"))
        each = placed.groupBy("id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size")).agg(F.count("*").alias("n_items"), F.sum("size").alias("size"), F.every((F.col("pieces") > 1) == (F.col("size") > capacity)).alias("whole"))
        both = used.crossJoin(each)  # a row each
        out.append(both.select(F.lit(field).alias("field_name"), "n_items", "size", (F.col("most") <= capacity).alias("within"), "whole", (F.col("used") >= 0.95 * capacity * (F.col("n") - 1)).alias("filled")))
    return out[0].unionByName(out[1])


def p4_validated(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoff, recall and precision of each defect on spoilt pairs that took no part in fitting."""
    return defects.validation(_table(spark, folder, "smoltalk"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The defect of the highest posterior."""
    return p4_labels(spark, folder).select("conv_id", "turn", F.col("labels")[0].alias("defect"))


def p4_labels(spark: SparkSession, folder: str) -> DataFrame:
    return defects.detect(_table(spark, folder, "smoltalk"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    talk = _table(spark, folder, "smoltalk").select(F.lit("smoltalk").alias("tab"), F.col("conv_id").alias("id"), "split", "source", cross_split.conversation_text(F.col("messages")).alias("text"))
    problems = _table(spark, folder, "gsm8k").select(F.lit("gsm8k").alias("tab"), F.col("item_id").alias("id"), "split", "source", F.col("question").alias("text"))
    split = F.lower(F.trim("split"))
    kind = F.when(split == "train", True).when(split.isin("test", "validation"), False)
    tidy = F.regexp_replace(F.lower(F.trim("source")), "-", "_")
    return talk.unionByName(problems).withColumn("train", kind).withColumn("split", split).withColumn("source", tidy)


HELD_OUT = {"words": WORDS, "threshold": LIKENESS, "min_words": MIN_WORDS}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    ids = cross_split.overlaps(_records(spark, folder).where("train is not null"), **HELD_OUT)
    return ids.select("tab", F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.report(_records(spark, folder).where("train is not null"), **HELD_OUT)


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.classes(_records(spark, folder).where("train is not null"), **HELD_OUT).withColumn("overlap", F.round("overlap", 6))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("item_id", "doc_id")


def p6_removal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.removal_spans(leakage.leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")))


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    tidy = F.regexp_replace(F.lower(F.trim("source")), "-", "_")
    docs = _table(spark, folder, "documents").select("doc_id", "text", F.array(tidy).alias("sources"))
    return mixing.mix(docs, _table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_mix(spark, folder), _table(spark, folder, "mix_targets"))


def _checked_mix(spark: SparkSession, folder: str, several: bool) -> DataFrame:
    tidy = F.regexp_replace(F.lower(F.trim("source")), "-", "_")
    targets = _table(spark, folder, "mix_targets")
    docs = _table(spark, folder, "documents").select("doc_id", "text", F.array(tidy).alias("sources"))
    if several:
        # Every third document also belongs to the listed source behind its own.
        names = F.array(*(F.lit(r["source"]) for r in small(targets.select("source").orderBy("source"), 10_000, "mix_targets")))
        own = F.get("sources", F.lit(0))
        at = F.array_position(names, own)
        docs = docs.withColumn("sources", F.when((F.pmod("doc_id", F.lit(3)) == 0) & (at > 0), F.array(own, F.get(names, F.pmod(at, F.size(names)).cast("int")))).otherwise(F.col("sources")))
    mixed = cut(mixing.mix(docs, targets))
    there = docs.where("length(text) > 0").select(F.explode("sources").alias("source")).distinct().withColumn("there", F.lit(True))
    found = mixing.shares(mixed, targets).join(targets.select("source", "max_repeats"), "source").join(there, "source", "left")
    goal = F.col("target_share") / F.sum(F.when(F.col("there"), F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # a row per source
    # A share can be missed by a document.
    one = mixed.agg((F.max("n_tokens") / F.sum(F.col("n_tokens") * F.col("uses"))).alias("one"))
    near = F.abs(F.col("actual_share") - F.when(F.col("there"), goal).otherwise(0.0)) < F.greatest(F.lit(0.01), F.col("one"))
    found = found.crossJoin(F.broadcast(one))  # a row
    return found.select("source", F.coalesce("there", F.lit(False)).alias("has_documents"), near.alias("reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"))


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source reaches its share (of the sources that have documents) within 0.01 or one document, and uses no document too often."""
    return _checked_mix(spark, folder, several=False)


def p7_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_checked, with documents that belong to two sources."""
    return _checked_mix(spark, folder, several=True)


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with wide letters, garbled here without loss: whether nearly all are found, and what is restored is the original."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = garbled.fit(docs)
    unsound = garbled.detect(docs, model=model).select("doc_id")
    good = cut(docs.where(F.col("text").rlike("\\p{L}*[^\\x00-\\x7f]\\p{L}+")).join(unsound, "doc_id", "left_anti"))
    bad = good.select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    both = good.join(garbled.detect(bad, model=model), "doc_id", "left")
    return both.agg(F.count("*").alias("n"), F.count("chains").alias("found"), F.count("restored").alias("whole"), F.sum((F.col("restored") == F.col("text")).cast("long")).alias("right")).select(
        (F.col("n") > 0).alias("tried"), (F.col("found") >= 0.97 * F.col("n")).alias("found"), (F.col("right") >= 0.97 * F.col("whole")).alias("right")
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.detect(_table(spark, folder, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.detect(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p2_checked, p3_conversations, p3_documents, p3_report, p3_checked, p4_found, p4_labels, p4_validated, p5_found, p5_report, p5_classes, p6_found, p6_removal_spans, p7_mix, p7_shares, p7_checked, p7_overlap, p8_found, p8_restored, p8_roundtrip)}
ORACLES: dict[str, str] = oracle.ORACLES
