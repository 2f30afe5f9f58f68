"""Row numbers and running sums over a whole table, without putting it into one task.

The rows are range-partitioned by the order, each partition is summed, and the sums of the partitions before it are added. What
is gathered is one row per partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def running(df: DataFrame, order: list[str], value: Column, name: str, per_partition: int = 1_000_000) -> DataFrame:
    """df with `name`: the sum of value over all rows before, by `order`, which must be unique. Null values count as 0."""
    value = F.coalesce(value.cast("long"), F.lit(0).cast("long"))
    n = df.count()
    parts = max(1, math.ceil(n / per_partition), min(df.sparkSession.sparkContext.defaultParallelism, n // 1000))
    # Written once: range bounds come from a sample, so a recomputed partition could hold other rows.
    placed = cut(df.withColumn("_v", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    return placed.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_v", "_part", "_in", "_before")


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """df with a dense 0-based row number by `order`."""
    return running(df, order, F.lit(1), name)


def seeded(df: DataFrame, key: list[str], seed: int = 2026, name: str = "idx") -> DataFrame:
    """df numbered in a pseudo-random order that depends on the key columns and the seed only."""
    return numbered(df.withColumn("_h", F.xxhash64(*key, F.lit(seed))), ["_h", *key], name).drop("_h")


def python_shuffle(df: DataFrame, n: int, idx: str = "idx", seed: int = 2026, max_rows: int = 5_000_000) -> DataFrame:
    """df renumbered as random.Random(seed).shuffle() would leave a list of its n rows. The permutation is made on the driver, so n is bounded; take seeded() beyond."""
    import random

    if n > max_rows:
        raise ValueError(f"python_shuffle(): {n} rows; use seeded() for more than {max_rows}")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    import pandas as pd

    table = df.sparkSession.createDataFrame(pd.DataFrame({idx: pd.Series(order, dtype="int64"), "_to": range(n)}))
    return df.join(table, idx).drop(idx).withColumnRenamed("_to", idx)


def char_budget(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """The documents read, in order of id, until their characters reach the budget: those before which fewer were read. Null texts have 0; ids must be unique.

    Only ids and lengths are put in order; the texts are read where the ids lie below the last one taken.
    """
    sizes = running(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("_n")), ["_id"], F.col("_n"), "chars_before").where(F.col("chars_before") < budget)
    taken = cut(sizes.select("_id", "chars_before"))
    last = taken.agg(F.max("_id")).first()[0]
    return docs.select(id_col, text_col).where(F.col(id_col) <= F.lit(last)).join(taken, F.col(id_col) == F.col("_id")).drop("_id")


def numbered_within(df: DataFrame, group: str, idx: str, name: str, per_bucket: int = 1_000_000) -> DataFrame:
    """df with a dense 0-based number within each group, by the number `idx`, which has about as many values as there are rows: no range partitioning is needed."""
    df = df.withColumn("_b", F.floor(F.col(idx) / per_bucket))
    counts = df.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    before = counts.select(group, "_b", (F.sum("_c").over(Window.partitionBy(group).orderBy("_b")) - F.col("_c")).alias("_before"))  # a row for a million
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy(idx)) - 1
    return df.withColumn("_in", inside).join(before, [group, "_b"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def shards(df: DataFrame, key: str, world: int) -> DataFrame:
    """df with `rank`, the round-robin share of its dense number `key`."""
    return df.withColumn("rank", F.pmod(F.col(key), F.lit(world)).cast("int"))


def schedule(sizes: list[int], world: int, steps: int, spark) -> DataFrame:
    """rank, step, task_idx, idx, epoch, progress: what each rank draws from concatenated tasks that start over at their end.

    Rank r's k-th example is number r + k * world of the endless concatenation. Valid for world up to the smallest task's size, beyond which ValueError is raised.
    """
    if not sizes or min(sizes) < world:
        raise ValueError("schedule(): every task needs as many examples as there are ranks")
    total = sum(sizes)
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    k, r = F.col("id") / world, F.pmod("id", F.lit(world))
    at = F.pmod(F.col("id"), F.lit(total))
    task = sum((at >= s).cast("int") for s in starts[1:]) if len(starts) > 1 else F.lit(0)
    out = spark.range(world * steps).select(r.cast("int").alias("rank"), F.floor(k).alias("step"), task.alias("task_idx"), at.alias("at"), F.floor(F.col("id") / total).alias("epoch"))
    begin = F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("task_idx") + 1)
    return out.select("rank", "step", F.col("task_idx").cast("int").alias("task_idx"), (F.col("at") - begin).alias("idx"), "epoch", ((F.col("step") + 1) * world / F.lit(float(total))).alias("progress"))
