"""Problem 3: items of varying length in containers of fixed capacity, by cost-balanced packing.

An item of size n costs linear * n + quadratic * n * n, as a sequence costs a transformer. Items are spread over shards by a hash, so every
shard has a like mix of sizes whatever source is large; in each, the items go in descending order to the container of the lowest cost so far that has room for them.
Items above the capacity are cut before, at natural boundaries.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .splitting import size_of, split


def assign(sizes: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[int]:
    """The container of each size; sizes in descending order, none above the capacity.

    There are as many containers as the sum needs at least, and more where an item fits in none. A container without room for the item in hand waits until items have become small enough; as sizes only fall, each item moves at most one container there and back.
    """
    n = max(1, math.ceil(sum(sizes) / capacity))
    used = [0] * n
    cost = [0.0] * n
    ready = [(0.0, k) for k in range(n)]
    waiting: list[tuple[int, int]] = []
    out = []
    for size in sizes:
        while waiting and -waiting[0][0] >= size:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (cost[k], k))
        while ready and capacity - used[ready[0][1]] < size:
            k = heapq.heappop(ready)[1]
            heapq.heappush(waiting, (used[k] - capacity, k))
        if ready:
            k = heapq.heappop(ready)[1]
        else:
            k = len(used)
            used.append(0)
            cost.append(0.0)
        used[k] += size
        cost[k] += linear * size + quadratic * size * size
        heapq.heappush(ready, (cost[k], k))
        out.append(k)
    return out


def pack(items: DataFrame, id_col: str, text_col: str, capacity: int, unit: str = "utf8_bytes", linear: float = 1.0, quadratic: float = 1 / 2048, shard_items: int = 50_000, seed: int = 42) -> DataFrame:
    """<id>, piece, first, past, size, container: one row per item, or per piece of an item above the capacity.

    first and past are characters of the text. container is unique over all shards. Null and empty texts have size 0 and no row. Rows that repeat an id
    are counted once (ids must have one text). Shards hold about shard_items rows, so the fill loses about one container in each.
    """
    plain = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    whole = plain.select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first"), F.length("text").cast("long").alias("past"), size_of(F.col("text"), unit).cast("long").alias("size")).where(F.col("size") <= capacity)
    # Pieces are measured where they are cut: in bytes, a piece's size isn't its number of characters.
    large = split(plain, "text", capacity, 0, unit)
    parts = large.select("id", F.explode("pieces").alias("p")).select("id", F.col("p.no").alias("piece"), F.col("p.first").alias("first"), F.col("p.past").alias("past"))
    texts = plain.where(size_of(F.col("text"), unit) > capacity).dropDuplicates(["id"])
    parts = parts.dropDuplicates(["id", "piece"]).join(texts, "id").withColumn("size", size_of(F.substring(F.col("text"), (F.col("first") + 1).cast("int"), (F.col("past") - F.col("first")).cast("int")), unit).cast("long")).drop("text")
    rows = cut(whole.dropDuplicates(["id"]).unionByName(parts))
    shards = max(1, math.ceil(rows.count() / shard_items))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending")])
        base = table.column("shard")[0].as_py() << 32
        where = assign(table.column("size").to_pylist(), capacity, linear, quadratic)
        return table.drop_columns(["shard"]).append_column("container", pa.array([base + k for k in where], pa.int64()))

    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), F.lit(shards))).groupBy("shard").applyInArrow(fill, "id long, piece int, first long, past long, size long, container long")
    return placed.withColumnRenamed("id", id_col)


def fill_report(placed: DataFrame, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """One row: items, containers, mean fill, and the spread of the containers' cost (standard deviation by mean)."""
    each = placed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"), F.sum(F.col("size") * linear + F.col("size") * F.col("size") * quadratic).alias("cost"))
    return each.agg(F.sum("items").alias("n_items"), F.count("*").alias("n_containers"), F.max("used").alias("most_used"), (F.sum("used") / F.count("*") / capacity).alias("mean_fill"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"))
