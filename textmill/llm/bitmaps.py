"""Bitmaps of hashes, by which rows that no join wants are left out before they are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions, and of all together at most.
BITMAP, MOST_BITS = 1 << 15, 1 << 28


def bitmap(values: DataFrame) -> np.ndarray:
    """Bytes in which a bit is set for each value (one column of longs): 16 bits for a value or more, MOST_BITS (32 MB) at most; beyond that more bits are set, and less is left out."""
    values = values.toDF("v")
    size = min(MOST_BITS, max(BITMAP, 1 << (16 * values.count()).bit_length()))
    bit = values.select((F.col("v").bitwiseAND(F.lit(size - 1)) + 1).alias("bit"))
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((size // BITMAP, BITMAP // 8), np.uint8)
    for r in parts.toLocalIterator():
        out[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def marked(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Rows whose keys are in `wanted`, and a few others: a join with `wanted` must follow, which then shuffles little. The bitmap is broadcast; wanted is read twice."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64(*keys))))
    names = rows.columns

    def run(batches):
        for batch in batches:
            keep = is_set(bits.value, batch.column(len(names)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))], names=names).filter(pa.array(keep))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_marked", F.xxhash64(*keys)).mapInArrow(run, schema)
