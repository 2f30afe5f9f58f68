"""Training schedules as closed forms, and running figures over a log table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def learning_rate(step: Column, steps: int, warmup: float = 0.0, warmdown: float = 0.4, final: float = 0.0) -> Column:
    """Multiplier: a linear rise, a plateau, a linear fall to `final`. Step counts are rounded half to even."""
    up, down = round(warmup * steps), round(warmdown * steps)
    left = (F.lit(steps) - step) / F.lit(float(down or 1))
    return F.when(step < up, (step + 1) / F.lit(float(up or 1))).when(step <= steps - down, 1.0).otherwise(left + (1 - left) * final)


def plateau(progress: Column, start: float = 0.8) -> Column:
    """Multiplier: 1 up to `start`, then a linear fall to 0 at the end."""
    return F.when(progress < start, 1.0).otherwise(1 - (progress - start) / (1 - start))


def momentum(step: Column, first: float = 0.85, then: float = 0.95, over: int = 300) -> Column:
    part = F.least(step / F.lit(float(over)), F.lit(1.0))
    return (1 - part) * first + part * then


def weight_decay(step: Column, steps: int, decay: float, depth: int) -> Column:
    return F.lit(decay * (12 / depth) ** 2) * (1 - step / F.lit(float(steps)))


def batch_scale(tokens: int, reference: int = 1 << 19) -> float:
    """Learning rates grow with the square root of the batch."""
    return (tokens / reference) ** 0.5


def accumulation(tokens: int, batch: int, length: int, world: int) -> int:
    one = batch * length * world
    if one <= 0 or tokens % one:
        raise ValueError(f"{tokens} tokens are no multiple of {one}")
    return tokens // one


def flops_per_token(params: int, embedding: int, layers: int, heads: int, width: int, length: int) -> int:
    return 6 * (params - embedding) + 12 * layers * heads * width * length


def horizon(tokens_per_step: int, iterations: int = 0, flops: float = 0, per_token: int = 0, ratio: float = 0, params: int = 0) -> int:
    """Steps: as given, else by the compute, else by the tokens per parameter."""
    if iterations > 0:
        return iterations
    if flops > 0:
        return round(flops / (per_token * tokens_per_step))
    if ratio > 0:
        return round(params * ratio / tokens_per_step)
    raise ValueError("horizon(): give iterations, flops or ratio")


def smoothed(log: DataFrame, series: list[str], order: list[str], value: str, beta: float = 0.9, name: str = "ema") -> DataFrame:
    """log with the exponential mean of value within each series, corrected for its start (divided by 1 - beta ** k at the k-th row). Null values count as 0.

    The closed form, a sum of weighted values, by windows over blocks of rows so long that what lies two blocks back has no weight in double precision. beta must be above 0 and below 1.
    """
    if not 0 < beta < 1:
        raise ValueError("smoothed(): beta must lie between 0 and 1")
    length = math.ceil(math.log(1e-20) / math.log(beta))
    k = F.row_number().over(Window.partitionBy(*series).orderBy(*order)) - 1
    rows = log.withColumn("_k", k).withColumn("_b", F.floor(F.col("_k") / length)).withColumn("_p", F.col("_k") % length)
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * (1 - beta)
    inside = F.sum(x * F.pow(F.lit(beta), -F.col("_p"))).over(Window.partitionBy(*series, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(beta), F.col("_p"))
    rows = rows.withColumn("_in", inside)
    ends = rows.where(F.col("_p") == length - 1).select(*series, (F.col("_b") + 1).alias("_b"), F.col("_in").alias("_end"))
    carry = ends.withColumn("_carry", F.col("_end") + F.coalesce(F.lag("_end").over(Window.partitionBy(*series).orderBy("_b")), F.lit(0.0)) * beta**length).drop("_end")
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*series, "_b"]]
    both = rows.alias("r").join(carry.alias("c"), keys, "left")
    mean = F.col("r._in") + F.coalesce(F.col("c._carry"), F.lit(0.0)) * F.pow(F.lit(beta), F.col("r._p") + 1)
    return both.select(*(F.col(f"r.{c}") for c in log.columns), (mean / (1 - F.pow(F.lit(beta), F.col("r._k") + 1))).alias(name))


def running_best(log: DataFrame, series: list[str], order: list[str], value: str, name: str = "best") -> DataFrame:
    """log with the lowest value so far."""
    return log.withColumn(name, F.min(value).over(Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def progress(log: DataFrame, series: list[str], steps: int, tokens: int, warm: int = 10) -> DataFrame:
    """log (step, seconds) with tokens_per_second, trained (seconds without the first steps), percent, eta (seconds; null in the first steps)."""
    w = Window.partitionBy(*series).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = log.withColumn("tokens_per_second", F.floor(F.lit(tokens) / F.col("seconds"))).withColumn("trained", F.sum(F.when(F.col("step") > warm, F.col("seconds")).otherwise(0.0)).over(w))
    out = out.withColumn("percent", F.lit(100.0) * F.col("step") / steps)
    return out.withColumn("eta", F.when(F.col("step") > warm, (F.lit(steps) - F.col("step")) * F.col("trained") / (F.col("step") - warm)))
