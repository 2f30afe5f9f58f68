"""Conversations as token and loss-mask arrays. messages is array<struct<role, content>>."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf8_bytes
from .tokenizer import Tokenizer, _build


def tidy_roles(messages: Column) -> Column:
    """Roles in lower case and without blanks at the ends; null contents become empty."""
    return F.transform(messages, lambda m: F.struct(F.lower(F.trim(m["role"])).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))


def folded(messages: Column) -> Column:
    """A leading system message is put before the next message's content, without a separator; its own place goes. Alone, it is dropped."""
    second = F.get(messages, F.lit(1))
    joined = F.struct(second["role"].alias("role"), F.concat(F.get(messages, F.lit(0))["content"], second["content"]).alias("content"))
    rest = F.when(F.size(messages) > 1, F.concat(F.array(joined), F.slice(messages, F.lit(3), F.greatest(F.lit(0), F.size(messages) - 2)))).otherwise(F.slice(messages, 2, 1))
    return F.when(F.get(messages, F.lit(0))["role"] == "system", rest).otherwise(messages)


def alternates(messages: Column) -> Column:
    """Whether user and assistant take turns, the user first; false for null or no messages."""
    want = lambda i: F.when(F.pmod(i, F.lit(2)) == 0, "user").otherwise("assistant")
    fits = F.forall(F.transform(messages, lambda m, i: F.coalesce(m["role"] == want(i), F.lit(False))), lambda x: x)
    return F.coalesce((F.size(messages) > 0) & fits, F.lit(False))


def without_last(messages: Column) -> Column:
    return F.slice(messages, F.lit(1), F.greatest(F.lit(0), F.size(messages) - 1))


def render(df: DataFrame, messages_col: str = "messages", tokenizer: Tokenizer | None = None) -> DataFrame:
    """df with ids array<int> and mask array<int> of equal length: what the assistant says, and its end mark, has mask 1.

    Conversations whose roles do not alternate after folding give null arrays. Without a tokenizer each byte is a token, in pure column expressions.
    """
    tok = tokenizer or Tokenizer.bytes_only()
    bos, us, ue, as_, ae = (tok.special(s) for s in tok.names)
    out = df.withColumn("_m", folded(tidy_roles(F.col(messages_col))))
    out = out.withColumn("_m", F.when(alternates(F.col("_m")), F.col("_m")))
    contents = F.transform("_m", lambda m: m["content"])
    if tokenizer is None:
        out = out.withColumn("_t", F.transform(contents, utf8_bytes))
    else:
        shared = df.sparkSession.sparkContext.broadcast((tok.table, tok.pattern))

        @F.pandas_udf("array<array<int>>")
        def encoded(rows: pd.Series) -> pd.Series:
            enc = _build(*shared.value)
            return rows.map(lambda r: None if r is None else [enc.encode_ordinary(t) for t in r])

        out = out.withColumn("_t", encoded(contents))
    one = lambda x: F.array(F.lit(x))
    user = lambda i: F.pmod(i, F.lit(2)) == 0
    ids = F.flatten(F.transform("_t", lambda t, i: F.when(user(i), F.concat(one(us), t, one(ue))).otherwise(F.concat(one(as_), t, one(ae)))))
    mask = F.flatten(F.transform("_t", lambda t, i: F.when(user(i), F.array_repeat(F.lit(0), F.size(t) + 2)).otherwise(F.concat(one(0), F.array_repeat(F.lit(1), F.size(t) + 1)))))
    return out.withColumn("ids", F.concat(one(bos), ids)).withColumn("mask", F.concat(one(0), mask)).drop("_m", "_t")
