"""Encoding and decoding with a vocabulary table, in Arrow batches."""

import base64
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PATTERN
from ..runtime import small
from .bpe import SPECIALS


@lru_cache(maxsize=4)
def _build(table: tuple[tuple[bytes, int], ...], pattern: str):
    import tiktoken

    return tiktoken.Encoding("textmill", pat_str=pattern, mergeable_ranks=dict(table), special_tokens={})


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary (bytes to number), a split pattern and special tokens behind the vocabulary's numbers."""

    table: tuple[tuple[bytes, int], ...]
    pattern: str = PATTERN
    names: tuple[str, ...] = SPECIALS
    specials: dict = field(init=False, compare=False)

    def __post_init__(self):
        top = max((i for _, i in self.table), default=-1)
        object.__setattr__(self, "specials", {s: top + 1 + k for k, s in enumerate(self.names)})

    @classmethod
    def of(cls, vocab: DataFrame, pattern: str = PATTERN, max_tokens: int = 1_000_000) -> "Tokenizer":
        return cls(tuple((bytes(r["bytes"]), r["token_id"]) for r in small(vocab, max_tokens, "Tokenizer: tokens")), pattern)

    @classmethod
    def bytes_only(cls) -> "Tokenizer":
        return cls(tuple((bytes([k]), k) for k in range(256)))

    @classmethod
    def from_ranks(cls, path: str, pattern: str = PATTERN) -> "Tokenizer":
        """From a file of base64 tokens and ranks."""
        with open(path, "rb") as file:
            return cls(tuple((base64.b64decode(a), int(b)) for a, b in map(bytes.split, file)), pattern)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, bytearray(b)) for b, i in self.table], "token_id int, bytes binary")

    @property
    def size(self) -> int:
        return len(self.table) + len(self.names)

    def special(self, name: str) -> int:
        if name not in self.specials:
            raise KeyError(f"{name} is no special token")
        return self.specials[name]

    @property
    def bos(self) -> int:
        return self.special(self.names[0])

    def token(self, number: int) -> str:
        for s, i in self.specials.items():
            if i == number:
                return s
        return dict((i, b) for b, i in self.table)[number].decode("utf-8", "replace")

    def _number(self, x: int | str | None) -> list[int]:
        return [] if x is None else [x if isinstance(x, int) else self.special(x)]

    def encode(self, df: DataFrame, text_col: str, out: str = "ids", prepend: int | str | None = None, append: int | str | None = None) -> DataFrame:
        """df with array<int> `out`; null texts stay null. Special tokens' names within a text are plain text."""
        head, tail = self._number(prepend), self._number(append)
        shared = df.sparkSession.sparkContext.broadcast((self.table, self.pattern))

        @F.pandas_udf("array<int>")
        def ids(texts: pd.Series) -> pd.Series:
            enc = _build(*shared.value)
            return texts.map(lambda t: None if t is None else [*head, *enc.encode_ordinary(t), *tail])

        return df.withColumn(out, ids(F.col(text_col)))

    def decode(self, df: DataFrame, ids_col: str, out: str = "text") -> DataFrame:
        """df with the text of the tokens; special ones show their names, bytes that are no UTF-8 become replacement characters."""
        shared = df.sparkSession.sparkContext.broadcast((self.table, tuple(self.specials.items())))
        names = [f.name for f in df.schema]

        def run(batches):
            table, specials = shared.value
            back = {i: b for b, i in table} | {i: s.encode() for s, i in specials}
            for batch in batches:
                texts = [None if r is None else b"".join(back[i] for i in r).decode("utf-8", "replace") for r in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, out])

        return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` string"]))
