"""Column expressions over arrays of token numbers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjacent(ids: Column) -> Column:
    """array<struct<a, b>> of neighbours, overlapping ones included; empty below two elements."""
    return F.when(F.size(ids) > 1, F.zip_with(F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def merged(ids: Column, a: int, b: int, new: int) -> Column:
    """Every a, b replaced by new, from the left and without overlaps."""

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        return F.when((F.size(done) > 0) & (last == a) & (x == b), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.lit(new)))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(ids, F.array().cast("array<int>"), step)


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once although f's lambdas name it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def common_prefix(sequences: Column) -> Column:
    """Length of the longest common beginning of several arrays; 0 for none."""

    def of(seqs):
        shortest = F.array_min(F.transform(seqs, lambda s: F.size(s)))
        first = F.get(seqs, F.lit(0))
        places = F.when(shortest > 0, F.sequence(F.lit(0), shortest - 1)).otherwise(F.array().cast("array<int>"))
        differs = F.filter(places, lambda i: F.exists(seqs, lambda s: F.get(s, i) != F.get(first, i)))
        return F.coalesce(F.get(differs, F.lit(0)), shortest, F.lit(0))

    return bound(sequences, of)


def common_suffix(sequences: Column) -> Column:
    return common_prefix(F.transform(sequences, lambda s: F.reverse(s)))


def last(ids: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer."""
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def padded(ids: Column, width: Column, value: int) -> Column:
    """ids, filled up at the right."""
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), width - F.size(ids))))


def next_tokens(ids: Column) -> Column:
    """The target of each position but the last: the token behind it."""
    return F.slice(ids, F.lit(2), F.greatest(F.lit(0), F.size(ids) - 1))


def rolled(ids: Column) -> Column:
    """The array moved one place to the left, its first element at the end."""
    return F.when(F.size(ids) > 0, F.concat(next_tokens(ids), F.slice(ids, 1, 1))).otherwise(ids)


def masked_targets(ids: Column, mask: Column, ignore: int = -1) -> Column:
    """Next tokens where the next position's mask is 1, else the ignore label."""
    return F.zip_with(next_tokens(ids), F.slice(mask, F.lit(2), F.greatest(F.lit(0), F.size(mask) - 1)), lambda t, m: F.when(m == 1, t).otherwise(F.lit(ignore)))


def first_lowest(values: Column) -> Column:
    """0-based place of the first lowest element."""
    return F.array_position(values, F.array_min(values)) - 1


def upto(ids: Column, stops: list[int]) -> Column:
    """The elements before the first stop token."""
    at = [F.nullif(F.array_position(ids, s), F.lit(0)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), ids).otherwise(F.slice(ids, F.lit(1), (first - 1).cast("int")))
