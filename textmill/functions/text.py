"""Column expressions over strings. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts text into words before byte pairs are merged.
PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""


def words(text: Column, pattern: str = PATTERN) -> Column:
    """The pre-tokens of a text, in order; their concatenation is the text. (?U) gives white space its Unicode meaning."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def utf8_bytes(text: Column) -> Column:
    """The bytes of a string as array<int>; empty for the empty string."""
    # Read as ISO 8859-1, each byte is one character: one pass, where cutting the bytes out of a hex string would be one pass per byte.
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.when(F.octet_length(text) > 0, F.transform(chars, lambda c: F.ascii(c))).when(text.isNotNull(), F.array().cast("array<int>"))


def on_specials(text: Column, names: tuple[str, ...]) -> Column:
    """The text cut before and behind each special token's name, the names kept as pieces; empty pieces are left out."""
    literal = "|".join(re.escape(n) for n in names)
    return F.filter(F.split(text, f"(?={literal})|(?<={literal})"), lambda x: x != "")


#: What stands before a final answer, and the forms of a number and of a letter.
NUMBER, NUMBER_OR_LETTER = r"#### (-?[0-9.,]+)", r"#### (-?[0-9.,]+|[A-Z]\b)"


def extract_answer(text: Column) -> Column:
    """The number behind the first '#### ', without commas; null if there is none."""
    return F.nullif(F.replace(F.regexp_extract(text, NUMBER, 1), F.lit(","), F.lit("")), F.lit(""))


def extract_label(text: Column) -> Column:
    """As extract_answer(), but a capital letter counts too."""
    return F.nullif(F.replace(F.regexp_extract(text, NUMBER_OR_LETTER, 1), F.lit(","), F.lit("")), F.lit(""))


def without_markers(text: Column) -> Column:
    """The text without the signs << and >>; what stands between them stays."""
    return F.regexp_replace(text, "<<|>>", "")


def strip(text: Column) -> Column:
    """The text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def spelled(word: Column) -> Column:
    return F.array_join(F.split(word, ""), ",")


def occurrences(text: Column, letter: Column) -> Column:
    """How often a single character occurs."""
    return F.length(text) - F.length(F.replace(text, letter, F.lit("")))


def lettered(labels: Column, choices: Column) -> Column:
    """'A:first' 'B:second' ... joined without a separator; a null choice counts as empty."""
    return F.array_join(F.zip_with(labels, choices, lambda a, c: F.concat(a, F.lit(":"), F.coalesce(c, F.lit("")))), "")


def escaped(text: Column) -> Column:
    """Control characters shown as their four-digit escapes."""
    points = F.split(text, "")
    return F.array_join(F.transform(points, lambda c: F.when(c.rlike(r"\p{C}"), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0")))).otherwise(c)), "")
