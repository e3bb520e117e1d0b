"""Text expressions: lines, line numbers, readable content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(content: Column) -> Column:
    """Lines of a text: parted at \\n, without one \\r before it; no empty line after a last \\n; a lone \\r parts nothing."""
    parts = F.split(content, "\n", -1)
    ended = F.element_at(parts, -1) == ""
    # The last part is a line only if it isn't empty, and its \r stays, since no \n follows it.
    whole = F.slice(parts, 1, F.size(parts) - 1)
    trimmed = F.transform(whole, lambda line: F.regexp_replace(line, r"\r\z", ""))
    plain = F.when(F.contains(content, F.lit("\r")), trimmed).otherwise(whole)
    return F.when(ended, plain).otherwise(F.concat(plain, F.array(F.element_at(parts, -1))))


def line_count(content: Column) -> Column:
    """How many lines a text has, without making them."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (breaks + F.when((content == "") | F.endswith(content, F.lit("\n")), 0).otherwise(1)).cast("long")


def line_number_of_first(content: Column, java: str) -> Column:
    """The line, from 1, on which a pattern's first match begins; only \\n counts."""
    before = F.element_at(F.split(content, java, 2), 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def readable(content: Column) -> Column:
    """Whether bytes are text: valid UTF-8 without a zero byte."""
    text = content.cast("string")
    return F.is_valid_utf8(text) & (F.instr(text, "\0") == 0)


def shell_quoted(text: str) -> str:
    """A text in single quotes for a POSIX shell."""
    return "'" + text.replace("'", "'\"'\"'") + "'"
