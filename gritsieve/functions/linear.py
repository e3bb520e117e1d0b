"""First matches of built-in patterns that a backtracking matcher tries again at every place of a long run.

Each expression gives what the pattern's first match is, or an empty text. A text is cut where no
match goes on, and what may begin or end one is looked for once in each piece, so that time is
linear in the text. Each follows either reading of dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import ASCII_BLANKS, ASCII_EDGES, ASCII_PREFIX, PREFIX, java_pattern

_LOCAL = "[A-Za-z0-9._%+-]"
_SCHEME = "(?i:mysql|postgres|mongodb|redis)://"


def _first(found: Column) -> Column:
    return F.coalesce(F.get(F.filter(found, lambda m: m != ""), F.lit(0)), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _flags_edge_blanks(ascii: bool) -> tuple[str, str, str]:
    """The flags of a reading, its word boundary, and its blanks within a class."""
    return (ASCII_PREFIX, ASCII_EDGES["b"], ASCII_BLANKS) if ascii else (PREFIX, r"\b", r"\s")


def first_email(text: Column, ascii: bool = False) -> Column:
    """A match has one @, with the end of a run of its first part before it: the match begins at the first word boundary of that run."""
    flags, edge, _ = _flags_edge_blanks(ascii)

    def around(parts: Column, k: Column) -> Column:
        left, right = F.get(parts, k), F.get(parts, k + 1)
        domain = F.regexp_extract(right, flags + r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + edge, 0)
        run = F.length(F.regexp_extract(F.reverse(left), f"^{_LOCAL}+", 0))
        local = F.regexp_extract(F.substr(left, F.greatest(F.length(left) - run, F.lit(1))), flags + edge + rf"{_LOCAL}++\z", 0)
        return F.when((domain != "") & (run > 0) & (local != ""), F.concat(local, F.lit("@"), domain)).otherwise("")

    found = _let(F.split(text, "@", -1), lambda parts: _first(F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda k: around(parts, k))))
    return F.when(F.contains(text, F.lit("@")), found).otherwise("")


def first_database_url(text: Column, ascii: bool = False) -> Column:
    """A match lies between quotes and blanks, and begins at the first scheme there, or nowhere there."""
    flags, _, blanks = _flags_edge_blanks(ascii)
    scheme = java_pattern(_SCHEME, ascii=True).removeprefix(ASCII_PREFIX) if ascii else _SCHEME
    runs = F.regexp_extract_all(text, F.lit(flags + rf"[^'\"{blanks}]++"), F.lit(0))
    some = F.filter(runs, lambda r: F.contains(r, F.lit("://")) & F.contains(r, F.lit("@")))
    pattern = flags + rf"^(?>(?s:.*?)(?={scheme}))({scheme}[^'\"{blanks}]+@[^'\"{blanks}]+)"
    return F.when(F.contains(text, F.lit("://")), _first(F.transform(some, lambda r: F.regexp_extract(r, pattern, 1)))).otherwise("")


def first_mongodb_url(text: Column, ascii: bool = False) -> Column:
    """No match begins behind the last @."""
    pattern = _flags_edge_blanks(ascii)[0] + r"mongodb(?:\+srv)?://[^:]+:[^@]+@[^/]+"
    after = F.substring_index(text, "@", -1)
    before = F.substr(text, F.lit(1), F.length(text) - F.length(after))
    return F.when(F.contains(before, F.lit("mongodb")), F.regexp_extract(text, pattern, 0)).otherwise("")


FIRST = {
    "EmailDetector": first_email,
    "DatabaseURLDetector": first_database_url,
    "MongoDBConnectionStringDetector": first_mongodb_url,
}
