"""Exclude patterns: a glob dialect in which * also passes separators.

? is any one character, * any run, ** as a whole component any number of directories, [a-z] and
[!a-z] classes. No braces, no escapes; a leading dot is nothing special; the whole text must match.
"""

from __future__ import annotations

import re


class GlobError(ValueError):
    pass


def glob_regex(glob: str) -> str:
    """An anchored expression that Java and Python read alike."""
    out, i = [r"(?s)\A"], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            stars = len(glob) - i - len(glob[i:].lstrip("*"))
            if stars > 2:
                raise GlobError("wildcards are either regular `*` or recursive `**`")
            if stars == 2:
                if (i and glob[i - 1] != "/") or glob[i + 2 : i + 3] not in ("", "/"):
                    raise GlobError("recursive wildcards must form a single path component")
                if glob[i + 2 : i + 3] == "/":
                    out.append("(?:[^/]+/)*" if i else "(?:.*/)?")
                    i += 3
                else:
                    out.append(".*")
                    i += 2
                continue
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            start = i + 1 + (glob[i + 1 : i + 2] == "!")
            end = glob.find("]", start + 1)
            if end < 0:
                raise GlobError("invalid range pattern")
            out.append(_class(glob[start:end], negated=start > i + 1))
            i = end
        else:
            out.append(_literal(c))
        i += 1
    return "".join(out) + r"\z"


def _class(body: str, negated: bool) -> str:
    parts, i = [], 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            if body[i] <= body[i + 2]:
                parts.append(f"{_literal(body[i])}-{_literal(body[i + 2])}")
            i += 3
        else:
            parts.append(_literal(body[i]))
            i += 1
    if not parts:
        return "." if negated else r"[^\x{0}-\x{10FFFF}]"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/" else "\\" + c if ord(c) < 128 else c


def parse_excludes(text: str | None) -> list[str]:
    """Expressions of a comma-separated list; blank items are dropped."""
    found = []
    for item in (text or "").split(","):
        if item.strip():
            try:
                found.append(glob_regex(item.strip()))
            except GlobError as e:
                raise GlobError(f"Invalid exclude pattern '{item}': {e}") from e
    return found


def python_regex(expression: str) -> re.Pattern[str]:
    return re.compile(expression.replace(r"\z", r"\Z").replace(r"[^\x{0}-\x{10FFFF}]", "(?!)"))
