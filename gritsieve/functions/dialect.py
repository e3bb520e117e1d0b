"""From the configuration's regular expressions to Java's.

The configuration's dialect is Unicode-aware, runs in linear time and has neither look-around
nor back-references. What Java would read otherwise is rewritten, and what it can't express the
same way is refused. Matching by Java backtracks: a pattern with nested repetition can be slow.

Beside it there is the ASCII reading, which is RE2's and so that of the SQL of the queries: classes and word
boundaries know ASCII alone, and only folding of case goes beyond it.
"""

from __future__ import annotations

import re

#: Unicode classes and folding, and only \n as a line end.
PREFIX = "(?Ud)"
#: In the ASCII reading, where all else is written out.
ASCII_PREFIX = "(?d)"

_WORD = "[0-9A-Za-z_]"
#: Word boundaries of the ASCII reading (Java's own take letters and digits beyond ASCII for words), and what is blank.
ASCII_EDGES = {"b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"}
ASCII_BLANKS = r"\t\n\f\r "
#: Characters beyond ASCII that fold to an ASCII letter; Java would fold a dotless i as well.
FOLDED = {"k": r"\x{212A}", "s": r"\x{17F}"}

_POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\x00-\x7F", "blank": r" \t", "cntrl": r"\p{Cntrl}", "digit": "0-9", "graph": r"!-~", "lower": "a-z", "print": r" -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": r"0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_ASCII = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "cntrl": r"\x00-\x1F\x7F"}
_PLAIN_ESCAPES = set(r".+*?()|[]{}^$#&-~/ \nrtfabBdDwWsSAz\"'=:;,<>@!%_`") | set("pPx")


class PatternError(ValueError):
    pass


def java_pattern(pattern: str, ascii: bool = False) -> str:
    """The pattern for Spark's functions, flags included; PatternError if there is none."""
    return ASCII_PREFIX + _AsciiTranslator(pattern).run() if ascii else PREFIX + _Translator(pattern).run()


class _Translator:
    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.multiline = bool(re.search(r"\(\?[a-zA-Z]*m", pattern))

    def run(self) -> str:
        repeated = False
        while self.at < len(self.text):
            c = self.text[self.at]
            was, repeated = repeated, False
            if c == "\\":
                self.escape(inside=False)
            elif c == "[":
                self.char_class()
            elif c == "(":
                self.group()
            elif c == "$" and not self.multiline:
                self.put(r"\z", 1)
            elif c in "*+?" or c == "{" and re.match(r"\{\d+(,\d*)?\}", self.text[self.at :]):
                if was and c != "?":
                    raise PatternError(f"repetition of a repetition at {self.at}")
                end = self.at + 1 if c != "{" else self.text.index("}", self.at) + 1
                self.put(self.text[self.at : end], end - self.at)
                repeated = True
            else:
                self.plain(c)
        return "".join(self.out)

    def plain(self, c: str) -> None:
        self.put(c, 1)

    def put(self, piece: str, used: int) -> None:
        self.out.append(piece)
        self.at += used

    def escape(self, inside: bool) -> None:
        nxt = self.text[self.at + 1 : self.at + 2]
        if m := re.match(r"\\[uU]\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", self.text[self.at :]):
            self.put(r"\x{" + (m[1] or m[2] or m[3]) + "}", m.end())
        elif nxt == "v":
            self.put(r"\x0B", 2)
        elif nxt == "b" and self.text[self.at + 2 : self.at + 3] == "{":
            raise PatternError("half word boundaries are not supported")
        elif not nxt or nxt not in _PLAIN_ESCAPES or nxt == "b" and inside:
            raise PatternError(f"unsupported escape \\{nxt} at {self.at}")
        elif nxt in "pP" and (m := re.match(r"\\[pP](\{\^?[^}]*\}|[A-Za-z])", self.text[self.at :])):
            self.put(m[0], m.end())
        elif nxt in "<>@!%_`\"'=:;,":
            self.put(nxt, 2)  # not letters: the escape is idle
        else:
            self.put("\\" + nxt, 2)

    def group(self) -> None:
        rest = self.text[self.at :]
        if m := re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", rest):
            self.put("(", m.end())
        elif re.match(r"\(\?(<?[=!]|>|#|P[=>])", rest):
            raise PatternError(f"look-around, atomic groups and back-references are not supported, at {self.at}")
        elif m := re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])", rest):
            on, off, end = m[1], (m[2] or "")[1:], m[3]
            if set(on + off) - set("imsxu") or "u" in off:
                raise PatternError(f"unsupported flags at {self.at}")
            on, off = on.replace("u", ""), off.replace("u", "")
            flags = on + ("-" + off if off else "")
            self.put(f"(?{flags}{end}" if flags or end == ":" else "", m.end())
        elif rest.startswith("(?"):
            raise PatternError(f"unsupported group at {self.at}")
        else:
            self.put("(", 1)

    def char_class(self) -> None:
        self.put("[", 1)
        if self.text[self.at : self.at + 1] == "^":
            self.put("^", 1)
        if self.text[self.at : self.at + 1] == "]":
            self.put(r"\]", 1)
        while True:
            rest = self.text[self.at :]
            if not rest:
                raise PatternError("unclosed class")
            if m := re.match(r"\[:(\^?)(\w+):\]", rest):
                inner = _ASCII.get(m[2]) or _POSIX.get(m[2])
                if inner is None:
                    raise PatternError(f"unknown class {m[2]}")
                self.put(f"[{m[1]}{inner}]", m.end())
            elif rest[0] == "[":
                self.char_class()
            elif rest[0] == "]":
                self.put("]", 1)
                return
            elif rest[0] == "\\":
                self.escape(inside=True)
            elif rest.startswith(("--", "~~")) and not rest.startswith("--]"):
                raise PatternError("class difference is not supported")
            elif re.match(r"-[^\]]", rest) and self._after_range():
                self.put(r"\-", 1)  # a dash right after a range stands for itself
            else:
                self.put(rest[0], 1)

    def _after_range(self) -> bool:
        return bool(re.search(r"[^\\]-[^\]]$", "".join(self.out[-3:]))) and len(self.out) >= 3


class _AsciiTranslator(_Translator):
    """Java folds ASCII letters here; the two that others fold to are given these beside them."""

    def __init__(self, pattern: str):
        super().__init__(pattern)
        self.folds = [False]  # of each open group, whether case is folded at this place

    def plain(self, c: str) -> None:
        if c == ")" and len(self.folds) > 1:
            self.folds.pop()
        if self.folds[-1] and c.lower() in FOLDED:
            self.put(f"[{c}{FOLDED[c.lower()]}]", 1)
        elif self.folds[-1] and not c.isascii():
            raise PatternError(f"folding beyond ASCII is not supported, at {self.at}")
        else:
            self.put(c, 1)

    def escape(self, inside: bool) -> None:
        nxt = self.text[self.at + 1 : self.at + 2]
        if nxt == "s":
            self.put(ASCII_BLANKS if inside else f"[{ASCII_BLANKS}]", 2)
        elif nxt == "S":
            self.put(r"\S\x0B" if inside else f"[^{ASCII_BLANKS}]", 2)
        elif nxt in ASCII_EDGES and not inside and self.text[self.at + 2 : self.at + 3] != "{":
            self.put(ASCII_EDGES[nxt], 2)
        else:
            super().escape(inside)

    def group(self) -> None:
        began = self.at
        super().group()
        m = re.match(r"\(\?([a-z]*)(?:-([a-z]+))?([:)])", self.text[began : self.at])
        on, off, end = m.groups("") if m else ("", "", "")
        fold = "i" in on or self.folds[-1] and "i" not in off
        if end == ")":
            self.folds[-1] = fold
        else:
            self.folds.append(fold)

    def char_class(self) -> None:
        began, at = self.at, len(self.out)
        super().char_class()
        if self.folds[-1]:
            written = self.text[began : self.at]
            if "[" in written[1:] or not written.isascii():
                raise PatternError(f"folding of such a class is not supported, at {began}")
            some = re.compile("[" + written[1:].removeprefix("^"), re.ASCII | re.IGNORECASE)
            self.out.insert(at + 1 + written.startswith("[^"), "".join(x for letter, x in FOLDED.items() if some.match(letter)))
