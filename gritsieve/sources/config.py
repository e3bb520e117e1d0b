"""Detector configuration: discovery, TOML, and validation on the driver."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path

from ..functions import linear
from ..functions.dialect import PatternError, java_pattern
from . import catalogue

VARIABLE = "GRITSIEVE_CONFIG_PATH"
FILE = "detectors.toml"


class ConfigError(Exception):
    pass


@dataclass(frozen=True)
class Detector:
    ordinal: int
    name: str
    pattern: str
    finding_type: str
    severity: str
    ascii: bool = False  # read as RE2 does (see functions.dialect)

    @property
    def whole_file(self) -> bool:
        """A test of the pattern's text: flags such as (?si) stay with lines."""
        return "(?s)" in self.pattern

    @property
    def java(self) -> str:
        return java_pattern(self.pattern, self.ascii)

    @property
    def literals(self) -> tuple[str, ...]:
        return catalogue.LITERALS.get(self.name, ()) if self._built_in else ()

    @property
    def pretest(self) -> str:
        """What a text must match as a whole for the pattern to match in it."""
        return catalogue.PRETESTS.get(self.name, self.java) if self._built_in else self.java

    @property
    def gate(self) -> str | None:
        """Which shared expression stands before the pretest."""
        return catalogue.GATED.get(self.name) if self._built_in else None

    @property
    def linear(self) -> str | None:
        """Which expression of functions.linear finds the first match in time linear in the text, where the pattern itself would not."""
        return self.name if self._built_in and self.name in linear.FIRST else None

    @property
    def _built_in(self) -> bool:
        return any((self.name, self.pattern) == (n, p) for n, _, _, p in catalogue.DETECTORS)

    @property
    def anchored(self) -> bool:
        """Whether the start or end of a line may matter, so that whole texts don't stand for their lines."""
        bare = self.pattern.replace("[^", "[").replace(r"\$", "").replace(r"\^", "")
        return any(a in bare for a in ("^", "$", r"\A", r"\z", r"\B")) or r"\n" in self.pattern and not self._built_in


def normal_severity(text: str) -> str:
    upper = text.upper()
    return upper if upper in ("HIGH", "MEDIUM") else "LOW"


def built_in(ascii: bool = False) -> list[Detector]:
    return [Detector(i, name, pattern, kind, normal_severity(severity), ascii) for i, (name, severity, kind, pattern) in enumerate(catalogue.DETECTORS)]


def config_path() -> Path | None:
    """The first that exists: the environment's, ./detectors.toml, the user's. None: the built-in catalogue."""
    home = os.environ.get("XDG_CONFIG_HOME") or (Path.home() / ".config")
    candidates = [os.environ.get(VARIABLE), FILE, Path(home) / "gritsieve" / FILE]
    return next((Path(c) for c in candidates if c and Path(c).exists()), None)


def parse(text: str) -> list[Detector]:
    """Detectors of a TOML text with [[detectors]] tables; other keys than the four needed are ignored."""
    try:
        tables = tomllib.loads(text)["detectors"]
        rows = [tuple(t[k] for k in ("name", "pattern", "finding_type", "severity")) for t in tables]
        if not all(isinstance(v, str) for r in rows for v in r):
            raise ValueError("name, pattern, finding_type and severity must be strings")
    except KeyError as e:
        raise ConfigError(f"Failed to parse detectors.toml: missing field {e}") from e
    except (ValueError, TypeError) as e:
        raise ConfigError(f"Failed to parse detectors.toml: {e}") from e
    return [Detector(i, name, pattern, kind, normal_severity(severity)) for i, (name, pattern, kind, severity) in enumerate(rows)]


def load(path: str | Path | None = None) -> list[Detector]:
    """Detectors of a file, or of the first that discovery finds, checked; any failure is a ConfigError."""
    path = path or config_path()
    if path is None:
        detectors = built_in()
    else:
        try:
            text = Path(path).read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError) as e:
            raise ConfigError(f"Failed to read {path}: {e}") from e
        detectors = parse(text)
    for d in detectors:
        try:
            d.java
        except PatternError as e:
            raise ConfigError(f"Invalid detector pattern: {d.pattern}: {e}") from e
    return detectors


def compile_check(spark, detectors: list[Detector]) -> None:
    """Has Java compile every pattern on the driver, so that a bad one fails before any job."""
    for d in detectors:
        try:
            spark._jvm.java.util.regex.Pattern.compile(d.java)
        except Exception as e:
            raise ConfigError(f"Invalid detector pattern: {d.pattern}: {getattr(e, 'java_exception', e)}") from e
