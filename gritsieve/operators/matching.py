"""Detectors over lines and over whole texts.

Input is any DataFrame with path and content (text), read once. Detectors are unrolled into
expressions, so that every pattern is a literal that a task compiles once. A text is first tested
as a whole, by cheap conditions that hold wherever a detector matches; only texts that some
detector may match are cut into lines, and a line is tested against its text's detectors alone.
Nothing is shuffled. Patterns that would try long runs again at every place have linear forms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear
from ..functions.text import line_number_of_first, lines_of
from ..sources import catalogue
from ..sources.config import Detector

#: Columns of a finding, in the order of the report.
COLUMNS = ("file_path", "line_number", "finding_type", "severity", "matched_content", "plugin_name")
#: What orders the findings of one file: whole-file ones first, then by line, then by detector.
ORDER = ("phase", "detector_ord")


def _literals(text: Column, detector: Detector) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in detector.literals], F.lit(not detector.literals))


def _may_match(text: Column, detector: Detector, gates: dict[str, Column] | None = None) -> Column:
    """Whether a whole text may have a match. gates: columns that have the results of shared expressions already."""
    if detector.anchored and not detector.whole_file:
        return F.lit(True)
    gate = F.lit(True) if detector.gate is None else gates[detector.gate] if gates else text.rlike(catalogue.GATES[detector.gate])
    return _literals(text, detector) & gate & text.rlike(detector.pretest)


def _first_match(text: Column, detector: Detector, i: int, number: Column) -> Column:
    """(d, line_number, matched_content) of a detector's first match in a text, or null."""
    if detector.linear:
        matched = linear.FIRST[detector.linear](text, detector.ascii)
        condition = _literals(text, detector) & (matched != "")
    else:
        matched = F.regexp_extract(text, detector.java, 0)
        condition = _literals(text, detector) & text.rlike(detector.java)
    return F.when(condition, F.struct(F.lit(i).alias("d"), number.alias("line_number"), matched.alias("matched_content")))


def _named(detectors: list[Detector]) -> list[Column]:
    """finding_type, severity and plugin_name by place among the detectors."""
    look = lambda values: F.get(F.array(*map(F.lit, values)), F.col("d"))
    return [
        look([d.finding_type for d in detectors]).alias("finding_type"),
        look([d.severity for d in detectors]).alias("severity"),
        look([d.name for d in detectors]).alias("plugin_name"),
        look([d.ordinal for d in detectors]).alias("detector_ord"),
    ]


def find(docs: DataFrame, detectors: list[Detector]) -> DataFrame:
    """All findings, with the columns that order them: of each detector the first match in each line, or in the whole text; both kinds may report the same."""
    content, unit = F.col("content"), F.col("unit")
    gates = {name: F.col(f"gate_{name}") for name in catalogue.GATES if any(d.gate == name for d in detectors)}
    gated = docs.select("path", "content", *[content.rlike(catalogue.GATES[name]).alias(f"gate_{name}") for name in gates])
    tests = [F.when(_may_match(content, d, gates), i) for i, d in enumerate(detectors)]
    hit = gated.select("path", "content", F.array_compact(F.array(F.lit(None).cast("int"), *tests)).alias("hits")).where(F.size("hits") > 0)

    # A row for the whole text, where a whole-file detector may match, and one for each line.
    piece = lambda phase, at, text: F.struct(F.lit(phase).alias("phase"), at.cast("long").alias("at"), text.alias("text"))
    nothing = F.array().cast("array<struct<phase:int,at:bigint,text:string>>")
    of_kind = lambda whole: F.arrays_overlap("hits", F.array(*[F.lit(i) for i, d in enumerate(detectors) if d.whole_file == whole]))
    units = []
    if any(d.whole_file for d in detectors):
        units.append(F.when(of_kind(True), F.array(piece(0, F.lit(0), content))).otherwise(nothing))
    if not all(d.whole_file for d in detectors):
        units.append(F.when(of_kind(False), F.transform(lines_of(content), lambda line, at: piece(1, at + 1, line))).otherwise(nothing))
    pieces = hit.select("path", "hits", F.explode(F.concat(*units) if units else nothing).alias("unit")).select("path", "hits", "unit.*")

    text, phase = F.col("text"), F.col("phase")
    found = []
    for i, d in enumerate(detectors):
        number = line_number_of_first(text, d.java) if d.whole_file else F.col("at")
        found.append(F.when((phase == (0 if d.whole_file else 1)) & F.array_contains("hits", i), _first_match(text, d, i, number)))
    none = F.lit(None).cast("struct<d:int,line_number:bigint,matched_content:string>")
    rows = pieces.select("path", "phase", F.explode(F.array_compact(F.array(none, *found))).alias("f")).select("path", "phase", "f.*")
    named = dict(zip(("finding_type", "severity", "plugin_name", "detector_ord"), _named(detectors))) if detectors else dict.fromkeys(("finding_type", "severity", "plugin_name"), F.lit("")) | {"detector_ord": F.lit(0)}
    named = {name: column.alias(name) for name, column in named.items()}
    return rows.select(F.col("path").alias("file_path"), "line_number", named["finding_type"], named["severity"], "matched_content", named["plugin_name"], "phase", named["detector_ord"])


def within_file() -> list[Column]:
    """What orders a file's findings: whole-file ones, then line, then detector."""
    return [F.col("phase"), F.when(F.col("phase") == 1, F.col("line_number")).otherwise(0), F.col("detector_ord")]


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in the report's order: by path, then as within a file."""
    return findings.orderBy("file_path", *within_file()).select(*COLUMNS)
