"""A scan of paths from request to report."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from ..operators import matching, paths, summary
from ..sources import config, files, globs, listing
from ..sources.config import Detector


@dataclass(frozen=True)
class ScanOptions:
    paths: Sequence[str]
    output: str | None = None
    verbose: bool = False
    exclude: str | None = None
    exit_mode: str = "strict"
    config: str | None = None

    def __post_init__(self) -> None:
        if not self.paths:
            raise ValueError("at least one path is needed")
        if self.exit_mode not in summary.EXIT_MODES:
            raise ValueError(f"exit mode {self.exit_mode!r}")


@dataclass(frozen=True)
class Scan:
    """findings carries its ordering columns; texts and excluded are what it was made from."""

    findings: DataFrame
    texts: DataFrame
    excluded: DataFrame
    detectors: list[Detector]


@dataclass(frozen=True)
class Result:
    findings: list[Row]
    files_scanned: int
    total_lines: int
    excluded_files: list[str]
    scan_time: str

    @property
    def counts(self) -> tuple[int, int, int]:
        of = [f.severity for f in self.findings]
        return of.count("HIGH"), of.count("MEDIUM"), of.count("LOW")


def scan_texts(texts: DataFrame, detectors: list[Detector]) -> DataFrame:
    """Findings of any (path, content) frame."""
    return matching.find(texts, detectors)


def plan_scan(spark: SparkSession, options: ScanOptions) -> Scan:
    """Lists, then loads detectors, then parses exclusions, so that errors come in that order and before any file is read."""
    listed = listing.target_frame(spark, options.paths)
    detectors = config.load(options.config)
    config.compile_check(spark, detectors)
    patterns = globs.parse_excludes(options.exclude)
    kept, out = paths.split_targets(listed, patterns)
    texts = files.texts(files.read_files(kept))
    return Scan(scan_texts(texts, detectors), texts, out, detectors)


def run_scan(spark: SparkSession, options: ScanOptions) -> Result:
    """The whole result on the driver, as the report needs it; a large scan writes plan_scan().findings instead."""
    began = time.monotonic()
    scan = plan_scan(spark, options)
    scan.texts.persist()
    try:
        findings = matching.ordered(scan.findings).collect()
        totals = summary.scanned(scan.texts).first()
    finally:
        scan.texts.unpersist()
    excluded = [r.path for r in scan.excluded.orderBy("path").select("path").collect()]
    tenths = int((time.monotonic() - began) * 10)
    return Result(findings, totals.files_scanned, totals.total_lines, excluded, f"{tenths // 10}.{tenths % 10}s")
