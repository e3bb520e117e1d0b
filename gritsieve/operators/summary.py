"""Totals of a scan. Each is one row, of zeros where there is nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_count

EXIT_MODES = ("always", "critical", "strict")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("high", "medium", "low")], F.count("*").alias("findings"))


def status(findings: DataFrame) -> DataFrame:
    """FAIL if there is any finding, whatever the exit mode."""
    return findings.agg(F.when(F.count("*") > 0, "FAIL").otherwise("PASS").alias("status"))


def exit_codes(findings: DataFrame) -> DataFrame:
    """(exit_mode, exit_code): 0 without findings; else always 0, critical 1 for any HIGH, strict 1."""
    counts = severity_counts(findings)
    code = F.when(F.col("findings") == 0, 0).when(F.col("exit_mode") == "always", 0).when((F.col("exit_mode") == "critical") & (F.col("high") == 0), 0).otherwise(1)
    return counts.select(F.explode(F.array(*map(F.lit, EXIT_MODES))).alias("exit_mode"), "high", "findings").select("exit_mode", code.alias("exit_code"))


def exit_code(high: int, findings: int, mode: str) -> int:
    if mode not in EXIT_MODES:
        raise ValueError(f"exit mode {mode!r}")
    return int(findings > 0 and (mode == "strict" or mode == "critical" and high > 0))


def scanned(docs: DataFrame) -> DataFrame:
    """files_scanned and total_lines of readable texts; an empty text is a file of no lines."""
    return docs.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum(line_count(F.col("content"))), F.lit(0)).cast("long").alias("total_lines"))
