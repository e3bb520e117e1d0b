"""Reports: JSON, summary line, files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching, summary
from .scan import Result


def report_json(result: Result) -> str:
    """The report as JSON, two spaces an indent, keys in the report's order."""
    return json.dumps(
        {
            "status": "FAIL" if result.findings else "PASS",
            "findings": [{c: f[c] for c in matching.COLUMNS} for f in result.findings],
            "files_scanned": result.files_scanned,
            "total_lines": result.total_lines,
            "excluded_files": result.excluded_files,
            "scan_time": result.scan_time,
        },
        indent=2,
        ensure_ascii=False,
    )


def summary_line(result: Result) -> str:
    if not result.findings:
        return "No secrets found."
    high, medium, low = result.counts
    return f"WARNING: {len(result.findings)} potential secret(s) detected (HIGH: {high}, MEDIUM: {medium}, LOW: {low})"


def write_report(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def report_frame(findings: DataFrame, texts: DataFrame, excluded: DataFrame, scan_time: str) -> DataFrame:
    """The report as one row, for a bounded number of findings; larger scans keep findings as a table."""
    line = F.when(F.col("phase") == 1, F.col("line_number")).otherwise(0)
    key = F.struct("file_path", "phase", line.alias("line"), "detector_ord", F.struct(*matching.COLUMNS).alias("finding"))
    listed = findings.agg(F.transform(F.sort_array(F.collect_list(key)), lambda k: k["finding"]).alias("findings"))
    out = excluded.agg(F.sort_array(F.collect_list("path")).alias("excluded_files"))
    # One row meets one row.
    joined = listed.join(summary.scanned(texts), how="cross").join(out, how="cross")
    return joined.select(F.when(F.size("findings") > 0, "FAIL").otherwise("PASS").alias("status"), "findings", "files_scanned", "total_lines", "excluded_files", F.lit(scan_time).alias("scan_time"))


def write_findings(findings: DataFrame, path: str, kind: str = "json") -> None:
    """Findings as a table; every executor writes its own."""
    findings.select(*matching.COLUMNS).write.mode("overwrite").format(kind).save(path)
