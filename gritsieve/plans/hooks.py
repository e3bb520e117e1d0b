"""Checks that a git hook makes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import policy
from ..operators.summary import exit_code
from ..sources import listing
from .report import report_json
from .scan import Result, ScanOptions, run_scan

PRE_COMMIT, PRE_PUSH = "pre-commit", "pre-push"


@dataclass(frozen=True)
class HookOptions:
    hook_type: str
    allowed_repos: str | None = None
    blocked_repos: str | None = None
    exclude: str | None = None

    def __post_init__(self) -> None:
        if self.hook_type not in (PRE_COMMIT, PRE_PUSH):
            raise ValueError(f"hook type {self.hook_type!r}")
        if self.hook_type == PRE_COMMIT and (self.allowed_repos is not None or self.blocked_repos is not None):
            raise ValueError("--allowed-repos and --blocked-repos are only supported for pre-push hooks")
        if self.hook_type == PRE_PUSH and self.exclude is not None:
            raise ValueError("--exclude is only supported for pre-commit hooks")


def check_commit(spark: SparkSession, options: HookOptions, repository: str = ".", say: Callable[[str], None] = print) -> int:
    """1 if a staged file has findings, the first such file by path shown; else 0. All files are scanned in one run."""
    staged = listing.staged_files(repository)
    if not staged:
        return 0
    result = run_scan(spark, ScanOptions(staged, exclude=options.exclude))
    if not result.findings:
        return 0
    first = result.findings[0].file_path
    say(f"ERROR: Secret detected in {first}")
    say(report_json(replace(result, findings=[f for f in result.findings if f.file_path == first])))
    return 1


def check_push(spark: SparkSession, options: HookOptions, repository: str = ".", remote: str | None = None, say: Callable[[str], None] = print) -> int:
    """1 if the remote isn't allowed or the repository has a HIGH finding; else 0."""
    remote = listing.push_remote(repository) if remote is None else remote
    row = spark.range(1).select(policy.push_allowed(F.lit(remote), F.lit(options.allowed_repos), F.lit(options.blocked_repos)).alias("ok")).first()
    if not row.ok:
        say(f"Error: push blocked for remote {remote}")
        return 1
    result: Result = run_scan(spark, ScanOptions([repository], exit_mode="critical"))
    return exit_code(result.counts[0], len(result.findings), "critical")
