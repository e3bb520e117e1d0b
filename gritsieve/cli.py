"""Command line: scan paths, check and install hooks; exit 0, 1 for findings, 2 for an error."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators.summary import EXIT_MODES, exit_code
from .plans import hooks, install, report
from .plans.scan import ScanOptions, run_scan


def session() -> SparkSession:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark = SparkSession.builder.appName("gritsieve").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, spark.sparkContext.environment.get("PYTHONPATH")]))
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gritsieve", description="Scan files and folders for secrets")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("paths", nargs="+")
    scan.add_argument("-o", "--output")
    scan.add_argument("-v", "--verbose", action="store_true")
    scan.add_argument("--exclude")
    scan.add_argument("--exit-mode", choices=EXIT_MODES, default="strict")
    check = commands.add_parser("check", help="what a git hook checks")
    check.add_argument("hook_type", choices=(hooks.PRE_COMMIT, hooks.PRE_PUSH))
    check.add_argument("--allowed-repos")
    check.add_argument("--blocked-repos")
    check.add_argument("--exclude")
    hook = commands.add_parser("hook", help="git hooks").add_subparsers(dest="action", required=True)
    for action in ("install", "uninstall"):
        one = hook.add_parser(action)
        one.add_argument("hook_type", choices=(hooks.PRE_COMMIT, hooks.PRE_PUSH))
        one.add_argument("--global", dest="everywhere", action="store_true")
        if action == "install":
            one.add_argument("--allowed-repos")
            one.add_argument("--blocked-repos")
            one.add_argument("--exclude")
    commands.add_parser("init", help="aliases for a shell").add_argument("shell", choices=install.SHELLS)
    commands.add_parser("verify-integrity")
    return top


def without_spark(given: argparse.Namespace) -> bool:
    """Runs a command that needs no session; whether it was one."""
    if given.command == "hook" and given.action == "install":
        install.install(hooks.HookOptions(given.hook_type, given.allowed_repos, given.blocked_repos, given.exclude), given.everywhere)
    elif given.command == "hook":
        install.uninstall(given.hook_type, given.everywhere)
    elif given.command == "init":
        print(install.shell_aliases(given.shell), end="")
    elif given.command == "verify-integrity":
        install.verify(__file__)
    else:
        return False
    return True


def scan_command(spark: SparkSession, options: ScanOptions) -> int:
    result = run_scan(spark, options)
    text = report.report_json(result)
    print(text if options.verbose else report.summary_line(result))
    if options.output is not None:
        try:
            report.write_report(options.output, text)
        except OSError as e:
            raise RuntimeError(f"Failed to write report to '{options.output}': {e}") from e
    return exit_code(result.counts[0], len(result.findings), options.exit_mode)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    try:
        if without_spark(given):
            return 0
        if given.command == "check":
            options = hooks.HookOptions(given.hook_type, given.allowed_repos, given.blocked_repos, given.exclude)
            check = hooks.check_commit if given.hook_type == hooks.PRE_COMMIT else hooks.check_push
            return check(spark or session(), options)
        return scan_command(spark or session(), ScanOptions(given.paths, given.output, given.verbose, given.exclude, given.exit_mode))
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2
