"""Paths to scan: named files, walked folders, staged files."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TARGET_SCHEMA = "path string, root string"


def walk(folder: str, root: str) -> list[tuple[str, str]]:
    """Files below a folder with the argument they belong to. Hidden ones count, folders named .git aren't entered, links are followed.

    A folder that is its own ancestor by links is entered once (elsewhere such a loop would not end).
    Unreadable folders and names that aren't UTF-8 are passed over.
    """
    found: list[tuple[str, str]] = []
    todo = [(folder, frozenset({os.path.realpath(folder)}))]
    while todo:
        at, above = todo.pop()
        try:
            entries = list(os.scandir(at))
        except OSError:
            continue
        for entry in entries:
            path = os.path.join(at, entry.name)
            try:
                path.encode("utf-8")
                if entry.is_file():
                    found.append((path, root))
                elif entry.is_dir() and entry.name != ".git" and (real := os.path.realpath(path)) not in above:
                    todo.append((path, above | {real}))
            except (OSError, UnicodeEncodeError):
                continue
    return found


def targets(arguments: Iterable[str]) -> list[tuple[str, str | None]]:
    """A file or a missing path stands for itself, a folder for the files below it."""
    found: list[tuple[str, str | None]] = []
    for argument in arguments:
        found += walk(argument, argument) if os.path.isdir(argument) else [(argument, None)]
    return found


def target_frame(spark: SparkSession, arguments: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(targets(arguments), TARGET_SCHEMA)


def staged_files(repository: str = ".") -> list[str]:
    """Working copies of the files staged in a git repository, as far as they are regular files."""
    listed = subprocess.run(["git", "-C", repository, "diff", "--cached", "--name-only", "-z"], capture_output=True, check=True).stdout
    paths = [os.path.join(repository, p) for p in listed.decode("utf-8", "surrogateescape").split("\0") if p]
    return [p for p in paths if os.path.isfile(p)]


def push_remote(repository: str = ".") -> str:
    """The URL that git pushes origin to, else origin's, else nothing."""
    for arguments in (["--push", "origin"], ["origin"]):
        done = subprocess.run(["git", "-C", repository, "remote", "get-url", *arguments], capture_output=True, text=True)
        if done.returncode == 0:
            return done.stdout.strip()
    return ""
