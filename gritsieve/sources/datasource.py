"""Files as a Spark data source.

    spark.dataSource.register(FilesSource)
    spark.read.format("gritsieve_files").option("paths", json.dumps([...])).option("exclude", "*.log").load()

Rows are path and content (bytes) of the files below the paths, each once, without those that
an exclude pattern or a .git folder rules out, which are never opened, and without those that
can't be read. Spark's own file sources would lose hidden and empty files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import globs, listing

PER_TASK = 64


def kept(targets: list[tuple[str, str | None]], exclude: str | None) -> list[str]:
    """Paths to read, ascending."""
    patterns = [globs.python_regex(p) for p in globs.parse_excludes(exclude)]
    roots: dict[str, set[str]] = {}
    for path, root in targets:
        roots.setdefault(path, set()).update([root] if root is not None else [])
    return sorted(p for p, rs in roots.items() if ".git" not in p.split("/") and not _excluded(p, rs, patterns))


def _excluded(path: str, roots: set[str], patterns: list) -> bool:
    names = {path, PurePosixPath(path).name}
    for root in roots:
        try:
            names.add(str(PurePosixPath(path).relative_to(root)))
        except ValueError:
            continue
    return any(p.match(n) for p in patterns for n in names)


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options.get("paths", "[]"))
        self.exclude = options.get("exclude")

    def partitions(self) -> list[InputPartition]:
        found = kept(listing.targets(self.paths), self.exclude)
        return [Paths(found[i : i + PER_TASK]) for i in range(0, len(found), PER_TASK)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple[str, bytes]]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except OSError:
                continue
            yield path, content


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gritsieve_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)
