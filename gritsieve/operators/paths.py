"""Target paths: exclusion and grouping.

Input rows have path and root; root is null for a path named by itself, else the argument under
which a walk found it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_targets(targets: DataFrame) -> DataFrame:
    """One row a path, by its raw text: path and the distinct roots it was found under."""
    return targets.groupBy("path").agg(F.sort_array(F.collect_set("root")).alias("roots"))


def in_git_folder(path: Column) -> Column:
    """Whether any component is .git."""
    return F.array_contains(F.split(path, "/"), ".git")


def _base_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def _relative(path: Column, root: Column) -> Column:
    """The path below a root, component by component; null if it isn't below."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.ltrim(F.substr(path, F.length(base) + 1), F.lit("/"))).when(root.isin(".", ""), path)


def excluded(path: Column, roots: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches the path, its last component, or the path below one of its roots."""
    if not patterns:
        return F.lit(False)
    any_of = lambda text: reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])
    below = F.exists(roots, lambda root: F.coalesce(any_of(_relative(path, root)), F.lit(False)))
    return any_of(path) | any_of(_base_name(path)) | below


def split_targets(targets: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct targets to read, and excluded ones, which are never read."""
    flagged = distinct_targets(targets).withColumn("out", in_git_folder(F.col("path")) | excluded(F.col("path"), F.col("roots"), patterns))
    return flagged.where(~F.col("out")).drop("out"), flagged.where("out").drop("out")
