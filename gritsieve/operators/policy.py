"""Whether pushes to remotes are allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _listed(remote: Column, items: Column) -> Column:
    """Whether a non-empty item of a comma-separated list is part of the remote; items aren't trimmed."""
    return F.exists(F.split(items, ","), lambda item: (item != "") & F.contains(remote, item))


def push_allowed(remote: Column, allowed: Column, blocked: Column) -> Column:
    """No remote passes; a list of allowed ones that has none of it blocks; then a blocked one does."""
    remote, allowed, blocked = (F.coalesce(c, F.lit("")) for c in (remote, allowed, blocked))
    passes = ((allowed == "") | _listed(remote, allowed)) & ~((blocked != "") & _listed(remote, blocked))
    return (remote == "") | passes
