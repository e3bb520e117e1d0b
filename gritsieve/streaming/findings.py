"""Findings of a stream of texts. Detectors look at one text at a time, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching
from ..sources.config import Detector


def stream_findings(texts: DataFrame, detectors: list[Detector]) -> DataFrame:
    """Findings of a streaming (path, content) frame, with their ordering columns."""
    return matching.find(texts, detectors)


def write_stream(findings: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Appends findings to a table as texts arrive."""
    return findings.select(*matching.COLUMNS).writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint).start(path)
