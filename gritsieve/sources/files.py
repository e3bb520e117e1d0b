"""Reading whole files: path and content (bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import readable

#: Bytes of content in one batch, unless a file is larger.
BATCH_BYTES = 1 << 25


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    for batch in batches:
        paths: list[str] = []
        contents: list[bytes] = []
        size = 0
        for path in batch.column(0).to_pylist():
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except OSError:
                continue
            paths.append(path)
            contents.append(content)
            size += len(content)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=schema)
                paths, contents, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)


def read_files(targets: DataFrame, per_task: int = 64) -> DataFrame:
    """(path, content) of a frame of paths that executors can open; what can't be read is left out.

    Spark's file sources would lose hidden and empty files and fail on missing ones.
    """
    paths = targets.select("path")
    tasks = max(1, min(10_000, -(-paths.count() // per_task)))
    return paths.repartition(tasks, F.xxhash64("path")).mapInArrow(_read, "path string, content binary")


def texts(files: DataFrame) -> DataFrame:
    """(path, content) of the files that are text: no zero byte, valid UTF-8; a byte order mark stays."""
    return files.where(readable(F.col("content"))).select("path", F.col("content").cast("string").alias("content"))


#: Bytes of a table for each core, up to which it may be dealt out.
SPREAD_BYTES = 1 << 26


def spread(table: DataFrame) -> DataFrame:
    """Deals the rows of a small table in fewer files than cores over all cores.

    Spark can't cut a row group, so that such a table would be the work of a few tasks. A larger one stays as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size <= cores * SPREAD_BYTES and len(table.inputFiles()) < cores else table


def column_texts(df: DataFrame, path, content: str) -> DataFrame:
    """(path, content) of a table's text column."""
    return df.select(path.cast("string").alias("path"), F.col(content).alias("content")).where("content is not null")
