"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: The white space that every contract here means: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Maps A-Z alone to lower case, in UTF-8 bytes.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all machines share: spark.checkpoint.dir.

    Where the session names none, a temporary one is set if it runs in one process; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_finished(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that nothing refers to any more; it acts on the driver's garbage collection.

    Twice, since what the first one frees holds other objects until it is itself collected.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


#: Bytes of rows in one Arrow batch, and so much of what a Python worker holds.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 23


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded by bytes, since some texts are very long; memory is handed back after each task.

    Lowers the session's limit for Arrow batches if it is higher.
    """
    spark = df.sparkSession
    if int(re.sub(r"\D", "", spark.conf.get(BATCH_CONF)) or 1 << 62) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        hand_back()

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies a function to the rows of each key. Groups are read off sorted batches, which suits many small ones; a group must fit a worker."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from function(pa.Table.from_batches(held)).select(names).to_batches()

        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            start = 0
            for i, key in enumerate(rows):
                if key != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield from done()
                    held, start, last = [], i, key
            if len(rows) > start:
                held.append(batch.slice(start))
        yield from done()

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def hand_back() -> None:
    """Returns free memory to the system, where it can be; a worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of a table for each core, up to which it may be dealt out.
SPREAD_BYTES = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. One in fewer files than cores is dealt over all cores if it is small, since Spark can't cut a row group; rows are the same."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return read.repartition(cores) if size <= cores * SPREAD_BYTES and len(read.inputFiles()) < cores else read


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_az(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_remainder(id_column: str, folds: int) -> Column:
    """crc32 of the id as text modulo folds; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(folds)), F.lit(0)).cast("int")


def id_field(df: DataFrame, column: str = "doc_id") -> str:
    """The id column's type as a DDL fragment, for schemas of Arrow functions."""
    return f"{column} {df.schema[column].dataType.simpleString()}"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, in UTF-8; bytes.split() parts at exactly the six characters of SPACE."""
    return (text or "").encode().translate(LOWER_AZ).split()




#: No fewer rows than this make a key hot, and no more keys than the other are hot.
HOT_ROWS = 200
HOT_KEYS = 20_000


def join_by_key(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with values, which has one row a key and in column size how many of the total rows have that key.

    A key of more than HOT_ROWS rows and a HOT_KEYS-th of all rows is hot. There are at most HOT_KEYS
    such keys, which bounds what is broadcast; their rows stay where they are. No other key has
    rows enough to weigh on its task.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(values.where(F.col(size) > least))
    cold = values.where(F.col(size) <= least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share; it is deleted when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def portions(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices whose sizes come to at most so much, or of one item."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows before each in a total order, by ranges; rows come sorted.

    Order should tell most rows apart, since equal ones share a range. What meets in one task is
    a row for each range.
    """
    part, at, total, before = "__part", "__at", "__total", "__before"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
    ranged = materialize(ranged)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(part).agg(F.sum(value).alias(total))
    offsets = sums.select(part, F.coalesce(F.sum(total).over(earlier(Window.orderBy(part))), F.lit(0)).alias(before))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(part).orderBy(at))), F.lit(0))
    done = ranged.join(offsets, part).withColumn(name, F.col(before) + inside)
    return done.sortWithinPartitions(at).drop(part, at, before)
