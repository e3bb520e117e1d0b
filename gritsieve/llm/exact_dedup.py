"""Exact deduplication by two passes over a partitioned Bloom filter.

Pass 1 puts each text's digest into Bloom filters, one set per task (of SET_ROWS rows, if it has
more), and merges them shard by shard into the filter of bits that were set twice. Pass 2 probes that filter: a digest that is
surely unique passes straight through, and only possible repeats are shuffled and settled
exactly. False positives cost a shuffled row of some 50 bytes, never a wrong result; a repeat is
never missed, since all bits of a repeated digest are set at least twice.

Size: the filter takes BITS_PER_ROW bits a row up to max_bits (128 MB), which bounds what is
broadcast at every input size. Past that bound more unique digests take the exact path.

Cases: a null text counts as empty. Rows of equal text and equal id count as separate rows of
the group, of which one stays. Rows with a null id stay only if their whole group has no id. An
empty table gives an empty result. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_by_key, map_arrow, materialize, text_or_empty

BITS_PER_ROW = 16
PROBES = 4
SHARD_BITS = 1 << 23
MAX_BITS = 1 << 30
#: Rows whose hashes a task holds before it sends a set.
SET_ROWS = 1 << 21


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with each run of white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE, " "), 256))


class Geometry:
    """Where a 64-bit hash goes: a shard, and PROBES bits in it."""

    def __init__(self, rows: int, max_bits: int = MAX_BITS):
        bits = 1 << max(16, min(max(1, rows) * BITS_PER_ROW - 1, max_bits - 1).bit_length())
        self.shard_bits = min(bits, SHARD_BITS)
        self.shards = bits // self.shard_bits

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        step = ((h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        probes = np.arange(PROBES, dtype=np.uint64)
        bits = (h[:, None] + step[:, None] * probes) >> np.uint64(8)
        return ((h >> np.uint64(40)) % np.uint64(self.shards)).astype(np.int64), bits % np.uint64(self.shard_bits)


def _pack(positions: np.ndarray, bits: int) -> bytes:
    """Sparse sets as 32-bit positions, dense ones as a bitmap; never larger than the bitmap."""
    if len(positions) * 32 < bits:
        return b"s" + positions.astype("<u4").tobytes()
    flags = np.zeros(bits, np.uint8)
    flags[positions] = 1
    return b"d" + np.packbits(flags).tobytes()


def _unpack(blob: bytes, bits: int) -> np.ndarray:
    if blob[:1] == b"s":
        return np.frombuffer(blob, "<u4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=1), count=bits))


def task_sets(hashes: DataFrame, geometry: Geometry) -> DataFrame:
    """shard, seen, again: for each task and shard the bits that rows of column h set, and those set twice."""
    bits = geometry.shard_bits

    def sets(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        shard, places = geometry.place(values.view(np.uint64))
        rows: dict[str, list] = {"shard": [], "seen": [], "again": []}
        order = np.argsort(shard, kind="stable")
        for s, part in zip(*_runs(shard[order], order)):
            own, times = np.unique(np.concatenate([places[part].ravel(), places[part[counts[part] > 1]].ravel()]), return_counts=True)
            rows["shard"].append(int(s))
            rows["seen"].append(_pack(own, bits))
            rows["again"].append(_pack(own[times > 1], bits))
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("shard", pa.int32()), ("seen", pa.binary()), ("again", pa.binary())]))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= SET_ROWS:
                yield sets(held)
                held = []
        if held:
            yield sets(held)

    return map_arrow(hashes.select("h"), local, "shard int, seen binary, again binary")


def build_repeat_filter(hashes: DataFrame, geometry: Geometry) -> list[tuple[int, bytes]]:
    """Pass 1: (shard, bitmap) of the bits that the rows of column h set at least twice."""
    bits = geometry.shard_bits

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(bits, np.uint8)
        for batch in batches:
            for seen, again in zip(batch.column("seen").to_pylist(), batch.column("again").to_pylist()):
                at = _unpack(seen, bits)
                times[at] = np.minimum(times[at] + 1, 2)
                times[_unpack(again, bits)] = 2
        packed = zlib.compress(np.packbits(times == 2).tobytes(), 1)
        yield pa.RecordBatch.from_pydict({"shard": [key[0].as_py()], "bitmap": [packed]}, schema=pa.schema([("shard", pa.int32()), ("bitmap", pa.binary())]))

    parts = task_sets(hashes, geometry)
    # At most max_bits / 8 bytes in all, whatever the input.
    return [(r.shard, bytes(r.bitmap)) for r in parts.groupBy("shard").applyInArrow(merge, "shard int, bitmap binary").collect()]


def _runs(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(keys):
        return keys, []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.split(order, starts[1:])


def may_repeat(df: DataFrame, hash_column: Column, bitmaps: list[tuple[int, bytes]], geometry: Geometry) -> Column:
    """Pass 2: whether all bits of a hash were set twice. False is certain."""
    shared = df.sparkSession.sparkContext.broadcast(bitmaps)

    @F.arrow_udf("boolean")
    def probe(hashes: pa.Array) -> pa.Array:
        filters = _opened(shared)
        values = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        shard, places = geometry.place(values)
        out = np.zeros(len(values), bool)
        order = np.argsort(shard, kind="stable")
        for s, part in zip(*_runs(shard[order], order)):
            if int(s) in filters:
                bitmap, at = filters[int(s)], places[part]
                out[part] = ((bitmap[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)
        return pa.array(out)

    return probe(hash_column)


_OPEN: dict[int, dict[int, np.ndarray]] = {}


def _opened(shared) -> dict[int, np.ndarray]:
    """The broadcast filter, unpacked once for each Python worker."""
    key = id(shared.value)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = {s: np.frombuffer(zlib.decompress(b), np.uint8) for s, b in shared.value}
    return _OPEN[key]


def dedup_report(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest (32 bytes)."""
    keyed = materialize(docs.select("doc_id", text_digest(text_or_empty()).alias("digest")).withColumn("h", F.xxhash64("digest")))
    geometry = Geometry(keyed.count(), max_bits)
    flagged = keyed.withColumn("maybe", may_repeat(keyed, F.col("h"), build_repeat_filter(keyed, geometry), geometry)).drop("h")
    unique = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    # Equal rows are counted before anything else, then each group's rows before they meet.
    rows = materialize(flagged.where("maybe").groupBy("digest", "doc_id").agg(F.count("*").alias("n")))
    groups = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("rows")))
    settled = join_by_key(rows, groups, "digest", "rows", rows.count()).select(
        "doc_id", "keep_id", "group_size", "digest", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return unique.unionByName(settled.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest"))


def dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, whole: of equal texts the one with the smallest id (ties by a hash of all columns; then rows are as good as equal).

    Only possible repeats are shuffled, and of those each task sends one row a text.
    """
    tag = "__digest"
    while tag in docs.columns:
        tag += "_"
    columns = docs.columns
    hashed = docs.select(F.xxhash64(text_digest(text_or_empty())).alias("h"))
    geometry = Geometry(hashed.count(), max_bits)
    bitmaps = build_repeat_filter(hashed, geometry)
    keyed = docs.withColumn(tag, text_digest(text_or_empty()))
    maybe = may_repeat(docs, F.xxhash64(tag), bitmaps, geometry)
    unique = keyed.where(~maybe).select(columns)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*hashed))
    first = keyed.where(maybe).groupBy(tag).agg(F.min_by(row, order).alias("row"))
    return unique.unionByName(first.select("row.*"))

