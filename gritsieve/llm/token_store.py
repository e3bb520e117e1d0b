"""A content-addressed store of token ids.

A rolling hash over the last WINDOW ids cuts each document's id stream into chunks, so that equal
passages give equal chunks wherever they stand. A chunk is named by a digest of its ids; each
distinct chunk is written once. A document's recipe lists its chunks, and the root of a Merkle
tree over their digests is its manifest.

Layout of a store, all Parquet:
  chunks/   digest (16 bytes), n, ids (little-endian, WIDTHS bytes to an id as the vocabulary needs)
  recipes/  doc_id, start, n_tokens, chunks (the digests on end), lengths, root; files in
            ascending doc_id order, rows without an id last

start counts the ids of all documents before a row in that order; since every document has an
end id, start names a row. Documents of equal id and text are rows of their own, in either order.

Cases: a null text counts as empty and has the end id alone. A null id is allowed. An empty table
gives an empty store. Equal digests are taken for equal chunks (128 bits); a reader rehashes each
chunk and rebuilds each root, and fails if either differs.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_field, join_by_key, map_arrow, materialize, portions, running_sum

WINDOW = 16
MEAN_CHUNK = 256
LEAST_CHUNK = 32
MOST_CHUNK = 2048
DIGEST = 16
MEMO = 1 << 21
LONG_CHUNK = 64
#: Bytes of text worked on at once.
BATCH_BYTES = 1 << 23
#: Bytes of text whose chunks are looked up at once.
GROUP_BYTES = 1 << 24
_MULTIPLIER = 0xD1342543DE82EF95
_MASK64 = (1 << 64) - 1


# -- cutting and trees ---------------------------------------------------------------------


def rolling_hashes(ids: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """A polynomial hash modulo 2**64 of the WINDOW ids that end at each place, or of those since its document's start."""
    n = len(ids)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    powers, inverse = _powers(n)
    mixed *= inverse
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    first = np.maximum(np.arange(1, n + 1) - WINDOW, 0)
    if starts is not None:
        first = np.maximum(first, np.repeat(starts, np.diff(starts, append=n)))
    rolled = (total[1:] - total[first]) * powers
    return (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for the places below n."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        back = pow(_MULTIPLIER, -1, 1 << 64)
        made = []
        for base in (_MULTIPLIER, back):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS = (made[0], made[1])
    return _POWERS[0][:n], _POWERS[1][:n]


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: after a place whose rolling hash is low, LEAST_CHUNK to MOST_CHUNK ids apart."""
    return cut_all(ids, np.array([len(ids)]))[0]


def cut_all(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """The same for documents that stand one after another, in places of the whole."""
    starts = np.concatenate([[0], ends[:-1]])
    low = np.flatnonzero(rolling_hashes(ids, starts) < np.uint64(_MASK64 // (MEAN_CHUNK - LEAST_CHUNK))) + 1
    bounds = np.searchsorted(low, [starts, ends], side="right").T.tolist()
    low, out = low.tolist(), []
    for start, end, (a, b) in zip(starts.tolist(), ends.tolist(), bounds):
        own: list[int] = []
        for p in low[a:b]:
            while p - start > MOST_CHUNK:
                start += MOST_CHUNK
                own.append(start)
            if p - start >= LEAST_CHUNK:
                own.append(p)
                start = p
        while end - start > MOST_CHUNK:
            start += MOST_CHUNK
            own.append(start)
        if start < end:
            own.append(end)
        out.append(own)
    return out


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST, person=b"chunk").digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd node at the end moves up as it is."""
    level = leaves
    while len(level) > 1:
        pairs = [hashlib.blake2b(a + b, digest_size=DIGEST, person=b"node").digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0] if level else b""


# -- checksums of documents from those of chunks -------------------------------------------

_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of CRC-32, in its reflected form."""
    a, b = np.broadcast_arrays(a, b)
    out, b = np.zeros(a.shape, np.uint64), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ _POLY, b >> np.uint64(1))
    return out


def shifted_crc(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """What the CRC-32 of a part adds to that of the whole, if so many bytes follow the part. The whole's is the XOR of its parts'."""
    out, step = crc.astype(np.uint64), np.array([0x00800000], np.uint64)  # x**8
    rest = following.astype(np.uint64)
    while rest.any():
        odd = np.flatnonzero(rest & np.uint64(1))
        own, shifted = out[odd], np.zeros(len(odd), np.uint64)
        for byte in (0, 8, 16, 24):  # a product is the XOR of those of its bytes, which are looked up
            products = _times(step, np.arange(256, dtype=np.uint64) << np.uint64(byte))
            shifted ^= products[(own >> np.uint64(byte)) & np.uint64(255)]
        out[odd] = shifted
        step, rest = _times(step, step), rest >> np.uint64(1)
    return out.astype(np.int64)


# -- encoding ------------------------------------------------------------------------------


#: Letters with white space before them are one piece of the vocabulary's splitting pattern, a run
#: of ASCII marks after them another (an apostrophe may start one of its own). Below U+0250 letters have settled classes, and
#: all but one (U+0130) stay one letter in lower case.
_PLAIN = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130") + "]+([!-&(-/:-@[-`{-~]*)")


class Encoder:
    """Ids by the tokenizers library, worked out once for each distinct white-space-delimited chunk.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its
    chunks on end. Plain chunks are handed to the library many at a time, in one text with spaces
    between; the ids that end a piece tell them apart again. The memo saves time only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.ends_piece = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_piece[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, self.kind)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, by the library."""
        out = [b""] * len(chunks)
        plain, counts, others = [], [], []
        for i, c in enumerate(chunks):
            if m := _PLAIN.fullmatch(c):
                plain.append(i)
                counts.append(2 if m[1] else 1)
            elif c:
                others.append(i)
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([chunks[i] for i in part])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends_piece[ids]) + 1
            pieces = np.cumsum(counts[at : at + 1024])
            if len(ends) != pieces[-1]:  # not as the pattern says; never with the vocabularies known here
                others += part
                continue
            raw, cuts, width = ids.tobytes(), ends[pieces - 1].tolist(), ids.itemsize
            for i, a, b in zip(part, [0, *cuts], cuts):
                out[i] = raw[a * width : b * width]
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)):
                out[i] = np.array(e.ids, self.kind).tobytes()
        return out

    def _ids_of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids on end, and each chunk's start and length among them; what is new is remembered."""
        if len(self.known) > MEMO:
            self._forget()
        at = pc.index_in(distinct, value_set=self.known)
        new = pc.is_null(at)
        found = at.fill_null(0).to_numpy()
        is_new = new.to_numpy(zero_copy_only=False)
        missing = distinct.filter(new)
        values = self._look_up(missing.to_pylist())
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(values), self.kind)])
        own = np.array([len(v) for v in values], np.int64) // flat.itemsize
        own_starts = len(self.flat) + np.cumsum(own) - own
        starts, lengths = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        starts[is_new], lengths[is_new] = own_starts, own
        starts[~is_new], lengths[~is_new] = self.starts[found[~is_new]], self.lengths[found[~is_new]]
        short = pc.less_equal(pc.binary_length(missing), LONG_CHUNK)
        held = short.to_numpy(zero_copy_only=False)
        kept = np.frombuffer(b"".join([v for v, h in zip(values, held.tolist()) if h]), self.kind)
        self.known = pa.concat_arrays([self.known, missing.filter(short)])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(own[held]) - own[held]])
        self.lengths = np.concatenate([self.lengths, own[held]])
        self.flat = np.concatenate([self.flat, kept])
        return flat, starts, lengths

    def encode_many(self, batches: list[pa.Array], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each batch of texts, their ids with the end id after each, one after another; and where each ends. Chunks are looked up once for all."""
        splits = [pc.ascii_split_whitespace(texts.fill_null("")) for texts in batches]
        flats = [s.flatten() for s in splits]
        coded = pa.concat_arrays(flats).dictionary_encode()
        flat, starts, lengths = self._ids_of(coded.dictionary)
        codes = np.split(coded.indices.to_numpy(), np.cumsum([len(f) for f in flats])[:-1])
        del flats, coded
        for split, order in zip(splits, codes):
            n = lengths[order]
            past = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
            at = np.repeat(starts[order] - past[:-1], n)
            at += np.arange(len(at))
            words = split.offsets.to_numpy()
            ends = past[words[1:] - words[0]]
            yield np.insert(flat[at], ends, end), ends + np.arange(1, len(ends) + 1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- writing -------------------------------------------------------------------------------

_PIECES = "doc_id, n_tokens long, chunks binary, lengths array<int>, root binary, digest binary, n int, ids binary"


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encodes each row's text, adds end_id and writes a store to folder.

    The texts are read once. Chunks and recipes go through one shuffle, keyed by the chunk's
    digest or the document, in which equal chunks of a task travel once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for group in _grouped(batches):
            for batch, (ids, ends) in zip(group, own.encode_many([b.column(1) for b in group], end_id)):
                yield _pieces(batch.column(0), ids, ends, schema)

    kind = docs.schema["doc_id"].dataType
    ddl = _PIECES.replace("doc_id", id_field(docs), 1)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    pieces = map_arrow(docs.select("doc_id", "text"), run, ddl)
    first = [F.first(c).alias(c) for c in ("n_tokens", "lengths", "root", "n", "ids")]
    once = pieces.groupBy("digest", "doc_id", "chunks").agg(*first, F.count("*").alias("copies"))
    is_chunk = F.col("digest").isNotNull()
    spark = docs.sparkSession
    # Chunks are distinct and their ids look random: a dictionary would be in vain, and a slow codec gains little.
    kinds = once.withColumn("kind", F.when(is_chunk, "chunk").otherwise("recipe"))
    kinds.write.partitionBy("kind").option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(f"{folder}/pieces")
    raw = spark.read.schema(once.schema).parquet(f"{folder}/pieces/kind=recipe") if _has(spark, f"{folder}/pieces/kind=recipe") else spark.createDataFrame([], once.schema)
    listed = raw.select(F.col("doc_id").cast(kind), "n_tokens", "chunks", "lengths", "root", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("i")).drop("i")
    _with_starts(listed).write.option("compression", "zstd").parquet(f"{folder}/recipes")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches by GROUP_BYTES, none of more than BATCH_BYTES unless a single text is longer."""
    group: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in portions(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), BATCH_BYTES):
            group.append(batch.slice(part.start, part.stop - part.start))
            size += group[-1].nbytes
            if size >= GROUP_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _has(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _pieces(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of documents, then rows of the distinct chunks among them."""
    recipes, lengths, roots, chunks = [], [], [], {}
    starts, size, payload = np.concatenate([[0], ends[:-1]]).tolist(), ids.itemsize, ids.tobytes()
    for start, own in zip(starts, cut_all(ids, ends)):
        leaves = []
        for a, b in zip([start, *own], own):
            piece = payload[a * size : b * size]
            leaves.append(name := digest(piece))
            chunks[name] = piece
        recipes.append(b"".join(leaves))
        lengths.append([b - a for a, b in zip([start, *own], own)])
        roots.append(merkle_root(leaves))
    counts = np.diff(ends, prepend=0).tolist()
    m, k = len(recipes), len(chunks)
    columns = [
        pa.concat_arrays([doc_ids, pa.nulls(k, doc_ids.type)]),
        pa.array(counts + [None] * k, pa.int64()),
        pa.array(recipes + [None] * k, pa.binary()),
        pa.array(lengths + [None] * k, pa.list_(pa.int32())),
        pa.array(roots + [None] * k, pa.binary()),
        pa.array([None] * m + list(chunks), pa.binary()),
        pa.array([None] * m + [len(c) // size for c in chunks.values()], pa.int32()),
        pa.array([None] * m + list(chunks.values()), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_type(c.type) for f, c in zip(schema, columns)]))


def _with_starts(recipes: DataFrame) -> DataFrame:
    order = [F.col("doc_id").asc_nulls_last(), F.col("chunks")]
    return running_sum(recipes, order, "n_tokens", "start").select("doc_id", "start", "n_tokens", "chunks", "lengths", "root")


# -- reading -------------------------------------------------------------------------------


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pieces/kind=chunk").select("digest", "n", "ids")


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/recipes")


def _entries(recipes: DataFrame) -> DataFrame:
    """(start, following, digest) for each chunk of each document; fails where a recipe and its manifest differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, places, names, follow, counts = [], [], [], [], []
            for start, total, recipe, lengths, root in zip(*(batch.column(c).to_pylist() for c in ("start", "n_tokens", "chunks", "lengths", "root"))):
                leaves = [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)]
                if len(leaves) != len(lengths) or merkle_root(leaves) != root:
                    raise ValueError(f"the manifest of the document that starts at id {start} does not match its recipe")
                if sum(lengths) != total:
                    raise ValueError(f"the document that starts at id {start} has chunks of {sum(lengths)} tokens, but its recipe tells {total}")
                starts += [start] * len(leaves)
                places += range(len(leaves))
                names += leaves
                counts += lengths
                follow += (sum(lengths) - np.cumsum(lengths)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(places, pa.int32()), pa.array(follow, pa.int64()), pa.array(counts, pa.int32()), pa.array(names, pa.binary())], names=["start", "place", "following", "want", "digest"])

    return map_arrow(recipes.select("start", "n_tokens", "chunks", "lengths", "root"), run, "start long, place int, following long, want int, digest binary")


def checked_chunks(chunks: DataFrame) -> DataFrame:
    """(digest, n, crc): each chunk rehashed, with the CRC-32 of its ids as 32-bit integers; fails where the digest differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            names, counts, payloads = (c.to_pylist() for c in batch.columns)
            for name, payload in zip(names, payloads):
                if digest(payload) != name:
                    raise ValueError(f"chunk {name.hex()} does not match its digest")
            if names:
                ends = np.cumsum(counts)
                kind = f"<u{sum(map(len, payloads)) // int(ends[-1])}"
                wide = memoryview(np.frombuffer(b"".join(payloads), kind).astype("<u4").tobytes())
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["digest", "n", "crc"])

    return map_arrow(chunks.select("digest", "n", "ids"), run, "digest binary, n int, crc long")


def _resolved(entries: DataFrame, values: DataFrame) -> DataFrame:
    """Entries with their chunk's columns; a chunk in many documents doesn't meet them in one task."""
    uses = entries.groupBy("digest").agg(F.count("*").alias("uses"))
    known = materialize(uses.join(values, "digest", "left"))
    return join_by_key(entries, known, "digest", "uses", entries.count())


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, from the files.

    A document's CRC-32 is put together from those of its chunks, so that no ids are shuffled.
    """
    recipes = read_recipes(spark, folder)
    entries = materialize(_entries(recipes))
    found = _resolved(entries, checked_chunks(read_chunks(spark, folder)))

    @F.arrow_udf("long")
    def part(crc: pa.Array, following: pa.Array) -> pa.Array:
        return pa.array(shifted_crc(crc.to_numpy(zero_copy_only=False), following.to_numpy(zero_copy_only=False) * 4))

    checked = found.select("start", F.when(F.col("n") == F.col("want"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or of another length"))).cast("long").alias("crc"), "following")
    sums = checked.withColumn("part", part("crc", "following")).groupBy("start").agg(F.expr("bit_xor(part)").alias("ids_crc32"))
    return recipes.select("doc_id", "start", "n_tokens").join(sums, "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers), from the files."""
    recipes = read_recipes(spark, folder)
    found = _resolved(materialize(_entries(recipes)), read_chunks(spark, folder))
    whole = found.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("place", "ids", "n"))).alias("parts"))

    @F.arrow_udf("binary")
    def widen(parts: pa.Array) -> pa.Array:
        return pa.array([b"".join(np.frombuffer(p["ids"], f"<u{len(p['ids']) // p['n']}").astype("<u4").tobytes() for p in ps) for ps in parts.to_pylist()], pa.binary())

    joined = whole.select("start", widen("parts").alias("ids"))
    return recipes.select("doc_id", "start", "n_tokens").join(joined, "start").select("doc_id", "start", "n_tokens", "ids")
